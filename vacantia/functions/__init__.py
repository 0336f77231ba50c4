"""Column -> Column functions (no Python in the row path)."""
