"""DataFrame operators: filters, joins, aggregates, ranking, state changes."""
