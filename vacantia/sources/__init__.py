"""Readers and writers: company lists, vendor payloads, documents, tables."""
