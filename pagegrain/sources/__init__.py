"""Readers and writers for documents, layout results, indexes and logs."""
