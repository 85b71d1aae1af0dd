"""Readers and writers for documents, labelled sets, summaries and request logs."""
