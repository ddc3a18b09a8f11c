"""Readers and writers: transcripts, side documents, logs, catalogs."""
