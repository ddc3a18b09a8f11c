"""Structured Streaming twins of the monitoring operators."""
