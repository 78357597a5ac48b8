"""Streaming of the trace analytics."""
