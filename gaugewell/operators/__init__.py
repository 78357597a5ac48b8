"""Operators of the trace analytics."""
