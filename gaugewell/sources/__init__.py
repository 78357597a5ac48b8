"""Sources of the trace analytics."""
