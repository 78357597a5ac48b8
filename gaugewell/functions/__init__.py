"""Functions of the trace analytics."""
