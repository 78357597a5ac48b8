"""Gaugewell: workload-trace analytics as lazy PySpark DataFrame plans."""
