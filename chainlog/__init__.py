"""Blockchain execution traces to object-centric event logs, on Spark."""
