"""Keyed-state and event-time analytics on plain PySpark DataFrames."""
