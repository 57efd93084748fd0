"""Operators: plain functions from DataFrames to DataFrames."""

from . import joins, partitioning, sessions, specs, stateful, tables, ttl, windows

__all__ = ["joins", "partitioning", "sessions", "specs", "stateful", "tables", "ttl", "windows"]
