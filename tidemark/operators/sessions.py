"""Session windows: the built-in aggregate for ordered input, an exact fold for
late data, and reads of session tables."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.time import positive
from .stateful import ordered_fold


def session_aggregate(df: DataFrame, keys: list[str], ms: str, gap: int, **aggregates: Column) -> DataFrame:
    """Sessions of input in order: events at most ``gap`` apart are one. The end is
    the last event's time."""
    stamped = df.withColumn("__at", F.timestamp_millis(F.col(ms)))
    grouped = stamped.groupBy(*keys, F.session_window("__at", f"{positive('gap', gap)} milliseconds"))
    out = grouped.agg(F.min(ms).alias("session_start"), F.max(ms).alias("session_end"), *(a.alias(n) for n, a in aggregates.items()))
    return out.drop("session_window")


def session_fold(df: DataFrame, keys: list[str], seq: str, ms: str, value: str, gap: int, grace: int, start: Any, add: Callable[[Any, Any], Any], merge: Callable[[Any, Any], Any], result: T.DataType, clock: str = "stream_time", updates: bool = False) -> DataFrame:
    """Sessions in order of arrival, late events included, exactly.

    An event takes in the sessions within ``gap`` that are not past retention
    (gap + grace before stream time); it is dropped where the outcome would end
    before that. Returns the final sessions, or with ``updates`` every change:
    n numbers a key's changes, and a null value takes a session back.
    """
    retention, width = positive("gap", gap) + grace, len(keys)
    src = df.select(*keys, seq, F.col(ms).alias("__ms"), F.col(clock).alias("__clock"), F.col(value).alias("__value"))
    fields = [*src.schema.fields[:width], T.StructField("session_start", T.LongType()), T.StructField("session_end", T.LongType()), T.StructField("value", result)]
    schema = T.StructType(([T.StructField("n", T.LongType())] if updates else []) + fields)

    def step(state, row):
        key, at, now, v = row[:width], row[width + 1], row[width + 2], row[width + 3]
        n, sessions = (state[1], state[2]) if state else (0, [])
        out: list[tuple] = []
        valid = now - retention + 1
        live = [s for s in sessions if s[1] >= valid]
        if not updates:
            out.extend((*key, *s) for s in sessions if s[1] < valid)
        met = [s for s in live if s[1] >= at - gap and s[0] <= at + gap]
        low, high, total = at, at, start
        for s in met:
            low, high, total = min(low, s[0]), max(high, s[1]), merge(total, s[2])
        if high >= valid:
            total = add(total, v)
            live = sorted([s for s in live if s not in met] + [(low, high, total)])
            if updates:
                gone = met if (low, high) != (at, at) else []
                for s in [(*g[:2], None) for g in gone] + [(low, high, total)]:
                    out.append((n, *key, *s))
                    n += 1
        return (key, n, live), out

    return ordered_fold(src, keys, [seq], step, schema, None if updates else lambda s: [(*s[0], *x) for x in s[2]])


def find_sessions(table: DataFrame, earliest_end: int, latest_start: int, key: str | None = None, wanted=None, min_valid: int = 0) -> DataFrame:
    """Sessions that end at or after ``earliest_end`` and start at or before
    ``latest_start``; of one key, or of all."""
    out = table.where((F.col("session_end") >= max(0, earliest_end, min_valid)) & (F.col("session_start") <= latest_start))
    return out if key is None else out.where(F.col(key) == F.lit(wanted))


def fetch_session(table: DataFrame, key: str, wanted, start: int, end: int) -> DataFrame:
    return table.where((F.col(key) == F.lit(wanted)) & (F.col("session_start") == start) & (F.col("session_end") == end))


def fetch_keys(table: DataFrame, key: str, low, high=None) -> DataFrame:
    """All sessions of one key, or of the keys from ``low`` to ``high``."""
    return table.where(F.col(key).between(low, low if high is None else high))


def fetch_sessions(table: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """The sessions named by key, start and end."""
    at = [*keys, "session_start", "session_end"]
    return table.join(wanted.select(*at), at, "left_semi")


def fetch_by_end(table: DataFrame, end_from: int, end_to: int, key: str | None = None, wanted=None) -> DataFrame:
    """Sessions by the range of their ends, both included."""
    out = table.where(F.col("session_end").between(end_from, end_to))
    return out if key is None else out.where(F.col(key) == F.lit(wanted))


def remove_sessions(table: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    at = [*keys, "session_start", "session_end"]
    return table.join(gone.select(*at), at, "left_anti")
