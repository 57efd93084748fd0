"""Event-time windows: assignment, late data, and reads of windowed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.time import hopping_starts, positive, tumbling_start, window_end


def assign_windows(df: DataFrame, ms: str, size: int, advance: int | None = None) -> DataFrame:
    """``df`` with window_start and window_end (milliseconds); with ``advance`` a
    row for each window that holds the event."""
    if advance is None or advance == size:
        out = df.withColumn("window_start", tumbling_start(F.col(ms), positive("size", size)))
    else:
        out = df.withColumn("window_start", F.explode(hopping_starts(F.col(ms), size, advance)))
    return out.withColumn("window_end", window_end(F.col("window_start"), size))


def drop_late(df: DataFrame, grace: int, clock: str = "stream_time") -> DataFrame:
    """Rows of windows that are still open: end + grace later than stream time."""
    return df.where(F.col("window_end") + F.lit(grace) > F.col(clock))


def windowed(df: DataFrame, keys: list[str], ms: str, size: int, advance: int | None = None, grace: int | None = None, clock: str = "stream_time", **aggregates: Column) -> DataFrame:
    """Aggregates by key and window; late rows are dropped where ``grace`` is given."""
    rows = assign_windows(df, ms, size, advance)
    if grace is not None:
        rows = drop_late(rows, grace, clock)
    return rows.groupBy(*keys, "window_start", "window_end").agg(*(a.alias(n) for n, a in aggregates.items()))


def default_segments(retention: int, size: int) -> int:
    """Segments of a window table: one a window where there are more than ten of
    them, up to a hundred; else ten."""
    if positive("size", size) > positive("retention", retention):
        raise ValueError("retention must not be shorter than a window")
    return min(100, retention // size) if size < retention / 10 else 10


def with_segments(retention: int, size: int, wanted: int | None = None) -> int:
    """Segments as asked for: at most one a millisecond of retention; fewer than two
    are not possible, the default stays then."""
    default = default_segments(retention, size)
    return default if wanted is None or wanted < 2 else min(wanted, retention)


def retained(table: DataFrame, observed: Column | int, retention: int, at: str = "window_start") -> DataFrame:
    """Windows (or sessions, by their end) that retention still covers."""
    return table.where(F.col(at) >= (F.lit(observed) if isinstance(observed, int) else observed) - F.lit(positive("retention", retention)) + F.lit(1))


def fetch(table: DataFrame, key: str, wanted, start: int) -> DataFrame:
    return table.where((F.col(key) == F.lit(wanted)) & (F.col("window_start") == F.lit(start)))


def fetch_range(table: DataFrame, time_from: int, time_to: int, key: str | None = None, key_from=None, key_to=None, descending: bool = False) -> DataFrame:
    """Windows that start from ``time_from`` to ``time_to``, both included, of one
    key (``key_from`` alone), a range of keys, or all; by key and start."""
    out = table.where(F.col("window_start").between(time_from, time_to))
    if key is not None and key_from is not None:
        out = out.where(F.col(key).between(key_from, key_from if key_to is None else key_to))
    by = [*([key] if key else []), "window_start"]
    return out.orderBy(*(F.desc(c) if descending else F.asc(c) for c in by))


def put(table: DataFrame, writes: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Upserts of (key, window_start, value); a null value deletes the window."""
    slots = [*keys, "window_start"]
    kept = table.join(writes.select(*slots), slots, "left_anti")
    return kept.unionByName(writes.where(F.col(value).isNotNull()).select(*table.columns))


def retain_duplicates(df: DataFrame, keys: list[str], ms: str, seq: str, value: str) -> DataFrame:
    """(key, time) with the array of all values put there, by arrival; nulls put
    nothing. ``explode`` of the array gives the rows back."""
    held = F.array_sort(F.collect_list(F.struct(F.col(seq).alias("s"), F.col(value).alias("v"))))
    return df.where(F.col(value).isNotNull()).groupBy(*keys, ms).agg(F.transform(held, lambda x: x["v"]).alias("values"))
