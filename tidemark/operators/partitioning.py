"""Routing of keys to sub-partitions and of times to segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.time import positive, segment_start


def subpartition_factor(desired: int, partitions: int) -> int:
    """Sub-partitions of each partition: as few as reach ``desired``; 1 for -1."""
    return 1 if desired == -1 else max(1, -(-desired // positive("partitions", partitions)))


def subpartition(partition: Column, hashed: Column, factor: int) -> Column:
    """Number of a key's sub-partition: its partition's block, and within it the
    key's hash (31-fold, sign bit cleared) modulo the block's size."""
    return partition * F.lit(factor) + F.pmod((F.lit(31) * hashed.cast("long")).bitwiseAND(F.lit(0x7FFFFFFF)), F.lit(factor))


def all_subpartitions(partition: int, factor: int) -> list[int]:
    return [partition * factor + k for k in range(factor)]


def with_segment(df: DataFrame, ms: str, interval: int, name: str = "segment") -> DataFrame:
    """A column to write a table partitioned by, so that reads by time prune."""
    return df.withColumn(name, segment_start(F.col(ms), interval))


def active_segments(observed: Column, retention: int, interval: int) -> Column:
    """Array of the segments' starts that retention still covers; empty while no
    time was observed (negative)."""
    low = segment_start(observed - F.lit(retention) + F.lit(1), interval)
    return F.when(observed < 0, F.array().cast("array<bigint>")).otherwise(F.sequence(low, segment_start(observed, interval), F.lit(interval).cast("long")))


def segment_range(low: int, high: int, interval: int, descending: bool = False) -> list[int]:
    """Starts of the segments that a range of times touches."""
    out = [k * interval for k in range(max(0, low) // interval, max(0, high) // interval + 1)]
    return out[::-1] if descending else out


def segment_roll(before: Column, after: Column, retention: int, interval: int) -> tuple[Column, Column]:
    """(expired, created): what advancing stream time removes and adds."""
    old, new = active_segments(before, retention, interval), active_segments(after, retention, interval)
    return F.array_except(old, new), F.array_except(new, old)


#: The segment of a table's own records, apart from those of its rows.
METADATA_SEGMENT = -1


def session_segment(end: Column, interval: int, metadata: Column | None = None) -> Column:
    """Segment of a session, by its end; rows that ``metadata`` marks go to
    ``METADATA_SEGMENT``."""
    at = segment_start(end, interval)
    return at if metadata is None else F.when(metadata, F.lit(METADATA_SEGMENT).cast("long")).otherwise(at)
