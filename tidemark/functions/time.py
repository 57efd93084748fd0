"""Event time as 64-bit milliseconds, and arithmetic on it.

All results are Columns of built-in functions; nothing here leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_LONG = 2**63 - 1


def millis(df: DataFrame, column: str = "ts") -> Column:
    """Milliseconds since the epoch of a timestamp, zoned or not, or of a long
    that already is; microseconds are truncated."""
    kind = dict(df.dtypes)[column]
    c = F.col(column)
    if kind in ("bigint", "int"):
        return c.cast("long")
    if kind == "timestamp_ntz":
        return F.expr(f"timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', `{column}`)")
    return F.unix_millis(c)


def positive(name: str, value: int) -> int:
    if not isinstance(value, int) or value <= 0:
        raise ValueError(f"{name} must be a positive number of milliseconds")
    return value


def tumbling_start(ms: Column, size: int) -> Column:
    return ms - F.pmod(ms, F.lit(positive("size", size)))


def window_end(start: Column, size: int) -> Column:
    """start + size, held at the largest long where that overflows."""
    return F.when(start > F.lit(MAX_LONG - size), F.lit(MAX_LONG)).otherwise(start + F.lit(size))


def hopping_starts(ms: Column, size: int, advance: int) -> Column:
    """Array of the starts (none negative) of the windows that hold ``ms``."""
    if not 0 < advance <= size:
        raise ValueError("advance must be positive and at most size")
    last = tumbling_start(ms, advance)
    first = F.greatest(F.lit(0).cast("long"), last - F.lit((size - 1) // advance * advance))
    every = F.sequence(first, F.greatest(first, last), F.lit(advance).cast("long"))
    return F.filter(every, lambda s: (s + F.lit(size) > ms) & (s <= ms))


def stream_time(df: DataFrame, seq: str, ms: str, name: str = "stream_time", bucket: int = 65_536) -> DataFrame:
    """``df`` and the largest event time so far, by arrival (``seq``, a long).

    A running maximum over the whole table would sort it in one task. Here the
    table is cut into ranges of ``seq``; their maxima (one row a range) are
    accumulated within ranges of ranges, and only the maxima of these in one task:
    one row for each ``bucket`` squared of ``seq``, also where ``seq`` is sparse, as
    times are. Each range then adds its own running maximum.
    """
    kept = df.withColumn("__range", F.col(seq) - F.pmod(F.col(seq), F.lit(bucket)))
    tops = kept.groupBy("__range").agg(F.max(ms).alias("__top"))
    tops = tops.withColumn("__wide", F.col("__range") - F.pmod(F.col("__range"), F.lit(bucket * bucket)))
    wide = tops.groupBy("__wide").agg(F.max("__top").alias("__most"))
    far = wide.select("__wide", F.max("__most").over(Window.orderBy("__wide").rowsBetween(Window.unboundedPreceding, -1)).alias("__far"))
    before = Window.partitionBy("__wide").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    near = tops.select("__wide", "__range", F.max("__top").over(before).alias("__near"))
    carried = near.join(far, "__wide").select("__range", F.greatest("__near", "__far").alias("__before"))
    own = Window.partitionBy("__range").orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    joined = kept.join(carried, "__range")
    return joined.withColumn(name, F.greatest(F.max(ms).over(own), F.col("__before"))).drop("__range", "__before")


def segment_interval(retention: int, segments: int) -> int:
    """Length of a segment: retention / segments, at least 1."""
    return max(1, positive("retention", retention) // max(1, segments))


def segment_start(ms: Column, interval: int) -> Column:
    """Start of the segment of an event time; times before 0 belong to the first."""
    at = F.greatest(F.lit(0).cast("long"), ms)
    return at - F.pmod(at, F.lit(positive("interval", interval)))
