"""Joins of streams and tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.time import positive
from .stateful import ordered_fold

#: Largest estimated size of a side that is broadcast.
BROADCAST_BYTES = 64 * 2**20


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of a plan's size."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def broadcast_checked(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """A broadcast hint where the estimate allows it; else the plain frame, which
    Spark joins by shuffling both sides."""
    return F.broadcast(df) if estimated_bytes(df) <= limit else df


def asof_join(stream: DataFrame, table: DataFrame, keys: list[str], seq: str, value: list[str], how: str = "inner", ms: str | None = None, ttl: Column | None = None, clock: str = "stream_time", deleted: str | None = None) -> DataFrame:
    """Each stream row with the table's newest version as of its arrival.

    ``table`` holds versions: keys, ``seq`` in the stream's numbering, the columns
    ``value``, and with ``ttl`` their time ``ms``; a version with the same seq comes
    first. Both are united and the last version is carried forward within a key: a
    sort, not a range join. A tombstone (``deleted``) or a version past its time to
    live (``ttl``: a Column over the version's columns) is no match.
    """
    if how not in ("inner", "left"):
        raise ValueError("how must be inner or left")
    held = [*value, *([ms] if ttl is not None else []), *([deleted] if deleted else [])]
    if ttl is not None:
        table = table.withColumn("__ttl", ttl)
        held.append("__ttl")
    version = F.struct(*(F.col(c).alias(f"v{i}") for i, c in enumerate(held)))
    rows = stream.select(*keys, F.col(seq).alias("__seq"), F.lit(1).alias("__side"), F.struct(*stream.columns).alias("__row"))
    versions = table.select(*keys, F.col(seq).alias("__seq"), F.lit(0).alias("__side"), version.alias("__version"))
    both = rows.unionByName(versions, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("__seq", "__side").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("__v", F.last("__version", ignorenulls=True).over(w)).where("__side = 1")
    at = {c: F.col(f"__v.v{i}") for i, c in enumerate(held)}
    good = F.col("__v").isNotNull()
    if deleted:
        good = good & ~F.coalesce(at[deleted], F.lit(False))
    if ttl is not None:
        good = good & (at[ms] >= F.col(f"__row.{clock}") - at["__ttl"])
    if how == "inner":
        found = found.where(good)
    return found.select("__row.*", *(F.when(good, at[c]).alias(c) for c in value))


def global_join(stream: DataFrame, table: DataFrame, on: Column | list[str], how: str = "inner") -> DataFrame:
    """With a table that every task sees whole, as long as its size allows."""
    return stream.join(broadcast_checked(table), on, how)


def foreign_key_join(left: DataFrame, right: DataFrame, foreign: str, primary: str, how: str = "inner") -> DataFrame:
    """Left rows with the right row that they refer to. Both sides are tables, one
    row a key (:func:`tables.latest_by_key` of a feed); recomputed from these, the
    result shows changes of either side, and :func:`table_changes` tells which."""
    return left.join(right, left[foreign] == right[primary], how)


def table_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """What changed between two states of a table: rows taken back (change "-") and
    rows put there ("+"), equal rows counted singly. One aggregate, no join."""
    columns = after.columns
    both = before.select(*columns).withColumn("__n", F.lit(-1)).unionByName(after.withColumn("__n", F.lit(1)))
    net = both.groupBy(*columns).agg(F.sum("__n").alias("__n")).where("__n != 0")
    return net.select(*columns, F.when(F.col("__n") > 0, "+").otherwise("-").alias("change"), F.explode(F.sequence(F.lit(1), F.abs("__n").cast("int"))).alias("__k")).drop("__k")


def interval_join(left: DataFrame, right: DataFrame, keys: list[str], left_ms: str, right_ms: str, before: int, after: int | None = None) -> DataFrame:
    """Pairs of a key with left - before <= right <= left + after. Time is cut into
    cells of the interval's length and the left side visits the cells it reaches
    (three at most): the join is by key and cell, so a hot key is spread over time.
    """
    after = before if after is None else after
    cell = positive("interval", max(1, before + after))
    reach = F.sequence(F.floor((F.col(left_ms) - before) / cell), F.floor((F.col(left_ms) + after) / cell))
    a = left.withColumn("__cell", F.explode(reach))
    b = right.withColumn("__cell", F.floor(F.col(right_ms) / cell))
    met = a.join(b, [*keys, "__cell"])
    return met.where(F.col(right_ms).between(F.col(left_ms) - before, F.col(left_ms) + after)).drop("__cell")


def state_scan(df: DataFrame, group: list[str], seq: str, key: str, value: str, low=None, high=None, name: str = "seen") -> DataFrame:
    """Each row with the newest earlier values of its group's keys from ``low`` to
    ``high``, joined in order of key, and its own value last. One pass over each
    group; what it holds is the newest value of each key in the range, kept in order,
    not the rows. A null value takes its key out; a null key is in no range."""
    from bisect import bisect_left

    from pyspark.sql import types as T

    src = df.select(*df.columns, F.col(key).alias("__k"), F.col(value).cast("string").alias("__v"))
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.StringType())])

    def step(state, row):
        keys, values = state or ([], [])
        k, v = row[-2], row[-1]
        said = "".join(values) + (v or "")
        if k is not None and (low is None or k >= low) and (high is None or k <= high):
            at = bisect_left(keys, k)
            known = at < len(keys) and keys[at] == k
            if known and v is not None:
                values[at] = v
            elif known:
                del keys[at], values[at]
            elif v is not None:
                keys.insert(at, k)
                values.insert(at, v)
        return (keys, values), ((*row[:-2], said),)

    return ordered_fold(src, group, [seq], step, schema)
