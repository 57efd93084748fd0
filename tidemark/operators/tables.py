"""Key-value tables over a change feed: the newest version of each key.

A feed is a DataFrame with key columns, an arrival order ``seq`` that is unique
within a key, and any other columns. A null value (``value``), or a row that the
``deleted`` predicate marks, is a tombstone. The newest version is found by an
aggregate, which combines before the shuffle: keys with very many versions cost
no more than others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ranges import Bound, KeyRange


def _pick(df: DataFrame, keys: list[str], seq: str, newest: bool) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    best = (F.max_by if newest else F.min_by)(F.struct(*rest), F.col(seq))
    return df.groupBy(*keys).agg(best.alias("__row")).select(*keys, "__row.*").select(*df.columns)


def latest_by_key(df: DataFrame, keys: list[str], seq: str = "seq", value: str | None = None, deleted: Column | None = None) -> DataFrame:
    """Table source: one row a key, its newest, unless that is a tombstone."""
    gone = F.col(value).isNull() if deleted is None and value else deleted
    if gone is None:
        return _pick(df, keys, seq, True)
    return _pick(df.withColumn("__gone", F.coalesce(gone, F.lit(False))), keys, seq, True).where(~F.col("__gone")).drop("__gone")


def first_by_key(df: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """put-if-absent, fact tables, deduplication without expiry: a key's first row."""
    return _pick(df, keys, seq, False)


def get(table: DataFrame, key: str, wanted) -> DataFrame:
    """Point lookup; a list looks up several keys."""
    return table.where(F.col(key).isin(list(wanted)) if isinstance(wanted, (list, tuple, set)) else F.col(key) == F.lit(wanted))


def range_scan(table: DataFrame, key: str, low=None, high=None, upper_inclusive: bool = True, descending: bool = False) -> DataFrame:
    """Keys in order from ``low`` to ``high``; an end left out is open."""
    inside = KeyRange(Bound(low), Bound(high, upper_inclusive)).contains(F.col(key))
    return table.where(inside).orderBy(F.desc(key) if descending else F.asc(key))


def prefix_scan(table: DataFrame, key: str, prefix, descending: bool = False) -> DataFrame:
    return table.where(KeyRange.prefix(F.col(key), prefix)).orderBy(F.desc(key) if descending else F.asc(key))


def all_entries(table: DataFrame, key: str, descending: bool = False) -> DataFrame:
    return table.orderBy(F.desc(key) if descending else F.asc(key))


def put_all(feed: DataFrame, rows: DataFrame) -> DataFrame:
    """A feed with more writes; their ``seq`` must be larger."""
    return feed.unionByName(rows)


def delete(feed: DataFrame, rows: DataFrame, value: str) -> DataFrame:
    """A feed with tombstones for ``rows`` (keys and seq)."""
    return feed.unionByName(rows.withColumn(value, F.lit(None).cast(feed.schema[value].dataType)), allowMissingColumns=True)


def entry_count(table: DataFrame, keys: list[str], approximate: bool = False) -> DataFrame:
    return table.agg(F.approx_count_distinct(F.struct(*keys)) if approximate else F.count(F.lit(1))).toDF("entries")


def overlay_merge(stored: DataFrame, written: DataFrame, keys: list[str], deleted: str, duplicates: bool = False) -> DataFrame:
    """A stored table under newer writes: a write wins over the stored row with
    its key, a tombstone hides it, and one without a stored row does nothing. With
    ``duplicates`` a write stands beside the stored rows of its key."""
    columns = [c for c in written.columns if c != deleted]
    if duplicates:
        gone = written.where(F.col(deleted)).select(*keys)
        return stored.join(gone, keys, "left_anti").select(*columns).unionByName(written.where(~F.col(deleted)).select(*columns))
    rest = stored.join(written.select(*keys), keys, "left_anti").select(*columns)
    return rest.unionByName(written.where(~F.col(deleted)).select(*columns))


def flush_retained(batch: DataFrame, ms: str, now: Column, ttl: int, value: str) -> DataFrame:
    """What of a batch of writes goes to the store: rows past their time to live
    don't, tombstones always do."""
    return batch.where(F.col(value).isNull() | (F.col(ms) >= now - F.lit(ttl)))


def migrate_changelog(feed: DataFrame, keys: list[str], ms: str, now: int | Column, ttl: int | None, seq: str = "seq", value: str | None = None) -> DataFrame:
    """Bulk load of a changelog: rows too old to be visible are skipped before the
    newest version of each key is taken, tombstones included."""
    fresh = feed if ttl is None else feed.where(F.col(ms) >= (F.lit(now) if isinstance(now, int) else now) - F.lit(ttl))
    return latest_by_key(fresh, keys, seq, value)
