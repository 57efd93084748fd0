"""Time to live: visibility of stored rows, lookups and deduplication with expiry."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.time import positive
from .stateful import keyed_runs, longs

INFINITE = 2**62


@dataclass(frozen=True)
class TimeToLive:
    """A default (milliseconds; None: for ever), and at most one kind of override:
    a Column of keys, of values, or of both that gives milliseconds, ``INFINITE``,
    or null where the default holds."""

    default: int | None = None
    from_key: Column | None = None
    from_value: Column | None = None
    from_both: Column | None = None

    def __post_init__(self):
        if self.default is not None:
            positive("default", self.default)
        if sum(x is not None for x in (self.from_key, self.from_value, self.from_both)) > 1:
            raise ValueError("only one kind of override may be given")

    def column(self) -> Column:
        """Milliseconds that a row lives."""
        own = next((x for x in (self.from_key, self.from_value, self.from_both) if x is not None), None)
        default = F.lit(INFINITE if self.default is None else self.default).cast("long")
        return default if own is None else F.coalesce(own.cast("long"), default)


def visible(row_ms: Column, now_ms: Column, ttl: Column) -> Column:
    """A row of age equal to its time to live is still visible."""
    return row_ms >= now_ms - ttl


def expire(table: DataFrame, ms: str, now: int | Column, ttl: TimeToLive) -> DataFrame:
    """What of a table is visible at stream time ``now``. With a constant time to
    live the filter is one comparison with the time column, which reaches the scan."""
    if isinstance(now, int) and all(x is None for x in (ttl.from_key, ttl.from_value, ttl.from_both)):
        return table if ttl.default is None else table.where(F.col(ms) >= F.lit(now - ttl.default))
    return table.where(visible(F.col(ms), F.lit(now) if isinstance(now, int) else now, ttl.column()))


def dedup_with_ttl(df: DataFrame, keys: list[str], ttl: TimeToLive, seq: str = "seq", ms: str = "ms", clock: str = "stream_time") -> DataFrame:
    """Rows that are forwarded: a key's row is dropped while the row last forwarded
    for it is visible at stream time. In order of ``seq`` within a key; a key's
    rows stream through, so memory doesn't grow with them.

    Stream time never falls, so the row forwarded next after any row is found by
    binary search, for all rows of an Arrow batch at once; what is left is to follow
    these links from one forwarded row to the next. A clock that falls counts by its
    largest value so far; a row without a time has the clock's, one without a clock
    comes before all times."""
    src = df.withColumn("__ttl", F.least(ttl.column(), F.lit(INFINITE)))
    at = {c: i for i, c in enumerate(src.columns)}
    i_ms, i_clock, i_ttl, width = at[ms], at[clock], at["__ttl"], len(df.columns)
    arrow = to_arrow_schema(df.schema)

    def work(b, bounds, state):
        """``state``: (when the row last forwarded expires, the clock's last value)."""
        n, run = b.num_rows, np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        now = np.array(longs(b.column(i_clock), -INFINITE))
        if state is not None:
            np.maximum(now[: bounds[1]], state[1], out=now[: bounds[1]])
        expires = np.where(pc.is_null(b.column(i_ms)).to_numpy(zero_copy_only=False), now, longs(b.column(i_ms))) + longs(b.column(i_ttl), INFINITE)
        times = np.unique(now)
        place = np.maximum.accumulate(run * (len(times) + 1) + np.searchsorted(times, now))
        due = np.searchsorted(place, run * (len(times) + 1) + np.searchsorted(times, expires, side="right"))
        due = np.maximum(due, np.arange(1, n + 1)).tolist()
        row, forwarded = 0, []
        if state is not None:
            row = int(np.searchsorted(place[: bounds[1]], np.searchsorted(times, state[0], side="right")))
        while row < n:
            forwarded.append(row)
            row = due[row]
        last = forwarded[-1] if forwarded else -1
        left = int(expires[last]) if last >= bounds[-2] else state[0]
        out = b.take(pa.array(forwarded, pa.int64()))
        return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(out.columns[:width], arrow)], schema=arrow), (left, int(times[place[-1] - run[-1] * (len(times) + 1)]))

    return keyed_runs(src, keys, [seq], work, df.schema)
