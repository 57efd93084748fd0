"""Per-key state in arrival order: running aggregates, folds and ordered maps."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from itertools import chain, islice
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def ordered_fold(df: DataFrame, keys: list[str], order: list[str], step: Callable[[Any, tuple], tuple[Any, Any]], schema: T.StructType, finish: Callable[[Any], Any] | None = None, start: Any = None) -> DataFrame:
    """A left fold over each key's rows in order.

    ``step(state, row)`` gives the next state and the rows to put out; ``finish``
    puts out what is left at a key's end. Rows are hash-dealt by key, sorted on
    disk where need be, and streamed: state is one key's, whatever the number of
    its rows. This is the form for folds that no built-in aggregate expresses.
    """
    at = [df.columns.index(k) for k in keys]
    arrow = to_arrow_schema(schema)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, last, out = start, None, []

        def batch(rows):
            cols = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)

        for b in it:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                key = tuple([None if row[i] != row[i] else row[i] for i in at])  # one NaN isn't another
                if key != last:
                    if last is not None and finish is not None:
                        out.extend(finish(state))
                    state, last = start, key
                state, more = step(state, row)
                out.extend(more)
            if len(out) >= 5000:
                yield batch(out)
                out = []
        if last is not None and finish is not None:
            out.extend(finish(state))
        if out:
            yield batch(out)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def _key_starts(batch: pa.RecordBatch, at: list[int]) -> np.ndarray:
    """Rows where a key begins, row 0 too, and the number of rows. One NaN is as
    another, one null too."""
    n = batch.num_rows
    new = np.zeros(n, dtype=bool)
    new[0] = True
    for i in at:
        c = batch.column(i)
        if pa.types.is_nested(c.type):
            held = c.to_pylist()
            new[1:] |= np.fromiter((x != y for x, y in zip(held, held[1:])), dtype=bool, count=n - 1)
            continue
        x, y = c.slice(0, n - 1), c.slice(1)
        differ = pc.fill_null(pc.not_equal(x, y), False)
        if pa.types.is_floating(c.type):
            differ = pc.and_not(differ, pc.fill_null(pc.and_(pc.is_nan(x), pc.is_nan(y)), False))
        new[1:] |= pc.or_(differ, pc.xor(pc.is_null(x), pc.is_null(y))).to_numpy(zero_copy_only=False)
    return np.append(np.flatnonzero(new), n)


def _key_of(batch: pa.RecordBatch, at: list[int], row: int) -> tuple:
    held = [batch.column(i)[row].as_py() for i in at]
    return tuple([None if x is None else "NaN" if x != x else x for x in held])


def keyed_runs(df: DataFrame, keys: list[str], order: list[str], work: Callable[[pa.RecordBatch, np.ndarray, Any], tuple[pa.RecordBatch | None, Any]], schema: T.StructType, finish: Callable[[Any], pa.RecordBatch | None] | None = None) -> DataFrame:
    """A left fold by whole column slices, for folds that can leap over rows.

    Rows are dealt and sorted as by :func:`ordered_fold`. ``work(batch, bounds,
    state)`` gets an Arrow batch, the rows where its keys begin (and its length, last),
    and the state of the key of its first rows, None where that key is new; it gives
    what to put out and the state of the batch's last key. Where another key comes, or
    none, ``finish(state)`` closes a key that the end of a batch left open; keys that
    end within a batch are closed by ``work``.
    """
    at = [df.columns.index(k) for k in keys]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, last = None, None
        for b in it:
            if not b.num_rows:
                continue
            bounds = _key_starts(b, at)
            if last is not None and _key_of(b, at, 0) != last:
                if finish is not None and (out := finish(state)) is not None:
                    yield out
                state = None
            out, state = work(b, bounds, state)
            last = _key_of(b, at, b.num_rows - 1)
            if out is not None and out.num_rows:
                yield out
        if last is not None and finish is not None and (out := finish(state)) is not None:
            yield out

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def longs(column: pa.Array, null: int = 0) -> np.ndarray:
    return pc.fill_null(column.cast(pa.int64()), null).to_numpy(zero_copy_only=False)


def running(df: DataFrame, keys: list[str], seq: str, **aggregates: Column) -> DataFrame:
    """An update for every row: aggregates over a key's rows up to it."""
    w = Window.partitionBy(*keys).orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({n: a.over(w) for n, a in aggregates.items()})


def concat_in_order(df: DataFrame, keys: list[str], seq: str, value: str, name: str = "value", separator: str = "") -> DataFrame:
    """A key's values joined by arrival."""
    held = F.array_sort(F.collect_list(F.struct(F.col(seq).alias("s"), F.col(value).cast("string").alias("v"))))
    return df.groupBy(*keys).agg(F.array_join(F.transform(held, lambda x: x["v"]), separator).alias(name))


#: Stands for a missing time.
_NO_TIME = -(2**63)


def _first_past(values: np.ndarray, start: int, stop: int, limit: int) -> int:
    """The first place in start..stop with a value above ``limit``, else ``stop``;
    looked for in slices of doubling length."""
    step = 64
    while start < stop:
        hit = values[start : min(start + step, stop)] > limit
        if hit.any():
            return start + int(hit.argmax())
        start, step = start + step, step * 2
    return stop


def _pieces(ms: np.ndarray, size: np.ndarray, bounds: np.ndarray, state: tuple | None, max_count: int, max_size: int, max_age: int | None) -> Iterator[tuple]:
    """(key's run, first row, row after the last, number, first time, rows, total,
    closed) of the pieces of batches in a slice of sorted rows. A piece that is not
    closed ends its run; ``state`` is (number, first time, rows, total) of the batch
    that the first run goes on with."""
    total = np.cumsum(size)
    for run, (i, end) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
        number, first, count, held = state if run == 0 and state is not None else (0, _NO_TIME, 0, 0)
        while i < end:
            base = (int(total[i - 1]) if i else 0) - held
            stop = _first_past(total, i, min(end, i + max_count - count), base + max_size)
            closed = stop < end
            if first == _NO_TIME:
                known = _first_past(ms, i, min(stop + 1, end), _NO_TIME)
                first = int(ms[known]) if known < min(stop + 1, end) else _NO_TIME
            if max_age is not None and first != _NO_TIME:
                old = _first_past(ms, i, min(stop + 1, end), first + max_age)
                if old < min(stop + 1, end):
                    stop, closed = old, True
            after = stop + 1 if closed else end
            count, held = count + after - i, int(total[after - 1]) - base
            yield run, i, after, number, first, count, held, closed
            if closed:
                number, first, count, held = number + 1, _NO_TIME, 0, 0
            i = after


def _batch_source(df: DataFrame, keys: list[str], seq: str, ms: str, size: Column, *more: Column) -> DataFrame:
    return df.select(*keys, seq, F.col(ms).cast("long").alias("__ms"), size.cast("long").alias("__size"), *more)


def key_batches(df: DataFrame, keys: list[str], seq: str, ms: str, size: Column, max_count: int = 50, max_size: int = 1000, max_age: int | None = None) -> DataFrame:
    """Batches of a key's rows: one closes with the row that makes it hold more
    than ``max_count`` rows or more than ``max_size`` in all, or, where ``max_age``
    is given, with the row that comes more than that after its first. Returns key,
    batch (from 0), first_ms, rows and total; the last, open batch has open = true.
    A null size counts as 0, a null time never closes a batch.
    """
    src = _batch_source(df, keys, seq, ms, size)
    n = len(keys)
    schema = T.StructType([*src.schema.fields[:n], *(T.StructField(c, T.LongType()) for c in ("batch", "first_ms", "rows", "total")), T.StructField("open", T.BooleanType())])
    arrow = to_arrow_schema(schema)

    def rows_of(b, at, found, is_open):
        said = [pa.array([None if f == _NO_TIME else f for f in c] if k == 1 else c, pa.int64()) for k, c in enumerate(zip(*found, strict=True))]
        return pa.RecordBatch.from_arrays([*(b.column(i).take(pa.array(at)).cast(arrow.field(i).type) for i in range(n)), *said, pa.array(is_open)], schema=arrow)

    def work(b, bounds, state):
        at, found, is_open, left = [], [], [], None
        for run, _, after, *piece, closed in _pieces(longs(b.column(n + 1), _NO_TIME), longs(b.column(n + 2)), bounds, state and state[0], max_count, max_size, max_age):
            if not closed and run == len(bounds) - 2:
                left = (tuple(piece), b.slice(after - 1, 1))
            else:
                at.append(after - 1)
                found.append(piece)
                is_open.append(not closed)
            number = piece[0] + 1
        if left is None:
            left = ((number, _NO_TIME, 0, 0), None)
        return rows_of(b, at, found, is_open) if at else None, left

    def finish(state):
        return rows_of(state[1], [0], [state[0]], [True]) if state[0][2] else None

    return keyed_runs(src, keys, [seq], work, schema, finish)


def batch_rows(df: DataFrame, keys: list[str], seq: str, ms: str, size: Column, item: str, max_count: int = 50, max_size: int = 1000, max_age: int | None = None) -> DataFrame:
    """The batches of :func:`key_batches` with what they hold: key, batch, first_ms,
    total, and ``items``, the array of ``item`` in order."""
    src = _batch_source(df, keys, seq, ms, size, F.col(item).alias("item"))
    n = len(keys)
    schema = T.StructType([*src.schema.fields, T.StructField("batch", T.LongType())])
    arrow = to_arrow_schema(schema)

    def work(b, bounds, state):
        number, left = np.zeros(b.num_rows, dtype=np.int64), None
        for _, start, after, *piece, closed in _pieces(longs(b.column(n + 1), _NO_TIME), longs(b.column(n + 2)), bounds, state, max_count, max_size, max_age):
            number[start:after] = piece[0]
            left = (piece[0] + 1, _NO_TIME, 0, 0) if closed else tuple(piece)
        return pa.RecordBatch.from_arrays([*(c.cast(f.type) for c, f in zip(b.columns, arrow)), pa.array(number)], schema=arrow), left

    rows = keyed_runs(src, keys, [seq], work, schema)
    held = F.transform(F.array_sort(F.collect_list(F.struct(F.col(seq).alias("s"), F.col("item").alias("v")))), lambda x: x["v"])
    return rows.groupBy(*keys, "batch").agg(F.min_by("__ms", seq).alias("first_ms"), F.sum("__size").alias("total"), held.alias("items"))


def checksum_chain(df: DataFrame, keys: list[str], seq: str, values: list[str]) -> DataFrame:
    """key, links, checksum: SHA-256 chained over a key's rows; for each of the
    row's values in turn, h becomes sha256(h || value as eight bytes, big end first).
    The bytes are laid out by column; only the chain itself goes link by link. A
    null counts as 0."""
    n = len(keys)
    src = df.select(*keys, F.col(seq).alias("__seq"), *(F.col(v).cast("long").alias(f"__v{i}") for i, v in enumerate(values)))
    schema = T.StructType([*src.schema.fields[:n], T.StructField("links", T.LongType()), T.StructField("checksum", T.StringType())])
    arrow = to_arrow_schema(schema)

    def rows_of(b, at, links, said):
        return pa.RecordBatch.from_arrays([*(b.column(i).take(pa.array(at)).cast(arrow.field(i).type) for i in range(n)), pa.array(links, pa.int64()), pa.array(said, pa.string())], schema=arrow)

    def work(b, bounds, state):
        data = np.stack([longs(c) for c in b.columns[n + 1 :]], axis=1).astype(">i8").tobytes()
        width, sha, done = 8 * len(values), hashlib.sha256, []
        for start, stop in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            h, links = state[:2] if state is not None else (b"", 0)
            for at in range(start * width, stop * width, 8):
                h = sha(h + data[at : at + 8]).digest()
            state = None
            done.append((stop - 1, links + stop - start, h))
        at, links, h = done.pop()
        out = rows_of(b, [d[0] for d in done], [d[1] for d in done], [d[2].hex() for d in done]) if done else None
        return out, (h, links, b.slice(at, 1))

    return keyed_runs(src, keys, ["__seq"], work, schema, lambda s: rows_of(s[2], [0], [s[1]], [s[0].hex()]))


def origin_event_count(df: DataFrame, partition: str, offset: str, committed: Column, derived: Column) -> DataFrame:
    """Events below the committed offset that don't derive from others."""
    counted = F.count_if((F.col(offset) < committed) & ~F.coalesce(derived, F.lit(False)))
    return df.groupBy(partition).agg(counted.alias("origin_events"))


def async_map(df: DataFrame, keys: list[str], order: list[str], function: Callable[[dict], list[dict]], schema: T.StructType, threads: int = 5, queued: int = 25, retries: int = 3) -> DataFrame:
    """Applies a blocking function to every row with ``threads`` calls in flight.

    Rows of a key run one after the other and come out in order; different keys
    overlap. A call that fails is tried again, and fails the task in the end.
    ``function`` takes a row as a dict and returns rows as dicts.
    """
    names = df.columns
    at = [names.index(k) for k in keys]
    arrow = to_arrow_schema(schema)

    def call(rows: list[tuple]) -> list[dict]:
        out = []
        for row in rows:
            for attempt in range(retries + 1):
                try:
                    out.extend(function(dict(zip(names, row, strict=True))))
                    break
                except Exception:
                    if attempt == retries:
                        raise
        return out

    def groups(it: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        """A key's rows within a batch: the unit that must run in order."""
        for b in it:
            held: list[tuple] = []
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held and tuple(held[0][i] for i in at) != tuple(row[i] for i in at):
                    yield held
                    held = []
                held.append(row)
            if held:
                yield held
            yield []  # a key may go on in the next batch: everything ends first

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with ThreadPoolExecutor(threads) as pool:
            work = groups(it)
            while True:
                first = next(work, None)
                if first is None:
                    return
                wave = [g for g in chain([first], islice(iter(lambda: next(work, []), []), queued - 1)) if g]
                rows = [r for f in [pool.submit(call, g) for g in wave] for r in f.result()]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in rows], f.type) for f in arrow], schema=arrow)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
