"""Operator 7: packing documents into sequences by the sum-of-squares rule.

Documents are tokenised, closed by an end id and cut into pieces of ``capacity``
ids only where longer. Full pieces are sequences of their own. What is left, at
most one shorter piece a document, is dealt by a hash of its row to shards
of about ``SHARD`` pieces (equal rows too fall into different ones); each shard packs its pieces longest first, and puts
each where the sum over residual gaps of the squared number of open bins that
gap becomes smallest; a bin is opened only where none has room, as pieces come
longest first (with opening among the choices the same pieces needed 0.4 % more
sequences than the lower bound; so they meet it). A shard keeps counts by gap and sizes alone, so its memory is
bounded, and it leaves only its few last bins part empty.

Null and empty texts hold the end id only. Long texts are cut into as many pieces
as they need. Rows whose id is null or repeated, equal rows too, are packed like any
other, each by itself; ties between gaps go to the fuller bin. No row is dropped; an
empty table gives an empty result. Only the id and the text are read, and the
result has its own columns, so clashing names of others do no harm.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import drops_space, shared_memo
from .common import cut, parts, ship

#: Pieces that one shard packs, about.
SHARD = 4096


def sum_of_squares(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin number and offset of each size (each 1 to ``capacity``), in order."""
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    count = np.zeros(capacity + 1, dtype=np.int64)  # open bins by gap; gap 0 isn't open
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    total, never = 0, np.iinfo(np.int64).max
    for i, s in enumerate(sizes.tolist()):
        here = count[s:capacity]
        gap = capacity
        if len(here):
            change = np.where(here > 0, 2 * (count[: capacity - s] - here) + 2, never)
            if here[0] > 0:
                change[0] = 1 - 2 * here[0]
            k = int(change.argmin())
            if change[k] < never:
                gap = s + k
        if gap == capacity:
            b = total
            total += 1
        else:
            b = open_bins[gap].pop()
            count[gap] -= 1
        bins[i], offsets[i] = b, capacity - gap
        if gap - s:
            count[gap - s] += 1
            open_bins[gap - s].append(b)
    return bins, offsets


def pieces(docs: DataFrame, path: str, capacity: int, text: str, key: str, end_id: int) -> DataFrame:
    """One row for each piece, tokenised but not placed."""
    kind = docs.schema[key].dataType

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = shared_memo(path, False)
        t = memo.t
        whole = not drops_space(t)
        end = np.asarray([end_id], dtype="<u4").tobytes()
        for batch in it:
            texts = batch.column(1)
            out: list[tuple] = []
            for d, s in zip(batch.column(0).to_pylist(), texts, strict=True):
                s = s.as_py()
                ids = (np.asarray(t.encode(s or "", add_special_tokens=False).ids, dtype="<u4").tobytes() if whole else memo.ids(s or "")) + end
                for p, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    out.append((d, p, at // 4, len(part) // 4, zlib.crc32(part)))
            cols = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(cols, (batch.column(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=[key, "piece", "start", "length", "ids_crc32"])

    schema = T.StructType([T.StructField(key, kind), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())])
    return docs.select(key, text).mapInArrow(run, schema)


def pack(docs: DataFrame, path: str, capacity: int = 2048, text: str = "text", key: str = "doc_id", end_id: int = 0) -> DataFrame:
    """Columns ``key``, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    ship(spark)
    cutted = cut(pieces(docs, path, capacity, text, key, end_id))
    full = cutted.where(F.col("length") == capacity).withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    short = cutted.where(F.col("length") < capacity)
    n = max(1, -(-short.count() // SHARD))
    # the row's place in the table just written tells equal rows apart
    shard = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n)).cast("int")
    n_parts = min(n, 4 * parts(spark))

    def place(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Partitions hold whole shards, in order of shard."""

        def packed(table: pa.Table, number: int) -> pa.RecordBatch:
            length = table["length"].to_numpy()
            order = np.argsort(-length, kind="stable")
            bins, offsets = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            bins[order], offsets[order] = sum_of_squares(length[order], capacity)
            return table.drop_columns(["shard"]).append_column("sequence_id", pa.array(bins + (number << 32), pa.int64())).append_column("offset", pa.array(offsets, pa.int64())).combine_chunks().to_batches()[0]

        held, now = [], None
        for batch in it:
            number = batch.column("shard").to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), len(number)] if len(number) else []
            for a, b in zip(edges, edges[1:]):
                if now is not None and number[a] != now:
                    yield packed(pa.Table.from_batches(held), int(now))
                    held = []
                now = number[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield packed(pa.Table.from_batches(held), int(now))

    schema = T.StructType([*cutted.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    placed = short.withColumn("shard", shard).repartitionById(n_parts, F.col("shard") % n_parts).sortWithinPartitions("shard", "length", key, "piece", "ids_crc32").mapInArrow(place, schema)
    return full.unionByName(placed)
