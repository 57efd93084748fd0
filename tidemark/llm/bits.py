"""Bit tables of bounded size, built by executors: a set of 64-bit numbers for
which "not in it" is certain and "in it" may be wrong."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, mix

#: Log2 of the bits: bounds that hold for any input (128 KB to 128 MB).
LEAST, MOST, _BLOCKS = 20, 30, 64


def size_for(n: int) -> int:
    """Bits for n numbers: about 16 for each, within the bounds."""
    return int(min(MOST, max(LEAST, np.ceil(np.log2(max(1, 16 * n))))))


def place(numbers: np.ndarray, log2: int) -> np.ndarray:
    return (mix(numbers.astype(np.uint64)) >> U64(64 - log2)).astype(np.int64)


def build(numbers: DataFrame, column: str, log2: int) -> np.ndarray:
    """The table of all numbers in a long column: 2**log2 bits as packed bytes.
    Numbers are dealt to the blocks of the table; each block is filled by one task,
    and only the table reaches the driver."""
    size = (1 << log2) // _BLOCKS

    def where(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            at = np.unique(place(batch.column(0).to_numpy(zero_copy_only=False), log2))
            yield pa.RecordBatch.from_arrays([pa.array(at // size, pa.int32()), pa.array(at % size, pa.int32())], names=["block", "at"])

    def fill(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in it:
            block, at = (batch.column(i).to_numpy() for i in (0, 1))
            for b in np.unique(block).tolist():
                held.setdefault(b, np.zeros(size, dtype=bool))[at[block == b]] = True
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([np.packbits(x).tobytes() for x in held.values()], pa.binary())], names=["block", "bits"])

    n = _BLOCKS // 4
    filled = numbers.select(column).mapInArrow(where, "block int, at int").repartitionById(n, F.col("block") % n).mapInArrow(fill, "block int, bits binary")
    out = np.zeros((_BLOCKS, size // 8), dtype=np.uint8)
    for r in filled.collect():
        out[r["block"]] = np.frombuffer(r["bits"], dtype=np.uint8)
    return out.ravel()


def holds(table: np.ndarray, numbers: np.ndarray, log2: int) -> np.ndarray:
    at = place(numbers, log2)
    return (table[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
