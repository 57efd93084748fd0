"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

U64 = np.uint64
#: Bytes of all sampled texts together that a fit takes to the driver.
SAMPLE_BYTES = 64_000_000
#: Fixed seed of every random table below, so all executors build the same ones.
_rng = np.random.default_rng(20240229)
BYTE_CODE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | U64(1)
_BASE = U64(0x9E3779B97F4A7C15) | U64(1)
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER_AZ = np.arange(256, dtype=np.uint8)
LOWER_AZ[65:91] += 32


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once per application."""
    sc = spark.sparkContext
    if getattr(sc, "_tidemark_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if os.path.isdir(root):
        path = os.path.join(tempfile.mkdtemp(prefix="tidemark"), "tidemark_src.zip")
        with zipfile.ZipFile(path, "w") as z:
            for folder, _, names in os.walk(root):
                for n in names:
                    if n.endswith(".py"):
                        full = os.path.join(folder, n)
                        z.write(full, os.path.relpath(full, os.path.dirname(root)))
        sc.addPyFile(path)
    sc._tidemark_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or
    a temporary one where the session names none and runs in one process (tests).
    A cluster without that setting is refused: its executors would each write to
    a disk of their own, and what is read back would fall short."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tidemark-shared")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: lineage ends there,
    and a lost executor costs no recomputation of what came before."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemark-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift, multiply)."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


_power = {1: np.ones(1, dtype=np.uint64), -1: np.ones(1, dtype=np.uint64)}
_factor = {1: _BASE, -1: U64(pow(int(_BASE), -1, 2**64))}


def powers(n: int, sign: int = 1) -> np.ndarray:
    """_BASE to the powers 0..n-1 (or 0..1-n with sign -1), modulo 2**64."""
    while len(_power[sign]) < n:
        _power[sign] = np.concatenate([_power[sign], _power[sign] * (_power[sign][-1:] * _factor[sign])])
    return _power[sign][:n]


def run_hash(h: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hash of h[start:stop] for each start and stop (none before start), by sums
    of powers: the same for equal runs wherever they stand."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * powers(len(h)), dtype=np.uint64)])
    return mix((total[stop] - total[start]) * powers(len(h) + 1, -1)[start] + (stop - start).astype(np.uint64))


def hash_sample(df: DataFrame, key: str, rows: int) -> DataFrame:
    """At most ``rows`` rows, those with the smallest hash of ``key``. A threshold
    on the hash thins the table out before it is sorted, so what tasks send to the
    driver follows ``rows``, not the number of tasks."""
    total = df.count()
    if total > rows:
        share = int(2**31 * min(1.0, (rows + 4 * rows**0.5) / total))
        df = df.where(F.pmod(F.xxhash64(key), F.lit(2**31)) < share)
    return df.orderBy(F.pmod(F.xxhash64(key), F.lit(2**31)), key).limit(rows)


def whole_texts(df: DataFrame, sized: list[tuple], key: str, text: str, size: int) -> list:
    """The rows of ``df`` with the keys of ``sized`` (key, bytes of its text), texts
    whole, in order of a hash of the key. Keys are taken in the order given while
    their texts keep within ``size`` bytes together; one that doesn't fit is passed
    over, so that the driver's memory is bounded however long texts are."""
    taken, total = [], 0
    for k, n in sized:
        if k is not None and total + n <= size:
            taken.append((k,))
            total += n
    ids = df.sparkSession.createDataFrame(sorted(set(taken)), T.StructType([T.StructField(key, df.schema[key].dataType)]))
    return df.join(F.broadcast(ids), key, "left_semi").orderBy(F.xxhash64(key), key, text).limit(max(1, len(taken))).collect()


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a run of texts, as numpy arrays.

    buf: bytes of all texts, one separating space after each; start, end: byte
    range of each word; first: index of each text's first word (n + 1 entries);
    hash: a 64-bit hash of each word's bytes.
    """

    def __init__(self, texts, lower: bool = False, salt: int = 0):
        data = [b"" if t is None else t.encode("utf-8", "replace") if isinstance(t, str) else t for t in texts]
        self.raw = b" ".join(data) + b" "
        buf = np.frombuffer(self.raw, dtype=np.uint8)
        if lower:
            buf = LOWER_AZ[buf]
            self.raw = buf.tobytes()
        self.buf = buf
        space = _IS_SPACE[buf]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        if len(buf) and not space[0]:
            edge = np.concatenate([[0], edge])
        self.start, self.end = edge[0::2], edge[1::2]
        ends = np.cumsum(np.fromiter((len(d) + 1 for d in data), dtype=np.int64, count=len(data)))
        self.text_start = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(data) else np.zeros(0, np.int64)
        self.first = np.concatenate([[0], np.searchsorted(self.start, ends)]).astype(np.int64)
        self.salt = U64((salt * 0x9E3779B97F4A7C15) & (2**64 - 1))

    @property
    def hash(self) -> np.ndarray:
        if not hasattr(self, "_hash"):
            n, at = len(self.start), self.start
            if not n:
                self._hash = np.zeros(0, dtype=np.uint64)
            else:
                length = self.end - at
                keep = ~_IS_SPACE[self.buf]
                packed = self.buf[keep]
                offset = np.cumsum(length) - length
                place = np.arange(len(packed), dtype=np.int64) - np.repeat(offset, length)
                code = BYTE_CODE[packed] * powers(int(length.max()))[place]
                self._hash = mix(np.add.reduceat(code, offset) + length.astype(np.uint64) + self.salt)
        return self._hash


def batches(column, rows: int = 256, size: int = 1_500_000):
    """Slices of a list of texts: at most ``rows`` of them, and about ``size``
    characters, so that memory doesn't follow the longest run of texts. A single
    longer text is a slice of its own."""
    at = 0
    while at < len(column):
        stop, total = at, 0
        while stop < len(column) and stop - at < rows and (stop == at or total + len(column[stop] or "") <= size):
            total += len(column[stop] or "")
            stop += 1
        yield at, stop
        at = stop
