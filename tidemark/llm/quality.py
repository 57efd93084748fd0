"""Operator 9: a compression classifier of text quality.

Two zstandard dictionaries are built, one from good and one from bad labelled
texts, whole. A text is compressed with either, in blocks of ``BLOCK`` bytes, so
that a dictionary tells as much in a long text as in a short one; the difference
of the compressed sizes, divided by the length of the text, is its one feature. It
becomes a score by a logistic calibration (slope and offset) fitted on whole
labelled texts that built no dictionary.

Bounded sample: at most ``sample`` labelled rows of each label, those with the
smallest hash of their id, as far as their whole texts keep within ``size`` bytes
together. Every whole text is scored, in one map without a shuffle.

Null and empty texts get the score of the empty text. Long texts are compressed to
their end. Equal texts get equal scores, repeated rows too. An empty table gives an
empty result; without labelled rows every score is that of the prior. Labels that
are neither 0 nor 1, without an id, or that contradict one another for an id teach
nothing; an id with several rows of text gives each of them. Rows with a null id are
scored. Other columns are carried as they are; one named like the score is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SAMPLE_BYTES, batches, cut, hash_sample, ship, whole_texts

#: Bytes of a dictionary, of the samples it is trained on, and of the blocks that are compressed with it.
DICT_BYTES, PASSAGE, BLOCK = 112_640, 2048, 256
#: Optimal parsing: compressed sizes follow the dictionary closely (17 separated best, and is the second cheapest, of
#: the levels with such parsing, 16 to 19, on training rows outside the sample).
LEVEL = 17


class CompressionModel:
    """Scores texts; pickles as its dictionaries and its calibration."""

    def __init__(self, good: bytes, bad: bytes, offset: float = 0.0, slope: float = 0.0):
        self.good, self.bad, self.offset, self.slope = good, bad, offset, slope

    def _start(self) -> None:
        import zstandard as z

        conf = z.ZstdCompressionParameters.from_level(LEVEL, write_content_size=False, write_dict_id=False, write_checksum=False)
        self._c = []
        for d in (self.good, self.bad):
            d = z.ZstdCompressionDict(d, dict_type=z.DICT_TYPE_AUTO)
            d.precompute_compress(compression_params=conf)
            self._c.append(z.ZstdCompressor(dict_data=d, compression_params=conf))

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_c"}

    def difference(self, texts: list[str | None]) -> np.ndarray:
        """How much smaller the good dictionary makes each text than the bad one,
        for each of its bytes."""
        if not hasattr(self, "_c"):
            self._start()
        out = np.zeros(len(texts))
        for i, t in enumerate(texts):
            data = (t or "").encode("utf-8", "replace")
            blocks = [data[a : a + BLOCK] for a in range(0, max(1, len(data)), BLOCK)]
            good, bad = (sum(len(c.compress(p)) for p in blocks) for c in self._c)
            out[i] = (bad - good) / (len(data) + 16)
        return out

    def score(self, texts: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.offset + self.slope * self.difference(texts), -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    """Newton's method on weighted rows."""
    w = np.zeros(x.shape[1])
    reg = np.eye(x.shape[1]) * ridge
    reg[0, 0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + reg
        step = np.linalg.solve(h, x.T @ (weight * (y - p)) - reg @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def dictionary(texts: list[bytes]) -> bytes:
    """A zstandard dictionary of the texts; raw content where there are too few."""
    import zstandard as z

    texts = [t[a : a + PASSAGE] for t in texts for a in range(0, len(t), PASSAGE)]
    try:
        return z.train_dictionary(min(DICT_BYTES, max(256, sum(map(len, texts)) // 8)), texts).as_bytes()
    except z.ZstdError:
        return b"".join(texts)[-DICT_BYTES:] or b"no labelled text "


def labelled(docs: DataFrame, labels: DataFrame, label: str, train, sample: int, text: str, key: str, size: int = SAMPLE_BYTES) -> list[tuple[str, int, float]]:
    """At most ``sample`` (whole text, label, weight) of each label, of rows where
    ``train`` holds, ordered by a hash of the id, and ``size`` bytes of texts: a
    bounded sample on the driver. The weight makes up for labels that it thins out."""
    rows = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("t")).where(train)
    known = labels.select(F.col(key), F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col(key).isNotNull()).where(train)
    known = cut(known.groupBy(key).agg(F.min("y").alias("y"), F.max("y").alias("__most")).where("y = __most").drop("__most"))
    total = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    pick = hash_sample(known.where(F.col("y") == 0), key, sample).unionByName(hash_sample(known.where(F.col("y") == 1), key, sample))
    chosen = {r[0]: r[1] for r in pick.collect()}
    ids = rows.sparkSession.createDataFrame([(k,) for k in chosen], T.StructType([T.StructField(key, docs.schema[key].dataType)]))
    sized = rows.join(F.broadcast(ids), key, "left_semi").select(key, F.octet_length("t").alias("n")).orderBy(F.xxhash64(key), key, "n").limit(2 * sample).collect()
    rows = [(r["t"], chosen[r[key]]) for r in whole_texts(rows, sized, key, "t", size)]
    have = {k: max(1, sum(y == k for _, y in rows)) for k in (0, 1)}
    norm = len(rows) / max(1, sum(total.values()))
    return [(t, y, norm * total[y] / have[y]) for t, y in rows]


def fit(rows: list[tuple[str, int, float]]) -> CompressionModel:
    """Even rows build the dictionaries, odd ones the calibration."""
    data = [(t.encode("utf-8", "replace"), y) for t, y, _ in rows]
    build = data[0::2]
    model = CompressionModel(*(dictionary([t for t, y in build if y == k]) for k in (1, 0)))
    rest = rows[1::2] or [("", 1, 1.0)]
    x, y, w = model.difference([t for t, *_ in rest]), np.array([r[1] for r in rest], dtype=float), np.array([r[2] for r in rest])
    mean, scale = float(x.mean()), float(x.std()) + 1e-6
    offset, slope = logistic(np.column_stack([np.ones(len(x)), (x - mean) / scale]), y, w)
    model.slope = float(slope / scale)
    model.offset = float(offset - slope * mean / scale)
    return model


def train_quality(docs: DataFrame, labels: DataFrame, train, label: str = "quality", sample: int = 3000, text: str = "text", key: str = "doc_id", size: int = SAMPLE_BYTES) -> CompressionModel:
    return fit(labelled(docs, labels, label, train, sample, text, key, size))


def score_texts(docs: DataFrame, model, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` and a column ``name``: the score of each whole text."""
    spark = docs.sparkSession
    ship(spark)
    held = spark.sparkContext.broadcast(model)
    columns = [c for c in docs.columns if c != name]
    at = columns.index(text)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for a, b in batches(texts := batch.column(at).to_pylist(), 512):
                part = batch.slice(a, b - a)
                s = held.value.score(texts[a:b])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(s, pa.float64())], names=[*columns, name])

    src = docs.select(*columns)
    return src.mapInArrow(run, T.StructType([*src.schema.fields, T.StructField(name, T.DoubleType())]))
