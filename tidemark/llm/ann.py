"""Operator 5: nearest neighbours by a forest of random-projection trees.

The trees' planes are fitted on a bounded sample of the vectors (``SAMPLE`` rows
with the smallest hash of their id): each node splits at the median of the
projection on the line through two of its rows. A query walks all trees through
one shared priority queue, ordered by the squared margins it crossed on the way
down, until the leaves taken in one tree hold ``fraction`` of all rows and ``k``
rows of other ids; the rows of the leaves taken are its candidates, and they are
reranked by the exact cosine in double precision. ``fraction`` is not set by hand:
it is the smallest share at which, within the sample, ``RECALL`` of the true
neighbours of ``PROBES`` rows are found, so vectors with structure are searched
thinly and vectors without it widely (measured recall: see README).

The index is built once: one pass counts the rows of each leaf, another deals
each row once for each tree to a *cell*, the rows below one node, hot cells split
by a hash of the row so that none holds many more than ``CELL``. Queries are dealt
to the cells in which they take a leaf and stream past their rows, leaf by leaf, in
products of matrices; a cell gives each query its ``k`` best, and these are merged.
Work follows queries times candidates; nothing that grows with the table is
broadcast or sent to the driver, and the plan has the same steps at any size.

Vectors that are null, empty, zero, of another length than the sample's, or hold
nulls or non-finite numbers take no part, nor do rows without an id; of repeated
query ids one row counts, and none of the rows with the query's id is an answer.
Repeated rows are answers of their own. Ties go to the smaller id. Fewer rows than
``k``: all are returned. Empty tables give an empty result. Only the two columns
named are read, so clashing names of others do no harm.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import hash_sample, mix, parts, ship

SAMPLE, TREES, DEPTH = 20_000, 2, 8
#: Rows of a leaf that a tree on few rows keeps, about.
LEAF = 40
#: Calibration of the share searched: recall within the sample, and rows it is measured on.
RECALL, PROBES = 0.95, 400
#: Levels above the cells, rows of one cell, and queries scored at once.
TOP, CELL, BATCH = 3, 131_072, 4096


def usable(vectors: list, width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(places, rows) of the vectors that take part, as doubles."""
    places, rows = [], []
    for i, v in enumerate(vectors):
        if v is not None and len(v) and (width is None or len(v) == width) and None not in v:
            places.append(i)
            rows.append(v)
    if not rows:
        return np.zeros(0, dtype=np.int64), np.zeros((0, width or 0))
    x = np.asarray(rows, dtype=np.float64)
    good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
    return np.asarray(places, dtype=np.int64)[good], x[good]


def unit(x: np.ndarray) -> np.ndarray:
    top = np.abs(x).max(axis=1, keepdims=True) if len(x) else 1.0
    x = x / top
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _between(p: np.ndarray) -> float:
    """A cut beside the median, in a gap: on a row's own value, rounding would
    send the row to one side here and to the other when it is looked up."""
    right = p >= np.median(p) - 1e-9
    return float((p[~right].max() + p[right].min()) / 2 if not right.all() else p.min() - 1)


class Forest:
    """``counts`` (trees, leaves): rows of the table in each leaf, set once they
    are counted; until then those of the sample."""

    def __init__(self, sample: np.ndarray, trees: int = TREES, depth: int | None = None, seed: int = 11):
        rng = np.random.default_rng(seed)
        n, self.width = sample.shape
        self.depth = depth = int(min(DEPTH, max(1, np.log2(max(1, n / LEAF))))) if depth is None else depth
        self.planes, self.cuts = np.zeros((trees, 2**depth - 1, self.width)), np.zeros((trees, 2**depth - 1))
        for t in range(trees):
            rows = [np.arange(n)]
            for d in range(depth):
                below = []
                for i, m in enumerate(rows):
                    k = 2**d - 1 + i
                    w = sample[m[rng.integers(len(m))]] - sample[m[rng.integers(len(m))]] if len(m) > 1 else np.zeros(self.width)
                    if not np.any(w):
                        w = rng.normal(size=self.width)
                    w = w / np.sqrt((w * w).sum())
                    p = sample[m] @ w
                    c = _between(p) if len(p) else 0.0
                    self.planes[t, k], self.cuts[t, k] = w, c
                    below += [m[p < c], m[p >= c]]
                rows = below
        self.counts = self.tally(self.leaves(sample))

    def tally(self, leaves: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(leaves[:, t], minlength=2**self.depth) for t in range(leaves.shape[1])])

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """(rows, trees): each row's leaf in each tree."""
        out = np.zeros((len(x), len(self.planes)), dtype=np.int64)
        for t in range(len(self.planes)):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                side = np.einsum("ij,ij->i", x, self.planes[t, node]) >= self.cuts[t, node]
                node = 2 * node + 1 + side
            out[:, t] = node - (2**self.depth - 1)
        return out

    def walk(self, q: np.ndarray) -> Iterator[tuple[int, int]]:
        """(tree, leaf) in the order in which one shared queue gives them out."""
        margins = (self.planes @ q - self.cuts).tolist()
        inner = 2**self.depth - 1
        queue = [(0.0, t, 0) for t in range(len(margins))]
        pop, push = heapq.heappop, heapq.heappush
        while queue:
            crossed, t, k = pop(queue)
            while k < inner:  # down the near side; the far sides wait
                m = margins[t][k]
                near = 2 * k + 1 + (m >= 0)
                push(queue, (crossed + m * m, t, 4 * k + 3 - near))
                k = near
            yield t, k - inner

    def search(self, q: np.ndarray, fraction: float, least: int) -> np.ndarray:
        """(trees, leaves) booleans: the leaves taken; those of one tree hold
        ``fraction`` of the table and ``least`` rows, or the leaves are all there are."""
        taken = np.zeros(self.counts.shape, dtype=bool)
        counts = self.counts.tolist()
        held = [0] * len(counts)
        want = max(fraction * sum(counts[0]), least)
        for t, leaf in self.walk(q):
            taken[t, leaf] = True
            held[t] += counts[t][leaf]
            if held[t] >= want:
                break
        return taken

    def calibrate(self, sample: np.ndarray, k: int, recall: float = RECALL, probes: int = PROBES) -> float:
        """The smallest share at which ``recall`` of the ``k`` nearest rows of
        ``probes`` rows of the sample are among their candidates."""
        if len(sample) < 2:
            return 1.0
        leaves, total = self.leaves(sample), len(sample)
        needed = []
        for i in np.random.default_rng(5).permutation(total)[:probes]:
            s = sample @ sample[i]
            s[i] = -np.inf
            near = np.argpartition(-s, min(k, total - 1) - 1)[: min(k, total - 1)]
            open_, held = set(near.tolist()), [0] * len(self.counts)
            for t, leaf in self.walk(sample[i]):
                held[t] += int(self.counts[t, leaf])
                for j in [j for j in open_ if leaves[j, t] == leaf]:
                    open_.discard(j)
                    needed.append(max(held))
                if not open_:
                    break
        return float(np.quantile(needed, recall)) / total


def sample_vectors(rows: DataFrame, vector: str, key: str, sample: int = SAMPLE) -> np.ndarray:
    """Unit vectors of a bounded sample; vectors of its most frequent length."""
    known = rows.where(F.col(key).isNotNull() & F.col(vector).isNotNull())
    vectors = hash_sample(known.select(F.col(key).alias("k"), F.col(vector).alias("v")), "k", sample).select("v").toArrow().column("v").to_pylist()
    widths = [len(v) for v in vectors if len(v)]
    if not widths:
        return np.zeros((0, 0))
    return unit(usable(vectors, max(set(widths), key=widths.count))[1])


def neighbours(rows: DataFrame, queries: DataFrame, k: int = 5, fraction: float | None = None, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of ``rows`` to each query.
    ``fraction``: the share of the rows that a query looks at in one tree (1: all
    of them); left out, it is calibrated."""
    spark = rows.sparkSession
    ship(spark)
    sample = sample_vectors(rows, vector, key)
    if not len(sample):
        out = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("rank", T.IntegerType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.DoubleType())])
        return spark.createDataFrame([], out)
    forest = Forest(sample)
    share = forest.calibrate(sample, k) if fraction is None else fraction
    scan = rows.where(F.col(key).isNotNull()).select(F.monotonically_increasing_id().alias("uid"), F.col(key).cast("long").alias("id"), F.col(vector).alias("v"))
    forest.counts = _count(scan, forest)
    cells = Cells(forest)
    plan = spark.sparkContext.broadcast((forest, cells, share))
    own = rows.select(F.col(key).cast("long").alias("id")).join(queries.select(F.col(key).cast("long").alias("id")).distinct(), "id", "left_semi").groupBy("id").agg(F.count(F.lit(1)).alias("own"))
    asked = queries.where(F.col(key).isNotNull()).dropDuplicates([key]).select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v")).join(own, "id", "left").select(F.coalesce("own", F.lit(0)).alias("uid"), "id", "v")
    single = isinstance(rows.schema[vector].dataType.elementType, T.FloatType)
    dealt = scan.mapInArrow(_deal_rows(plan, single), _DEALT).unionByName(asked.mapInArrow(_deal_queries(plan, k), _DEALT))
    n = min(cells.total, 4 * parts(spark))
    met = dealt.repartitionById(n, F.col("cell") % n).sortWithinPartitions("cell", "leaf").mapInArrow(_score(forest.width, k, single), "query_id bigint, uid bigint, vec_id bigint, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id", "uid")
    best = met.dropDuplicates(["query_id", "uid"]).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")


#: A row has the leaf it lies in, within its cell. A query comes after a cell's rows
#: (its leaf is beyond all), with a mask of the cell's leaves that it takes.
_NAMES = ["cell", "leaf", "uid", "id", "v", "mask"]
_DEALT = "cell int, leaf int, uid bigint, id bigint, v binary, mask binary"
_BEYOND = 2**30


class Cells:
    """Numbers of the cells: the nodes ``TOP`` levels down each tree, in pieces
    where they hold more than ``CELL`` rows."""

    def __init__(self, forest: Forest):
        self.low = forest.depth - min(TOP, forest.depth)  # levels within a cell
        counts = forest.counts.reshape(len(forest.counts), -1, 2**self.low).sum(axis=2)
        self.pieces = np.maximum(1, -(-counts // CELL))
        self.total = int(self.pieces.sum())
        self.first = (np.cumsum(self.pieces.ravel()) - self.pieces.ravel()).reshape(counts.shape)

    def of_rows(self, tree: int, leaf: np.ndarray, uid: np.ndarray) -> np.ndarray:
        node = leaf >> self.low
        return self.first[tree, node] + (mix(uid.astype(np.uint64)) % self.pieces[tree, node].astype(np.uint64)).astype(np.int64)


def _count(scan: DataFrame, forest: Forest) -> np.ndarray:
    """Rows of the table in each leaf; each task sends one row of counts."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(forest.counts.shape, dtype=np.int64)
        for batch in it:
            _, x = usable(batch.column(0).to_pylist(), forest.width)
            if len(x):
                total += forest.tally(forest.leaves(unit(x)))
        at = np.flatnonzero(total.ravel())
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total.ravel()[at], pa.int64())], names=["at", "n"])

    out = np.zeros(forest.counts.size, dtype=np.int64)
    for r in scan.select("v").mapInArrow(run, "at int, n bigint").groupBy("at").agg(F.sum("n").alias("n")).collect():
        out[r["at"]] = r["n"]
    return out.reshape(forest.counts.shape)


def _deal_rows(plan, single: bool):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, cells, _ = plan.value
        for batch in it:
            at, raw = usable(batch.column(2).to_pylist(), forest.width)
            if not len(at):
                continue
            uid, ids = (batch.column(i).to_numpy(zero_copy_only=False)[at] for i in (0, 1))
            said = pa.array([r.tobytes() for r in raw.astype("<f4" if single else "<f8")], pa.binary())
            leaves = forest.leaves(unit(raw))
            for t in range(leaves.shape[1]):
                leaf = leaves[:, t]
                yield pa.RecordBatch.from_arrays([pa.array(cells.of_rows(t, leaf, uid), pa.int32()), pa.array(leaf & (2**cells.low - 1), pa.int32()), pa.array(uid, pa.int64()), pa.array(ids, pa.int64()), said, pa.nulls(len(at), pa.binary())], names=_NAMES)

    return run


def _deal_queries(plan, k: int):
    """uid: how many rows the query's id has; the leaves taken hold ``k`` beyond them."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, cells, share = plan.value
        for batch in it:
            at, raw = usable(batch.column(2).to_pylist(), forest.width)
            own, ids = (batch.column(i).to_numpy(zero_copy_only=False)[at] for i in (0, 1))
            cell, who, masks = [], [], []
            for i, q in enumerate(unit(raw)):
                taken = forest.search(q, share, k + int(own[i])).reshape(len(forest.counts), -1, 2**cells.low)
                for t, node in np.argwhere(taken.any(axis=2)).tolist():
                    n = int(cells.pieces[t, node])
                    cell.extend(range(int(cells.first[t, node]), int(cells.first[t, node]) + n))
                    who.extend([i] * n)
                    masks.extend([np.packbits(taken[t, node]).tobytes()] * n)
            said = pa.array([r.tobytes() for r in raw], pa.binary()).take(pa.array(who, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(np.full(len(who), _BEYOND), pa.int32()), pa.array(own[who], pa.int64()), pa.array(ids[who], pa.int64()), said, pa.array(masks, pa.binary())], names=_NAMES)

    return run


class _Rows:
    """A cell's rows: distinct vectors in order of leaf, each with the ids and uids
    that have it, in order."""

    def __init__(self, leaf: np.ndarray, uid: np.ndarray, ids: np.ndarray, raw: np.ndarray):
        x = unit(raw)
        order = np.lexsort((uid, ids))
        whole = np.ascontiguousarray(x).view(np.dtype((np.void, x.shape[1] * 8))).ravel()
        vectors, self.leaf, self.ids, self.uids, self.solo = [], [], [], [], []
        for n in np.unique(leaf).tolist():
            here = order[leaf[order] == n]
            _, first, which = np.unique(whole[here], return_index=True, return_inverse=True)
            vectors.append(x[here[first]])
            self.leaf += [n] * len(first)
            by = np.argsort(which, kind="stable")
            cuts = np.searchsorted(which[by], np.arange(1, len(first)))
            for m in np.split(here[by], cuts):
                self.ids.append(ids[m])
                self.uids.append(uid[m])
                self.solo.append(ids[m[0]] if ids[m[0]] == ids[m[-1]] else None)
        self.x = np.concatenate(vectors)
        self.leaf = np.asarray(self.leaf)
        self.alone = np.array([s is not None for s in self.solo])
        self.solo = np.array([s if s is not None else 0 for s in self.solo], dtype=np.int64)

    def best(self, qid: np.ndarray, q: np.ndarray, masks: np.ndarray, k: int) -> list[tuple]:
        """(query, uid, id, score) of the k best of each query, ties by id."""
        pq, pu = [], []
        for n in np.unique(self.leaf).tolist():
            asked = np.flatnonzero(masks[:, n])
            lo, hi = np.searchsorted(self.leaf, [n, n + 1])
            step = max(1, 4_000_000 // (hi - lo))
            for a in range(0, len(asked), step):
                some = asked[a : a + step]
                s = self.x[lo:hi] @ q[some].T
                s[self.alone[lo:hi, None] & (self.solo[lo:hi, None] == qid[some])] = -np.inf
                least = np.partition(s, hi - lo - k, axis=0)[hi - lo - k] - 1e-12 if hi - lo > k else -2.0
                u, w = np.nonzero(s >= np.maximum(least, -2.0))
                pq.append(some[w])
                pu.append(u + lo)
        pq, pu = np.concatenate([*pq, np.zeros(0, np.int64)]), np.concatenate([*pu, np.zeros(0, np.int64)])
        # summed row by row: a product of matrices rounds equal vectors unequally, and ties would break
        ps = (self.x[pu] * q[pq]).sum(axis=1)
        order = np.lexsort((-ps, pq))
        pq, pu, ps = pq[order], pu[order], ps[order]
        start = np.searchsorted(pq, np.arange(len(q) + 1))
        out = []
        for i in range(len(q)):
            a, b = int(start[i]), int(start[i + 1])
            if a == b:
                continue
            got = []
            least = ps[min(a + k, b) - 1]
            for j in range(a, b):
                if ps[j] < least:
                    break
                ids, uids, n = self.ids[pu[j]], self.uids[pu[j]], 0
                for x, y in zip(ids.tolist(), uids.tolist(), strict=True):
                    if x != qid[i]:
                        got.append((-ps[j], x, y))
                        n += 1
                        if n == k:
                            break
            got.sort()
            out += [(int(qid[i]), y, x, -s) for s, x, y in got[:k]]
        return out


def _score(width: int, k: int, single: bool):
    """Batches come in order of cell; within a cell rows first, then queries."""

    def vectors(column, kind: str) -> np.ndarray:
        return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(-1, width).astype(np.float64)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, rows = None, [], None
        for batch in it:
            number, leaf = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            asks = leaf == _BEYOND
            edges = [0, *(np.flatnonzero((np.diff(number) != 0) | (np.diff(asks) != 0)) + 1).tolist(), len(number)]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                if number[a] != cell:
                    cell, held, rows = number[a], [], None
                uid, ids = (part.column(i).to_numpy() for i in (2, 3))
                if not asks[a]:
                    held.append((leaf[a:b], uid, ids, vectors(part.column(4), "<f4" if single else "<f8")))
                    continue
                if held:
                    rows, held = _Rows(*(np.concatenate(c) for c in zip(*held, strict=True))), []
                if rows is None:
                    continue
                q = unit(vectors(part.column(4), "<f8"))
                masks = np.unpackbits(np.frombuffer(b"".join(part.column(5).to_pylist()), dtype=np.uint8).reshape(len(q), -1), axis=1).astype(bool)
                for c in range(0, len(q), BATCH):
                    found = rows.best(ids[c : c + BATCH], q[c : c + BATCH], masks[c : c + BATCH], k)
                    if found:
                        yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*found, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["query_id", "uid", "vec_id", "score"])

    return run
