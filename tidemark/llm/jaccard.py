"""Operator 10: n-gram Jaccard join by set-relation skipping.

A document's set holds the 64-bit hashes of its distinct word shingles. Two
documents link when their sets' Jaccard similarity reaches ``percent`` / 100;
the result is the component each document lies in. Equal sets are collapsed
first; every later step works on one document of each set.

*Answers from similar sets.* Documents that share a minimum hash meet one
of them, their *centre*; the exact similarity with the centre is
computed once, and who links with it (distance d) takes over its answers: a pair
x, y of members with centres a, b is settled by the triangle inequality of the
Jaccard distance, D(x, y) >= D(a, b) - d(x) - d(y), so only centres are compared
and members only where that leaves the answer open.

*Block-skipping lists.* Candidate pairs come from index lists: each document
enters the lists of its set's prefix (so many of its elements, rarest first, that
sets similar enough must share one of them; a set so small that it links with
equal ones only enters none). Lists are sorted by set size and position. A list is
visited by blocks of equal size: two blocks whose sizes can't match are skipped,
and so is what stands in a block at positions that leave too little room for the
overlap that these sizes need. What is left is told apart by bitmaps of 256 bits,
one parity for each: a pair that links differs in no more bits than elements. Pairs
leave in chunks (of two sets too large for such bitmaps those that share ``SHARE``
elements of somewhat longer prefixes), so memory doesn't follow a list's length, and a list of more than
``HOT`` documents is dealt as a grid of its pieces.
Rarity is told by a table of ``2**SKETCH`` counters over the shingles of all
documents (bounded; a common order is all that exactness needs), which keeps
passages and lines that very many documents share out of the prefixes.

Null and empty texts and texts without words have empty sets and link with nothing:
their component is their own id. Long texts give all their shingles. Equal texts
have equal sets and link. A null id is in no component (null). Rows that share an
id are one document with the links of each of them. An empty table gives an empty
result. Only the id and the text are read, so clashing names of other columns do
no harm.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bits
from .common import U64, Words, batches, cut, mix, parts, ship

SKETCH, _BLOCKS = 20, 64
#: Documents in a list beyond which it is dealt as a grid, and in one that is visited with others at once.
HOT, SMALL = 16_384, 12
#: Differing bits of 256 beyond which bitmaps tell little, and elements of prefixes that large sets must share.
FAR, SHARE = 80, 3
#: Pairs looked at together.
CHUNK = 500_000
_BITS = ["b0", "b1", "b2", "b3"]
#: Tasks that the documents of one minimum hash are spread over.
SALTS = 16


def shingle_sets(texts: list, n: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    for a, b in batches(texts):
        w = Words(texts[a:b], lower=True)
        h = w.hash
        wide = np.zeros(max(0, len(h) - n + 1), dtype=np.uint64)
        for k in range(n):
            wide = wide * U64(0xD6E8FEB86659FD93) + h[k : len(h) - n + 1 + k]
        wide = mix(wide)
        for x, y in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
            if y - x >= n:
                s = np.sort(wide[x : y - n + 1])
                yield s[np.concatenate([[True], s[1:] != s[:-1]])]
            elif y > x:
                short = U64(0)
                for v in h[x:y]:
                    short = U64((int(short) * 0xC2B2AE3D27D4EB4F + int(v)) & (2**64 - 1))
                yield mix(np.array([short ^ U64(0x5851F42D4C957F2D)], dtype=np.uint64))
            else:
                yield np.zeros(0, dtype=np.uint64)


def least_overlap(x: int, y: int, percent: int) -> int:
    """Smallest intersection of sets of x and y elements that link."""
    return -(-percent * (x + y) // (100 + percent))


def prefix_size(x: int, percent: int) -> int:
    """How many elements of a set of x, in the common order, the lists hold: a set
    that links with it shares one of them. 0: only equal sets link with it."""
    least = -(-percent * x // 100)
    if least == x and 100 * x // percent == x and least_overlap(x, x, percent) == x:
        return 0
    return x - least + (SHARE if is_large(x, percent) else 1)


def is_large(x, percent: int):
    """Whether sets of x elements may link although more bits differ than the
    bitmaps can tell; such sets must share ``SHARE`` elements of their prefixes."""
    return 2 * (x - least_overlap(x, x, percent)) > FAR


def parities(s: np.ndarray) -> np.ndarray:
    """256 bits: for each, whether an odd number of elements falls to it."""
    at = np.bincount(((s >> U64(8)) & U64(255)).astype(np.int64), minlength=256) & 1
    return np.packbits(at.astype(np.uint8)).view(np.int64)


def _profiles(docs: DataFrame, text: str, key: str, n: int) -> DataFrame:
    """A row for each document (id, size, set's digest, two minimum hashes, a
    signature of 16 bytes, one from each sixteenth of the hashes' range, and the
    parities), and rows with the partition's counters (block, counts)."""
    sixteenths = (np.arange(16, dtype=np.uint64)) << U64(60)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "size", "same", "m1", "m2", "sig", *_BITS, "block", "counts"]
        counter = np.zeros(1 << SKETCH, dtype=np.uint32)
        some = False
        for batch in it:
            ids, size, same, m1, m2, sig, odd, held = batch.column(0), [], [], [], [], [], [], []
            for s in shingle_sets(batch.column(1).to_pylist(), n):
                size.append(len(s))
                same.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                at = np.minimum(np.searchsorted(s, sixteenths), max(0, len(s) - 1))
                m1.append(int(s[0].view(np.int64)) if len(s) else None)
                m2.append(int(s[at[8]].view(np.int64)) if len(s) else None)
                sig.append((s[at] & U64(255)).astype(np.uint8).tobytes() if len(s) else None)
                odd.append(parities(s))
                some = True
                held.append((s >> U64(64 - SKETCH)).astype(np.int64))
                if sum(map(len, held)) > 1_000_000:
                    counter += np.bincount(np.concatenate(held), minlength=1 << SKETCH).astype(np.uint32)
                    held = []
            if held:
                counter += np.bincount(np.concatenate(held), minlength=1 << SKETCH).astype(np.uint32)
            k = len(size)
            odd = np.stack(odd) if odd else np.zeros((0, 4), np.int64)
            yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array(size, pa.int32()), pa.array(same, pa.binary()), pa.array(m1, pa.int64()), pa.array(m2, pa.int64()), pa.array(sig, pa.binary()), *(pa.array(odd[:, i]) for i in range(4)), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], names=names)
        if some:
            parts_ = counter.reshape(_BLOCKS, -1)
            yield pa.RecordBatch.from_arrays([pa.nulls(_BLOCKS, pa.int64()), pa.nulls(_BLOCKS, pa.int32()), pa.nulls(_BLOCKS, pa.binary()), pa.nulls(_BLOCKS, pa.int64()), pa.nulls(_BLOCKS, pa.int64()), pa.nulls(_BLOCKS, pa.binary()), *(pa.nulls(_BLOCKS, pa.int64()) for _ in _BITS), pa.array(np.arange(_BLOCKS), pa.int32()), pa.array([np.minimum(p, 65535).astype(np.uint16).tobytes() for p in parts_], pa.binary())], names=names)

    return docs.select(key, text).mapInArrow(run, "id bigint, size int, same binary, m1 bigint, m2 bigint, sig binary, b0 bigint, b1 bigint, b2 bigint, b3 bigint, block int, counts binary")


def _rarity(rows: DataFrame) -> np.ndarray:
    """Log-scale counters (a byte each), merged by executors."""

    def merge(it):
        import pandas as pd

        held: dict[int, np.ndarray] = {}
        for pdf in it:
            for b, x in zip(pdf["block"], pdf["counts"], strict=True):
                x = np.frombuffer(x, dtype=np.uint16).astype(np.uint64)
                held[b] = held[b] + x if b in held else x
        yield pd.DataFrame({"block": list(held), "counts": [np.round(4 * np.log2(x + 1.0)).astype(np.uint8).tobytes() for x in held.values()]}).astype({"block": "int32"})

    out = np.zeros((_BLOCKS, (1 << SKETCH) // _BLOCKS), dtype=np.uint8)
    for r in rows.where("block is not null").select("block", "counts").repartition(_BLOCKS // 4, "block").mapInPandas(merge, "block int, counts binary").collect():
        out[r["block"]] = np.frombuffer(r["counts"], dtype=np.uint8)
    return out.ravel()


def in_order(s: np.ndarray, rarity: np.ndarray) -> np.ndarray:
    """The set, rarest first; ties by hash."""
    return s[np.argsort(rarity[(s >> U64(64 - SKETCH)).astype(np.int64)], kind="stable")]


def _entries(docs: DataFrame, text: str, key: str, n: int, percent: int, rarity) -> DataFrame:
    """Index entries (token, id, size and position) of each document's prefix;
    equal sets enter once a partition. And a row with a negative place for each
    document: how common its elements are on average, dealt by its id."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in it:
            ids = batch.column(0).to_pylist()
            tok, who, place = [], [], []
            for d, s in zip(ids, shingle_sets(batch.column(1).to_pylist(), n), strict=True):
                if d is None or not len(s):
                    continue
                common = rarity.value[(s >> U64(64 - SKETCH)).astype(np.int64)].mean()
                tok.append(mix(np.array([d], dtype=np.int64).view(np.uint64)))
                who.append(np.array([d], dtype=np.int64))
                place.append(np.array([-1 - round(1000 * float(common))], dtype=np.int64))
                k = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                if k in seen:
                    continue
                if len(seen) > 1_000_000:
                    seen.clear()
                seen.add(k)
                p = in_order(s, rarity.value)[: prefix_size(len(s), percent)]
                tok.append(p)
                who.append(np.full(len(p), d, dtype=np.int64))
                place.append((len(s) << 32) + np.arange(len(p), dtype=np.int64))
            if tok:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tok).view(np.int64)), pa.array(np.concatenate(who)), pa.array(np.concatenate(place))], names=["token", "id", "place"])

    return docs.select(key, text).mapInArrow(run, "token bigint, id bigint, place bigint")


def _shared(entries: DataFrame, n_parts: int) -> DataFrame:
    """Entries of lists with two documents or more, and the rows of documents."""
    names = ["token", "id", "place"]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """An entry has company where its neighbour has the same token; the last
        entry of a batch waits for the next."""
        last, same = None, False
        for batch in it:
            if not batch.num_rows:
                continue
            now = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            if last is not None:
                now = [np.concatenate([x, y]) for x, y in zip(last, now, strict=True)]
            pair = now[0][1:] == now[0][:-1]
            keep = np.concatenate([[same], pair]) | np.concatenate([pair, [False]]) | (now[2] < 0)
            last, same = [x[-1:] for x in now], bool(pair[-1]) if len(pair) else same
            yield pa.RecordBatch.from_arrays([pa.array(x[:-1][keep[:-1]]) for x in now], names=names)
        if last is not None and (same or last[2][0] < 0):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in last], names=names)

    return entries.repartition(n_parts, "token").sortWithinPartitions("token").mapInArrow(run, "token bigint, id bigint, place bigint")


def by_list(it: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """(columns, bounds) of runs of whole lists, of batches in order of token. A list
    holds ``HOT`` documents of either of two pieces at most, so runs are bounded."""
    left: list[np.ndarray] | None = None
    for batch in it:
        now = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns)]
        if left is not None:
            now = [np.concatenate([x, y]) for x, y in zip(left, now, strict=True)]
        edge = np.flatnonzero(now[0][1:] != now[0][:-1]) + 1
        last = int(edge[-1]) if len(edge) else 0
        left = [x[last:] for x in now]
        if last:
            yield [x[:last] for x in now], np.concatenate([[0], edge])
    if left is not None and len(left[0]):
        yield left, np.array([0, len(left[0])])


def _gridded(lists: DataFrame) -> DataFrame:
    """Lists of more than ``HOT`` documents as a grid: each document goes to the
    cells of its piece with every other; side tells the two pieces of a cell apart
    (0: one piece with itself)."""
    many = cut(lists.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where(f"n > {HOT}").select("token", F.ceil(F.col("n") / HOT).cast("int").alias("pieces")))
    if not many.limit(1).count():
        return lists.withColumn("side", F.lit(0))
    rest = lists.join(F.broadcast(many.select("token")) if many.count() < 100_000 else many.select("token"), "token", "left_anti").withColumn("side", F.lit(0))
    own = F.pmod(F.xxhash64("id"), F.col("pieces")).cast("int")
    dealt = lists.join(many, "token").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
    dealt = dealt.withColumns({"side": side, "token": F.xxhash64("token", F.least("own", "other"), F.greatest("own", "other"))})
    return rest.unionByName(dealt.select(*rest.columns))


def candidates(cols: list[np.ndarray], bounds: np.ndarray, percent: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, share): places of entries (token, place, id, centre, d, side, bits) of
    one list that may link, in chunks, and how many lists they must meet in: 1, or
    ``most`` where both sets are large. cols are in order of token and place."""
    place, centre, side = cols[1], cols[3], cols[5]
    size, pos, bits_ = place >> 32, place & 0xFFFFFFFF, [b.view(np.uint64) for b in cols[6:]]  # signed ones would be counted by absolute value

    def fit(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x, y = size[i], size[j]
        need = least_overlap(x, y, percent)
        share = np.where(is_large(x, percent) & is_large(y, percent), most, 1)
        ok = (pos[i] <= x - need + share - 1) & (pos[j] <= y - need + share - 1) & (percent * y <= 100 * x) & (centre[i] != centre[j]) & ((side[i] == 0) | (side[i] != side[j]))
        i, j, share, far = i[ok], j[ok], share[ok], (x + y - 2 * need)[ok]
        differ = np.zeros(len(i), dtype=np.int64)
        for b in bits_:
            differ += np.bitwise_count(b[i] ^ b[j])
        ok = differ <= far
        return i[ok], j[ok], share[ok]

    length = np.diff(bounds)
    small = np.repeat(length <= SMALL, length)
    behind = np.repeat(bounds[1:], length) - np.arange(len(place))  # entries from here to the list's end
    for lag in range(1, SMALL):
        i = np.flatnonzero(small & (behind > lag))
        for a in range(0, len(i), CHUNK):
            yield fit(i[a : a + CHUNK], i[a : a + CHUNK] + lag)
    for k in np.flatnonzero(length > SMALL).tolist():
        a, b = int(bounds[k]), int(bounds[k + 1])
        if (centre[a:b] == centre[a]).all():
            continue
        sizes, first = np.unique(size[a:b], return_index=True)
        edge = [*(first + a).tolist(), b]
        for u, x in enumerate(sizes.tolist()):
            for v in range(u, len(sizes)):
                y = int(sizes[v])
                if percent * y > 100 * x:
                    break
                room = (most if is_large(x, percent) and is_large(y, percent) else 1) - 1 - least_overlap(x, y, percent)
                left = edge[u] + int(np.searchsorted(pos[edge[u] : edge[u + 1]], x + room, side="right"))
                right = edge[v] + int(np.searchsorted(pos[edge[v] : edge[v + 1]], y + room, side="right"))
                wide = right - edge[v]
                if not wide:
                    continue
                step = max(1, CHUNK // wide)
                for at in range(edge[u], left, step):
                    i = np.repeat(np.arange(at, min(left, at + step)), wide)
                    j = np.tile(np.arange(edge[v], right), min(left, at + step) - at)
                    if u == v:
                        i, j = i[i < j], j[i < j]
                    yield fit(i, j)


def _visit(lists: DataFrame, percent: int, n_parts: int, members: bool) -> DataFrame:
    """Of lists: pairs of centres (a, b, slack, met) whose members may link (met
    reaches SHARE, summed, where they meet in as many lists as they must); with
    ``members`` the pairs of members (a, b, ca, cb, slack), other than the centres
    themselves."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols, bounds in by_list(it):
            ids, centre, d = cols[2:5]
            for i, j, share in candidates(cols, bounds, percent, 1 if members else SHARE):
                slack = d[i] + d[j]
                if members:
                    i, j, slack = i[slack > 0], j[slack > 0], slack[slack > 0]
                if not len(i):
                    continue
                if members:
                    i, j = np.where(ids[i] > ids[j], j, i), np.where(ids[i] > ids[j], i, j)
                    _, at = np.unique(np.stack([ids[i], ids[j]], axis=1), axis=0, return_index=True)
                    i, j = i[at], j[at]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[i], ids[j], centre[i], centre[j], slack[at])], names=["a", "b", "ca", "cb", "slack"])
                else:
                    pair, at = np.unique(np.stack([np.minimum(centre[i], centre[j]), np.maximum(centre[i], centre[j])], axis=1), axis=0, return_inverse=True)
                    most = np.zeros(len(pair))
                    np.maximum.at(most, at.ravel(), slack)
                    met = np.bincount(at.ravel(), weights=np.where(share > 1, 1, SHARE)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1]), pa.array(most), pa.array(met)], names=["a", "b", "slack", "met"])

    dealt = _gridded(lists.select("token", "place", "id", "centre", "d", *_BITS)).select("token", "place", "id", "centre", "d", "side", *_BITS)
    dealt = dealt.repartition(n_parts, "token").sortWithinPartitions("token", "place")
    return dealt.mapInArrow(run, "a bigint, b bigint, ca bigint, cb bigint, slack double" if members else "a bigint, b bigint, slack double, met bigint")


def _measure(docs: DataFrame, pairs: DataFrame, text: str, key: str, n: int) -> DataFrame:
    """(a, b, common, size_a, size_b) of pairs of ids, by their whole sets: the
    sets of documents in a pair are shuffled, once for each centre they meet."""
    spark = docs.sparkSession
    pairs = cut(pairs)
    ends = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    ends = cut(ends)
    log2 = bits.size_for(ends.count())
    table = spark.sparkContext.broadcast(bits.build(ends, "id", log2))

    def sets(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            id_ = batch.column(0).cast(pa.int64())
            known = np.asarray(id_.is_valid())
            hit = known & bits.holds(table.value, np.asarray(id_.fill_null(0)), log2)
            part = batch.filter(pa.array(hit))
            for i in range(0, part.num_rows, 256):
                p = part.slice(i, 256)
                got = [s.tobytes() for s in shingle_sets(p.column(1).to_pylist(), n)]
                yield pa.RecordBatch.from_arrays([p.column(0).cast(pa.int64()), pa.array(got, pa.binary())], names=["id", "elements"])

    found = cut(docs.select(key, text).mapInArrow(sets, "id bigint, elements binary").join(ends, "id", "left_semi").dropDuplicates(["id"]))
    first = found.select(F.col("id").alias("a"), F.col("elements").alias("x"))
    second = found.select(F.col("id").alias("b"), F.col("elements").alias("y"))

    def compare(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            common, sa, sb = [], [], []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), dtype=np.uint64), np.frombuffer(y.as_buffer(), dtype=np.uint64)
                common.append(len(np.intersect1d(x, y, assume_unique=True)))
                sa.append(len(x))
                sb.append(len(y))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(common, pa.int32()), pa.array(sa, pa.int32()), pa.array(sb, pa.int32())], names=["a", "b", "common", "sa", "sb"])

    return pairs.join(first, "a").join(second, "b").select("a", "b", "x", "y").mapInArrow(compare, "a bigint, b bigint, common int, sa int, sb int")


def spread(edges: DataFrame) -> DataFrame:
    """(id, low) for ids in links (a, b): the smallest id of their component. By
    alternating large-star and small-star steps until nothing changes; stars are
    aggregates, combined before the shuffle."""
    edges = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct())
    before = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small_low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_low, "u")
        edges = cut(small.select("u", F.col("m").alias("v")).union(small.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))).where("u != v").distinct())
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.count_distinct("u")).first())
        if now == before or now[0] == now[2] and _flat(edges):
            return edges.select(F.col("u").alias("id"), F.col("v").alias("low"))
        before = now


def _flat(edges: DataFrame) -> bool:
    """Whether no root hangs below another: every document names its root."""
    return edges.join(edges.select(F.col("u").alias("v")), "v", "left_semi").limit(1).count() == 0


def links(docs: DataFrame, rows: DataFrame, percent: int, n: int, text: str, key: str, rarity) -> DataFrame:
    """(a, b): links that connect all documents that link; rows are profiles."""
    n_parts = max(2, parts(docs.sparkSession))
    classes = cut(rows.groupBy("same").agg(F.min("id").alias("rep"), F.first("size").alias("size"), F.first("m1").alias("m1"), F.first("m2").alias("m2"), F.first("sig").alias("sig"), *(F.first(b).alias(b) for b in _BITS)))
    copies = rows.select("same", F.col("id").alias("b")).join(classes.select("same", "rep", *_BITS), "same").select(F.col("rep").alias("a"), "b", *_BITS)
    copies = cut(copies)
    # centres: of the documents with the same minimum hash the one whose elements are most common
    # (the original of near copies has none of their changes), where sizes and signatures look alike
    entries = cut(_shared(_entries(docs, text, key, n, percent, rarity), n_parts))
    common = entries.where("place < 0").groupBy(F.col("id").alias("rep")).agg(F.min("place").alias("common"))
    classes = cut(classes.join(common, "rep"))
    alike = F.expr("size(filter(sequence(1, 16), i -> substring(sig, i, 1) = substring(csig, i, 1)))")
    stars = []
    for m in ("m1", "m2"):
        low = classes.groupBy(m).agg(F.min(F.struct("common", "rep", "size", "sig")).alias("c"), F.count(F.lit(1)).alias("k")).where("k > 1").select(m, F.col("c.rep").alias("a"), F.col("c.size").alias("csize"), F.col("c.sig").alias("csig"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        # many near copies of one text share a minimum: they are spread over salts
        star = classes.withColumn("salt", F.pmod(F.xxhash64("rep"), F.lit(SALTS)).cast("int")).join(low, [m, "salt"]).where(f"a != rep and 100L * least(size, csize) >= {percent}L * greatest(size, csize)")
        stars.append(star.where(alike >= 11).select("a", F.col("rep").alias("b")))
    linked = F.expr(f"100L * common >= {percent}L * (sa + sb - common)")
    far = 1 - F.col("common") / (F.col("sa") + F.col("sb") - F.col("common"))
    met = cut(_measure(docs, stars[0].union(stars[1]).distinct(), text, key, n))
    joined = met.where(linked).select("a", "b", far.alias("d"))
    own = joined.groupBy("b").agg(F.min(F.struct("d", "a")).alias("c")).select(F.col("b").alias("rep"), F.col("c.a").alias("centre"), F.col("c.d").alias("d"))
    place = copies.select(F.col("b").alias("id"), F.col("a").alias("rep"), *_BITS).join(own, "rep", "left").select("id", "rep", *_BITS, F.coalesce("centre", "rep").alias("centre"), F.coalesce("d", F.lit(0.0)).alias("d"))
    lists = cut(entries.where("place >= 0").join(place, "id").select("token", "place", F.col("rep").alias("id"), "centre", "d", *_BITS))
    pairs = cut(_visit(lists, percent, n_parts, False).groupBy("a", "b").agg(F.max("slack").alias("slack"), F.sum("met").alias("met")).where(f"met >= {SHARE}").drop("met"))
    either = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "common", "sa", "sb").dropDuplicates(["a", "b"])
    known = either.join(pairs.select("a", "b"), ["a", "b"], "left_semi")
    new = _measure(docs, pairs.select("a", "b").join(either, ["a", "b"], "left_anti"), text, key, n)
    settled = cut(new.unionByName(known).join(pairs, ["a", "b"]).withColumn("far", far))
    out = copies.where("a != b").select("a", "b").unionByName(joined.select("a", "b")).unionByName(settled.where(linked).select("a", "b"))
    # members: only where the triangle inequality leaves a link possible
    unsettled = cut(settled.where(~linked).where(f"far - slack <= {1 - percent / 100} + 1e-9").select(F.col("a").alias("x"), F.col("b").alias("y"), "far"))
    if unsettled.limit(1).count():
        ends = unsettled.select(F.col("x").alias("centre")).union(unsettled.select(F.col("y").alias("centre"))).distinct()
        open_ = _visit(lists.join(ends, "centre", "left_semi"), percent, n_parts, True).withColumns({"x": F.least("ca", "cb"), "y": F.greatest("ca", "cb")})
        open_ = cut(open_.join(unsettled, ["x", "y"]).where(f"far - slack <= {1 - percent / 100} + 1e-9").select("a", "b").distinct())
        if open_.limit(1).count():
            out = out.unionByName(_measure(docs, open_, text, key, n).where(linked).select("a", "b"))
    return out


def components(docs: DataFrame, percent: int = 90, n: int = 3, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs``."""
    spark = docs.sparkSession
    ship(spark)
    profiles = cut(_profiles(docs, text, key, n))
    rarity = spark.sparkContext.broadcast(_rarity(profiles))
    rows = profiles.where("block is null").drop("block", "counts")
    found = links(docs, rows.where("size > 0 and id is not null"), percent, n, text, key, rarity)
    low = spread(found)
    return rows.join(low, "id", "left").select(F.col("id").alias(key), F.col("size").cast("long").alias("n_shingles"), F.coalesce("low", "id").alias("component_id"))
