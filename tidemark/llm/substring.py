"""Operator 6: removal of repeated passages by repeated-phrase automata.

A window is ``width`` consecutive words; a word goes if any window over it
stands, word for word, anywhere else as well.

1. *Recurring phrases.* Each window names the phrase of ``PHRASE`` words in it
   with the smallest hash, so equal windows name equal phrases. Windows in a row
   that name the same place form a *region*. Phrases named by two regions or more
   are kept as a bit table of bounded size, which spares most other regions the
   way; beyond its bound it lets more of them through, and results stay the same.
2. *Confirming.* Regions whose phrase recurs are written out once, and equal ones
   are counted. Their windows are counted by a 128-bit digest of their words, over
   all regions; of each window that stands twice or more one place is kept. These
   are aggregates, combined before the shuffle: a window or a phrase that very many
   regions share is no group anywhere. Runs of the kept places are the passages.
3. *Automata.* Passages and all regions that name their phrases are dealt by
   phrase to shards; a phrase with more than ``HOT`` passages or regions is dealt in
   a grid, so that none is a group. Each shard compiles one Aho-Corasick automaton,
   over words, of all windows of its passages, and the regions stream through it:
   what goes is what it locates, word for word, in each of them.
4. *Removal.* Located spans are gathered by document, and only documents with
   spans are shuffled.

A document is streamed as its regions, and through the automata of its phrases
alone: streaming it through all of them would cost documents times shards.

Null and empty texts have no words; texts shorter than the window are kept whole;
long ones are read to their end. Rows are told apart by id and text, so null and
repeated ids are no hindrance; equal rows count as repeats of each other. An empty
table gives an empty result. Columns are taken by name from the table alone, and
those made on the way can't clash with them: ``keep`` may name any of its columns
but n_words, n_removed, kept, original and kept_sha256.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bits
from .common import U64, Words, batches, cut, mix, parts, run_hash, ship

PHRASE = 12
#: Regions that stream through one shard's automaton, about, and regions or passages of
#: one phrase in a shard. Small automata are far faster: the search for a letter below
#: the root takes time in proportion to how many there are.
AUTOMATON, HOT = 64, 512
_BLANK = re.compile(b" ")


def sliding_hash(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive entries (len(h) - n + 1 of them)."""
    start = np.arange(max(0, len(h) - n + 1))
    return run_hash(h, start, start + n)


def second(h: np.ndarray) -> np.ndarray:
    """Other hashes of the same words, for digests of 128 bits."""
    return mix(h ^ U64(0xA0761D6478BD642F))


def sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """Minimum of each n consecutive entries."""
    size, out = 1, x
    while size < n:
        step = min(size, n - size)
        out = np.minimum(out[:-step], out[step:])
        size += step
    return out


def regions(w: Words, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text number, first word, windows, phrase hash) of each region."""
    h, k = w.hash, min(PHRASE, width)
    none = np.zeros(0, dtype=np.int64)
    if len(h) < width:
        return none, none, none, none.astype(np.uint64)
    gram = sliding_hash(h, k)
    place = np.arange(len(gram), dtype=np.uint64)
    low = sliding_min((gram & ~U64(0xFFFFFF)) | (place & U64(0xFFFFFF)), width - k + 1)
    start = np.arange(len(low), dtype=np.int64)
    doc = np.searchsorted(w.first, start, side="right") - 1
    fits = start + width <= w.first[doc + 1]
    at = start + (((low & U64(0xFFFFFF)).astype(np.int64) - start) & 0xFFFFFF)
    start, doc, at = start[fits], doc[fits], at[fits]
    if not len(start):
        return none, none, none, none.astype(np.uint64)
    new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])]))
    return doc[new], start[new], np.diff(np.append(new, len(start))), gram[at[new]]


def _phrases(docs: DataFrame, text: str, width: int) -> DataFrame:
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for a, b in batches(texts := batch.column(0).to_pylist()):
                p, n = np.unique(regions(Words(texts[a:b]), width)[3], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(p.view(np.int64)), pa.array(n, pa.int64())], names=["phrase", "n"])

    return docs.select(text).mapInArrow(run, "phrase bigint, n bigint")


def _regions(docs: DataFrame, text: str, key: str, width: int, table, log2: int) -> DataFrame:
    kind = docs.schema[key].dataType.simpleString()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in it:
            texts = batch.column(2).to_pylist()
            for a, b in batches(texts):
                w = Words([b" ".join((t or "").encode("utf-8", "replace").split()) for t in texts[a:b]])
                doc, first, n, phrase = regions(w, width)
                hit = bits.holds(table.value, phrase, log2)
                doc, first, n, phrase = doc[hit], first[hit], n[hit], phrase[hit]
                stop = first + n + width - 1
                r1, r2 = run_hash(w.hash, first, stop), run_hash(second(w.hash), first, stop)
                said: list[bytes | None] = [None] * len(r1)
                _, at, same = np.unique(r1, return_index=True, return_inverse=True)
                at = np.concatenate([at, np.flatnonzero(r2 != r2[at][same])])  # the latter: equal in half the digest only
                for k, i, x, y in zip(zip(r1[at].tolist(), r2[at].tolist(), strict=True), at.tolist(), w.start[first[at]].tolist(), w.end[stop[at] - 1].tolist(), strict=True):
                    if k not in seen:
                        seen.add(k)
                        said[i] = w.raw[x:y]
                if len(seen) > 150_000:
                    seen.clear()
                at = pa.array(a + doc)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(at), batch.column(1).take(at), pa.array((first - w.first[doc]).astype(np.int32)), pa.array(phrase.view(np.int64)), pa.array(r1.view(np.int64)), pa.array(r2.view(np.int64)), pa.array(said, pa.binary())],
                    names=["k1", key, "first", "phrase", "r1", "r2", "words"],
                )

    return docs.select(F.xxhash64(text).alias("k1"), key, text).mapInArrow(run, f"k1 bigint, `{key}` {kind}, first int, phrase bigint, r1 bigint, r2 bigint, words binary")


def _windows(rows: DataFrame, width: int) -> DataFrame:
    """(h1, h2, stands, rid, place) of the windows of each distinct region."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            texts = batch.column(1).to_pylist()
            for a, b in batches(texts, 2000):
                w = Words(texts[a:b])
                h = w.hash
                one, two = sliding_hash(h, width), sliding_hash(second(h), width)
                n = np.maximum(np.diff(w.first) - width + 1, 0)
                place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                at = np.repeat(w.first[:-1], n) + place
                who = pa.array(np.repeat(np.arange(a, b), n))
                yield pa.RecordBatch.from_arrays([pa.array(one[at].view(np.int64)), pa.array(two[at].view(np.int64)), batch.column(2).take(who), batch.column(0).take(who), pa.array(place.astype(np.int32))], names=["h1", "h2", "stands", "rid", "place"])

    return rows.select("rid", "words", "stands").mapInArrow(run, "h1 bigint, h2 bigint, stands bigint, rid bigint, place int")


def _passages(rows: DataFrame, width: int) -> DataFrame:
    """(phrase, words): the runs of windows that ``mask`` marks in each region."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            phrase, said = [], []
            for p, text, mask in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                words, place = text.split(b" "), 0
                while place <= len(words) - width:
                    if mask >> place & 1:
                        stop = place
                        while stop < len(words) - width and mask >> (stop + 1) & 1:
                            stop += 1
                        phrase.append(p)
                        said.append(b" ".join(words[place : stop + width]))
                        place = stop
                    place += 1
            yield pa.RecordBatch.from_arrays([pa.array(phrase, pa.int64()), pa.array(said, pa.binary())], names=["phrase", "words"])

    return rows.select("phrase", "words", "mask").mapInArrow(run, "phrase bigint, words binary")


def _locate(rows: DataFrame, width: int) -> DataFrame:
    """(r1, r2, a, b): the spans of words that the automata find, of rows (shard,
    r1, r2, words) in order of shard; rows without r1 are passages, and come first."""

    step = next(g for g in range(8, 0, -1) if width % g == 0)

    def grams(text: bytes) -> list[bytes]:
        """Each run of ``step`` words of a text."""
        at = [0, *[m.end() for m in _BLANK.finditer(text)], len(text) + 1]
        return [text[x : y - 1] for x, y in zip(at, at[step:])]

    def machine_of(passages: list[bytes]):
        import ahocorasick

        known: dict[bytes, int] = {}
        machine = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        for p in passages:
            ids = [known.setdefault(x, len(known) + 1) for x in grams(p)]
            for k in range(len(ids) - width + step):
                machine.add_word(tuple(ids[k : k + width : step]), 1)
        machine.make_automaton()
        return machine, known

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, passages, machine, known = None, [], None, {}
        for batch in it:
            found, first, last = [], [], []
            for i, (shard, r, text) in enumerate(zip(*(batch.column(i).to_pylist() for i in (0, 1, 3)), strict=True)):
                if shard != now:
                    now, passages, machine = shard, [], None
                if r is None:
                    passages.append(text)
                    continue
                if machine is None:
                    if not passages:
                        continue
                    machine, known = machine_of(passages)
                ids = list(map(known.get, grams(text), repeat(0)))
                if not any(ids):
                    continue
                met = sorted(p + step * (end + 1) - width for p in range(step) for end, _ in machine.iter(tuple(ids[p::step])))
                b = -1
                for a in met:
                    if a > b:
                        found.append(i)
                        first.append(a)
                        last.append(0)
                    b = last[-1] = a + width
            if found:
                at = pa.array(found)
                yield pa.RecordBatch.from_arrays([batch.column(1).take(at), batch.column(2).take(at), pa.array(first, pa.int32()), pa.array(last, pa.int32())], names=["r1", "r2", "a", "b"])

    return rows.select("shard", "r1", "r2", "words").mapInArrow(run, "r1 bigint, r2 bigint, a int, b int")


def _deal(passages: DataFrame, regions: DataFrame, n_shards: int, n_parts: int) -> DataFrame:
    """(shard, r1, r2, words) in order of shard, passages (r1 null) first. A hot
    phrase lies in a grid of pieces of its passages and pieces of its regions."""
    sizes = passages.groupBy("phrase").agg(F.count(F.lit(1)).alias("k")).join(regions.groupBy("phrase").agg(F.count(F.lit(1)).alias("m")), "phrase")
    grid = cut(sizes.select("phrase", F.ceil(F.col("k") / HOT).cast("int").alias("across"), F.ceil(F.col("m") / HOT).cast("int").alias("down")))
    hot = cut(grid.where("across > 1 or down > 1"))
    one = F.lit(1)
    placed = lambda df: df.join(hot, "phrase", "left").withColumns({"across": F.coalesce("across", one), "down": F.coalesce("down", one)})
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    deal = lambda text, n: F.pmod(F.xxhash64(text), F.col(n)).cast("int")
    left = placed(passages).select("phrase", F.lit(None).cast("bigint").alias("r1"), F.lit(None).cast("bigint").alias("r2"), "words", deal("words", "across").alias("i"), every("down").alias("j"))
    right = placed(regions.join(grid.select("phrase"), "phrase", "left_semi")).select("phrase", "r1", "r2", "words", every("across").alias("i"), deal("r1", "down").alias("j"))
    both = left.unionByName(right).select(F.pmod(F.xxhash64("phrase", "i", "j"), F.lit(n_shards)).cast("int").alias("shard"), "r1", "r2", "words")
    return both.repartitionById(n_parts, F.col("shard") % n_parts).sortWithinPartitions("shard", F.asc_nulls_first("r1"))


def repeated_spans(docs: DataFrame, width: int = 35, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(k1, key, spans): for texts (by id and xxhash64 of the text) with repeated
    windows, the [from, to) ranges of their words, in any order."""
    spark = docs.sparkSession
    ship(spark)
    if not 2 <= width <= 64:
        raise ValueError("width must be 2 to 64 words")
    recurring = cut(_phrases(docs, text, width).groupBy("phrase").agg(F.sum("n").alias("n")).where("n >= 2").select("phrase"))
    log2 = bits.size_for(recurring.count())
    table = spark.sparkContext.broadcast(bits.build(recurring, "phrase", log2))
    found = cut(_regions(docs, text, key, width, table, log2))
    distinct = found.groupBy("r1", "r2").agg(F.count(F.lit(1)).alias("stands"), F.max("phrase").alias("phrase"), F.max("words").alias("words"))
    distinct = cut(distinct.withColumn("rid", F.monotonically_increasing_id()))
    places = _windows(distinct, width).groupBy("h1", "h2").agg(F.sum("stands").alias("stands"), F.min("rid").alias("rid"), F.min_by("place", "rid").alias("place")).where("stands >= 2")
    masks = places.groupBy("rid").agg(F.expr("bit_or(shiftleft(1L, place))").alias("mask"))
    passages = cut(_passages(distinct.join(masks, "rid"), width))
    n_shards = max(1, distinct.count() // AUTOMATON)
    located = _locate(_deal(passages, distinct, n_shards, min(n_shards, 4 * parts(spark))), width)
    spans = found.select("k1", key, "first", "r1", "r2").join(located, ["r1", "r2"]).select("k1", key, F.struct((F.col("a") + F.col("first")).alias("a"), (F.col("b") + F.col("first")).alias("b")).alias("span"))
    return spans.groupBy("k1", key).agg(F.collect_set("span").alias("spans"))


def remove_repeats(docs: DataFrame, width: int = 35, text: str = "text", key: str = "doc_id", keep: tuple[str, ...] | None = None, digests: bool = False) -> DataFrame:
    """The columns ``keep`` (the id), n_words, n_removed, and kept (the words left,
    joined by blanks) and original, or with ``digests`` kept_sha256."""
    spark = docs.sparkSession
    keep = keep or (key,)
    spans = cut(repeated_spans(docs, width, text, key))
    log2 = bits.size_for(spans.count())
    table = spark.sparkContext.broadcast(bits.build(spans, "k1", log2))
    src = docs.select(*keep, F.xxhash64(text).alias("__k1"), F.col(text).alias("__text"))
    tail = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())] + ([T.StructField("kept_sha256", T.StringType())] if digests else [T.StructField("kept", T.StringType()), T.StructField("original", T.StringType())])
    names = [*keep, *(f.name for f in tail)]
    head = list(src.schema.fields[: len(keep)])

    def outcome(columns, texts, spans) -> pa.RecordBatch:
        total, removed, kept = [], [], []
        for t, s in zip(texts, spans, strict=True):
            words = (t or "").encode("utf-8", "replace").split(None) if t else []
            gone = np.zeros(len(words) + 1, dtype=np.int64)
            for x in s or ():
                gone[x["a"]] += 1
                gone[x["b"]] -= 1
            stay = np.cumsum(gone)[:-1] == 0
            left = [w for w, k in zip(words, stay.tolist(), strict=True) if k] if s else words
            total.append(len(words))
            removed.append(len(words) - len(left))
            left = b" ".join(left)
            kept.append(hashlib.sha256(left).hexdigest() if digests else left.decode())
        rest = [pa.array(kept, pa.string())] if digests else [pa.array(kept, pa.string()), pa.array(texts, pa.string())]
        return pa.RecordBatch.from_arrays([*columns, pa.array(total, pa.int64()), pa.array(removed, pa.int64()), *rest], names=names)

    def first(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts that may have spans, by the table, pass on; others are done."""
        k = len(keep)
        for batch in it:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                hit = bits.holds(table.value, part.column(k).to_numpy(zero_copy_only=False), log2)
                done, wait = part.filter(pa.array(~hit)), part.filter(pa.array(hit))
                out = outcome(done.columns[:k], done.column(k + 1).to_pylist(), [None] * done.num_rows)
                yield pa.RecordBatch.from_arrays([*out.columns, done.column(k), pa.nulls(done.num_rows, pa.string()), pa.array([False] * done.num_rows, pa.bool_())], names=[*names, "__k1", "__text", "__wait"])
                blank = [pa.nulls(wait.num_rows, out.schema.field(j).type) for j in range(k, len(names))]
                yield pa.RecordBatch.from_arrays([*wait.columns[:k], *blank, wait.column(k), wait.column(k + 1), pa.array([True] * wait.num_rows, pa.bool_())], names=[*names, "__k1", "__text", "__wait"])

    def second(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(keep)
        for batch in it:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                wait = part.column(len(names) + 1)
                done, held = part.filter(pc.invert(wait)), part.filter(wait)
                yield pa.RecordBatch.from_arrays(done.columns[: len(names)], names=names)
                yield outcome(held.columns[:k], held.column(len(names)).to_pylist(), held.column(len(names) + 2).to_pylist())

    mid = T.StructType([*head, *tail, T.StructField("__k1", T.LongType()), T.StructField("__text", T.StringType()), T.StructField("__wait", T.BooleanType())])
    both = src.mapInArrow(first, mid)
    spans = spans.withColumnsRenamed({"k1": "__s1", key: "__key"})
    met = both.join(spans, (both["__k1"] == spans["__s1"]) & both[key].eqNullSafe(spans["__key"]), "left")
    return met.select(*names, "__text", "__wait", "spans").mapInArrow(second, T.StructType([*head, *tail]))
