"""Operator 1: exact dedup against a history of digests held in minimal perfect
hashes.

History is a set of distinct SHA-256 digests, each with its winner (largest id
so far) and its number of rows. It is split into shards by the first bits of the
digest; each shard holds a minimal perfect hash over its digests (levels of bit
arrays: a key takes the first level where its position is its own, and the rank
of that bit is its slot) and slots with the full digests and winner locators.
Incoming rows are pre-aggregated by digest and looked up: a slot always answers,
so the full 32 bytes are compared before the row counts as a repeat. Digests
that aren't members form their own groups, and together with the updated winners
they are the history of the next run (:func:`dedup` returns it as its second
frame).

Nothing but (id, digest) pairs is shuffled. Digests spread evenly over shards
however many copies a text has, as copies are combined before the shuffle; the
last join, of rows with their group, is left to Spark's split of skewed joins.

Nulls count as empty texts; long texts are digested whole. A null id is smaller
than any other; among equal rows with the same id exactly the rows with the kept id
stay, so repeated ids stay together (a tie). Empty tables give empty results, with
or without a history. Of the table only the id and the text are read, and the result
has its own columns, so clashing names of others do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import U64, cut, mix, parts, ship

#: Digests in one shard of the history, about.
SHARD = 65_536
_GAMMA = 1.5


def _keys(digests: list[bytes]) -> np.ndarray:
    """n x 4 words of the digests."""
    return np.frombuffer(b"".join(digests), dtype="<u8").reshape(-1, 4)


class PerfectHash:
    """A minimal perfect hash over 32-byte digests (distinct)."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.ranks, done = [], 0
        for bits in levels:
            before = np.cumsum(bits) - bits + done
            self.ranks.append(before)
            done += int(bits.sum())
        self.size = done

    @staticmethod
    def _at(words: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(words[:, level % 4] + U64((level + 1) * 0x9E3779B97F4A7C15 % 2**64)) % U64(size)).astype(np.int64)

    @classmethod
    def build(cls, words: np.ndarray) -> PerfectHash:
        if len(words) != len(np.unique(np.ascontiguousarray(words).view("V32"))):
            raise ValueError("digests must be distinct")
        levels, left = [], words
        while len(left):
            size = max(8, int(len(left) * _GAMMA))
            at = cls._at(left, len(levels), size)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            left = left[~alone[at]]
        return cls(levels)

    def slot(self, words: np.ndarray) -> np.ndarray:
        """A slot for each key; for keys outside the set any slot, or -1."""
        out = np.full(len(words), -1, dtype=np.int64)
        left = np.arange(len(words))
        for k, bits in enumerate(self.levels):
            if not len(left):
                break
            at = self._at(words[left], k, len(bits))
            hit = bits[at]
            out[left[hit]] = self.ranks[k][at[hit]]
            left = left[~hit]
        return out

    def dump(self) -> list[bytes]:
        return [len(b).to_bytes(8, "little") + np.packbits(b).tobytes() for b in self.levels]

    @classmethod
    def load(cls, blobs) -> PerfectHash:
        return cls([np.unpackbits(np.frombuffer(b[8:], dtype=np.uint8), count=int.from_bytes(b[:8], "little")).astype(bool) for b in blobs])


def _shard(digest, n: int):
    """Shard of a digest: its first four bytes, modulo n."""
    return F.pmod(F.conv(F.hex(F.substring(digest, 1, 4)), 16, 10).cast("long"), F.lit(n)).cast("int")


def digests(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, digest): the SHA-256 of every whole text."""
    return docs.select(F.col(key).alias("id"), F.unhex(F.sha2(F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8"), 256)).alias("digest"))


def grouped(rows: DataFrame) -> DataFrame:
    """(digest, winner, n) of (id, digest) rows; combined before the shuffle."""
    return rows.groupBy("digest").agg(F.max("id").alias("winner"), F.count(F.lit(1)).alias("n"))


def build_index(history: DataFrame, n_shards: int) -> DataFrame:
    """One row a shard: its perfect hash, and its slots' digests, winners and
    counts, of distinct (digest, winner, n) rows."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        found = pdf["digest"].tolist()
        h = PerfectHash.build(words := _keys(found))
        order = np.argsort(h.slot(words))
        has = pdf["winner"].notna().to_numpy()[order]
        return pd.DataFrame({
            "shard": [int(pdf["shard"].iloc[0])], "levels": [h.dump()], "slots": [words[order].tobytes()],
            "winners": [pdf["winner"].fillna(0).astype("int64").to_numpy()[order].tobytes()], "known": [np.packbits(has).tobytes()], "counts": [pdf["n"].astype("int64").to_numpy()[order].tobytes()],
        })

    return history.withColumn("shard", _shard(F.col("digest"), n_shards)).groupBy("shard").applyInPandas(build, "shard int, levels array<binary>, slots binary, winners binary, known binary, counts binary")


_CLASS = "digest binary, winner bigint, n bigint, member boolean"


def look_up(incoming: DataFrame, index: DataFrame, n_shards: int) -> DataFrame:
    """(digest, winner, n, member) of incoming (digest, winner, n): repeats of
    the history with its winner and count taken in, nonmembers as they are; and
    what of the history no incoming row repeats."""

    def probe(_key, new: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
        has_new, has_old = len(new) > 0, len(old) > 0
        outs = []
        taken = None
        if has_old:
            row = old.iloc[0]
            h = PerfectHash.load(row["levels"])
            slots = np.frombuffer(row["slots"], dtype="<u8").reshape(-1, 4)
            winners = np.frombuffer(row["winners"], dtype=np.int64)
            known = np.unpackbits(np.frombuffer(row["known"], dtype=np.uint8), count=h.size).astype(bool)
            counts = np.frombuffer(row["counts"], dtype=np.int64)
            taken = np.zeros(h.size, dtype=bool)
        if has_new:
            words = _keys(new["digest"].tolist())
            member = np.zeros(len(new), dtype=bool)
            n = new["n"].astype("int64").to_numpy().copy()
            own = new["winner"].notna().to_numpy().copy()
            w = new["winner"].fillna(0).astype("int64").to_numpy().copy()
            if has_old:
                slot = h.slot(words)
                member = (slot >= 0) & (slots[slot] == words).all(axis=1)
                at = slot[member]
                taken[at] = True
                n[member] += counts[at]
                a, b = own[member], known[at]
                w[member] = np.where(a & b, np.maximum(w[member], winners[at]), np.where(b, winners[at], w[member]))
                own[member] = a | b
            outs.append(pd.DataFrame({"digest": new["digest"], "winner": pd.array(np.where(own, w, 0), dtype="Int64"), "n": n, "member": member}).assign(winner=lambda d: d["winner"].mask(~own)))
        if has_old and not taken.all():
            rest = np.flatnonzero(~taken)
            outs.append(pd.DataFrame({"digest": [slots[i].tobytes() for i in rest], "winner": pd.array(winners[rest], dtype="Int64"), "n": counts[rest], "member": True}).assign(winner=lambda d: d["winner"].mask(~known[rest])))
        return pd.concat(outs) if outs else pd.DataFrame({"digest": [], "winner": pd.array([], dtype="Int64"), "n": [], "member": []})

    return incoming.withColumn("shard", _shard(F.col("digest"), n_shards)).groupBy("shard").cogroup(index.groupBy("shard")).applyInPandas(probe, _CLASS)


def dedup(docs: DataFrame, history: DataFrame | None = None, text: str = "text", key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(rows, classes) of ``docs`` given ``history`` (digest, winner, n).

    rows: id, digest, keep_id, group_size, kept, each row of docs once; classes:
    the history including docs. A history's repeated digests are put together. Without a history, the first half of the ids (up
    to the middle of their range) is taken as the past and the rest as incoming.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = digests(docs, text, key)
    if history is None:
        low, high = docs.agg(F.min(key), F.max(key)).first()
        middle = (low + high) // 2 if low is not None else 0
        history = grouped(rows.where(F.col("id") <= middle))
        incoming = grouped(rows.where(F.col("id").isNull() | (F.col("id") > middle)))
    else:
        history = history.groupBy("digest").agg(F.max("winner").alias("winner"), F.sum("n").alias("n"))
        incoming = grouped(rows)
    n = max(1, docs.count() // SHARD, parts(spark) // 2)
    classes = cut(look_up(incoming, build_index(history.select("digest", "winner", "n"), n), n))
    out = rows.join(classes.select("digest", "winner", "n"), "digest")
    keep = F.col("winner")
    out = out.select("id", "digest", keep.alias("keep_id"), F.col("n").alias("group_size"), F.col("id").eqNullSafe(keep).alias("kept"))
    return out, classes.select("digest", "winner", "n")
