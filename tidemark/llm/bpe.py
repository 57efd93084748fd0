"""Operator 2: BPE encoding and decoding by content-defined chunk reuse.

Texts are cut where a rolling hash of the last eight bytes meets a mask, so the
same passage is cut alike in whichever document it stands. Every task encodes a
chunk once and reuses it for each later copy. A cut usually falls inside a word;
each join is therefore repaired: the pieces of the cut word are put together and
re-encoded, from the white space left of the join to the white space right of
it. As the tokenizer drops white space and never merges over it, the outcome
then agrees exactly with the encoding of the whole text. A tokenizer for which
that doesn't hold (checked by :func:`drops_space`) gets the whole-text encoding.

Reuse is per worker process, across its tasks and all documents they hold, within a
memory bound: sharing chunks between processes would shuffle the corpus and its ids
(figures: see README).

Nulls count as empty texts; empty texts have no ids. Long texts are encoded whole,
chunk by chunk. Repeated rows give repeated results, and an empty table an empty one;
ties don't arise. ``keep`` may name any columns but n_tokens, ids, decoded and the
digests, which are made here; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import batches, ship

#: Average chunk length is about 2**CHUNK_BITS bytes.
CHUNK_BITS = 8
#: Entries at which a task forgets its memo of words or chunks.
WORD_LIMIT, CHUNK_LIMIT = 300_000, 30_000


def load(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def drops_space(t) -> bool:
    """Whether white space separates words and leaves nothing in the ids."""
    e = lambda s: t.encode(s, add_special_tokens=False).ids
    return t.decoder is None and e("ab \n\t cd,\x0b\x0c\r!e") == e("ab") + e("cd,") + e("!e")


#: The configuration for which :meth:`WordMemo._plain` holds: fixed values.
_PLAIN_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_PLAIN_NORMALIZERS = ["NFC", "Replace", "Lowercase"]
#: Characters that normalisation leaves alone but for case: printable ASCII and the letters of Latin-1.
_PLAIN_WORD = re.compile("[\x21-\x7e\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
_PLAIN_PIECE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^a-z0-9\u00df-\u00f6\u00f8-\u00ff]+")


def _byte_letters() -> dict[int, str]:
    """Code point -> the letters that stand for its UTF-8 bytes in a byte-level
    vocabulary: printable bytes stand for themselves, the others follow from 256."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in own]
    letter = {b: chr(b) if b in own else chr(256 + rest.index(b)) for b in range(256)}
    return {c: "".join(letter[b] for b in chr(c).encode()) for c in range(256)}


class WordMemo(dict):
    """word as UTF-8 bytes -> (ids as little-endian uint32 bytes, tokens joined
    by blanks); without ``names``, the ids alone."""

    def __init__(self, t, names: bool = True, limit: int = WORD_LIMIT):
        super().__init__()
        self.t, self.limit, self.pieces = t, limit, {}
        self.names: dict[int, str] | None = {} if names else None
        conf = json.loads(t.to_str())
        try:
            pre = conf["pre_tokenizer"]["pretokenizers"]
            self.plain = [x["type"] for x in conf["normalizer"]["normalizers"]] == _PLAIN_NORMALIZERS and pre[0]["pattern"] == {"Regex": _PLAIN_PATTERN} and pre[0]["invert"] and [x["type"] for x in pre] == ["Split", "ByteLevel"] and not pre[1]["add_prefix_space"] and not pre[1]["use_regex"] and all(x["content"][:2] == "<|" for x in conf["added_tokens"])
        except (KeyError, TypeError, IndexError):
            self.plain = False
        self.letters, self.model = _byte_letters(), t.model

    def __missing__(self, word: bytes):
        if len(self) >= self.limit:
            self.clear()
        text = word.decode()
        if self.plain and _PLAIN_WORD.fullmatch(text) and "<|" not in text:
            parts = [self._plain(p) for p in _PLAIN_PIECE.findall(text.lower())]
            found = parts[0] if len(parts) == 1 else (b"".join([p[0] for p in parts]), " ".join([p[1] for p in parts])) if self.names is not None else b"".join(parts)
        else:
            found = self._entry(self.t.encode(text, add_special_tokens=False).ids)
        self[word] = found
        return found

    def _plain(self, piece: str):
        """One pre-token of plain characters, straight from the library's model."""
        found = self.pieces.get(piece)
        if found is None:
            if len(self.pieces) >= self.limit:
                self.pieces.clear()
            self.pieces[piece] = found = self._entry([k.id for k in self.model.tokenize(piece if piece.isascii() else piece.translate(self.letters))])
        return found

    def _entry(self, ids):
        raw = array("I", ids).tobytes() if sys.byteorder == "little" else np.asarray(ids, dtype="<u4").tobytes()
        if self.names is None:
            return raw
        for i in ids:
            if i not in self.names:
                self.names[i] = self.t.id_to_token(i)
        return raw, " ".join([self.names[i] for i in ids])

    def ids(self, text: str) -> bytes:
        """The ids of a whole text as little-endian uint32 bytes (``names`` off)."""
        return b"".join(map(self.__getitem__, text.encode("utf-8", "replace").split()))


_memos: dict[tuple[str, bool], WordMemo] = {}


def shared_memo(path: str, names: bool) -> WordMemo:
    """The worker process's memo for a tokenizer file: it outlives a task."""
    found = _memos.get((path, names))
    if found is None:
        _memos[path, names] = found = WordMemo(load(path), names)
    return found


def cut_points(data: bytes) -> list[int]:
    """Content-defined cuts: offsets after which a chunk ends, on character
    boundaries. They depend on the eight bytes before them alone."""
    n = len(data)
    if n < 16:
        return []
    buf = np.frombuffer(data, dtype=np.uint8)
    window = np.zeros(n - 7, dtype=np.uint64)
    for k in range(8):
        window |= buf[k : n - 7 + k].astype(np.uint64) << np.uint64(8 * k)
    rolled = (window * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - CHUNK_BITS)
    at = np.flatnonzero(rolled == 0) + 8
    at = at[at < n]
    return at[(buf[at] & 0xC0) != 0x80].tolist()


_encoders: dict[str, ChunkEncoder] = {}


def shared_encoder(path: str) -> ChunkEncoder:
    """The worker process's encoder for a tokenizer file: its chunks outlive a task."""
    found = _encoders.get(path)
    if found is None:
        _encoders[path] = found = ChunkEncoder(path)
    return found


class ChunkEncoder:
    """Encodes and decodes texts through a memo of chunks and one of words."""

    def __init__(self, path: str):
        self.words = shared_memo(path, True)
        self.t = self.words.t
        self.exact = drops_space(self.t)
        self.chunks: dict[bytes, tuple] = {}
        self.reused = self.seen = 0

    def _chunk(self, piece: bytes) -> tuple:
        """(fragment before the first white space, ids and tokens of the whole
        words, fragment after the last white space); without any white space
        the first item is None and the last is the chunk."""
        words = piece.split()
        head = b"" if piece[:1].isspace() else words.pop(0) if words else b""
        if head == piece:
            return None, b"", "", piece
        tail = b"" if piece[-1:].isspace() or not words else words.pop()
        got = list(map(self.words.__getitem__, words))
        return head, b"".join([g[0] for g in got]), " ".join([g[1] for g in got if g[1]]), tail

    def encode(self, text: str) -> tuple[bytes, str]:
        """The ids (little-endian uint32 bytes) and the decoded text."""
        if not self.exact:
            ids = self.t.encode(text, add_special_tokens=False).ids
            return np.asarray(ids, dtype="<u4").tobytes(), self.t.decode(ids, skip_special_tokens=False)
        data = text.encode("utf-8", "replace")
        cuts = [0, *cut_points(data), len(data)]
        ids, said, torn, memo, words = [], [], b"", self.chunks, self.words
        self.seen += len(cuts) - 1
        for a, b in zip(cuts, cuts[1:]):
            piece = data[a:b]
            c = memo.get(piece)
            if c is None:
                if len(memo) >= CHUNK_LIMIT:
                    memo.clear()
                memo[piece] = c = self._chunk(piece)
            else:
                self.reused += 1
            head, inner, tokens, tail = c
            if head is None:
                torn += tail
                continue
            if torn or head:  # the join, repaired
                w = words[torn + head]
                ids.append(w[0])
                if w[1]:
                    said.append(w[1])
            if inner:
                ids.append(inner)
                said.append(tokens)
            torn = tail
        if torn:
            w = words[torn]
            ids.append(w[0])
            if w[1]:
                said.append(w[1])
        return b"".join(ids), " ".join(said)


def encode_documents(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), digests: bool = False) -> DataFrame:
    """The columns ``keep``, n_tokens, and ids (array of ints) and decoded text,
    or with ``digests`` their SHA-256 only, for every row of ``docs``."""
    ship(docs.sparkSession)
    src = docs.select(*keep, docs[text].alias("__text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    out = "ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string"

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = shared_encoder(path)
        for batch in it:
            column = batch.column(len(keep))
            for a, b in batches(texts := column.to_pylist()):
                got = [enc.encode(x or "") for x in texts[a:b]]
                n = [len(g[0]) // 4 for g in got]
                if digests:
                    cols = [[hashlib.sha256(g[0]).hexdigest() for g in got], [hashlib.sha256(g[1].encode()).hexdigest() for g in got]]
                    types = [pa.string(), pa.string()]
                else:
                    cols = [[np.frombuffer(g[0], dtype="<i4").tolist() for g in got], [g[1] for g in got]]
                    types = [pa.list_(pa.int32()), pa.string()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(i).slice(a, b - a) for i in range(len(keep))] + [pa.array(n, pa.int64()), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))],
                    names=[*keep, "n_tokens", *(("ids_sha256", "decoded_sha256") if digests else ("ids", "decoded"))],
                )

    return src.mapInArrow(run, f"{kinds}, n_tokens bigint, {out}")
