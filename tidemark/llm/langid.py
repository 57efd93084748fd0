"""Operator 3: language identification by Viterbi over the words of a text.

A model is learned from labelled texts: the counts of words and of letter
trigrams (with word edges) in each language, and the scripts each language is
written in. A text's words are scored in two steps: the script of their letters
narrows the candidate languages, and each candidate gets the mean log-probability
of the word's trigrams plus the smoothed log-odds of the word itself. Viterbi
finds the cheapest labelling of the words where every switch of language costs a
penalty, so spans of a mixed text keep labels of their own; the language with
the most letters in the labelling is the prediction and its share of the letters,
weighed by how clearly its words are its own, is the score.

Bounded sample: at most ``sample`` labelled texts, those with the smallest hash
of their id, whole, as far as they keep within ``size`` bytes together. Every
whole text is labelled, in one map without a shuffle.

Texts that are null or empty or have no letter get ``und``, 0. Long texts are
labelled word by word to their end, a word of any length by all its trigrams.
Ties go to the language that is first by name; repeated rows get the same label.
An empty table gives an empty result, and a table without labelled texts a model
whose one language is ``und``. Rows with a null id are labelled, but teach
nothing. Only the columns named are read or returned, so clashing names of
others do no harm.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SAMPLE_BYTES, batches, hash_sample, ship, whole_texts

#: Cost of a switch of language between two words, in nats.
SWITCH = 6.0
#: Words kept for each language, and entries of a task's memo of word scores.
VOCABULARY, MEMO = 20_000, 200_000
_WORD = re.compile(r"[^\W\d_]+")
#: Ranges of code points of scripts: fixed values.
SCRIPTS = {
    "Latin": [(0x41, 0x24F), (0x1E00, 0x1EFF)],
    "Greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "Cyrillic": [(0x400, 0x52F)],
    "Armenian": [(0x530, 0x58F)],
    "Hebrew": [(0x590, 0x5FF)],
    "Arabic": [(0x600, 0x6FF), (0x750, 0x77F)],
    "Devanagari": [(0x900, 0x97F)],
    "Thai": [(0xE00, 0xE7F)],
    "Georgian": [(0x10A0, 0x10FF)],
    "Hangul": [(0x1100, 0x11FF), (0xAC00, 0xD7AF)],
    "Kana": [(0x3040, 0x30FF)],
    "Han": [(0x3400, 0x9FFF), (0x20000, 0x2FA1F)],
}
_NAMES = list(SCRIPTS)


def script(word: str) -> int:
    """Number of the script of the word's first letter; -1: none listed."""
    c = ord(word[0])
    return next((k for k, name in enumerate(_NAMES) if any(a <= c <= b for a, b in SCRIPTS[name])), -1)


def words(text: str) -> list[str]:
    """Runs of letters, in lower case. Digits that aren't decimal (fractions,
    raised or circled ones) are no letters, though the pattern lets them pass."""
    found = _WORD.findall(unicodedata.normalize("NFC", text).lower())
    if all(map(str.isalpha, found)):
        return found
    return [x for w in found for x in ([w] if w.isalpha() else "".join(c if c.isalpha() else " " for c in w).split())]


def trigrams(word: str) -> list[str]:
    w = f"\x02{word}\x03"
    return [w[i : i + 3] for i in range(len(w) - 2)]


class Numbers(dict):
    """word -> number, in order of first sight; ``fresh`` are those not scored yet."""

    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []
        self.table = np.zeros((0, 0))

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.fresh.append(word)
        return n


class LanguageModel:
    """grams: letter trigram -> row of gram_scores (the last row: any other);
    vocabulary likewise; scripts: which language is written in which script."""

    def __init__(self, langs: list[str], grams: dict[str, int], gram_scores: np.ndarray, vocabulary: dict[str, int], word_scores: np.ndarray, scripts: np.ndarray):
        self.langs, self.grams, self.gram_scores, self.vocabulary, self.word_scores, self.scripts = langs, grams, gram_scores, vocabulary, word_scores, scripts

    def score_words(self, found: list[str]) -> np.ndarray:
        """Log-scores (words, languages); languages not written in a word's
        script are all but ruled out."""
        if not found:
            return np.zeros((0, len(self.langs)))
        get, none = self.grams.get, len(self.gram_scores) - 1
        rows = [[get(x, none) for x in trigrams(w)] for w in found]
        sizes = np.fromiter(map(len, rows), dtype=np.int64, count=len(rows))
        flat = np.fromiter((x for r in rows for x in r), dtype=np.int64, count=int(sizes.sum()))
        s = np.add.reduceat(self.gram_scores[flat], np.cumsum(sizes) - sizes, axis=0) / np.sqrt(sizes)[:, None]
        get, none = self.vocabulary.get, len(self.word_scores) - 1
        s += self.word_scores[[get(w, none) for w in found]]
        first = np.array([ord(w[0]) for w in found])
        for k, ranges in enumerate(SCRIPTS.values()):
            if self.scripts[:, k].any() and not self.scripts[:, k].all():
                inside = np.zeros(len(found), dtype=bool)
                for a, b in ranges:
                    inside |= (first >= a) & (first <= b)
                s[np.ix_(inside, ~self.scripts[:, k])] = -1e3
        return s

    def spans(self, text: str | None) -> list[tuple[int, int, str]]:
        """(first word, end word, language) of a text's spans."""
        found = words(text or "")
        if not found:
            return []
        path = viterbi(self.score_words(found)[None], np.array([len(found)]))[0]
        edge = [0, *(np.flatnonzero(np.diff(path)) + 1).tolist(), len(path)]
        return [(a, b, self.langs[path[a]]) for a, b in zip(edge, edge[1:])]

    def predict(self, texts: list[str | None], memo: Numbers) -> tuple[list[str], np.ndarray]:
        """Languages and scores of texts; memo holds the words scored so far."""
        codes, sizes, lengths = [], [], []
        for t in texts:
            found = words(t or "")
            codes.append(np.fromiter(map(memo.__getitem__, found), dtype=np.int64, count=len(found)))
            lengths.append(np.fromiter(map(len, found), dtype=np.int64, count=len(found)))
            sizes.append(len(found))
        if memo.fresh or not memo.table.size:
            memo.table = np.concatenate([memo.table.reshape(-1, len(self.langs)), self.score_words(memo.fresh)])
            memo.fresh = []
        scores = memo.table
        sizes = np.asarray(sizes)
        order = np.argsort(-sizes, kind="stable")
        langs, out = ["und"] * len(texts), np.zeros(len(texts))
        at = 0
        while at < len(order) and sizes[order[at]]:
            group = order[at : at + max(1, 400_000 // max(1, sizes[order[at]]))]
            group = group[sizes[group] > 0]
            wide = np.zeros((len(group), sizes[group[0]], len(self.langs)))
            for r, i in enumerate(group):
                wide[r, : sizes[i]] = scores[codes[i]]
            for r, path in enumerate(viterbi(wide, sizes[group])):
                i = group[r]
                share = np.bincount(path, weights=lengths[i], minlength=len(self.langs)) / lengths[i].sum()
                best = int(share.argmax())
                mean = wide[r, : sizes[i]].mean(axis=0)
                p = np.exp(np.clip(mean - mean[best], -30, 30))
                langs[i], out[i] = self.langs[best], np.sqrt(share[best] * p[best] / p.sum())
            at += len(group)
        return langs, out


def viterbi(scores: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """Best labels of each row of (texts, words, languages); texts come longest
    first. Staying is free, switching costs SWITCH."""
    n, steps, _ = scores.shape
    best = scores[:, 0].copy()
    came = np.zeros(scores.shape, dtype=np.int8)
    own = np.arange(scores.shape[2], dtype=np.int8)
    alive = np.searchsorted(-sizes, -np.arange(steps), side="left")  # texts with more words than t
    for t in range(1, steps):
        k = alive[t]
        top = best[:k].argmax(axis=1)
        leap = np.take_along_axis(best[:k], top[:, None], 1) - SWITCH
        move = leap > best[:k]
        came[:k, t] = np.where(move, top[:, None].astype(np.int8), own)
        best[:k] = np.where(move, leap, best[:k]) + scores[:k, t]
    out = []
    for r in range(n):
        path = np.empty(sizes[r], dtype=np.int64)
        now = int(best[r].argmax())
        # without a switch on the way back the label holds: jump between switches
        t = sizes[r] - 1
        while t >= 0:
            moved = np.flatnonzero(came[r, 1 : t + 1, now] != now) if t else ()
            start = int(moved[-1]) + 1 if len(moved) else 0
            path[start : t + 1] = now
            now, t = int(came[r, start, now]) if start else now, start - 1
        out.append(path)
    return out


def fit(rows: list[tuple[str, str]]) -> LanguageModel:
    langs = sorted({r[1] for r in rows}) or ["und"]
    k = len(langs)
    grams: dict[str, np.ndarray] = {}
    counts = [Counter() for _ in langs]
    scripts = np.zeros((k, len(_NAMES)))
    for text, lang in rows:
        counts[langs.index(lang)].update(words(text))
    for i, c in enumerate(counts):
        for w, n in c.items():
            for g in trigrams(w):
                grams.setdefault(g, np.zeros(k))[i] += n
            if (s := script(w)) >= 0:
                scripts[i, s] += n
    total = sum(grams.values(), np.zeros(k)) + 0.5 * len(grams) + 1
    logs = {g: np.log((v + 0.5) / total) for g, v in grams.items()}
    grams = {g: n for n, g in enumerate(logs)}
    gram_scores = np.array([*(v - v.max() for v in logs.values()), np.zeros(k)])
    vocabulary: dict[str, int] = {}
    word_scores = []
    size = np.array([sum(c.values()) + 1.0 for c in counts])
    for w in {w for c in counts for w, n in c.most_common(VOCABULARY) if n > 1}:
        f = (np.array([c[w] for c in counts]) + 0.5) / size
        vocabulary[w] = len(word_scores)
        word_scores.append(np.log(f / f.max()))
    share = scripts / np.maximum(1, scripts.sum(axis=1, keepdims=True))
    return LanguageModel(langs, grams, gram_scores, vocabulary, np.array([*word_scores, np.zeros(k)]), share > 0.02)


def train_langid(docs: DataFrame, train, sample: int = 6000, text: str = "text", lang: str = "lang", key: str = "doc_id", size: int = SAMPLE_BYTES) -> LanguageModel:
    """Learns from rows where ``train`` holds and text, language and id are known."""
    known = docs.where(train & F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).alias("l"))
    sized = [tuple(r) for r in hash_sample(known.select("k", F.octet_length("t").alias("n")), "k", sample).collect()]
    return fit([(r["t"], r["l"]) for r in whole_texts(known, sized, "k", "t", size)])


def identify(docs: DataFrame, model: LanguageModel, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep``, lang_pred and score, for every row."""
    spark = docs.sparkSession
    ship(spark)
    held = spark.sparkContext.broadcast(model)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Numbers()
        for batch in it:
            for k, to in batches(texts := batch.column(len(keep)).to_pylist(), 512):
                if len(memo) > MEMO:
                    memo = Numbers()
                part = batch.slice(k, to - k)
                lang, score = held.value.predict(texts[k:to], memo)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*keep, "lang_pred", "score"])

    src = docs.select(*keep, docs[text].alias("__text"))
    return src.mapInArrow(run, T.StructType([*src.schema.fields[:-1], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))
