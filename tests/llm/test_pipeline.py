"""Stages of the corpus pipeline against brute-force versions."""

import pytest

pytest.importorskip("tidemark.llm")
import corpus_pipeline as P  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows_of(texts):
    return [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]


def shingles(text, n=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} - {()}


def brute_near(rows):
    """Smallest id of each component of texts alike in 0.8 of their 5-word shingles."""
    sets, up = {r[0]: shingles(r[1]) for r in rows}, {r[0]: r[0] for r in rows}

    def top(d):
        while up[d] != d:
            d = up[d]
        return d

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                up[y] = x
    return [r for r in rows if up[r[0]] == r[0]]


def changed(text, k):
    w = text.split()
    for i in range(k):
        w[(2 * i + 1) * len(w) // (2 * k)] += "x"
    return " ".join(w)


def test_near_stage(spark):
    """Four scattered changes in 200 words: 0.815 by five words, 0.886 by three."""
    base = [" ".join(f"b{b}w{i}" for i in range(200)) for b in range(5)]
    texts = [t for b, t in enumerate(base) for t in (t, changed(t, b + 1))] + ["", None, "one two", "one two", "one three"]
    rows = rows_of(texts)
    docs = spark.createDataFrame(rows, SCHEMA)
    got = sorted(map(tuple, P.near(spark, docs, "").collect()))
    assert got == brute_near(rows)
    assert 7 not in [r[0] for r in got] and 9 in [r[0] for r in got]
