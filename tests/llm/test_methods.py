"""The methods of operators 3, 4, 5 and 10 against plain versions of the same rules."""

import itertools
import math
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("tidemark.llm")
from tests.llm.test_operators import brute_jaccard  # noqa: E402
from tidemark.llm import queries as Q  # noqa: E402

# 3 language


def test_viterbi_against_all_labellings():
    from tidemark.llm.langid import SWITCH, viterbi

    rng = np.random.default_rng(0)
    for steps in (1, 2, 5, 7):
        scores = rng.normal(scale=4, size=(6, steps, 3))
        for r, path in enumerate(viterbi(scores, np.full(6, steps))):
            value = lambda p: sum(scores[r, t, p[t]] for t in range(steps)) - SWITCH * sum(a != b for a, b in zip(p, p[1:]))
            assert math.isclose(value(tuple(path)), max(map(value, itertools.product(range(3), repeat=steps))))


def plain_language(model, text):
    """Word scores by their definition, then the best labelling by a plain table."""
    from tidemark.llm import langid as L

    found = L.words(text or "")
    if not found:
        return "und", 0.0
    k, rows = len(model.langs), []
    for w in found:
        s = [0.0] * k
        grams = L.trigrams(w)
        for g in grams:
            row = model.gram_scores[model.grams[g]] if g in model.grams else [0.0] * k
            s = [a + b / math.sqrt(len(grams)) for a, b in zip(s, row)]
        if w in model.vocabulary:
            s = [a + b for a, b in zip(s, model.word_scores[model.vocabulary[w]])]
        at = L.script(w)
        if at >= 0 and any(model.scripts[:, at]) and not all(model.scripts[:, at]):
            s = [a if model.scripts[i, at] else -1e3 for i, a in enumerate(s)]
        rows.append(s)
    best, back = rows[0][:], []
    for s in rows[1:]:
        top = max(range(k), key=lambda i: best[i])
        came = [top if best[top] - L.SWITCH > best[i] else i for i in range(k)]
        best = [max(best[top] - L.SWITCH, best[i]) + s[i] for i in range(k)]
        back.append(came)
    path = [max(range(k), key=lambda i: best[i])]
    for came in reversed(back):
        path.append(came[path[-1]])
    share = Counter()
    for w, i in zip(found, reversed(path)):
        share[i] += len(w) / sum(map(len, found))
    lead = max(range(k), key=lambda i: share[i])
    mean = [sum(s[i] for s in rows) / len(rows) for i in range(k)]
    odds = sum(math.exp(max(-30, min(30, m - mean[lead]))) for m in mean)
    return model.langs[lead], math.sqrt(share[lead] / odds)


def test_language_against_plain_version(spark):
    from tests.conftest import SMALL
    from tidemark.llm.langid import identify, train_langid

    docs = spark.read.parquet(f"{SMALL}/documents.parquet").where("doc_id % 7 = 0")
    more = spark.createDataFrame([(10**6, "½ ² ①"), (10**6 + 1, "le chat ½dort² the dog and " * 30), (10**6 + 2, "ab" * 5000), (None, "und der hund")], "doc_id long, text string")
    rows = docs.select("doc_id", "text").unionByName(more)
    from pyspark.sql import functions as F

    model = train_langid(spark.read.parquet(f"{SMALL}/documents.parquet"), F.lit(True))
    for r in identify(rows, model, keep=("doc_id", "text")).collect():
        lang, score = plain_language(model, r["text"])
        assert (r["lang_pred"], round(r["score"], 9)) == (lang, round(score, 9))
        if r["doc_id"] == 10**6:
            assert lang == "und"


# 4 toxicity


def test_ftrl_against_plain_version():
    """The published per-coordinate rule, with dictionaries, row by row."""
    from tidemark.llm.toxicity import BITS, Ftrl, hashed

    rng = np.random.default_rng(1)
    m, z, n = Ftrl(l1=0.5), Counter(), Counter()
    weight = lambda i: 0.0 if abs(z[i]) <= m.l1 else -(z[i] - math.copysign(m.l1, z[i])) / ((m.beta + math.sqrt(n[i])) / m.alpha + m.l2)
    for _ in range(200):
        text = " ".join(f"w{i}" for i in rng.integers(0, 12, 6))
        y = int("w3" in text)
        at = np.unique(np.concatenate([hashed([text])[1], [2**BITS]]))
        g = 1 / (1 + math.exp(-max(-30, min(30, sum(weight(i) for i in at.tolist()))))) - y
        for i in at.tolist():
            w, rate = weight(i), (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / m.alpha
            z[i] += g - rate * w
            n[i] += g * g
        m.learn(at, y, 1.0)
    for i in z:
        assert math.isclose(m.weights(np.array([i]))[0], weight(i), abs_tol=1e-9)
    assert any(weight(i) == 0 for i in z) and any(weight(i) != 0 for i in z)


def test_grams_and_skip_grams():
    from tidemark.llm.toxicity import hashed

    pair = lambda t: set(hashed([t])[1].tolist())
    assert len(pair("a b c d")) == 4 + 3 + 2 + 1
    assert len(pair("a b") & pair("a x b")) == 2  # single words; pairs keep their distance
    assert pair("A, B!") == pair("a b") and not pair("") and not pair("..")


def test_contradicting_labels_teach_nothing(spark):
    from pyspark.sql import functions as F
    from tidemark.llm.quality import labelled

    docs = spark.createDataFrame([(i, f"text {i}") for i in range(6)] + [(None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(0, 1), (0, 1), (1, 0), (2, 0), (2, 1), (3, None), (None, 1), (4, 7)], "doc_id long, quality int")
    assert sorted((t, y) for t, y, _ in labelled(docs, labels, "quality", F.lit(True), 10, "text", "doc_id")) == [("text 0", 1), ("text 1", 0)]


# 5 neighbours


def test_recall_of_production_parameters(spark):
    """At least 0.9 of the true neighbours on sf0.1 (2000 vectors)."""
    folder = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=float)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    got = {}
    for r in Q.op5_forest_neighbours(spark, folder).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = total = 0
    for q in ids[ids % 50 == 0]:
        s = u @ u[ids == q][0]
        s[ids == q] = -2
        hits += len(got[q] & set(ids[np.lexsort((ids, -s))[:5]].tolist()))
        total += 5
    assert hits / total >= 0.9


def test_shared_queue_order():
    """Leaves come in order of the squared margins crossed on the way."""
    from tidemark.llm.ann import Forest

    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 8))
    f = Forest(x / np.linalg.norm(x, axis=1, keepdims=True), trees=2, depth=4)

    def crossed(q, t, leaf):
        node, total = 0, 0.0
        for bit in format(leaf, "04b"):
            m = f.planes[t, node] @ q - f.cuts[t, node]
            side = int(bit)
            total += m * m if (m >= 0) != bool(side) else 0.0
            node = 2 * node + 1 + side
        return total

    for q in x[:5]:
        order = [crossed(q, t, leaf) for t, leaf in f.walk(q)]
        assert len(order) == 32 and all(a <= b + 1e-12 for a, b in zip(order, order[1:]))


# 1 and 10


def test_perfect_hash_refuses_repeats():
    from tidemark.llm.exact_dedup import PerfectHash

    with pytest.raises(ValueError):
        PerfectHash.build(np.ones((2, 4), dtype=np.uint64))


@pytest.mark.parametrize("words", [5, 12, 21])
def test_short_texts_with_one_changed_word(spark, words, monkeypatch):
    from tidemark.llm import jaccard

    monkeypatch.setattr(jaccard, "HOT", 100)  # lists are dealt as grids
    monkeypatch.setattr(jaccard, "CHUNK", 1000)
    rng = np.random.default_rng(words)
    rows = []
    for i in range(1500):
        t = [f"w{k}" for k in range(words)]
        t[int(rng.integers(words))] = f"x{rng.integers(10**9)}"
        rows.append((i, " ".join(t)))
    got = jaccard.components(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    assert Counter(map(tuple, got.collect())) == brute_jaccard(rows)


def test_hot_phrases_in_a_grid(spark, monkeypatch):
    from tests.llm.test_operators import brute_repeats
    from tidemark.llm import substring

    monkeypatch.setattr(substring, "HOT", 3)
    monkeypatch.setattr(substring, "AUTOMATON", 5)
    rng = np.random.default_rng(4)
    line = [f"line{i}" for i in range(14)]
    tails = [[f"t{k}w{i}" for i in range(25)] for k in range(12)]
    rows = []
    for i in range(120):
        own = [f"o{i}w{j}" for j in range(int(rng.integers(5, 30)))]
        rows.append((i, " ".join([*own, *line, *tails[int(rng.integers(12))], *own[:3]])))
    got = substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), digests=True)
    assert Counter(map(tuple, got.collect())) == brute_repeats(rows)
