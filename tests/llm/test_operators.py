"""Each operator against a brute-force version, and its defined edge cases."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("tidemark.llm")
from tests.conftest import MID, SMALL  # noqa: E402
from tidemark.llm import queries as Q  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, token string, region string, spans string, n int"


def odd_rows():
    """Nulls, empty and long texts, ties, repeated rows, and clashing columns."""
    para = " ".join(f"w{i}" for i in range(60))
    texts = [None, "", "", " \n ", "a", "a b", "a b c", "A b C", para, para + " end", "x " + para, para, "q " * 5000, "no-space" * 4000, "日本語 текст Ελληνικά", "<|endoftext|> it's\x0bok\x00"]
    rows = [(i, t, "en", "s", 1, 7, "t", "r", "s", 3) for i, t in enumerate(texts)]
    return [*rows, rows[8], (None, para, None, None, None, None, None, None, None, None), (None, "a", None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def texts(spark):
    return [(r[0], r[1]) for r in spark.read.parquet(f"{MID}/documents.parquet").select("doc_id", "text").collect()]


def words(t):
    return (t or "").encode().split()


# 1 exact dedup


def brute_dedup(rows):
    groups = defaultdict(list)
    for d, t in rows:
        groups[t or ""].append(d)
    out = []
    for d, t in rows:
        g = groups[t or ""]
        keep = max((x for x in g if x is not None), default=None)
        out.append((d, keep, len(g), d == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return Counter(out)


def test_exact_dedup(spark, texts):
    assert Counter(map(tuple, Q.op1_exact_dedup(spark, MID).collect())) == brute_dedup(texts)


def test_exact_dedup_odd(odd, none):
    from tidemark.llm.exact_dedup import dedup

    rows, classes = dedup(odd)
    got = Counter((r["id"], r["keep_id"], r["group_size"], r["kept"], bytes(r["digest"]).hex()) for r in rows.collect())
    assert got == brute_dedup([(r[0], r[1]) for r in odd_rows()])
    again, _ = dedup(odd.limit(0), classes)
    assert again.count() == 0
    assert dedup(none)[0].count() == 0


def test_exact_dedup_uses_history(spark, odd):
    from tidemark.llm.exact_dedup import dedup

    _, classes = dedup(odd.where("doc_id < 9"))
    rows, _ = dedup(odd.where("doc_id >= 9"), classes)
    whole = {r["id"]: (r["keep_id"], r["group_size"]) for r in dedup(odd.where("doc_id is not null"))[0].collect()}
    assert {r["id"]: (r["keep_id"], r["group_size"]) for r in rows.collect()} == {k: v for k, v in whole.items() if k >= 9}


def test_perfect_hash():
    from tidemark.llm.exact_dedup import PerfectHash

    rng = np.random.default_rng(0)
    keys = rng.integers(0, 2**63, (5000, 4), dtype=np.uint64)
    h = PerfectHash.load(PerfectHash.build(keys).dump())
    assert sorted(h.slot(keys)) == list(range(5000))
    assert (h.slot(rng.integers(0, 2**63, (1000, 4), dtype=np.uint64)) < 5000).all()


# 2 BPE


def test_bpe(spark, texts, odd, none):
    from tidemark.llm.bpe import encode_documents, load

    t = load(Q.tokenizer_path())

    def want(x):
        ids = t.encode(x or "", add_special_tokens=False).ids
        return len(ids), hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()

    known = dict(texts)
    for r in Q.op2_bpe_chunks(spark, MID).where("doc_id < 250").collect():
        assert tuple(r)[1:] == want(known[r["doc_id"]])
    for r in encode_documents(odd, Q.tokenizer_path(), keep=("doc_id", "text")).collect():
        ids = t.encode(r["text"] or "", add_special_tokens=False).ids
        assert (r["ids"], r["decoded"]) == (ids, t.decode(ids, skip_special_tokens=False))
    assert encode_documents(none, Q.tokenizer_path()).count() == 0


def test_bpe_reuses_chunks():
    from tidemark.llm.bpe import ChunkEncoder

    e = ChunkEncoder(Q.tokenizer_path())
    text = " ".join(f"word{i} and more" for i in range(800))
    a = e.encode("first " + text)
    before = e.reused
    b = e.encode("second one " + text)
    assert e.reused > before and a[0][-4000:] == b[0][-4000:]


# 3 language


def test_language(spark, texts):
    lang = {r[0]: r[1] for r in spark.read.parquet(f"{MID}/documents.parquet").select("doc_id", "lang").collect()}
    got = Q.op3_language_id(spark, MID).collect()
    assert len(got) == len(texts)
    held = [r for r in got if r["held_out"]]
    assert all((zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) == r["held_out"] and 0 <= r["score"] <= 1 for r in got)
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in held]) > 0.97


def test_language_spans_and_odd(spark, odd, none):
    from tidemark.llm.langid import fit, identify

    model = fit([("the cat and the dog with this house", "en"), ("der hund und die katze mit diesem haus", "de"), ("это кошка и собака", "ru")] * 3)
    text = "the cat and the dog with this house and the cat der hund und die katze mit diesem haus und der hund"
    assert [s[2] for s in model.spans(text)] == ["en", "de"]
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in identify(odd, model).collect()}
    assert got[0] == got[1] == ("und", 0.0)
    assert identify(none, model).count() == 0
    assert identify(spark.createDataFrame([(1, "кошка")], "doc_id long, text string"), model).first()["lang_pred"] == "ru"


# 4 and 9 classifiers


def auc(score, y):
    rank = np.argsort(np.argsort(score))
    return (rank[y == 1].mean() - (y == 1).sum() / 2 + 0.5) / (y == 0).sum()


@pytest.mark.parametrize("query, label, least", [("op4_toxicity", "toxic", 0.85), ("op9_quality", "quality", 0.95)])
def test_classifiers(spark, query, label, least):
    known = {r["doc_id"]: r[label] for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    got = getattr(Q, query)(spark, "/root/testdata/sf0.1").collect()
    assert len(got) == 10000 and all(0 <= r["score"] <= 1 for r in got)
    held = [(r["score"], known[r["doc_id"]], r["predicted"]) for r in got if r["held_out"] and r["doc_id"] in known]
    s, y, p = map(np.array, zip(*held))
    assert auc(s, y) > least and (p == y).mean() > 0.96


def test_classifiers_odd(spark, odd, none):
    from tidemark.llm import quality, toxicity

    rows = [("good words here and there", 1, 1.0), ("bad bad bad bad bad", 0, 1.0)] * 30
    for model in (quality.fit(rows), toxicity.fit(rows), quality.fit([]), toxicity.fit([])):
        got = quality.score_texts(odd, model).collect()
        assert len(got) == len(odd_rows()) and all(0 <= r["score"] <= 1 for r in got) and got[0]["score"] == got[1]["score"]
        assert quality.score_texts(none, model).count() == 0


# 5 neighbours


def test_neighbours(spark):
    rows = spark.read.parquet(f"{SMALL}/embeddings.parquet").select("vec_id", "embedding").collect()
    x = np.array([r[1] for r in rows], dtype=np.float64)
    ids = np.array([r[0] for r in rows])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    got = defaultdict(dict)
    for r in Q.op5_forest_neighbours(spark, SMALL).collect():
        got[r["query_id"]][r["rank"]] = (r["vec_id"], r["score"])
    hits = total = 0
    for q in ids[ids % 50 == 0]:
        s = u @ u[ids == q][0]
        best = [ids[i] for i in np.lexsort((ids, -s)) if ids[i] != q][:5]
        mine = [v for v, _ in got[q].values()]
        hits += len(set(best) & set(mine))
        total += 5
        for v, score in got[q].values():
            assert abs(s[ids == v][0] - score) < 1e-12
        assert [got[q][k] for k in sorted(got[q])] == sorted(got[q].values(), key=lambda z: (-z[1], z[0]))
    assert hits / total >= 0.9


def test_neighbours_odd(spark):
    from tidemark.llm.ann import neighbours

    rows = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (7, [1.0]), (None, [1.0, 1.0]), (8, [0.0, 3.0]), (8, [0.0, 3.0])], "vec_id long, embedding array<double>")
    got = neighbours(rows, rows.where("vec_id in (0, 3, 4)"), fraction=1.0).collect()
    assert {r["query_id"] for r in got} == {0}
    assert [(r["rank"], r["vec_id"]) for r in sorted(got, key=lambda r: r["rank"])] == [(1, 1), (2, 2), (3, 8), (4, 8)]
    assert neighbours(rows.limit(0), rows.limit(0)).count() == 0


def test_neighbours_ties(spark):
    """Copies of one vector score alike wherever they stand, so the smallest ids win."""
    from tidemark.llm.ann import neighbours

    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 64)).astype(np.float32).astype(float)
    copies = np.sort(rng.choice(np.arange(1, 3000), 700, replace=False))
    x[copies] = x[copies[0]]
    near = x[copies[0]] + 0.3 * rng.normal(size=64)
    x[0] = near
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(7)
    got = sorted(neighbours(rows, rows.where("vec_id = 0"), fraction=1.0).collect(), key=lambda r: r["rank"])
    assert [r["vec_id"] for r in got] == copies[:5].tolist() and len({r["score"] for r in got}) == 1


# 6 substring


def brute_repeats(rows, width=35):
    seen = Counter()
    for _, t in rows:
        w = words(t)
        seen.update(tuple(w[i : i + width]) for i in range(len(w) - width + 1))
    out = []
    for d, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i : i + width])] > 1:
                gone[i : i + width] = [True] * width
        left = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(left).hexdigest()))
    return Counter(out)


def test_substring(spark, texts):
    assert Counter(map(tuple, Q.op6_substring_dedup(spark, MID).collect())) == brute_repeats(texts)


def test_substring_odd(odd, none):
    from tidemark.llm.substring import remove_repeats

    assert Counter(map(tuple, remove_repeats(odd, digests=True).collect())) == brute_repeats([(r[0], r[1]) for r in odd_rows()])
    got = remove_repeats(odd, width=5).where("doc_id = 9").first()
    assert got["kept"] == "end" and got["n_removed"] == 60
    assert remove_repeats(none).count() == 0


# 7 packing


def check_packing(rows, texts, capacity=2048):
    from tidemark.llm.bpe import load

    t = load(Q.tokenizer_path())
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
    for s in by_seq.values():
        at = 0
        for r in sorted(s, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
    total = 0
    for d, x in texts:
        ids = np.asarray([*t.encode(x or "", add_special_tokens=False).ids, 0], "<u4")
        total += len(ids)
        want = [(k, a, min(capacity, len(ids) - a), zlib.crc32(ids[a : a + capacity].tobytes())) for k, a in enumerate(range(0, len(ids), capacity))]
        assert sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in by_doc[d]) == want
    return len(by_seq), -(-total // capacity)


def test_packing(spark, texts):
    rows = Q.op7_packing(spark, MID).collect()
    used, least = check_packing(rows, texts)
    assert used <= least * 1.01 + 1


def test_packing_odd(spark, odd, none):
    from tidemark.llm.packing import pack

    unique = odd.where("doc_id is not null").dropDuplicates(["doc_id"])
    check_packing(pack(unique, Q.tokenizer_path()).collect(), [(r[0], r[1]) for r in unique.collect()])
    rows = pack(odd, Q.tokenizer_path()).collect()
    assert len(rows) >= len(odd_rows())
    check_packing(rows, [])
    assert pack(none, Q.tokenizer_path()).count() == 0


# 8 html

PAGE = """<html><head><title>t</title><script>var a="</p>";</script></head><body><header>Top, of, site</header><div id="menu"><a href=x>Home</a></div>
<div class="cookie-notice">We use cookies, sorry.</div><div id="content"><h2>Caf&eacute; &amp; bar</h2><p>First paragraph, long enough,
to   count &#233;.<br>More of it.</p><p>Second, with a <a href=1>link</a> in it, and a good many words.<p>Third, unclosed, but fine, and long enough too.
<div class="comments"><p>nice, great, article, wow, commas, so, many</p></div><form><p>Your email, please</p></form></div><aside><p>Side, text, lots, of, commas, here</p></aside><footer>foot</footer></body></html>"""


def test_html(spark):
    from tidemark.llm.html_extract import extract, main_text

    want = "Café & bar\nFirst paragraph, long enough, to count é. More of it.\nSecond, with a link in it, and a good many words.\nThird, unclosed, but fine, and long enough too."
    assert main_text(PAGE) == want
    assert main_text(None) == main_text("") == main_text("<nav>a</nav>") == ""
    rows = spark.createDataFrame([(1, "u", PAGE, 1), (2, None, None, 1), (2, None, None, 1), (None, "u", "", 1)], "page_id long, url string, html string, text int")
    assert [(r["page_id"], r["n_chars"]) for r in extract(rows).collect()] == [(1, len(want)), (2, 0), (2, 0), (None, 0)]
    assert extract(rows.limit(0)).count() == 0


def test_html_pages(spark):
    import html
    import re

    known = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    for r in Q.op8_html_text(spark, SMALL).collect():
        article = re.search(r"<article>(.*?)(</article>|\Z)", known[r["page_id"]], re.S)[1]
        blocks = re.split(r"</?(?:p|h1)>", re.sub(r"</?b>", "", article.replace("<br>", " ")))
        assert r["text"] == "\n".join(x for x in (" ".join(html.unescape(b).split()) for b in blocks) if x)


# 10 jaccard


def brute_jaccard(rows, n=3):
    table = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
    sets, up = {}, {}
    for d, t in rows:
        w = (t or "").encode().translate(table).split()
        s = frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])
        sets.setdefault(d, []).append(s)
        up[d] = d

    def top(d):
        while up[d] != d:
            d = up[d]
        return d

    index = defaultdict(set)
    flat = [(d, s) for d, ss in sets.items() if d is not None for s in ss]
    for i, (d, s) in enumerate(flat):
        met = Counter(j for x in s for j in index[x])
        for j, c in met.items():
            e, o = flat[j]
            if 100 * c >= 90 * (len(s) + len(o) - c):
                a, b = sorted((top(d), top(e)))
                up[b] = a
        for x in s:
            index[x].add(i)
    return Counter((d, len(s), None if d is None else top(d)) for d, ss in sets.items() for s in ss)


def test_jaccard(spark, texts):
    assert Counter(map(tuple, Q.op10_jaccard_join(spark, MID).collect())) == brute_jaccard(texts)


def test_jaccard_odd(odd, none):
    from tidemark.llm.jaccard import components

    assert Counter(map(tuple, components(odd).collect())) == brute_jaccard([(r[0], r[1]) for r in odd_rows()])
    assert components(none).count() == 0


def test_jaccard_dense(spark):
    """Near copies around the threshold, in chains and clusters."""
    from tidemark.llm.jaccard import components

    rng = np.random.default_rng(5)
    rows = []
    for base in range(12):
        text = [f"b{base}x{i}" for i in range(int(rng.integers(40, 160)))]
        for _ in range(30):
            t = list(text)
            for _ in range(int(rng.integers(0, 6))):
                t[int(rng.integers(len(t)))] = f"e{rng.integers(10**9)}"
            if rng.random() < 0.3:
                text = t  # chains
            rows.append((len(rows), " ".join(t)))
    rows = [rows[i] for i in rng.permutation(len(rows))]
    got = components(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    assert Counter(map(tuple, got.collect())) == brute_jaccard(rows)
