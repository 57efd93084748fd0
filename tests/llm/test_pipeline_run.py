"""The whole pipeline, and its stages, against brute-force versions."""

import hashlib
import zlib
from collections import Counter

import pytest

pytest.importorskip("tidemark.llm")
import corpus_pipeline as P  # noqa: E402
from tests.llm.test_operators import brute_repeats, check_packing  # noqa: E402
from tests.llm.test_pipeline import changed, shingles  # noqa: E402
from tidemark.llm import quality as Q  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, token string, region int, id long"


def prose(seed, n):
    """Words that look alike within a text and differ between texts."""
    return " ".join(hashlib.md5(f"{seed} {i}".encode()).hexdigest()[: 3 + i % 6].translate(str.maketrans("0123456789", "aeioulnrst")) for i in range(n))


def junk(seed, n):
    return " ".join(f"$$${hashlib.md5(f'{seed} {i}'.encode()).hexdigest()[:4]}|||###" for i in range(n))


def fixture_rows():
    passage = prose("passage", 60)
    texts = [(i, prose(i, 80 + i)) for i in range(60)] + [(100 + i, junk(i, 40)) for i in range(60)]
    a, b, c = prose("a", 90), prose("b", 90), prose("c", 90)
    texts += [(5, a), (5, b), (9, b), (None, b), (None, c), (None, c), (7, None), (8, ""), (300, "one two"), (301, "one two")]
    base = prose("near", 200)
    texts += [(400, base), (401, changed(base, 4)), (402, changed(base, 5)), (403, prose(403, 30) + " " + passage + " " + prose("x403", 30)), (404, prose(404, 20) + " " + passage), (405, passage + " " + passage), (406, prose("long", 20000))]
    return [(d, t, "en", "s", len(t or ""), "t", 1, 2) for d, t in texts]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('corpus')}"
    spark.createDataFrame(fixture_rows(), SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    labels = [(i, 1, 0) for i in range(60)] + [(100 + i, 0, 0) for i in range(60)] + [(5, 1, 0), (5, 0, 0), (None, 0, 0), (400, None, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def brute_quality(rows, model):
    """The rule in plain steps: each block with either dictionary, then the calibration."""
    import zstandard as z

    conf = z.ZstdCompressionParameters.from_level(Q.LEVEL, write_content_size=False, write_dict_id=False, write_checksum=False)
    size = lambda data, d: sum(len(z.ZstdCompressor(dict_data=z.ZstdCompressionDict(d), compression_params=conf).compress(data[i : i + Q.BLOCK])) for i in range(0, max(1, len(data)), Q.BLOCK))
    out = []
    for r in rows:
        data = (r[1] or "").encode()
        x = (size(data, model.bad) - size(data, model.good)) / (len(data) + 16)
        if model.offset + model.slope * x >= 0:
            out.append(r)
    return out


def brute_exact(rows):
    best = {}
    for r in rows:
        held = best.get(r[1] or "")
        if held is None or (-1 if r[0] is None else r[0]) > (-1 if held[0] is None else held[0]):
            best[r[1] or ""] = r
    return list(best.values())


def brute_near(rows):
    sets, up = [shingles(r[1]) for r in rows], list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                up[top(i)] = top(j)
    best = {}
    for i, r in enumerate(rows):
        held = best.get(top(i))
        if held is None or (r[0] is None, r[0] or 0) < (held[0] is None, held[0] or 0):
            best[top(i)] = r
    return list(best.values())


def brute_substring(rows):
    gone = {(d, n, removed): kept for d, n, removed, kept in brute_repeats([(r[0], r[1]) for r in rows])}
    assert gone
    out, width = [], 35
    seen = Counter()
    for r in rows:
        w = (r[1] or "").split()
        seen.update(tuple(w[i : i + width]) for i in range(len(w) - width + 1))
    for r in rows:
        w = (r[1] or "").split()
        cover = [False] * len(w)
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i : i + width])] > 1:
                cover[i : i + width] = [True] * width
        left = " ".join(x for x, g in zip(w, cover) if not g)
        if not any(cover):
            out.append(r)
        elif left:
            out.append((r[0], left, r[2], r[3], len(left)))
    return out


def bag(rows):
    """n_chars of the last stages is that of the text, null for null."""
    return Counter((r[0], r[1]) for r in rows)


def test_stages_and_run(spark, folder):
    rows = [r[:5] for r in fixture_rows()]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = Q.train_quality(docs, spark.read.parquet(f"{folder}/labels.parquet"), P.F.crc32(P.F.col("doc_id").cast("string")) % 3 != 1)
    want = brute_quality(rows, model)
    assert {r[0] for r in want} >= set(range(60)) - {5, 7, 8, 9} and not {r[0] for r in want} & set(range(100, 160))
    for (name, stage), brute in zip(P.STAGES, (None, brute_exact, brute_near, brute_substring)):
        if brute is not None:
            want = brute(want)
        docs = P.cut(stage(spark, docs, folder))
        assert docs.columns == P.COLUMNS, name
        assert bag(docs.collect()) == bag(want), name
    assert [n for n, _ in P.STAGES] == ["quality", "exact_dedup", "near_dedup", "substring_dedup", "packing"]
    packed = P.run(spark, folder).collect()
    unique = Counter(r[0] for r in want)
    check_packing(packed, [(r[0], r[1]) for r in want if unique[r[0]] == 1 and r[0] is not None])
    assert {r["doc_id"] for r in packed} == set(unique)


def test_exact_stage_repeats(spark):
    rows = [(d, t, "en", "s", 1, "t", 1, 2) for d, t in [(5, "A"), (5, "B"), (9, "B"), (None, "B"), (None, "C"), (None, "C"), (3, "D"), (3, "D"), (4, None), (6, "")]]
    got = P.exact(spark, spark.createDataFrame(rows, SCHEMA), "")
    assert bag(got.collect()) == Counter([(5, "A"), (9, "B"), (None, "C"), (3, "D"), (6, "")])


def test_empty_tables(spark, tmp_path):
    path = f"file://{tmp_path}"
    spark.createDataFrame([], SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    assert P.run(spark, path).count() == 0


def test_fold_of_training_rows():
    """Held-out rows are those whose crc32 of the id leaves 1."""
    assert [i for i in range(8) if zlib.crc32(str(i).encode()) % 3 == 1]
