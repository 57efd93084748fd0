"""Folds by column slices against plain loops, with batches shorter than a key's rows."""

import hashlib
import random
import struct

import pytest
from pyspark.sql import functions as F

from tidemark.functions.time import stream_time
from tidemark.operators import joins, stateful, ttl
from tidemark.streaming import ChangeSink, ProgressLog, run_to_end, stateful_stream


@pytest.fixture(params=[3, 10_000])
def short(spark, request):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, request.param)
    yield spark
    spark.conf.set(name, before)


def rows_of(seed, n=400):
    """(key, seq, ms, clock, size, ttl): keys null and hot, late times, null times and sizes."""
    r, clock, out = random.Random(seed), 0, []
    for seq in range(n):
        ms = r.choice([None, seq * 10, max(0, seq * 10 - r.randrange(600))])
        clock = max(clock, ms or 0)
        out.append((r.choice(["a", "a", "a", "b", "c", None, f"k{r.randrange(40)}"]), seq, ms, clock, r.choice([None, 0, 5, 30, 90]), r.choice([None, 15, 200, ttl.INFINITE])))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "k string, seq long, ms long, stream_time long, size long, own long")


def by_key(rows):
    held = {}
    for r in rows:
        held.setdefault(r[0], []).append(r)
    return held


def test_dedup_with_ttl(short):
    rows = rows_of(1)
    want = []
    for _, mine in by_key(rows).items():
        until = None
        for r in mine:
            if until is None or r[3] > until:
                want.append(r[1])
                until = (r[3] if r[2] is None else r[2]) + (100 if r[5] is None else r[5])
    got = ttl.dedup_with_ttl(frame(short, rows), ["k"], ttl.TimeToLive(100, from_value=F.col("own")))
    assert got.columns == ["k", "seq", "ms", "stream_time", "size", "own"]
    assert {tuple(r) for r in got.collect()} == {r for r in rows if r[1] in set(want)} and got.count() == len(want)


def plain_batches(mine, max_count, max_size, max_age):
    """[(first, rows, total, open, seqs)]"""
    out, first, count, total, held = [], None, 0, 0, []
    for _, seq, ms, _, size, _ in mine:
        first = ms if first is None else first
        count, total, held = count + 1, total + (size or 0), [*held, seq]
        if count > max_count or total > max_size or (max_age is not None and ms is not None and first is not None and ms - first > max_age):
            out.append((first, count, total, False, held))
            first, count, total, held = None, 0, 0, []
    return out + ([(first, count, total, True, held)] if held else [])


@pytest.mark.parametrize("limits", [(4, 10**6, None), (10**6, 120, None), (6, 150, 300), (10**6, 10**6, 250), (10**6, 10**6, None)])
def test_key_batches(short, limits):
    rows = rows_of(2)
    want = {(k, n, *b[:4]) for k, mine in by_key(rows).items() for n, b in enumerate(plain_batches(mine, *limits))}
    df = frame(short, rows)
    got = stateful.key_batches(df, ["k"], "seq", "ms", F.col("size"), *limits).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    held = {(r["k"], r["batch"]): list(r["items"]) for r in stateful.batch_rows(df, ["k"], "seq", "ms", F.col("size"), "seq", *limits).collect()}
    assert held == {(k, n): b[4] for k, mine in by_key(rows).items() for n, b in enumerate(plain_batches(mine, *limits))}


def test_checksum_chain(short):
    rows = rows_of(3)
    want = set()
    for k, mine in by_key(rows).items():
        h = b""
        for r in mine:
            for v in (r[1], r[4] or 0):
                h = hashlib.sha256(h + struct.pack(">q", v)).digest()
        want.add((k, len(mine), h.hex()))
    assert {tuple(r) for r in stateful.checksum_chain(frame(short, rows), ["k"], "seq", ["seq", "size"]).collect()} == want


def test_nothing_and_odd_keys(short):
    empty = frame(short, rows_of(4)).where("seq < 0")
    assert not ttl.dedup_with_ttl(empty, ["k"], ttl.TimeToLive(5)).collect()
    assert not stateful.checksum_chain(empty, ["k"], "seq", ["seq"]).collect()
    assert not stateful.key_batches(empty, ["k"], "seq", "ms", F.lit(1)).collect()
    odd = short.createDataFrame([(float("nan"), [1], i, i) for i in range(5)] + [(None, [1], 5, 5), (None, [2], 6, 6), (1.0, [1], 7, 7)], "x double, y array<int>, seq long, ms long")
    got = stateful.key_batches(odd.select("*", F.lit(1).alias("one")), ["x"], "seq", "ms", F.col("one"))
    assert sorted(r["rows"] for r in got.collect()) == [1, 2, 5]


def test_change_sink_merges_and_restarts(spark, tmp_path):
    path = f"file://{tmp_path}/table"
    sink = lambda **kw: ChangeSink(path, ["u"], "seq", share=1e9, every=2, **kw)
    rows = lambda *r: spark.createDataFrame(r, "u long, seq long, v string")
    held = lambda: sorted(map(tuple, sink().read(spark).collect()))
    folders = lambda kind: sorted(x.name for x in (tmp_path / "table" / kind).iterdir() if x.is_dir())
    sink()(rows((1, 1, "a"), (1, 2, "b"), (2, 2, "b")), 0)
    assert held() == [(1, 2, "b"), (2, 2, "b")] and folders("merged") == ["0"]  # the first batch is the table
    sink()(rows((1, 3, "c")), 1)
    sink()(rows((1, 9, "replayed")), 1)
    assert held() == [(1, 3, "c"), (2, 2, "b")] and folders("merged") == ["0"]
    sink()(rows((3, 1, "old")), 2)
    assert folders("merged") == ["0", "2"] and folders("changes") == ["1", "2"]
    (tmp_path / "table" / "changes" / "3").mkdir()  # a write that broke off
    sink()(rows((3, 4, None)), 3)
    sink()(rows((2, 1, "late")), 4)
    assert folders("merged") == ["2", "4"] and folders("changes") == ["3", "4"]
    assert held() == [(1, 3, "c"), (2, 2, "b"), (3, 4, None)] and sink(value="v").read(spark).count() == 2
    with pytest.raises(ValueError):
        ChangeSink(path, ["u"], "seq", share=0)


def test_fold_of_a_stream_row_after_row(spark, tmp_path):
    for part in ([(1, 1), (1, 2), (2, 3)], [(1, 4)]):
        spark.createDataFrame(part, "k long, seq long").coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    df = spark.readStream.schema("k long, seq long").option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    step = lambda state, row: ((n := (state[0] if state else 0) + 1,), [{"k": row["k"], "n": n}] if n > 1 else [])
    got = run_to_end(stateful_stream(df, ["k"], "seq", step, "k long, n long", "n long"), f"file://{tmp_path}/out")
    assert sorted(map(tuple, got.collect())) == [(1, 2), (1, 3)]


@pytest.mark.parametrize("bucket", [2, 7, 65_536])
def test_stream_time_of_sparse_numbers(spark, bucket):
    r = random.Random(bucket)
    rows = sorted((s, r.choice([None, r.randrange(1000)])) for s in {r.randrange(-500, 10**6) if i % 3 else i for i in range(200)})
    top, want = None, []
    for s, ms in rows:
        top = ms if top is None else top if ms is None else max(top, ms)
        want.append((s, ms, top))
    assert sorted(map(tuple, stream_time(spark.createDataFrame(rows, "seq long, ms long"), "seq", "ms", bucket=bucket).collect())) == want


def test_state_scan_with_tombstones(short):
    r = random.Random(5)
    rows = [(r.choice("gh"), i, r.choice(["a", "b", "c", "d", None]), r.choice([None, f"v{i}."])) for i in range(120)]
    held, want = {"g": {}, "h": {}}, {}
    for g, i, k, v in rows:
        want[i] = "".join(held[g][x] for x in sorted(held[g]) if "b" <= x <= "c") + (v or "")
        if k is not None:
            held[g].pop(k, None)
            held[g] |= {} if v is None else {k: v}
    got = joins.state_scan(short.createDataFrame(rows, "g string, seq long, k string, v string"), ["g"], "seq", "k", "v", low="b", high="c")
    assert {x["seq"]: x["seen"] for x in got.collect()} == want


def test_lag_of_sources():
    from types import SimpleNamespace as S

    log = ProgressLog()
    assert log.lag() == {}
    log.progress = [S(sources=[S(description="feed", latestOffset='{"t": {"0": 7, "1": 5}}', endOffset='{"t": {"0": 4}}'), S(description="rate", latestOffset="9", endOffset="9"), S(description="other", latestOffset=None, endOffset="3")])]
    assert log.lag() == {"feed": 8, "rate": 0}
