"""Small vectors with known outcomes, edge cases and argument checks."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import sources, streaming
from tidemark.functions import Bound, KeyRange, order_preserving_base64, stream_time
from tidemark.functions.codec import from_order_preserving_base64
from tidemark.operators import joins, partitioning, sessions, stateful, tables, ttl, windows


def feed(spark, rows, bucket=4):
    """(key, value, ms) in order of arrival, with stream time."""
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "seq long, key string, value string, ms long")
    return stream_time(df, "seq", "ms", bucket=bucket)


def concat(df, keys):
    out = stateful.concat_in_order(df, keys, "seq", "value")
    return {tuple(r)[:-1]: r["value"] for r in out.collect()}


def test_stream_time_over_ranges(spark):
    times = [5, 3, 9, 1, 2, 20, 4, 30, 6, 7]
    got = feed(spark, [("k", "v", t) for t in times], bucket=3).orderBy("seq").collect()
    top, want = 0, []
    for t in times:
        top = max(top, t)
        want.append(top)
    assert [r["stream_time"] for r in got] == want


def test_tumbling_without_grace(spark):
    rows = [("k1", "a", 0), ("k2", "a", 1), ("k1", "b", 2), ("k2", "b", 3), ("k1", "c", 10000), ("k2", "c", 10001), ("k1", "d", 10002), ("k2", "d", 10003), ("k1", "d", 10), ("STOP", "", 50000)]
    kept = windows.drop_late(windows.assign_windows(feed(spark, rows), "ms", 5000), 0)
    got = concat(kept, ["key", "window_start"])
    assert got == {("k1", 0): "ab", ("k2", 0): "ab", ("k1", 10000): "cd", ("k2", 10000): "cd", ("STOP", 50000): ""}


def test_hopping_with_grace(spark):
    rows = [("k", v, t) for v, t in (("a", 0), ("b", 6000), ("c", 8000), ("d", 16000), ("e", 8000), ("f", 0), ("g", 11000), ("h", 5000), ("s", 45000))]
    kept = windows.drop_late(windows.assign_windows(feed(spark, rows), "ms", 10000, 5000), 5000).where("value <> 's'")
    assert concat(kept, ["window_start"]) == {(0,): "abc", (5000,): "bcegh", (10000,): "dg", (15000,): "d"}


def test_windowed_running_reduce(spark):
    rows = [("luna", str(v), t) for v, t in ((1, 1), (2, 6), (3, 10), (4, 5), (5, 18), (6, 2), (7, 23))]
    kept = windows.drop_late(windows.assign_windows(feed(spark, rows), "ms", 10), 5)
    got = stateful.running(kept, ["key", "window_start"], "seq", total=F.sum(F.col("value").cast("long"))).orderBy("seq")
    assert [r["total"] for r in got.collect()] == [1, 3, 3, 7, 8, 7]


def test_interval_join(spark):
    right = spark.createDataFrame([("A", "R:a", 30), ("B", "R:b", 200), ("B", "R:b2", 500)], "key string, r string, r_ms long")
    left = spark.createDataFrame([("A", "L:a", 0), ("A", "L:a2", 0), ("A", "L:a3", 0), ("B", "L:b", 300), ("A", "no", 2531), ("A", "edge", 2530), ("S", "stop", 10000)], "key string, l string, l_ms long")
    got = joins.interval_join(left, right, ["key"], "l_ms", "r_ms", 2500).collect()
    assert sorted((r["l"], r["r"]) for r in got) == [("L:a", "R:a"), ("L:a2", "R:a"), ("L:a3", "R:a"), ("L:b", "R:b"), ("L:b", "R:b2"), ("edge", "R:a")]


SESSIONS = [("key", "a", 0), ("key", "c", 4000), ("key", "b", 3000), ("key1", "d", 8000), ("key1", "e", 16000), ("key1", "f", 12000), ("key1", "g", 9500), ("key1", "h", 1500)]


def fold(spark, updates):
    return sessions.session_fold(feed(spark, SESSIONS), ["key"], "seq", "ms", "value", 5000, 2000, "", lambda a, v: a + v, lambda a, b: a + b, T.StringType(), updates=updates)


def test_session_fold_updates(spark):
    got = fold(spark, True).orderBy("key", "n").collect()
    assert [(r["session_start"], r["session_end"], r["value"]) for r in got if r["key"] == "key"] == [(0, 0, "a"), (0, 0, None), (0, 4000, "ac"), (0, 4000, None), (0, 4000, "acb")]
    assert [(r["session_start"], r["session_end"], r["value"]) for r in got if r["key"] == "key1"] == [(8000, 8000, "d"), (16000, 16000, "e"), (16000, 16000, None), (12000, 16000, "ef"), (12000, 16000, None), (9500, 16000, "efg")]


def test_session_fold_final_and_reads(spark):
    table = fold(spark, False)
    assert sorted(tuple(r) for r in table.collect()) == [("key", 0, 4000, "acb"), ("key1", 8000, 8000, "d"), ("key1", 9500, 16000, "efg")]
    assert sessions.find_sessions(table, 5000, 9000).count() == 1
    assert sessions.find_sessions(table, 0, 0, "key", "key").count() == 1
    assert sessions.fetch_session(table, "key", "key1", 8000, 8000).count() == 1
    assert sessions.fetch_by_end(table, 4000, 8000).count() == 2
    assert sessions.remove_sessions(table, table.where("value = 'd'"), ["key"]).count() == 2


def test_session_gap_is_inclusive(spark):
    df = spark.createDataFrame([("k", 0), ("k", 5000), ("k", 10001)], "key string, ms long")
    got = sessions.session_aggregate(df, ["key"], "ms", 5000, n=F.count(F.lit(1)))
    assert sorted((r["session_start"], r["session_end"], r["n"]) for r in got.collect()) == [(0, 5000, 2), (10001, 10001, 1)]


def test_dedup_with_row_ttl(spark):
    keys = ["K_forever", "K_5s", "K_20s", "V_forever", "V_5s", "V_20s", "default"]
    value = lambda k: k if k[0] == "V" else "plain"
    rows = [(k, value(k), t) for t in (0, 6000, 12000, 300_000) for k in keys]
    own = F.when(F.col("key").startswith("K_"), F.substring("key", 3, 9)).otherwise(F.substring("value", 3, 9))
    own = F.when(own == "forever", ttl.INFINITE).when(own == "5s", 5000).when(own == "20s", 20000)
    got = ttl.dedup_with_ttl(feed(spark, rows), ["key"], ttl.TimeToLive(10_000, from_both=own))
    by = {}
    for r in got.collect():
        by.setdefault(r["ms"], []).append(r["key"])
    assert {t: sorted(k) for t, k in by.items()} == {0: sorted(keys), 6000: ["K_5s", "V_5s"], 12000: ["K_5s", "V_5s", "default"], 300_000: ["K_20s", "K_5s", "V_20s", "V_5s", "default"]}


def test_stream_table_join_with_ttl(spark):
    people = [(0, "0", "infinite", "CA", 0), (1, "1", "alice", "CA", 0), (2, "2", "bob", "OR", 5), (3, "3", "carol", "CA", 10), (8, "1", "alex", "CA", 20)]
    bids = [(4, "1", "a", 10), (5, "2", "b", 10), (6, "1", "c", 20), (7, "3", "d", 20), (9, "1", "e", 20), (10, "3", "f", 30), (11, "0", "g", 30)]
    versions = spark.createDataFrame(people, "seq long, person string, name string, state string, p_ms long")
    stream = spark.createDataFrame(bids, "seq long, person string, bid string, stream_time long")
    own = F.when(F.col("person") == "0", ttl.INFINITE).otherwise(15)
    got = joins.asof_join(stream, versions, ["person"], "seq", ["name", "state"], ms="p_ms", ttl=own).where("state = 'CA'")
    assert sorted((r["bid"], r["name"]) for r in got.collect()) == [("a", "alice"), ("d", "carol"), ("e", "alex"), ("g", "infinite")]
    got = joins.asof_join(stream, versions, ["person"], "seq", ["name", "state"], how="left", ms="p_ms", ttl=own)
    assert got.count() == 7 and {r["bid"] for r in got.where("name is null").collect()} == {"c", "f"}


def test_tombstones_end_versions(spark):
    versions = spark.createDataFrame([(0, "k", "x", False), (2, "k", None, True)], "seq long, key string, v string, gone boolean")
    stream = spark.createDataFrame([(1, "k"), (3, "k")], "seq long, key string")
    got = joins.asof_join(stream, versions, ["key"], "seq", ["v"], deleted="gone").collect()
    assert [(r["seq"], r["v"]) for r in got] == [(1, "x")]


def test_foreign_key_join_recomputes(spark):
    merchants = [(0, 100, "store0"), (1, 101, "store1"), (2, 102, "store2"), (3, 101, "store1-rename"), (4, 103, "store3")]
    items = [(0, 0, 100, "nut"), (1, 1, 101, "bolt"), (2, 2, 102, "wheel"), (3, 3, 101, "axle"), (4, 4, 101, "nail"), (5, 0, 101, "nut"), (6, 5, 103, "board"), (7, 6, 102, "door")]
    right = tables.latest_by_key(spark.createDataFrame(merchants, "seq long, m int, store string"), ["m"]).drop("seq")
    left = tables.latest_by_key(spark.createDataFrame(items, "seq long, id int, merchant int, name string"), ["id"])
    got = {r["id"]: r["store"] for r in joins.foreign_key_join(left, right, "merchant", "m").collect()}
    assert got == {0: "store1-rename", 1: "store1-rename", 2: "store2", 3: "store1-rename", 4: "store1-rename", 5: "store3", 6: "store2"}


def test_scans_of_state_per_record(spark):
    def run(rows, **bounds):
        df = spark.createDataFrame([(i, "g", k, v) for i, (k, v) in enumerate(rows)], "seq long, g string, k string, v string")
        return [r["seen"] for r in joins.state_scan(df, ["g"], "seq", "k", "v", **bounds).orderBy("seq").collect()]

    assert run([("A", "A"), ("B", "B"), ("C", "C"), ("A", "a"), ("D", "D")]) == ["A", "AB", "ABC", "ABCa", "aBCD"]
    assert run([("A", "A"), ("b", "b"), ("C", "C"), ("d", "d"), ("E", "E")], low="A", high="Z") == ["A", "Ab", "AC", "ACd", "ACE"]


def test_ordered_scans(spark):
    df = spark.createDataFrame([(k,) for k in "A B C CC CCC CD D E F G H I aa aaa bbbb cc ccddd".split()], "k string")
    ks = lambda x: [r["k"] for r in x.collect()]
    assert ks(tables.range_scan(df, "k", "B", "H")) == "B C CC CCC CD D E F G H".split()
    assert ks(tables.range_scan(df, "k", "aaa", "cc")) == ["aaa", "bbbb", "cc"]
    assert ks(tables.range_scan(df, "k", "aaa", "cc", upper_inclusive=False)) == ["aaa", "bbbb"]
    assert ks(tables.range_scan(df, "k", "aaa", "cc", descending=True)) == ["cc", "bbbb", "aaa"]
    assert ks(tables.prefix_scan(df, "k", "CC")) == ["CC", "CCC"]
    raw = spark.createDataFrame([(bytes(x),) for x in ([1, 2], [2], [2, 2], [2, 2, 3], [3], [255], [255, 255, 255])], "k binary")
    assert ks(tables.prefix_scan(raw, "k", b"\x02")) == [b"\x02", b"\x02\x02", b"\x02\x02\x03"]
    assert ks(tables.prefix_scan(raw, "k", b"\xff")) == [b"\xff", b"\xff\xff\xff"]
    assert [r[0] for r in raw.where(KeyRange(Bound(b"\x02", False), Bound(b"\x03")).contains(F.col("k"))).orderBy("k").collect()] == [b"\x02\x02", b"\x02\x02\x03", b"\x03"]


def test_overlay(spark):
    stored = spark.createDataFrame([("k1", "s1"), ("k3", "s3"), ("k4", "s4")], "k string, v string")
    written = spark.createDataFrame([("k2", "w2", False), ("k3", "w3", False), ("k4", None, True), ("k9", None, True)], "k string, v string, gone boolean")
    assert sorted(map(tuple, joins and tables.overlay_merge(stored, written, ["k"], "gone").collect())) == [("k1", "s1"), ("k2", "w2"), ("k3", "w3")]


def test_table_writes(spark):
    f = spark.createDataFrame([("a", 1, 0), ("b", 2, 1)], "k string, v int, seq long")
    f = tables.put_all(f, spark.createDataFrame([("a", 5, 2)], "k string, v int, seq long"))
    f = tables.delete(f, spark.createDataFrame([("b", 3)], "k string, seq long"), "v")
    assert [tuple(r) for r in tables.latest_by_key(f, ["k"], value="v").collect()] == [("a", 5, 2)]
    assert tables.get(f, "k", ["a", "x"]).count() == 2
    assert sorted(tuple(r) for r in tables.first_by_key(f, ["k"]).collect()) == [("a", 1, 0), ("b", 2, 1)]


def test_segments(spark):
    active = lambda t: spark.range(1).select(partitioning.active_segments(F.lit(t).cast("long"), 10_000, 1000)).first()[0]
    assert active(-1) == [] and active(1999) == [0, 1000] and active(3000) == [0, 1000, 2000, 3000] and active(13000) == list(range(3000, 13001, 1000))

    def roll(a, b):
        return tuple(spark.range(1).select(*partitioning.segment_roll(F.lit(a).cast("long"), F.lit(b).cast("long"), 10_000, 1000)).first())

    assert roll(0, 1000) == ([], [1000]) and roll(0, 2000) == ([], [1000, 2000]) and roll(2000, 4000) == ([], [3000, 4000])
    assert roll(0, 500) == ([], []) and roll(9500, 12500) == ([0, 1000], [10000, 11000, 12000]) and roll(-1, 1500) == ([], [0, 1000])
    assert partitioning.segment_range(1000, 4000, 1000) == [1000, 2000, 3000, 4000]
    assert partitioning.segment_range(1000, 4000, 1000, True) == [4000, 3000, 2000, 1000]


def test_subpartitions(spark):
    assert partitioning.subpartition_factor(-1, 8) == 1 and partitioning.subpartition_factor(4096, 8) == 512
    assert partitioning.all_subpartitions(2, 3) == [6, 7, 8]
    got = spark.createDataFrame([(0, 0), (0, 1), (1, 2), (1, 3)], "p long, h long").select(partitioning.subpartition(F.col("p"), F.col("h"), 2)).collect()
    assert [r[0] for r in got] == [0, 1, 2, 3]


def test_codec_keeps_order(spark):
    import os

    keys = sorted({os.urandom(n % 7) for n in range(300)})
    df = spark.createDataFrame([(k,) for k in keys], "k binary").withColumn("t", order_preserving_base64(F.col("k")))
    got = df.withColumn("back", from_order_preserving_base64(F.col("t"))).collect()
    assert [bytes(r["k"]) for r in sorted(got, key=lambda r: r["t"])] == keys
    assert all(bytes(r["back"]) == bytes(r["k"]) for r in got)


def test_async_map_keeps_order_and_retries(spark):
    import random
    import time

    df = spark.createDataFrame([(k, n) for n in range(10) for k in "abcdefgh"], "key string, n long")

    def slow(row):
        time.sleep(random.random() / 500)
        if random.random() < 0.1:
            raise RuntimeError("injected")
        return [{"key": row["key"], "said": f"{row['key']}{row['n']}"}]

    got = [r["said"] for r in stateful.async_map(df, ["key"], ["n"], slow, T.StructType([T.StructField("key", T.StringType()), T.StructField("said", T.StringType())]), retries=9).collect()]
    for k in "abcdefgh":
        assert [x for x in got if x[0] == k] == [f"{k}{n}" for n in range(10)]


def test_key_batches_by_age(spark):
    df = spark.createDataFrame([("k", i, i * 1000) for i in range(5)], "key string, seq long, ms long")
    got = stateful.key_batches(df, ["key"], "seq", "ms", F.lit(1), max_count=99, max_age=1500).orderBy("batch").collect()
    assert [(r["rows"], r["open"]) for r in got] == [(3, False), (2, True)]


def test_window_reads_and_writes(spark):
    table = spark.createDataFrame([("a", 0, "x"), ("a", 10, "y"), ("b", 10, "z")], "key string, window_start long, v string")
    at = lambda df: [(r["key"], r["window_start"]) for r in df.collect()]
    assert at(windows.fetch_range(table, 0, 10, "key", "a")) == [("a", 0), ("a", 10)]
    assert at(windows.fetch_range(table, 0, 10, "key", "a", descending=True)) == [("a", 10), ("a", 0)]
    assert at(windows.fetch_range(table, 1, 10)) == [("a", 10), ("b", 10)] or len(at(windows.fetch_range(table, 1, 10))) == 2
    assert at(windows.fetch(table, "key", "a", 0)) == [("a", 0)]
    assert at(windows.retained(table, 12, 3)) == [("a", 10), ("b", 10)]
    writes = spark.createDataFrame([("a", 0, None), ("c", 5, "n")], "key string, window_start long, v string")
    assert sorted(at(windows.put(table, writes, ["key"], "v"))) == [("a", 10), ("b", 10), ("c", 5)]
    dup = spark.createDataFrame([("a", 0, 1, "x"), ("a", 0, 2, "x"), ("a", 0, 3, None)], "key string, ms long, seq long, v string")
    assert windows.retain_duplicates(dup, ["key"], "ms", "seq", "v").first()["values"] == ["x", "x"]


def test_arguments():
    for bad in (lambda: ttl.TimeToLive(0), lambda: ttl.TimeToLive(1, from_key=F.lit(1), from_value=F.lit(1)), lambda: windows.default_segments(5, 10)):
        with pytest.raises(ValueError):
            bad()
    assert windows.default_segments(100, 5) == 20 and windows.default_segments(1000, 5) == 100 and windows.default_segments(10, 5) == 10


def test_broadcast_only_what_is_small(spark):
    small = spark.range(10)
    assert "broadcast" in joins.broadcast_checked(small)._jdf.queryExecution().logical().toString().lower()
    assert "broadcast" not in joins.broadcast_checked(small, 1)._jdf.queryExecution().logical().toString().lower()


def test_sources(spark, tmp_path):
    rows = sources.memory_table(spark, [("a", 1), ("b", 2)], "k string, v int")
    for fmt in ("parquet", "json", "csv", "orc"):
        sources.write_table(rows, f"{tmp_path}/{fmt}", fmt)
        assert sorted(map(tuple, sources.read_feed(spark, f"{tmp_path}/{fmt}", fmt, "k string, v int").collect())) == [("a", 1), ("b", 2)]
    sources.write_table(rows, f"{tmp_path}/cut", partition_by=["v"])
    assert "PartitionFilters: [isnotnull" in spark.read.parquet(f"{tmp_path}/cut").where("v = 1")._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError):
        sources.use_state_backend(spark, "other")


def test_streaming_agrees_with_batch(spark, tmp_path):
    rows = [("k1", 0), ("k2", 1000), ("k1", 4000), ("k1", 11000), ("k2", 12000), ("k1", 60000)]
    df = spark.createDataFrame([(i, k, t) for i, (k, t) in enumerate(rows)], "seq long, key string, ms long").withColumn("at", F.timestamp_millis(F.col("ms") + 3_600_000))
    for i in range(3):
        df.where(F.col("seq").between(2 * i, 2 * i + 1)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    read = lambda: sources.stream_feed(spark, f"{tmp_path}/in", schema=df.schema)
    out = streaming.run_to_end(streaming.windowed_stream(read(), ["key"], "at", "10 seconds", n=F.count(F.lit(1))), str(tmp_path))
    assert {(r["key"], r["window_start"].second, r["n"]) for r in out.collect()} >= {("k1", 0, 2), ("k2", 0, 1)}
    out = streaming.run_to_end(streaming.session_stream(read(), ["key"], "at", "5 seconds", n=F.count(F.lit(1))), str(tmp_path))
    assert ("k1", 2) in {(r["key"], r["n"]) for r in out.collect()}
    left = read().select(F.col("key"), F.col("at").alias("l_at"), F.col("seq").alias("l_seq"))
    right = read().select(F.col("key"), F.col("at").alias("r_at"), F.col("seq").alias("r_seq"))
    out = streaming.run_to_end(streaming.interval_stream_join(left, right, ["key"], "l_at", "r_at", "4 seconds").select("l_seq", "r_seq"), str(tmp_path))
    assert (0, 2) in {(r[0], r[1]) for r in out.collect()}
    within = streaming.run_to_end(streaming.dedup_stream(read(), ["key"], "at", "1 second").select("key", "seq"), str(tmp_path))
    assert {r["key"] for r in within.collect()} == {"k1", "k2"}
