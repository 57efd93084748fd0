"""Restarts, update and complete mode, timers, specs and their checks, order of scans."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tests.conftest import MID
from tidemark.operators import joins, specs, tables, windows
from tidemark.operators.stateful import ordered_fold
from tidemark.plans import CATALOGUE
from tidemark.sources import kafka_sink, repartition_by, use_window_filter, write_table
from tidemark.streaming import ProgressLog, TableSink, key_batch_stream, peek, run_to_end, timed_stream, triggers

START = dt.datetime(2024, 1, 1)


def feed(spark, path, batches, schema):
    """One file for each list of rows, to be read one a micro-batch."""
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_table_sink_restarts(spark, tmp_path):
    path = f"file://{tmp_path}/table"
    rows = lambda *r: spark.createDataFrame(r, "u long, seq long, v string")
    TableSink(path, ["u"], "seq")(rows((1, 1, "a"), (2, 2, "b")), 0)
    TableSink(path, ["u"], "seq")(rows((1, 3, "c")), 1)
    TableSink(path, ["u"], "seq")(rows((1, 9, "replayed")), 1)
    TableSink(path, ["u"], "seq")(rows((3, 4, None)), 2)
    assert sorted(map(tuple, TableSink(path, ["u"], "seq").read(spark).collect())) == [(1, 3, "c"), (2, 2, "b"), (3, 4, None)]
    assert TableSink(path, ["u"], "seq", value="v").read(spark).count() == 2
    assert sorted(x.name for x in (tmp_path / "table").iterdir() if x.is_dir()) == ["1", "2"]


def test_unfinished_version_does_not_count(spark, tmp_path):
    path = f"file://{tmp_path}/table"
    one = spark.createDataFrame([(1, 1)], "u long, seq long")
    TableSink(path, ["u"], "seq")(one, 0)
    (tmp_path / "table" / "1").mkdir()
    assert TableSink(path, ["u"], "seq").read(spark).count() == 1
    TableSink(path, ["u"], "seq")(spark.createDataFrame([(2, 2)], "u long, seq long"), 1)
    assert TableSink(path, ["u"], "seq").read(spark).count() == 2


@pytest.mark.parametrize("mode", ["complete", "update"])
def test_outcome_of_several_batches(spark, tmp_path, mode):
    df = feed(spark, f"file://{tmp_path}/in", [[(1,), (2,)], [(1,)], [(1,), (3,)]], "k long")
    got = run_to_end(df.groupBy("k").count(), f"file://{tmp_path}/out", mode, keys=["k"])
    assert sorted(map(tuple, got.collect())) == [(1, 3), (2, 1), (3, 1)]
    with pytest.raises(ValueError):
        run_to_end(df.groupBy("k").count(), f"file://{tmp_path}/out", "update")


def test_timer_flushes_a_batch(spark, tmp_path):
    at = lambda s: START + dt.timedelta(seconds=s)
    batches = [[(1, at(0), 10, 1), (2, at(1), 20, 1)], [(1, at(5), 11, 1)], [(3, at(60), 30, 1)], [(3, at(61), 31, 1)]]
    df = feed(spark, f"file://{tmp_path}/in", batches, "k long, at timestamp, id long, size long")
    got = run_to_end(key_batch_stream(df, "k", "at", "id", "size", max_age=30_000), f"file://{tmp_path}/out")
    assert sorted((r["k"], list(r["items"]), r["total"]) for r in got.collect()) == [(1, [10, 11], 2), (2, [20], 1)]


def test_batches_by_count_and_size(spark, tmp_path):
    rows = [(1, START + dt.timedelta(seconds=i), i, 600 if i == 4 else 300) for i in range(8)]
    df = feed(spark, f"file://{tmp_path}/in", [rows], "k long, at timestamp, id long, size long")
    got = run_to_end(key_batch_stream(df, "k", "at", "id", "size", max_count=2, max_size=1000), f"file://{tmp_path}/out")
    assert sorted(list(r["items"]) for r in got.collect()) == [[0, 1, 2], [3, 4, 5]]


def test_state_lives_as_long_as_its_rows_say(spark, tmp_path):
    """A key is forwarded again once its state's time to live is over."""
    at = lambda s: START + dt.timedelta(seconds=s)
    df = feed(spark, f"file://{tmp_path}/in", [[(1, at(0))], [(1, at(5))], [(2, at(60))], [(1, at(61))]], "k long, at timestamp")
    millis = F.unix_millis("at").alias("ms")

    def step(state, row):
        return (1,), [] if state else [{"k": row["k"], "ms": row["ms"]}], row["ms"] + 10_000

    out = timed_stream(df.select("k", "at", millis), ["k"], "at", "ms", step, lambda k, s: [], "k long, ms long", "seen int")
    got = sorted((r["ms"], r["k"]) for r in run_to_end(out, f"file://{tmp_path}/out").collect())
    assert [(ms - got[0][0], k) for ms, k in got] == [(0, 1), (60_000, 2), (61_000, 1)]


def test_hooks_and_triggers(spark, tmp_path):
    seen = []
    log = ProgressLog(started=lambda e: seen.append("start"), progressed=lambda p: seen.append("progress"), ended=lambda e: seen.append("end"))
    spark.streams.addListener(log)
    df = feed(spark, f"file://{tmp_path}/in", [[(1,)], [(2,)]], "k long")
    run_to_end(df, f"file://{tmp_path}/out")
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    spark.streams.removeListener(log)
    assert seen[0] == "start" and "progress" in seen
    assert triggers(files=3, size="1g") == ({"maxFilesPerTrigger": "3", "maxBytesPerTrigger": "1g"}, {"availableNow": True})
    assert triggers("30 seconds") == ({}, {"processingTime": "30 seconds"})


def test_peek_observes(spark):
    df, seen = peek(spark.range(10), "test-peek", n=F.count(F.lit(1)), top=F.max("id"))
    assert df.count() == 10 and seen.get == {"n": 10, "top": 9}


@pytest.mark.parametrize("name, by, down", [("kv_range", "c_name", False), ("kv_prefix", "c_name", False), ("kv_all", "c_name", False), ("kv_reverse", "c_name", True), ("window_fetch_range", ("user_id", "window_start"), False), ("window_fetch_all", "window_start", False), ("window_back_fetch", ("user_id", "window_start"), True)])
def test_scans_come_in_order(spark, name, by, down):
    by = (by,) if isinstance(by, str) else by
    got = [tuple(r[c] for c in by) for r in CATALOGUE[name][0](spark, MID).collect()]
    assert len(got) > 1 and got == sorted(got, reverse=down)


def test_specs_are_checked():
    for bad in (dict(size=0, retention=10), dict(size=10, retention=5), dict(size=10, retention=12, grace=5), dict(size=10, retention=20, advance=11), dict(size=10, retention=20, grace=-1), dict(size=10, retention=20, duplicates=True, aggregates={"n": None})):
        with pytest.raises(ValueError):
            specs.WindowTable("w", ["k"], **bad)
    for make in (lambda: specs.KeyValueTable("", ["k"]), lambda: specs.FactTable("t", []), lambda: specs.KeyValueTable("t", ["k", "k"]), lambda: specs.SessionTable("s", ["k"], 0), lambda: specs.SessionTable("s", ["k"], 10, 5)):
        with pytest.raises(ValueError):
            make()
    held = specs.Registry()
    held.add(specs.FactTable("a", ["k"]), "feed-a")
    for table, source in ((specs.FactTable("a", ["k"]), None), (specs.FactTable("b", ["k"]), "feed-a")):
        with pytest.raises(ValueError):
            held.add(table, source)


def test_segments():
    assert windows.with_segments(1000, 10) == windows.default_segments(1000, 10) == 100
    assert windows.with_segments(1000, 10, 1) == 100 and windows.with_segments(1000, 10, 7) == 7 and windows.with_segments(5, 1, 9) == 5


def test_partitions_and_sinks(spark, tmp_path):
    assert repartition_by(spark.range(100), 3, "id").rdd.getNumPartitions() == 3
    with pytest.raises(ValueError):
        repartition_by(spark.range(1), 0, "id")
    use_window_filter(spark, True)
    assert spark.conf.get("spark.sql.optimizer.runtime.bloomFilter.enabled") == "true"
    write_table(spark.createDataFrame([(2, 1), (1, 2), (1, 1)], "k long, ms long").coalesce(1), f"file://{tmp_path}/t", order=["ms", "k"])
    assert list(map(tuple, spark.read.parquet(f"file://{tmp_path}/t").collect())) == [(1, 1), (2, 1), (1, 2)]
    assert kafka_sink(spark.createDataFrame([(1, "a")], "k long, v string"), "host:9092", "topic", "k") is not None


def test_nan_keys_are_one_key(spark):
    from pyspark.sql import types as T

    df = spark.createDataFrame([(float("nan"), 1), (float("nan"), 2), (1.0, 3)], "k double, seq long")
    schema = T.StructType([T.StructField("n", T.LongType())])
    got = ordered_fold(df, ["k"], ["seq"], lambda s, r: ((s or 0) + 1, ()), schema, lambda s: [(s,)])
    assert sorted(r["n"] for r in got.collect()) == [1, 2]


def test_changes_count_equal_rows(spark):
    before = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "k long, v string")
    after = spark.createDataFrame([(1, "a"), (3, "c"), (3, "c")], "k long, v string")
    assert sorted(map(tuple, joins.table_changes(before, after).collect())) == [(1, "a", "-"), (2, "b", "-"), (3, "c", "+"), (3, "c", "+")]


def test_overlay_keeps_duplicates(spark):
    stored = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    written = spark.createDataFrame([(1, "x", False), (2, None, True)], "k long, v string, gone boolean")
    assert sorted(map(tuple, tables.overlay_merge(stored, written, ["k"], "gone", duplicates=True).collect())) == [(1, "a"), (1, "x")]
