"""Further named queries: writes and reads of tables, updates, specs, streams."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import stream_time
from ..operators import joins, partitioning, sessions, specs, stateful, tables, ttl, windows
from ..sources import read_table, repartition_by
from .catalogue import _ASOF, _FOLD, _TTL, DAY, EV, HOUR, LATE, SES, _asof, _folder, _row_ttl, _stream, cents, events, late_events, query, session_agg

# --- projections


@query("SELECT c_custkey, split_part(c_name, '#', 1) AS kind, CAST(split_part(c_name, '#', 2) AS BIGINT) AS number FROM customer")
def split_fields(spark, d):
    part = F.split("c_name", "#")
    return read_table(spark, d, "customer").select("c_custkey", part[0].alias("kind"), part[1].cast("long").alias("number"))


@query(f"{_ASOF} SELECT event_id, l.user_id || ',' || v_seq || ',' || v_cents AS said FROM l ASOF JOIN r ON l.user_id = r.user_id AND l.event_id >= r.v_seq")
def joiner_concat(spark, d):
    return _asof(spark, d).select("event_id", F.concat_ws(",", "user_id", "v_seq", "v_cents").alias("said"))


@query("SELECT event_id, user_id, event_type FROM events")
def peek_pass(spark, d):
    from ..streaming import peek

    return peek(events(spark, d).select("event_id", "user_id", "event_type"), f"peek-{uuid.uuid4().hex}", n=F.count(F.lit(1)))[0]


@query("SELECT user_id, count(*) AS n, CAST(1 AS BIGINT) AS partitions FROM events GROUP BY user_id")
def repartition_n(spark, d):
    e = repartition_by(events(spark, d), 4, "user_id").withColumn("p", F.spark_partition_id())
    return e.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("p").alias("partitions"))


@query("SELECT event_id, CASE WHEN CAST(round(value * 100) AS BIGINT) % 7 < 3 THEN 'low' ELSE 'high' END AS grade FROM events")
def stateless_function(spark, d):
    """A user's function of single records, in Arrow batches."""

    @F.pandas_udf("string")
    def grade(x: pd.Series) -> pd.Series:
        return (x % 7 < 3).map({True: "low", False: "high"})

    return events(spark, d).select("event_id", grade("cents").alias("grade"))


# --- writes and reads of tables


@query("""SELECT user_id, event_id, event_type FROM (SELECT user_id, event_id, event_type, event_id AS seq FROM events WHERE event_type <> 'view' UNION ALL SELECT user_id, event_id, 'put', event_id + 1000000000 FROM events WHERE event_type = 'view')
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY seq DESC) = 1""")
def kv_put_all(spark, d):
    e = events(spark, d).select("user_id", "event_id", "event_type", F.col("event_id").alias("seq"))
    later = e.where("event_type = 'view'").withColumns({"event_type": F.lit("put"), "seq": F.col("seq") + 1_000_000_000})
    return tables.latest_by_key(tables.put_all(e.where("event_type <> 'view'"), later), ["user_id"]).drop("seq")


@query("""SELECT user_id, event_id, event_type FROM events WHERE user_id % 3 <> 0 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1""")
def kv_delete(spark, d):
    e = events(spark, d).select("user_id", "event_id", "event_type", F.col("event_id").alias("seq"))
    gone = e.where("user_id % 3 = 0").groupBy("user_id").agg((F.max("seq") + 1).alias("seq"))
    return tables.latest_by_key(tables.delete(e, gone, "event_type"), ["user_id"], value="event_type").drop("seq")


@query("""SELECT c_custkey AS key, CAST(round(c_acctbal * 100) AS BIGINT) AS cents FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')
  UNION ALL SELECT o_custkey, CAST(round(o_totalprice * 100) AS BIGINT) FROM orders WHERE o_orderstatus <> 'F'""")
def overlay_duplicates(spark, d):
    stored = read_table(spark, d, "customer").select(F.col("c_custkey").alias("key"), cents("c_acctbal").alias("cents"))
    written = read_table(spark, d, "orders").select(F.col("o_custkey").alias("key"), cents("o_totalprice").alias("cents"), (F.col("o_orderstatus") == "F").alias("deleted"))
    return tables.overlay_merge(stored, written, ["key"], "deleted", duplicates=True)


@query(f"WITH {EV} SELECT event_id, user_id, ms, CASE WHEN event_type <> 'error' THEN cents END AS cents FROM ev WHERE event_type = 'error' OR ms >= (SELECT max(ms) FROM ev) - {10 * DAY}")
def flush_retention(spark, d):
    e = events(spark, d)
    writes = e.select("event_id", "user_id", "ms", F.when(F.col("event_type") != "error", F.col("cents")).alias("cents"))
    return tables.flush_retained(writes, "ms", e.agg(F.max("ms")).scalar(), 10 * DAY, "cents")


@query("""WITH g AS (SELECT * FROM (SELECT user_id, event_id AS version, event_type FROM events WHERE event_type IN ('click', 'error') QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1) WHERE event_type <> 'error')
  SELECT event_id, e.user_id, version FROM events e JOIN g ON e.user_id = g.user_id WHERE e.event_type = 'purchase'""")
def global_put_delete(spark, d):
    e = events(spark, d)
    feed = e.where("event_type in ('click', 'error')").select("user_id", F.col("event_id").alias("version"), "event_type")
    table = tables.latest_by_key(feed, ["user_id"], "version", deleted=F.col("event_type") == "error").drop("event_type")
    return joins.global_join(e.where("event_type = 'purchase'").select("event_id", "user_id"), table, ["user_id"]).select("event_id", "user_id", "version")


@query("SELECT c_custkey, upper(n_name) || '/' || r_name AS place FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def global_processed_table(spark, d):
    """A global table whose rows pass a processor of their own before they are stored."""
    n, r = read_table(spark, d, "nation"), read_table(spark, d, "region")
    processed = joins.global_join(n, r, n["n_regionkey"] == r["r_regionkey"]).select("n_nationkey", F.concat_ws("/", F.upper("n_name"), "r_name").alias("place"))
    c = read_table(spark, d, "customer")
    return joins.global_join(c, processed, c["c_nationkey"] == processed["n_nationkey"]).select("c_custkey", "place")


# --- time to live by key, and by both


@query(f"WITH {EV} SELECT * FROM (SELECT user_id, event_id, ms FROM ev QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1) WHERE ms >= (SELECT max(ms) FROM ev) - CASE WHEN user_id % 4 = 0 THEN {DAY} WHEN user_id % 4 = 1 THEN {HOUR} ELSE {12 * HOUR} END")
def ttl_by_key(spark, d):
    e = events(spark, d)
    own = F.when(F.col("user_id") % 4 == 0, DAY).when(F.col("user_id") % 4 == 1, HOUR)
    return ttl.expire(tables.latest_by_key(e.select("user_id", "event_id", "ms"), ["user_id"], "event_id"), "ms", e.agg(F.max("ms")).scalar(), ttl.TimeToLive(12 * HOUR, from_key=own))


@query(f"WITH {EV} SELECT * FROM (SELECT user_id, event_id, event_type, ms FROM ev QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1) WHERE ms >= (SELECT max(ms) FROM ev) - CASE WHEN user_id % 2 = 0 AND event_type = 'click' THEN {3 * DAY} ELSE {12 * HOUR} END")
def ttl_by_both(spark, d):
    e = events(spark, d)
    own = F.when((F.col("user_id") % 2 == 0) & (F.col("event_type") == "click"), 3 * DAY)
    return ttl.expire(tables.latest_by_key(e.select("user_id", "event_id", "event_type", "ms"), ["user_id"], "event_id"), "ms", e.agg(F.max("ms")).scalar(), ttl.TimeToLive(12 * HOUR, from_both=own))


# --- windows and sessions


@query(f"WITH {LATE} SELECT event_type, ms - ms % {HOUR} AS window_start, ms - ms % {HOUR} + {HOUR} AS window_end, count(*) AS n FROM lt WHERE ms - ms % {HOUR} + {HOUR} > stream_time GROUP BY ALL")
def tumbling_no_grace(spark, d):
    return windows.windowed(late_events(spark, d), ["event_type"], "ms", HOUR, grace=0, n=F.count(F.lit(1)))


@query(f"""{_FOLD}, o AS (SELECT user_id, rn, 0 AS last, unnest(CASE WHEN kept AND (low, high) <> (ms, ms) THEN met ELSE [] END) AS x FROM f UNION ALL SELECT user_id, rn, 1, {{'s': low, 'e': high, 'v': total}} FROM f WHERE kept)
  SELECT row_number() OVER (PARTITION BY user_id ORDER BY rn, last, x.s, x.e) - 1 AS n, user_id, x.s AS session_start, x.e AS session_end, CASE WHEN last = 1 THEN x.v END AS cents FROM o""")
def session_updates(spark, d):
    """Every change of a session: what it took in is taken back (null) first."""
    out = sessions.session_fold(late_events(spark, d), ["user_id"], "seq", "ms", "cents", 6 * HOUR, HOUR, 0, lambda a, v: a + v, lambda a, b: a + b, T.LongType(), updates=True)
    return out.withColumnRenamed("value", "cents")


@query(f"WITH {SES} SELECT * FROM ses WHERE n > 1")
def session_remove(spark, d):
    table = session_agg(spark, d)
    return sessions.remove_sessions(table, table.where("n = 1"), ["user_id"])


@query(f"WITH {SES} SELECT * FROM ses QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY session_start) = 1")
def session_fetch(spark, d):
    table = session_agg(spark, d)
    wanted = table.groupBy("user_id").agg(F.min(F.struct("session_start", "session_end")).alias("s")).select("user_id", "s.*")
    return sessions.fetch_sessions(table, wanted, ["user_id"])


@query(f"WITH {SES} SELECT * FROM ses WHERE user_id BETWEEN 3 AND 60")
def session_fetch_keys(spark, d):
    return sessions.fetch_keys(session_agg(spark, d), "user_id", 3, 60)


@query(f"WITH {SES} SELECT CASE WHEN n = 1 THEN -1 ELSE session_end - session_end % {DAY} END AS segment, count(*) AS n FROM ses GROUP BY 1")
def session_segments(spark, d):
    """Segments of sessions; those of one event stand for the table's own records."""
    at = partitioning.session_segment(F.col("session_end"), DAY, F.col("n") == 1)
    return session_agg(spark, d).groupBy(at.alias("segment")).agg(F.count(F.lit(1)).alias("n"))


# --- changes of a join


@query("""WITH b AS (SELECT * FROM orders WHERE o_orderstatus <> 'O'), c2 AS (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN c_name || '*' ELSE c_name END AS c_name FROM customer),
  x AS (SELECT o_orderkey, c_name FROM b JOIN customer ON o_custkey = c_custkey), y AS (SELECT o_orderkey, c_name FROM orders JOIN c2 ON o_custkey = c_custkey WHERE o_orderstatus <> 'P')
  SELECT *, '-' AS change FROM (SELECT * FROM x EXCEPT ALL SELECT * FROM y) UNION ALL SELECT *, '+' FROM (SELECT * FROM y EXCEPT ALL SELECT * FROM x)""")
def fk_join_changes(spark, d):
    """Open orders come, pending ones go, some customers get a new name."""
    o, c = read_table(spark, d, "orders"), read_table(spark, d, "customer").select("c_custkey", "c_name")
    renamed = c.withColumn("c_name", F.when(F.col("c_custkey") % 5 == 0, F.concat("c_name", F.lit("*"))).otherwise(F.col("c_name")))
    before = joins.foreign_key_join(o.where("o_orderstatus <> 'O'"), c, "o_custkey", "c_custkey").select("o_orderkey", "c_name")
    after = joins.foreign_key_join(o.where("o_orderstatus <> 'P'"), renamed, "o_custkey", "c_custkey").select("o_orderkey", "c_name")
    return joins.table_changes(before, after)


# --- folds


@query(f"""WITH RECURSIVE {EV}, r AS (SELECT user_id, event_id, ms, CAST(cents // 100 AS BIGINT) AS sz, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM ev),
  f AS (SELECT user_id, rn, ms, event_id, sz, CAST(1 AS BIGINT) AS cnt, sz AS tot, CAST(0 AS BIGINT) AS batch FROM r WHERE rn = 1
    UNION ALL SELECT f.user_id, r.rn, r.ms, r.event_id, r.sz, CASE WHEN f.cnt > 50 OR f.tot > 1000 THEN 1 ELSE f.cnt + 1 END, CASE WHEN f.cnt > 50 OR f.tot > 1000 THEN r.sz ELSE f.tot + r.sz END, CASE WHEN f.cnt > 50 OR f.tot > 1000 THEN f.batch + 1 ELSE f.batch END
    FROM f JOIN r ON r.user_id = f.user_id AND r.rn = f.rn + 1)
  SELECT user_id, batch, arg_min(ms, rn) AS first_ms, CAST(sum(sz) AS BIGINT) AS total, string_agg(event_id, ',' ORDER BY rn) AS held FROM f GROUP BY user_id, batch""")
def key_batch_rows(spark, d):
    """Batches with what they hold, the open one too."""
    out = stateful.batch_rows(events(spark, d), ["user_id"], "event_id", "ms", F.floor(F.col("cents") / 100), "event_id")
    return out.select("user_id", "batch", "first_ms", "total", F.array_join(F.transform("items", lambda x: x.cast("string")), ",").alias("held"))


# --- tables by name


@query(f"WITH {EV} SELECT * FROM (SELECT user_id, event_id, event_type, ms FROM ev QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1) WHERE ms >= (SELECT max(ms) FROM ev) - {_TTL}")
def spec_key_value(spark, d):
    e = events(spark, d).select("user_id", "event_id", "event_type", "ms")
    return specs.KeyValueTable("latest", ["user_id"], "event_id", ttl=_row_ttl()).of(e, e.agg(F.max("ms")).scalar())


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1")
def spec_fact(spark, d):
    return specs.FactTable("first", ["user_id"], "event_id").of(events(spark, d).select("user_id", "event_id", "event_type"))


@query(f"WITH {LATE} SELECT event_type, ms - ms % {HOUR} AS window_start, ms - ms % {HOUR} + {HOUR} AS window_end, CAST(sum(cents) AS BIGINT) AS cents FROM lt WHERE ms - ms % {HOUR} + {HOUR} + {3 * HOUR} > stream_time GROUP BY ALL")
def spec_window(spark, d):
    table = specs.WindowTable("hourly", ["event_type"], HOUR, DAY, grace=3 * HOUR, aggregates={"cents": F.sum("cents")})
    return table.of(late_events(spark, d))


@query(f"WITH {SES} SELECT user_id, session_start, session_end, n FROM ses")
def spec_session(spark, d):
    return specs.SessionTable("visits", ["user_id"], 6 * HOUR, DAY, {"n": F.count(F.lit(1))}).of(events(spark, d))


# --- operations


@query(f"""WITH {EV} SELECT ms - ms % {DAY} AS day, count(*) AS arrived, count(*) FILTER (WHERE event_type <> 'error') AS processed,
  CASE WHEN count(*) > count(*) FILTER (WHERE event_type <> 'error') OR count(*) > 400 * 0.8 THEN 'up' WHEN count(*) < 400 * 0.3 THEN 'down' ELSE 'none' END AS action FROM ev GROUP BY 1""")
def diagnose_rates(spark, d):
    from ..streaming import diagnose

    rates = events(spark, d).groupBy((F.col("ms") - F.col("ms") % DAY).alias("day")).agg(F.count(F.lit(1)).alias("arrived"), F.count_if(F.col("event_type") != "error").alias("processed"))
    return diagnose(rates, "arrived", "processed", 400)


# --- streams


@query("SELECT user_id, count(*) AS n, max(event_id) AS last FROM events GROUP BY user_id")
def stream_updates(spark, d):
    """Changed rows of each of several micro-batches; the last of each key counts."""
    from .. import streaming

    out = _stream(spark, d).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("last"))
    return streaming.run_to_end(out, _folder(spark), "update", keys=["user_id"])


@query("SELECT user_id, count(*) AS n FROM events GROUP BY user_id")
def stream_state_read(spark, d):
    """The state of a finished stream, read from its checkpoint."""
    from .. import streaming

    marks = f"{_folder(spark)}/marks-{uuid.uuid4().hex}"
    streaming.run_to_end(_stream(spark, d).groupBy("user_id").count(), _folder(spark), "complete", checkpoint=marks)
    return streaming.state_table(spark, marks).select(F.col("key.user_id").alias("user_id"), F.col("value.count").alias("n"))


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def stream_table_restart(spark, d):
    """A table kept by a query that is stopped and started again with a new sink."""
    from .. import streaming

    path, keys = f"{_folder(spark)}/table-{uuid.uuid4().hex}", ["user_id"]
    feed = events(spark, d).select("user_id", "event_id", "event_type")
    for number, part in enumerate((feed.where("event_id % 2 = 0"), feed.where("event_id % 2 = 0"), feed.where("event_id % 2 = 1"))):
        streaming.TableSink(path, keys, "event_id")(part, max(0, number - 1))  # the first batch is replayed
    return streaming.TableSink(path, keys, "event_id").read(spark)


@query(f"""WITH {EV}, o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ms, event_id) AS rn FROM ev), g AS (SELECT *, (rn - 1) // 3 AS batch FROM o)
  SELECT user_id, min(ms) AS first_ms, CAST(count(*) AS BIGINT) AS n, CAST(sum(cents) AS BIGINT) AS total FROM g GROUP BY user_id, batch HAVING count(*) = 3""")
def stream_key_batches(spark, d):
    """Batches of three rows, put out by the row that completes them; rows of one
    file, so that none is late. What is left waits for its timer."""
    from .. import streaming

    e = _stream(spark, d, 1)
    src = e.withColumn("at", (F.unix_millis("at") * 1000 + F.col("event_id") % 1000).cast("long")).withColumn("at", F.timestamp_micros("at"))
    out = streaming.key_batch_stream(src, "user_id", "at", "event_id", "cents", max_count=2, max_size=2**60, max_age=400 * DAY)
    return streaming.run_to_end(out, _folder(spark)).select("user_id", "first_ms", F.size("items").cast("long").alias("n"), "total")


__all__ = ["stream_time"]
