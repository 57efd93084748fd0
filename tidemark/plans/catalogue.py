"""Named queries over the test tables: (function, SQL for an independent engine).

Times are milliseconds, money is whole cents, arrival order is ``event_id``. Late
data are made by reordering arrival: see :func:`late_events`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import millis, order_preserving_base64, segment_interval, stream_time
from ..operators import joins, partitioning, sessions, stateful, tables, ttl, windows
from ..sources import read_table

HOUR = 3_600_000
DAY = 24 * HOUR

CATALOGUE: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}

#: Common table expressions of the SQL below.
EV = "ev AS (SELECT event_id, user_id, event_type, epoch_us(ts) // 1000 AS ms, CAST(round(value * 100) AS BIGINT) AS cents FROM events)"
LATE = f"""{EV}, lt AS (SELECT *, max(ms) OVER (ORDER BY seq ROWS UNBOUNDED PRECEDING) AS stream_time
  FROM (SELECT *, (event_id + 40 * (event_id % 5)) * 8 + 4 - event_id % 5 AS seq FROM ev))"""
WT = f"""{EV}, wt AS (SELECT user_id, ms - ms % {DAY} AS window_start, ms - ms % {DAY} + {DAY} AS window_end, count(*) AS n FROM ev GROUP BY ALL)"""
SES = f"""{EV}, s1 AS (SELECT *, CASE WHEN ms - lag(ms) OVER w <= {6 * HOUR} THEN 0 ELSE 1 END AS new FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY ms, event_id)),
  s2 AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ms, event_id) AS sid FROM s1),
  ses AS (SELECT user_id, min(ms) AS session_start, max(ms) AS session_end, count(*) AS n, CAST(sum(cents) AS BIGINT) AS cents FROM s2 GROUP BY user_id, sid)"""


def query(sql: str | None = None):
    def put(f):
        CATALOGUE[f.__name__] = (f, sql)
        return f

    return put


def cents(column: str) -> Column:
    return F.round(F.col(column) * 100).cast("long")


def events(spark: SparkSession, d: str) -> DataFrame:
    e = read_table(spark, d, "events")
    return e.select("event_id", "user_id", "event_type", millis(e).alias("ms"), cents("value").alias("cents"))


def late_events(spark: SparkSession, d: str) -> DataFrame:
    """Events that arrive up to 160 places late, with stream time at arrival."""
    late = (F.col("event_id") + 40 * (F.col("event_id") % 5)) * 8 + 4 - F.col("event_id") % 5
    return stream_time(events(spark, d).withColumn("seq", late), "seq", "ms", bucket=1 << 16)


# --- aggregates


@query("SELECT user_id, count(*) AS n FROM events GROUP BY user_id")
def kv_count(spark, d):
    return events(spark, d).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def count_rekeyed(spark, d):
    return events(spark, d).withColumnRenamed("event_type", "key").groupBy(F.col("key").alias("event_type")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {EV} SELECT user_id, CAST(sum(cents) AS BIGINT) AS cents FROM ev GROUP BY user_id")
def sum_by_key(spark, d):
    return events(spark, d).groupBy("user_id").agg(F.sum("cents").alias("cents"))


@query("SELECT user_id, string_agg(substr(event_type, 1, 1), '' ORDER BY event_id) AS said FROM events GROUP BY user_id")
def concat_in_order(spark, d):
    e = events(spark, d).withColumn("v", F.substring("event_type", 1, 1))
    return stateful.concat_in_order(e, ["user_id"], "event_id", "v", "said")


@query("SELECT event_id, user_id, count(*) OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)")
def running_count(spark, d):
    return stateful.running(events(spark, d), ["user_id"], "event_id", n=F.count(F.lit(1))).select("event_id", "user_id", "n")


@query(f"WITH {EV} SELECT event_id, user_id, CAST(sum(cents) OVER w AS BIGINT) AS total, count(*) OVER w AS n, min(ms) OVER w AS first_ms FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)")
def running_sum(spark, d):
    e = stateful.running(events(spark, d), ["user_id"], "event_id", total=F.sum("cents"), n=F.count(F.lit(1)), first_ms=F.min("ms"))
    return e.select("event_id", "user_id", "total", "n", "first_ms")


# --- key-value tables


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def table_latest(spark, d):
    return tables.latest_by_key(events(spark, d).select("user_id", "event_id", "event_type"), ["user_id"], "event_id")


@query("SELECT * FROM (SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1) WHERE event_type <> 'error'")
def table_latest_tombstones(spark, d):
    return tables.latest_by_key(events(spark, d).select("user_id", "event_id", "event_type"), ["user_id"], "event_id", deleted=F.col("event_type") == "error")


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1")
def kv_put_if_absent(spark, d):
    return tables.first_by_key(events(spark, d).select("user_id", "event_id", "event_type"), ["user_id"], "event_id")


def _customers(spark, d):
    return read_table(spark, d, "customer").select("c_custkey", "c_name", cents("c_acctbal").alias("cents"))


_C = "SELECT c_custkey, c_name, CAST(round(c_acctbal * 100) AS BIGINT) AS cents FROM customer"


@query(f"{_C} WHERE c_name = 'Customer#000000042'")
def kv_get(spark, d):
    return tables.get(_customers(spark, d), "c_name", "Customer#000000042")


@query(f"{_C} WHERE c_name BETWEEN 'Customer#000000020' AND 'Customer#000000120'")
def kv_range(spark, d):
    return tables.range_scan(_customers(spark, d), "c_name", "Customer#000000020", "Customer#000000120")


@query(f"{_C} WHERE c_name >= 'Customer#000000020' AND c_name < 'Customer#000000120'")
def kv_range_exclusive(spark, d):
    return tables.range_scan(_customers(spark, d), "c_name", "Customer#000000020", "Customer#000000120", upper_inclusive=False)


@query(f"{_C} WHERE starts_with(c_name, 'Customer#0000000')")
def kv_prefix(spark, d):
    return tables.prefix_scan(_customers(spark, d), "c_name", "Customer#0000000")


@query(_C)
def kv_all(spark, d):
    return tables.all_entries(_customers(spark, d), "c_name")


@query(f"{_C} WHERE c_name <= 'Customer#000000300'")
def kv_reverse(spark, d):
    return tables.range_scan(_customers(spark, d), "c_name", None, "Customer#000000300", descending=True)


@query("SELECT count(DISTINCT user_id) AS entries FROM events")
def kv_entries(spark, d):
    return tables.entry_count(tables.latest_by_key(events(spark, d), ["user_id"], "event_id"), ["user_id"])


@query("""SELECT c_custkey AS key, CAST(round(c_acctbal * 100) AS BIGINT) AS cents FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)
  UNION ALL SELECT o_custkey, CAST(round(o_totalprice * 100) AS BIGINT) FROM (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1) WHERE o_orderstatus <> 'F'""")
def overlay_merge(spark, d):
    stored = _customers(spark, d).select(F.col("c_custkey").alias("key"), "cents")
    orders = tables.latest_by_key(read_table(spark, d, "orders"), ["o_custkey"], "o_orderkey")
    written = orders.select(F.col("o_custkey").alias("key"), cents("o_totalprice").alias("cents"), (F.col("o_orderstatus") == "F").alias("deleted"))
    return tables.overlay_merge(stored, written, ["key"], "deleted")


@query(f"WITH {EV} SELECT user_id, event_id, event_type, ms FROM ev WHERE ms >= (SELECT max(ms) FROM ev) - {10 * DAY} QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def migrate_changelog(spark, d):
    e = events(spark, d).select("user_id", "event_id", "event_type", "ms")
    now = e.agg(F.max("ms")).scalar()
    return tables.migrate_changelog(e, ["user_id"], "ms", now, 10 * DAY, "event_id")


@query("SELECT c_custkey, translate(rtrim(base64(encode(c_name)), '='), 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/', '+/0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz') AS code FROM customer")
def order_preserving_key(spark, d):
    return _customers(spark, d).select("c_custkey", order_preserving_base64(F.encode("c_name", "UTF-8")).alias("code"))


# --- time to live


def _row_ttl() -> ttl.TimeToLive:
    own = F.when(F.col("event_type") == "click", HOUR).when(F.col("event_type") == "purchase", 2 * DAY).when(F.col("event_type") == "error", ttl.INFINITE)
    return ttl.TimeToLive(12 * HOUR, from_value=own)


_TTL = f"CASE event_type WHEN 'click' THEN {HOUR} WHEN 'purchase' THEN {2 * DAY} WHEN 'error' THEN {ttl.INFINITE} ELSE {12 * HOUR} END"


@query(f"WITH {EV} SELECT * FROM (SELECT user_id, event_id, ms FROM ev QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1) WHERE ms >= (SELECT max(ms) FROM ev) - {12 * HOUR}")
def ttl_default_lookup(spark, d):
    e = events(spark, d)
    now = e.agg(F.max("ms")).scalar()
    return ttl.expire(tables.latest_by_key(e.select("user_id", "event_id", "ms"), ["user_id"], "event_id"), "ms", now, ttl.TimeToLive(12 * HOUR))


@query(f"WITH {EV} SELECT * FROM (SELECT user_id, event_id, event_type, ms FROM ev QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1) WHERE ms >= (SELECT max(ms) FROM ev) - {_TTL}")
def ttl_row_level(spark, d):
    e = events(spark, d)
    now = e.agg(F.max("ms")).scalar()
    return ttl.expire(tables.latest_by_key(e.select("user_id", "event_id", "event_type", "ms"), ["user_id"], "event_id"), "ms", now, _row_ttl())


_DEDUP = """WITH RECURSIVE {ev}, t AS (SELECT *, {ttl} AS ttl FROM ev),
  f AS (SELECT user_id, event_id, ms, ttl FROM t QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1
    UNION ALL SELECT n.user_id, t.event_id, t.ms, t.ttl FROM (SELECT f.user_id, min(t.event_id) AS event_id FROM f JOIN t ON t.user_id = f.user_id AND t.event_id > f.event_id AND f.ms < t.ms - f.ttl GROUP BY f.user_id) n JOIN t ON t.event_id = n.event_id)
  SELECT user_id, event_id FROM f"""


@query(_DEDUP.format(ev=EV, ttl=12 * HOUR))
def dedup_ttl(spark, d):
    e = stream_time(events(spark, d), "event_id", "ms")
    return ttl.dedup_with_ttl(e, ["user_id"], ttl.TimeToLive(12 * HOUR), "event_id").select("user_id", "event_id")


@query(_DEDUP.format(ev=EV, ttl=_TTL))
def dedup_ttl_row_level(spark, d):
    e = stream_time(events(spark, d), "event_id", "ms")
    return ttl.dedup_with_ttl(e, ["user_id"], _row_ttl(), "event_id").select("user_id", "event_id")


# --- windows


@query(f"WITH {WT} SELECT * FROM wt")
def tumbling_count(spark, d):
    return windows.windowed(events(spark, d), ["user_id"], "ms", DAY, n=F.count(F.lit(1)))


@query(f"""WITH {EV}, h AS (SELECT *, unnest(generate_series(ms - ms % {6 * HOUR} - {18 * HOUR}, ms - ms % {6 * HOUR}, {6 * HOUR})) AS window_start FROM ev)
  SELECT user_id, window_start, window_start + {DAY} AS window_end, count(*) AS n, CAST(sum(cents) AS BIGINT) AS cents FROM h GROUP BY ALL""")
def hopping_agg(spark, d):
    return windows.windowed(events(spark, d), ["user_id"], "ms", DAY, 6 * HOUR, n=F.count(F.lit(1)), cents=F.sum("cents"))


@query(f"WITH {LATE} SELECT event_type, ms - ms % {HOUR} AS window_start, ms - ms % {HOUR} + {HOUR} AS window_end, count(*) AS n FROM lt WHERE ms - ms % {HOUR} + {HOUR} + {2 * HOUR} > stream_time GROUP BY ALL")
def tumbling_grace_late(spark, d):
    return windows.windowed(late_events(spark, d), ["event_type"], "ms", HOUR, grace=2 * HOUR, n=F.count(F.lit(1)))


@query(f"""WITH {LATE}, h AS (SELECT *, unnest(generate_series(ms - ms % {HOUR} - {3 * HOUR}, ms - ms % {HOUR}, {HOUR})) AS window_start FROM lt)
  SELECT event_type, window_start, window_start + {4 * HOUR} AS window_end, count(*) AS n, CAST(sum(cents) AS BIGINT) AS cents FROM h WHERE window_start + {4 * HOUR} + {HOUR} > stream_time GROUP BY ALL""")
def hopping_grace_late(spark, d):
    return windows.windowed(late_events(spark, d), ["event_type"], "ms", 4 * HOUR, HOUR, HOUR, n=F.count(F.lit(1)), cents=F.sum("cents"))


@query(f"WITH {LATE} SELECT seq, event_type, ms, stream_time FROM lt")
def stream_clock(spark, d):
    return late_events(spark, d).select("seq", "event_type", "ms", "stream_time")


@query(f"""WITH {LATE}, k AS (SELECT *, ms - ms % {HOUR} AS window_start FROM lt WHERE ms - ms % {HOUR} + {HOUR} + {2 * HOUR} > stream_time)
  SELECT event_id, event_type, window_start, CAST(sum(cents) OVER (PARTITION BY event_type, window_start ORDER BY seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total FROM k""")
def window_running_reduce(spark, d):
    rows = windows.drop_late(windows.assign_windows(late_events(spark, d), "ms", HOUR), 2 * HOUR)
    return stateful.running(rows, ["event_type", "window_start"], "seq", total=F.sum("cents")).select("event_id", "event_type", "window_start", "total")


_T0 = 1_704_067_200_000  # 2024-01-01


@query(f"WITH {WT} SELECT * FROM wt WHERE window_start = {_T0 + 5 * DAY} AND user_id = 7")
def window_fetch(spark, d):
    return windows.fetch(tumbling_count(spark, d), "user_id", 7, _T0 + 5 * DAY)


@query(f"WITH {WT} SELECT * FROM wt WHERE window_start BETWEEN {_T0 + 2 * DAY} AND {_T0 + 9 * DAY} AND user_id BETWEEN 3 AND 60")
def window_fetch_range(spark, d):
    return windows.fetch_range(tumbling_count(spark, d), _T0 + 2 * DAY, _T0 + 9 * DAY, "user_id", 3, 60)


@query(f"WITH {WT} SELECT * FROM wt WHERE window_start BETWEEN {_T0 + 2 * DAY} AND {_T0 + 9 * DAY}")
def window_fetch_all(spark, d):
    return windows.fetch_range(tumbling_count(spark, d), _T0 + 2 * DAY, _T0 + 9 * DAY)


@query(f"WITH {WT} SELECT * FROM wt WHERE window_start BETWEEN {_T0 + 2 * DAY} AND {_T0 + 9 * DAY} AND user_id = 7")
def window_back_fetch(spark, d):
    return windows.fetch_range(tumbling_count(spark, d), _T0 + 2 * DAY, _T0 + 9 * DAY, "user_id", 7, descending=True)


@query(f"WITH {WT} SELECT * FROM wt WHERE window_start >= (SELECT max(ms) FROM ev) - {10 * DAY} + 1")
def window_retention(spark, d):
    now = events(spark, d).agg(F.max("ms")).scalar()
    return windows.retained(tumbling_count(spark, d), now, 10 * DAY)


@query(f"""WITH {WT}, w AS (SELECT user_id, window_start, CASE WHEN n > 3 THEN NULL ELSE n * 10 END AS v FROM wt WHERE n > 1)
  SELECT user_id, window_start, n FROM wt WHERE n <= 1 UNION ALL SELECT user_id, window_start, v FROM w WHERE v IS NOT NULL""")
def window_put(spark, d):
    table = tumbling_count(spark, d).select("user_id", "window_start", "n")
    writes = table.where("n > 1").withColumn("n", F.when(F.col("n") <= 3, F.col("n") * 10))
    return windows.put(table, writes, ["user_id"], "n")


@query(f"WITH {EV} SELECT user_id, ms - ms % {HOUR} AS slot, string_agg(event_type, ',' ORDER BY event_id) AS said, count(*) AS n FROM ev GROUP BY ALL")
def retain_duplicates(spark, d):
    e = events(spark, d).withColumn("slot", F.col("ms") - F.col("ms") % HOUR)
    held = windows.retain_duplicates(e, ["user_id"], "slot", "event_id", "event_type")
    return held.select("user_id", "slot", F.array_join("values", ",").alias("said"), F.size("values").cast("long").alias("n"))


# --- sessions


@query(f"WITH {SES} SELECT * FROM ses")
def session_agg(spark, d):
    return sessions.session_aggregate(events(spark, d), ["user_id"], "ms", 6 * HOUR, n=F.count(F.lit(1)), cents=F.sum("cents"))


@query(f"WITH {SES} SELECT * FROM ses WHERE session_end >= {_T0 + 3 * DAY} AND session_start <= {_T0 + 5 * DAY}")
def session_find(spark, d):
    return sessions.find_sessions(session_agg(spark, d), _T0 + 3 * DAY, _T0 + 5 * DAY)


#: The fold of sessions in order of arrival, one event of each key a step: live are the
#: sessions after it, gone those that expired before it, met those that it took in.
_FOLD = f"""WITH RECURSIVE {LATE}, r AS (SELECT user_id, ms, stream_time AS now, cents AS v, row_number() OVER (PARTITION BY user_id ORDER BY seq) AS rn FROM lt),
  f AS (SELECT user_id, CAST(0 AS BIGINT) AS rn, CAST([] AS STRUCT(s BIGINT, e BIGINT, v BIGINT)[]) AS live, CAST([] AS STRUCT(s BIGINT, e BIGINT, v BIGINT)[]) AS gone, CAST([] AS STRUCT(s BIGINT, e BIGINT, v BIGINT)[]) AS met, CAST(0 AS BIGINT) AS low, CAST(0 AS BIGINT) AS high, CAST(0 AS BIGINT) AS total, false AS kept, CAST(0 AS BIGINT) AS ms FROM r WHERE rn = 1
    UNION ALL SELECT user_id, rn, CASE WHEN high >= valid THEN list_concat([x FOR x IN live IF NOT list_contains(met, x)], [{{'s': low, 'e': high, 'v': total}}]) ELSE live END, gone, met, low, high, total, high >= valid, ms
    FROM (SELECT *, least(ms, coalesce(list_min([x.s FOR x IN met]), ms)) AS low, greatest(ms, coalesce(list_max([x.e FOR x IN met]), ms)) AS high, v + coalesce(CAST(list_sum([x.v FOR x IN met]) AS BIGINT), 0) AS total
      FROM (SELECT *, [x FOR x IN live IF x.e >= ms - {6 * HOUR} AND x.s <= ms + {6 * HOUR}] AS met
        FROM (SELECT *, [x FOR x IN held IF x.e >= valid] AS live, [x FOR x IN held IF x.e < valid] AS gone
          FROM (SELECT f.user_id, r.rn, r.ms, r.v, f.live AS held, r.now - {7 * HOUR} + 1 AS valid FROM f JOIN r ON r.user_id = f.user_id AND r.rn = f.rn + 1)))))"""


@query(f"""{_FOLD} SELECT user_id, x.s AS session_start, x.e AS session_end, x.v AS cents
  FROM (SELECT user_id, unnest(gone) AS x FROM f UNION ALL SELECT user_id, unnest(arg_max(live, rn)) AS x FROM f GROUP BY user_id)""")
def session_grace_late(spark, d):
    out = sessions.session_fold(late_events(spark, d), ["user_id"], "seq", "ms", "cents", 6 * HOUR, HOUR, 0, lambda a, v: a + v, lambda a, b: a + b, T.LongType())
    return out.withColumnRenamed("value", "cents")


# --- joins


def _versions(spark, d):
    e = events(spark, d).where("event_type = 'click'")
    return e.select("user_id", F.col("event_id").alias("v_seq"), F.col("ms").alias("v_ms"), F.col("cents").alias("v_cents"))


def _purchases(spark, d):
    return stream_time(events(spark, d), "event_id", "ms").where("event_type = 'purchase'").select("event_id", "user_id", "stream_time")


def _asof(spark, d, **options):
    v = _versions(spark, d).withColumn("event_id", F.col("v_seq"))
    return joins.asof_join(_purchases(spark, d), v, ["user_id"], "event_id", ["v_seq", "v_cents"], **options).drop("stream_time")


_ASOF = f"""WITH {EV}, l AS (SELECT event_id, user_id, ms FROM ev WHERE event_type = 'purchase'), r AS (SELECT user_id, event_id AS v_seq, ms AS v_ms, cents AS v_cents FROM ev WHERE event_type = 'click')"""


@query(f"{_ASOF} SELECT event_id, l.user_id, v_seq, v_cents FROM l ASOF JOIN r ON l.user_id = r.user_id AND l.event_id >= r.v_seq")
def stream_table_join(spark, d):
    return _asof(spark, d)


@query(f"{_ASOF} SELECT event_id, l.user_id, v_seq, v_cents FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.event_id >= r.v_seq")
def stream_table_left(spark, d):
    return _asof(spark, d, how="left")


@query(f"{_ASOF} SELECT event_id, l.user_id, v_seq, v_cents FROM l ASOF JOIN r ON l.user_id = r.user_id AND l.event_id >= r.v_seq WHERE v_ms >= ms - {12 * HOUR}")
def stream_ttl_table_join(spark, d):
    return _asof(spark, d, ms="v_ms", ttl=F.lit(12 * HOUR))


@query("SELECT c_custkey, c_name, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def global_table_join(spark, d):
    c, n = read_table(spark, d, "customer"), read_table(spark, d, "nation")
    return joins.global_join(c, n, c["c_nationkey"] == n["n_nationkey"]).select("c_custkey", "c_name", "n_name")


@query("SELECT o_orderkey, o_custkey, c_name, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders JOIN customer ON o_custkey = c_custkey")
def fk_table_join(spark, d):
    left = tables.latest_by_key(read_table(spark, d, "orders").withColumn("seq", F.col("o_orderkey")), ["o_orderkey"])
    right = tables.latest_by_key(read_table(spark, d, "customer").withColumn("seq", F.col("c_custkey")), ["c_custkey"])
    return joins.foreign_key_join(left, right, "o_custkey", "c_custkey").select("o_orderkey", "o_custkey", "c_name", cents("o_totalprice").alias("cents"))


@query(f"WITH {EV} SELECT l.user_id, l.event_id AS click, r.event_id AS purchase FROM ev l JOIN ev r ON l.user_id = r.user_id AND r.ms BETWEEN l.ms - {6 * HOUR} AND l.ms + {6 * HOUR} WHERE l.event_type = 'click' AND r.event_type = 'purchase'")
def interval_join(spark, d):
    e = events(spark, d)
    left = e.where("event_type = 'click'").select("user_id", F.col("event_id").alias("click"), F.col("ms").alias("l_ms"))
    right = e.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("purchase"), F.col("ms").alias("r_ms"))
    return joins.interval_join(left, right, ["user_id"], "l_ms", "r_ms", 6 * HOUR).select("user_id", "click", "purchase")


@query(f"""WITH a AS (SELECT *, epoch_us(o_orderdate) // 1000 AS ms FROM orders), t AS (SELECT *, max(ms) OVER (ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS now FROM a),
  o AS (SELECT o_orderkey, o_custkey, ms, CAST(round(o_totalprice * 100) AS BIGINT) AS cents, c_name FROM t JOIN customer ON o_custkey = c_custkey WHERE ms - ((ms % {DAY}) + {DAY}) % {DAY} + {DAY} + {12 * HOUR} > now)
  SELECT o_custkey, ms - ((ms % {DAY}) + {DAY}) % {DAY} AS window_start, CAST(sum(cents) AS BIGINT) AS cents, min(o_orderkey) AS first_order, any_value(c_name) AS c_name FROM o GROUP BY 1, 2""")
def enrich_window_reduce(spark, d):
    """One-day windows with twelve hours of grace; orders arrive by number."""
    o, c = read_table(spark, d, "orders"), read_table(spark, d, "customer")
    feed = stream_time(o.select("o_orderkey", "o_custkey", millis(o, "o_orderdate").alias("ms"), cents("o_totalprice").alias("cents")), "o_orderkey", "ms")
    rows = feed.join(c.select(F.col("c_custkey").alias("o_custkey"), "c_name"), "o_custkey")
    return windows.windowed(rows, ["o_custkey"], "ms", DAY, grace=12 * HOUR, cents=F.sum("cents"), first_order=F.min("o_orderkey"), c_name=F.min_by("c_name", "o_orderkey")).drop("window_end")


_SCAN = """WITH e AS (SELECT event_id, user_id, event_type, substr(event_type, 1, 1) || event_id % 10 AS v FROM events),
  j AS (SELECT e.event_id, p.event_type AS pt, arg_max(p.v, p.event_id) AS pv FROM e JOIN e p ON p.user_id = e.user_id AND p.event_id < e.event_id {where} GROUP BY 1, 2),
  g AS (SELECT event_id, string_agg(pv, '' ORDER BY pt) AS s FROM j GROUP BY 1)
  SELECT e.event_id, user_id, coalesce(s, '') || v AS seen FROM e LEFT JOIN g ON e.event_id = g.event_id"""


def _scanned(spark, d, **bounds):
    e = events(spark, d).select("event_id", "user_id", "event_type", F.concat(F.substring("event_type", 1, 1), (F.col("event_id") % 10).cast("string")).alias("v"))
    return joins.state_scan(e, ["user_id"], "event_id", "event_type", "v", **bounds).select("event_id", "user_id", "seen")


@query(_SCAN.format(where=""))
def state_all_scan(spark, d):
    return _scanned(spark, d)


@query(_SCAN.format(where="AND p.event_type BETWEEN 'd' AND 'q'"))
def state_range_scan(spark, d):
    return _scanned(spark, d, low="d", high="q")


# --- folds


@query(f"""WITH RECURSIVE {EV}, r AS (SELECT user_id, ms, CAST(cents // 100 AS BIGINT) AS sz, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM ev),
  f AS (SELECT user_id, rn, ms, CAST(1 AS BIGINT) AS cnt, sz AS tot, CAST(0 AS BIGINT) AS batch FROM r WHERE rn = 1
    UNION ALL SELECT f.user_id, r.rn, r.ms, CASE WHEN f.cnt > 50 OR f.tot > 1000 THEN 1 ELSE f.cnt + 1 END, CASE WHEN f.cnt > 50 OR f.tot > 1000 THEN r.sz ELSE f.tot + r.sz END, CASE WHEN f.cnt > 50 OR f.tot > 1000 THEN f.batch + 1 ELSE f.batch END
    FROM f JOIN r ON r.user_id = f.user_id AND r.rn = f.rn + 1)
  SELECT user_id, batch, min(ms) AS first_ms, max(cnt) AS rows, max(tot) AS total, NOT (max(cnt) > 50 OR max(tot) > 1000) AS open FROM f GROUP BY user_id, batch""")
def key_batches(spark, d):
    return stateful.key_batches(events(spark, d), ["user_id"], "event_id", "ms", F.floor(F.col("cents") / 100))


@query(f"""WITH RECURSIVE {EV}, r AS (SELECT user_id, event_id, cents, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM ev),
  f AS (SELECT user_id, CAST(0 AS BIGINT) AS rn, ''::BLOB AS h FROM r WHERE rn = 1
    UNION ALL SELECT f.user_id, r.rn, unhex(sha256(unhex(sha256(f.h || unhex(printf('%016x', r.event_id)))) || unhex(printf('%016x', r.cents)))) FROM f JOIN r ON r.user_id = f.user_id AND r.rn = f.rn + 1)
  SELECT user_id, max(rn) AS links, lower(hex(arg_max(h, rn))) AS checksum FROM f GROUP BY user_id""")
def checksum_chain(spark, d):
    return stateful.checksum_chain(events(spark, d), ["user_id"], "event_id", ["event_id", "cents"])


@query("""WITH c AS (SELECT user_id, max(event_id) AS committed FROM events WHERE event_type = 'purchase' GROUP BY user_id)
  SELECT e.user_id, count(*) FILTER (WHERE event_id < coalesce(committed, 0) AND event_type <> 'error') AS origin_events FROM events e LEFT JOIN c ON e.user_id = c.user_id GROUP BY e.user_id""")
def origin_event_count(spark, d):
    """A user's last purchase stands for the offset committed for them."""
    e = events(spark, d)
    committed = e.where("event_type = 'purchase'").groupBy("user_id").agg(F.max("event_id").alias("committed"))
    return stateful.origin_event_count(e.join(committed, "user_id", "left"), "user_id", "event_id", F.coalesce("committed", F.lit(0)), F.col("event_type") == "error")


@query(f"WITH {EV} SELECT event_id, user_id, event_type || ':' || cents AS said FROM ev")
def async_ordered_map(spark, d):
    schema = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("user_id", T.LongType()), T.StructField("said", T.StringType())])
    return stateful.async_map(events(spark, d), ["user_id"], ["event_id"], lambda r: [{"event_id": r["event_id"], "user_id": r["user_id"], "said": f"{r['event_type']}:{r['cents']}"}], schema)


# --- partitioning

_INTERVAL = segment_interval(10 * DAY, 10)


@query(f"WITH {EV} SELECT ms - ms % {_INTERVAL} AS segment, count(*) AS n FROM ev GROUP BY 1")
def segment_assign(spark, d):
    return partitioning.with_segment(events(spark, d), "ms", _INTERVAL).groupBy("segment").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {EV}, days AS (SELECT ms - ms % {3 * DAY} AS day, max(ms) AS now FROM ev GROUP BY 1), p AS (SELECT day, now, coalesce(lag(now) OVER (ORDER BY day), -1) AS before FROM days),
  l AS (SELECT *, greatest(0, now - {10 * DAY} + 1) // {_INTERVAL} AS a, now // {_INTERVAL} AS b, CASE WHEN before < 0 THEN 0 ELSE greatest(0, before - {10 * DAY} + 1) // {_INTERVAL} END AS c, CASE WHEN before < 0 THEN -1 ELSE before // {_INTERVAL} END AS e FROM p)
  SELECT day, CAST(greatest(0, least(a, e + 1) - c) AS BIGINT) AS expired, CAST(b - greatest(a, e + 1) + 1 AS BIGINT) AS created FROM l""")
def segment_roll(spark, d):
    from pyspark.sql import Window

    e = events(spark, d)
    days = e.groupBy((F.col("ms") - F.col("ms") % (3 * DAY)).alias("day")).agg(F.max("ms").alias("now"))
    days = days.withColumn("before", F.coalesce(F.lag("now").over(Window.orderBy("day")), F.lit(-1)))
    expired, created = partitioning.segment_roll(F.col("before"), F.col("now"), 10 * DAY, _INTERVAL)
    return days.select("day", F.size(expired).cast("long").alias("expired"), F.size(created).cast("long").alias("created"))


@query("SELECT (o_custkey % 8) * 512 + ((31 * o_orderkey) & 2147483647) % 512 AS sub, count(*) AS n FROM orders GROUP BY 1")
def subpartition_route(spark, d):
    o = read_table(spark, d, "orders")
    sub = partitioning.subpartition(F.col("o_custkey") % 8, F.col("o_orderkey"), partitioning.subpartition_factor(4096, 8))
    return o.groupBy(sub.alias("sub")).agg(F.count(F.lit(1)).alias("n"))


# --- streams, run to the end of what is there


def _stream(spark, d, batches: int = 3):
    """Events as files that arrive one after the other, one in each micro-batch."""
    import uuid

    from ..sources import stream_feed

    whole = read_table(spark, d, "events")
    feed = f"{_folder(spark)}/feed-{uuid.uuid4().hex}"
    ends = whole.approxQuantile("event_id", [k / batches for k in range(1, batches)], 0.01) if batches > 1 else []
    for low, high in zip([None, *ends], [*ends, None], strict=True):
        part = whole if low is None else whole.where(F.col("event_id") > low)
        (part if high is None else part.where(F.col("event_id") <= high)).coalesce(1).write.mode("append").parquet(feed)
    e = stream_feed(spark, feed, schema=whole.schema, files_per_trigger=1)
    return e.withColumn("at", F.timestamp_millis(millis(e))).withColumn("cents", cents("value"))


def _folder(spark):
    import tempfile

    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return found or "file://" + tempfile.mkdtemp(prefix="tidemark-stream")


@query(f"WITH {WT} SELECT user_id, window_start, n FROM wt")
def stream_tumbling_count(spark, d):
    from .. import streaming

    out = streaming.windowed_stream(_stream(spark, d), ["user_id"], "at", "1 day", n=F.count(F.lit(1)))
    got = streaming.run_to_end(out, _folder(spark), "complete")
    return got.select("user_id", F.unix_millis("window_start").alias("window_start"), "n")


@query("SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY ALL")
def stream_dedup(spark, d):
    from .. import streaming

    return streaming.run_to_end(streaming.dedup_stream(_stream(spark, d), ["user_id", "event_type"]), _folder(spark)).select("user_id", "event_type", "event_id")


@query("SELECT event_id, user_id, count(*) OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)")
def stream_running_count(spark, d):
    from .. import streaming

    def step(state, rows):
        n = state[0] if state else 0
        return (n + len(rows),), rows.assign(n=range(n + 1, n + 1 + len(rows)))

    out = streaming.stateful_frames(_stream(spark, d).select("event_id", "user_id"), ["user_id"], "event_id", step, "event_id long, user_id long, n long", "n long")
    return streaming.run_to_end(out, _folder(spark))


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def stream_table_latest(spark, d):
    from .. import streaming

    folder = _folder(spark)
    import uuid

    sink = streaming.ChangeSink(f"{folder}/table-{uuid.uuid4().hex}", ["user_id"], "event_id")
    return streaming.run_to_end(_stream(spark, d).select("user_id", "event_id", "event_type"), folder, "update", sink)


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return tumbling_count(spark, d)
