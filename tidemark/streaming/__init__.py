"""The operators on unbounded input, by Structured Streaming.

Late data follow Spark's watermark here, which moves once a micro-batch; the
batch operators follow it record by record.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.listener import StreamingQueryListener

from ..operators.tables import latest_by_key


def windowed_stream(df: DataFrame, keys: list[str], ts: str, size: str, advance: str | None = None, grace: str = "0 seconds", **aggregates: Column) -> DataFrame:
    """Tumbling or hopping windows, closed by the watermark."""
    w = F.window(ts, size, advance) if advance else F.window(ts, size)
    out = df.withWatermark(ts, grace).groupBy(*keys, w.alias("w")).agg(*(a.alias(n) for n, a in aggregates.items()))
    return out.select(*keys, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *aggregates)


def session_stream(df: DataFrame, keys: list[str], ts: str, gap: str, grace: str = "0 seconds", **aggregates: Column) -> DataFrame:
    out = df.withWatermark(ts, grace).groupBy(*keys, F.session_window(ts, gap).alias("w")).agg(F.max(ts).alias("session_end"), *(a.alias(n) for n, a in aggregates.items()))
    return out.select(*keys, F.col("w.start").alias("session_start"), "session_end", *aggregates)


def dedup_stream(df: DataFrame, keys: list[str], ts: str | None = None, within: str | None = None) -> DataFrame:
    """A key's first row; with ``within`` its state is given up after that time."""
    return df.dropDuplicates(keys) if within is None else df.withWatermark(ts, within).dropDuplicatesWithinWatermark(keys)


def interval_stream_join(left: DataFrame, right: DataFrame, keys: list[str], left_ts: str, right_ts: str, within: str, grace: str = "0 seconds") -> DataFrame:
    """Pairs at most ``within`` apart; state is kept as long as that needs."""
    a, b = left.withWatermark(left_ts, grace).alias("l"), right.withWatermark(right_ts, grace).alias("r")
    on = F.expr(f"r.{right_ts} between l.{left_ts} - interval {within} and l.{left_ts} + interval {within}")
    for k in keys:
        on = on & (F.col(f"l.{k}") == F.col(f"r.{k}"))
    return a.join(b, on)


def stateful_frames(df: DataFrame, keys: list[str], order: str, step: Callable, output: T.StructType | str, state: T.StructType | str, mode: str = "append") -> DataFrame:
    """A fold of each key's rows, kept across micro-batches, by whole columns:
    ``step(state tuple or None, a key's rows of the micro-batch as a frame in order of
    ``order``)`` gives (state tuple or None, frame of rows or None)."""

    def run(key, frames: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        now, out = step(held.get if held.exists else None, pd.concat(list(frames)).sort_values(order, kind="stable"))
        if now is not None:
            held.update(now)
        if out is not None and len(out):
            yield out

    return df.groupBy(*keys).applyInPandasWithState(run, output, state, mode, "NoTimeout")


def stateful_stream(df: DataFrame, keys: list[str], order: str, step: Callable, output: T.StructType | str, state: T.StructType | str, mode: str = "append") -> DataFrame:
    """As :func:`stateful_frames`, for steps that need row after row:
    ``step(state tuple or None, row as dict)`` gives (state tuple, rows as dicts)."""

    def run(now, frame):
        out: list[dict] = []
        for row in frame.to_dict("records"):
            now, more = step(now, row)
            out.extend(more)
        return now, pd.DataFrame(out)

    return stateful_frames(df, keys, order, run, output, state, mode)


def timed_stream(df: DataFrame, keys: list[str], ts: str, order: str, step: Callable, expired: Callable, output: T.StructType | str, state: T.StructType | str, grace: str = "0 seconds", mode: str = "append") -> DataFrame:
    """A fold with event-time timers. ``step(state tuple or None, row as dict)`` gives
    (state tuple or None, rows as dicts, due time in milliseconds or None); once the
    watermark passes the due time of a key, ``expired(key, state)`` gives its last rows
    and the state goes. A due time that each row moves on is a time to live of the
    state; one set once is a punctuation. A key whose time was up before its next
    row came is closed first, in the same micro-batch."""
    if isinstance(state, str):
        state = T._parse_datatype_string(state)
    kept = T.StructType([T.StructField("__due", T.LongType()), *state.fields])

    def run(key, frames: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        out = []
        if held.hasTimedOut:
            out = list(expired(key, held.get[1:]))
            held.remove()
        else:
            due, *now = held.get if held.exists else (None,)
            now = tuple(now) or None
            if now is not None and due is not None and due <= held.getCurrentWatermarkMs():
                out.extend(expired(key, now))
                now, due = None, None
            for row in pd.concat(list(frames)).sort_values(order).to_dict("records"):
                now, more, later = step(now, row)
                due = due if later is None and now is not None else later
                out.extend(more)
            if now is None:
                if held.exists:
                    held.remove()
            else:
                held.update((due, *now))
                if due is not None:
                    held.setTimeoutTimestamp(max(int(due), held.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame(out)

    return df.withWatermark(ts, grace).groupBy(*keys).applyInPandasWithState(run, output, kept, mode, "EventTimeTimeout")


def key_batch_stream(df: DataFrame, key: str, ts: str, item: str, size: str, max_count: int = 50, max_size: int = 1000, max_age: int = 30_000, grace: str = "0 seconds") -> DataFrame:
    """Batches of a key's rows as the array of their ``item`` (a long), with the time
    of the first: put out by the row that makes a batch hold more than ``max_count``
    rows or more than ``max_size`` in all, or by a timer once the watermark is
    ``max_age`` milliseconds past the batch's first row."""
    src = df.select(key, ts, F.col(item).cast("long").alias("__item"), F.col(size).cast("long").alias("__size"), F.unix_millis(F.col(ts).cast("timestamp")).alias("__ms"))
    kind = src.schema[key].dataType.simpleString()

    def row_of(k, state):
        return {key: k, "first_ms": state[0], "items": list(state[2]), "total": state[1]}

    def step(state, row):
        first, total, items = state if state else (row["__ms"], 0, [])
        total, items = total + row["__size"], [*items, row["__item"]]
        if len(items) > max_count or total > max_size:
            return None, [row_of(row[key], (first, total, items))], None
        return (first, total, items), [], first + max_age

    return timed_stream(src, [key], ts, ts, step, lambda k, state: [row_of(k[0], state)], f"`{key}` {kind}, first_ms bigint, items array<bigint>, total bigint", "first_ms bigint, total bigint, items array<bigint>", grace)


def peek(df: DataFrame, name: str, **metrics: Column) -> tuple[DataFrame, Observation]:
    """``df`` unchanged, and what is observed of the rows that pass by."""
    seen = Observation(name)
    return df.observe(seen, *(m.alias(n) for n, m in metrics.items())), seen


def triggers(every: str | None = None, files: int | None = None, size: str | None = None) -> tuple[dict, dict]:
    """(options of the source, trigger): micro-batches by number of files, by bytes,
    or by time; without a time, all there is at once, in batches of that many."""
    options = {k: str(v) for k, v in (("maxFilesPerTrigger", files), ("maxBytesPerTrigger", size)) if v is not None}
    return options, {"processingTime": every} if every else {"availableNow": True}


def state_table(spark: SparkSession, checkpoint: str, operator: int = 0) -> DataFrame:
    """Keys and values of a stream's state as of its last finished batch."""
    return spark.read.format("statestore").option("operatorId", operator).load(checkpoint)


class _Versions:
    """Numbered folders under a path; a folder counts once its write has finished."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.path = spark._jvm, path
        self.root = self.jvm.org.apache.hadoop.fs.Path(path)
        self.fs = self.root.getFileSystem(spark._jsc.hadoopConfiguration())

    def finished(self) -> list[int]:
        if not self.fs.exists(self.root):
            return []
        done = []
        for x in self.fs.listStatus(self.root):
            name = x.getPath().getName()
            if name.isdigit() and self.fs.exists(self.jvm.org.apache.hadoop.fs.Path(x.getPath(), "_SUCCESS")):
                done.append(int(name))
        return sorted(done)

    def size(self, number: int) -> int:
        return self.fs.getContentSummary(self.jvm.org.apache.hadoop.fs.Path(self.root, str(number))).getLength()

    def drop(self, number: int) -> None:
        self.fs.delete(self.jvm.org.apache.hadoop.fs.Path(self.root, str(number)), True)


class TableSink:
    """``foreachBatch`` target that keeps the newest version of each key as Parquet,
    one folder a batch under ``path``. The last finished folder is the table; it is
    looked up on disk, so a restarted query goes on from it, and a batch that was
    already merged is passed over. The folder before it is kept for readers that
    began with it; older ones go.
    """

    def __init__(self, path: str, keys: list[str], seq: str, value: str | None = None):
        self.path, self.keys, self.seq, self.value = path, keys, seq, value

    def __call__(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        versions = _Versions(spark, self.path)
        done = versions.finished()
        if done and number <= done[-1]:
            return
        rows = latest_by_key(batch, self.keys, self.seq)
        if done:
            rows = latest_by_key(rows.unionByName(spark.read.parquet(f"{self.path}/{done[-1]}")), self.keys, self.seq)
        rows.write.mode("overwrite").parquet(f"{self.path}/{number}")
        for old in done[:-1]:
            versions.drop(old)

    def read(self, spark: SparkSession) -> DataFrame:
        table = spark.read.parquet(f"{self.path}/{_Versions(spark, self.path).finished()[-1]}")
        return table if self.value is None else table.where(F.col(self.value).isNotNull())


class ChangeSink(TableSink):
    """As :class:`TableSink`, for tables much larger than what a batch changes: a batch
    writes the newest versions of its own keys only, under ``changes``. Once the changes
    not yet merged have ``share`` of the bytes of the table under ``merged``, or are
    ``every`` batches, all are written together as the next ``merged`` table. A
    reader takes the newest of both. What is written for a row is thus bounded by
    1 + 1 / ``share`` or, for small batches, by a table each ``every`` batches.

    A batch counts once its changes have been written, so a restart goes on after it; a
    merge that broke off is done again by a later batch. Folders that the last merged
    table but one has taken in go; the last one's stay for readers that began before.
    """

    def __init__(self, path: str, keys: list[str], seq: str, value: str | None = None, share: float = 0.5, every: int = 64):
        super().__init__(path, keys, seq, value)
        if share <= 0 or every < 1:
            raise ValueError("share and every must be positive")
        self.share, self.every = share, every

    def _state(self, spark: SparkSession) -> tuple[_Versions, _Versions, list[int], list[int]]:
        """Both kinds of folders, the numbers of merged tables, and of changes since."""
        changes, merged = _Versions(spark, f"{self.path}/changes"), _Versions(spark, f"{self.path}/merged")
        tops = merged.finished()
        return changes, merged, tops, [n for n in changes.finished() if not tops or n > tops[-1]]

    def _table(self, spark: SparkSession, tops: list[int], waiting: list[int]) -> DataFrame:
        folders = [*(f"{self.path}/merged/{n}" for n in tops[-1:]), *(f"{self.path}/changes/{n}" for n in waiting)]
        rows = spark.read.parquet(*folders)
        return latest_by_key(rows, self.keys, self.seq) if len(folders) > 1 else rows

    def __call__(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        _, _, tops, waiting = self._state(spark)
        if number <= max([*tops, *waiting], default=-1):
            return
        latest_by_key(batch, self.keys, self.seq).write.mode("overwrite").parquet(f"{self.path}/changes/{number}")
        changes, merged, tops, waiting = self._state(spark)
        if len(waiting) < self.every and tops and sum(map(changes.size, waiting)) < self.share * merged.size(tops[-1]):
            return
        self._table(spark, tops, waiting).write.mode("overwrite").parquet(f"{self.path}/merged/{number}")
        for n in changes.finished():
            if tops and n <= tops[-1]:
                changes.drop(n)
        for n in tops[:-1]:
            merged.drop(n)

    def read(self, spark: SparkSession) -> DataFrame:
        _, _, tops, waiting = self._state(spark)
        table = self._table(spark, tops, waiting)
        return table if self.value is None else table.where(F.col(self.value).isNotNull())


def run_to_end(df: DataFrame, folder: str, mode: str = "append", sink: TableSink | None = None, keys: list[str] | None = None, checkpoint: str | None = None) -> DataFrame | None:
    """Runs a stream over what is there (availableNow) into Parquet under ``folder``,
    or into ``sink``, and returns its outcome: all rows (append), those of the last
    batch (complete), or the last row of each of ``keys`` (update)."""
    spark = df.sparkSession
    if mode == "update" and sink is None and not keys:
        raise ValueError("update mode needs the keys that rows replace one another by")
    name = uuid.uuid4().hex
    out, marks = f"{folder}/stream-{name}", checkpoint or f"{folder}/marks-{name}"
    writer = df.writeStream.option("checkpointLocation", marks).trigger(availableNow=True).outputMode(mode)
    if sink is not None:
        query = writer.foreachBatch(sink).start()
    elif mode == "append":
        query = writer.format("parquet").option("path", out).start()
    else:
        query = writer.foreachBatch(lambda b, n: b.withColumn("__batch", F.lit(n)).write.mode("overwrite").parquet(f"{out}/{n}")).start()
    query.awaitTermination()
    if sink is not None:
        return sink.read(spark)
    if mode == "append":
        return spark.read.schema(df.schema).parquet(out)
    done = _Versions(spark, out).finished()
    if mode == "complete":
        return spark.read.parquet(f"{out}/{done[-1]}").drop("__batch")
    rows = spark.read.parquet(*[f"{out}/{n}" for n in done])
    return latest_by_key(rows, keys, "__batch").drop("__batch")


def _offsets(text: str | None) -> dict[str, int] | None:
    """The numbers in a source's offset, by their place in it."""
    try:
        held = json.loads(text)
    except (TypeError, ValueError):
        return None
    if isinstance(held, int):
        return {"": held}
    if not isinstance(held, dict):
        return None
    found = {}
    for at, x in held.items():
        if isinstance(x, dict):
            found |= {f"{at}/{k}": n for k, n in x.items() if isinstance(n, int)}
        elif isinstance(x, int):
            found[at] = x
    return found or None


class ProgressLog(StreamingQueryListener):
    """Collects the progress of a session's streams (rates, offsets, state sizes), and
    calls hooks: ``started(event)``, ``progressed(progress)``, ``ended(event)``."""

    def __init__(self, keep: int = 1000, started: Callable | None = None, progressed: Callable | None = None, ended: Callable | None = None):
        self.keep, self.progress = keep, []
        self.started, self.progressed, self.ended = started, progressed, ended

    def lag(self) -> dict[str, int]:
        """Records of each source that a stream's last batch left waiting, from its
        sources' latest and end offsets (of a feed with numbered offsets: the sum over
        its partitions); sources that report no such numbers are left out."""
        out = {}
        for source in self.progress[-1].sources if self.progress else []:
            latest, ended = _offsets(source.latestOffset), _offsets(source.endOffset)
            if latest is not None and ended is not None:
                out[source.description] = sum(max(0, n - ended.get(at, 0)) for at, n in latest.items())
        return out

    def onQueryStarted(self, event):
        if self.started:
            self.started(event)

    def onQueryProgress(self, event):
        self.progress = [*self.progress, event.progress][-self.keep :]
        if self.progressed:
            self.progressed(event.progress)

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        if self.ended:
            self.ended(event)


def diagnose(rates: DataFrame, arrived: str, processed: str, capacity: float, low: float = 0.3, high: float = 0.8) -> DataFrame:
    """Rows of rates (arrivals and processed rows in a span of time) with ``action``:
    "up" where arrivals exceed ``high`` of the capacity or more came than was
    processed, "down" where they are below ``low`` of it and nothing waits, else "none"."""
    behind = F.col(arrived) > F.col(processed)
    action = F.when(behind | (F.col(arrived) > capacity * high), "up").when(F.col(arrived) < capacity * low, "down").otherwise("none")
    return rates.withColumn("action", action)
