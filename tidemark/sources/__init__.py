"""Readers and writers, batch and streaming, and the choice of state backend."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: State store providers by name; "batch" keeps state in the plan itself.
STATE_BACKENDS = {
    "rocksdb": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "hdfs": "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider",
    "batch": None,
}


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_feed(spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType | str | None = None, ts: Column | None = None, **options: str) -> DataFrame:
    """A bounded feed; ``ts`` takes event time from the record itself."""
    reader = spark.read.format(fmt).options(**options)
    df = (reader.schema(schema) if schema is not None else reader).load(path)
    return df if ts is None else df.withColumn("ts", ts)


def stream_feed(spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType | str | None = None, ts: Column | None = None, files_per_trigger: int | None = None, **options: str) -> DataFrame:
    """An unbounded feed of files that arrive in ``path``."""
    reader = spark.readStream.format(fmt).options(**options)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    df = (reader.schema(schema) if schema is not None else reader).load(path)
    return df if ts is None else df.withColumn("ts", ts)


def kafka_feed(spark: SparkSession, servers: str, topic: str, value: T.StructType | None = None, streaming: bool = True, fail_on_data_loss: bool = True, starting: str = "earliest") -> DataFrame:
    """A Kafka topic as (key, value, partition, seq, ts); needs Spark's Kafka
    package on the class path. With a schema the value is parsed from JSON."""
    reader = (spark.readStream if streaming else spark.read).format("kafka")
    raw = reader.option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", starting).option("failOnDataLoss", str(fail_on_data_loss).lower()).load()
    body = F.col("value").cast("string")
    return raw.select(F.col("key").cast("string").alias("key"), (body if value is None else F.from_json(body, value)).alias("value"), "partition", F.col("offset").alias("seq"), F.col("timestamp").alias("ts"))


def memory_table(spark: SparkSession, rows: list, schema: T.StructType | str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite", partition_by: list[str] | None = None, order: list[str] | None = None) -> None:
    """Partition by a segment column to let reads prune and old segments be dropped;
    ``order`` within files: key first for reads of a key, time first for reads of a
    span, whose row groups are then skipped by their statistics."""
    if order:
        df = df.sortWithinPartitions(*(partition_by or []), *order)
    writer = df.write.format(fmt).mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def write_bucketed(df: DataFrame, table: str, buckets: int, keys: list[str]) -> None:
    """A table bucketed and sorted by its key: later joins by it don't shuffle."""
    df.write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(table)


def kafka_sink(df: DataFrame, servers: str, topic: str, key: str, value: list[str] | None = None, checkpoint: str | None = None):
    """Rows to a Kafka topic, key as text and value as JSON of the columns given (all
    but the key): a batch write, or for a stream the writer to start. Needs Spark's
    Kafka package on the class path."""
    columns = value or [c for c in df.columns if c != key]
    out = df.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct(*columns)).alias("value"))
    if df.isStreaming:
        return out.writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).option("checkpointLocation", checkpoint)
    return out.write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic)


def repartition_by(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """Exactly ``n`` partitions, each key in one of them."""
    if n < 1:
        raise ValueError("the number of partitions must be positive")
    return df.repartition(n, *keys)


def use_window_filter(spark: SparkSession, on: bool = True) -> None:
    """Bloom filters made at run time that spare joins rows without a match."""
    spark.conf.set("spark.sql.optimizer.runtime.bloomFilter.enabled", str(on).lower())


def use_state_backend(spark: SparkSession, name: str) -> None:
    if name not in STATE_BACKENDS:
        raise ValueError(f"state backend must be one of {sorted(STATE_BACKENDS)}")
    if STATE_BACKENDS[name]:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_BACKENDS[name])
    if name == "rocksdb":  # checkpoints hold what changed, not whole snapshots
        spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
