"""A corpus from raw documents to packed sequences, in five stages.

A row is known by its id and its text together, so rows with null or repeated ids are
decided one by one. Stages take the columns of documents by name and return these;
other columns of the table go. Empty tables pass through as empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import cut
from tidemark.llm.exact_dedup import dedup
from tidemark.llm.jaccard import components
from tidemark.llm.packing import pack
from tidemark.llm.quality import score_texts, train_quality
from tidemark.llm.queries import tokenizer_path
from tidemark.llm.substring import remove_repeats

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the compression classifier rejects (score below 0.5),
    each row by its own whole text; null and empty texts by the score of the empty
    text. Without labelled rows every score is that of the prior."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = train_quality(docs, labels, F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    return score_texts(docs.select(*COLUMNS), model, name="__score").where(F.col("__score") >= 0.5).select(*COLUMNS)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each text: of the rows with the largest doc_id any one (a null
    id only where all are null). Null counts as the empty text."""
    rows, _ = dedup(docs)
    stay = rows.where("kept").groupBy(F.col("id").alias("__id"), F.col("digest").alias("__kept")).agg(F.count(F.lit(1)).alias("__rows"))
    digest = F.unhex(F.sha2(F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8"), 256))
    met = docs.select(*COLUMNS, digest.alias("__digest")).join(stay, (F.col("__digest") == F.col("__kept")) & F.col("doc_id").eqNullSafe(F.col("__id")))
    once, more = met.where("__rows = 1"), met.where("__rows > 1").dropDuplicates(["__digest"])
    return once.select(*COLUMNS).unionByName(more.select(*COLUMNS))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group of near duplicates (shingles of five
    words, Jaccard similarity 0.8 or more; op10 has its own contract), null ids last
    and ties by a hash; documents without words are linked with nothing and stay."""
    docs = docs.select(*COLUMNS, F.xxhash64("doc_id", "text").alias("__row"))
    rows = components(docs, percent=80, n=5, key="__row").join(docs.select("__row", "doc_id"), "__row")
    stay = rows.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "__row"))["__row"].alias("__row"))
    return docs.join(stay.select("__row"), "__row", "left_semi").select(*COLUMNS)


def substring(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated passages out; documents of which no word is left go, those that
    had none to begin with stay. Texts without a repeated passage stay unchanged."""
    out = remove_repeats(docs.select(*COLUMNS), keep=("doc_id", "lang", "source"))
    return out.where((F.col("n_removed") == 0) | (F.length("kept") > 0)).select("doc_id", F.when(F.col("n_removed") == 0, F.col("original")).otherwise(F.col("kept")).alias("text"), "lang", "source").withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 2048 tokens, every row by itself."""
    return pack(docs, tokenizer_path())


STAGES = [("quality", quality), ("exact_dedup", exact), ("near_dedup", near), ("substring_dedup", substring), ("packing", packing)]

#: Classifiers and tokenizers aren't expressible in SQL; tests/llm/test_pipeline_run.py compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stage's rows written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
    return docs
