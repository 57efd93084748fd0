"""The queries of this subpackage, with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _fold(key: str, n: int):
    return F.crc32(F.col(key).cast("string")) % n


def _held_out(n: int, fold: int):
    """A row without an id is in no fold."""
    return F.coalesce(_fold("doc_id", n) == fold, F.lit(False)).alias("held_out")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import dedup

    rows, _ = dedup(_read(spark, sf_dir, "documents"))
    return rows.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op2_bpe_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import encode_documents

    return encode_documents(_read(spark, sf_dir, "documents"), tokenizer_path(), digests=True)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import identify, train_langid

    docs = _read(spark, sf_dir, "documents")
    model = train_langid(docs, _fold("doc_id", 4) != 2)
    return identify(docs, model).select("doc_id", _held_out(4, 2), "lang_pred", "score")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import score_texts
    from .toxicity import train_toxicity

    docs = _read(spark, sf_dir, "documents")
    model = train_toxicity(docs, _read(spark, sf_dir, "labels"), _fold("doc_id", 3) != 1)
    return _scored(score_texts(docs.select("doc_id", "text"), model), 0.7)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import score_texts, train_quality

    docs = _read(spark, sf_dir, "documents")
    model = train_quality(docs, _read(spark, sf_dir, "labels"), _fold("doc_id", 3) != 1)
    return _scored(score_texts(docs.select("doc_id", "text"), model), 0.5)


def _scored(df: DataFrame, at: float) -> DataFrame:
    return df.select("doc_id", _held_out(3, 1), "score", (F.col("score") >= at).cast("int").alias("predicted"))


def op5_forest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import neighbours

    rows = _read(spark, sf_dir, "embeddings")
    return neighbours(rows, rows.where(F.col("vec_id") % 50 == 0))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring import remove_repeats

    return remove_repeats(_read(spark, sf_dir, "documents"), digests=True)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(_read(spark, sf_dir, "documents"), tokenizer_path())


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_extract import extract

    return extract(_read(spark, sf_dir, "pages"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import components

    return components(_read(spark, sf_dir, "documents"))


def queries():
    return {f.__name__: f for f in (op1_exact_dedup, op2_bpe_chunks, op3_language_id, op4_toxicity, op5_forest_neighbours, op6_substring_dedup, op7_packing, op8_html_text, op9_quality, op10_jaccard_join)}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_exact_dedup": """
            SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
                   doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
            FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
        "op6_substring_dedup": r"""
            WITH r AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
              x AS (SELECT rid, i, sha256(array_to_string(words[i:i + 34], ' ')) AS win FROM r, unnest(generate_series(1, len(words) - 34)) AS t(i)),
              again AS (SELECT win FROM x GROUP BY win HAVING count(*) > 1),
              gone AS (SELECT DISTINCT rid, i + k AS p FROM x, unnest(range(35)) AS t(k) WHERE win IN (SELECT win FROM again)),
              u AS (SELECT rid, unnest(words) AS word, generate_subscripts(words, 1) AS p FROM r),
              kept AS (SELECT rid, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS said FROM u ANTI JOIN gone USING (rid, p) GROUP BY rid)
            SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(said, '')) AS kept_sha256
            FROM r LEFT JOIN kept USING (rid)""",
        "op10_jaccard_join": r"""
            WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
              e AS (SELECT DISTINCT doc_id, array_to_string(words[i:i + 2], ' ') AS shingle FROM w, unnest(generate_series(1, greatest(len(words) - 2, least(len(words), 1)))) AS t(i)),
              sizes AS (SELECT doc_id, count(*) AS n FROM e GROUP BY doc_id),
              pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM e a JOIN e b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
              links AS (SELECT x, y FROM pairs JOIN sizes p ON x = p.doc_id JOIN sizes q ON y = q.doc_id WHERE 100 * common >= 90 * (p.n + q.n - common)),
              ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
              met AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT y, root FROM met JOIN ways ON x = met.doc_id)
            SELECT doc_id, coalesce(any_value(n), 0) AS n_shingles, min(root) AS component_id FROM met LEFT JOIN sizes USING (doc_id) GROUP BY doc_id""",
    }
