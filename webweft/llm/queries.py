"""The registered queries of this subpackage: thin uses of its operators with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, langid, linededup, lzprint, mainhtml, packing, secrets, simhash, topk


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.filter("vec_id % 50 = 0"), 5)


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mainhtml.extract(_table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's number of candidates and secrets, digests of the secrets, and the masked text."""
    forest = secrets.train(secrets.labelled_findings(spark))
    found = secrets.redact(secrets.scan(_table(spark, sf_dir, "documents").select("doc_id", "text"), forest))
    true = F.filter("findings", lambda x: x["secret"])
    return found.select(
        "doc_id",
        F.size("findings").cast("long").alias("n_candidates"),
        F.size(true).cast("long").alias("n_secrets"),
        F.transform(true, lambda x: F.sha2(x["value"], 256)).alias("secrets_sha256"),
        "text",
    )


def op4_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed sequences of all documents; the matrices come as digests."""
    packed = packing.pack_best_fit_decreasing(_table(spark, sf_dir, "documents"))
    return packed.select(
        "sequence_id",
        F.col("n_tokens").cast("long").alias("n_tokens"),
        F.size("doc_ids").cast("long").alias("n_segments"),
        "doc_ids",
        "starts",
        "cu_seqlens",
        F.crc32("ids").alias("ids_crc32"),
        F.crc32("position_ids").alias("position_ids_crc32"),
    )


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(_table(spark, sf_dir, "documents"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_sum_of_squares(_table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op9_lz_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lzprint.fingerprint_with_edits(_table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return linededup.remove_widespread_lines(docs, removed_col="n_removed").select("doc_id", "text", "n_removed")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_topk": op1_topk,
    "op2_html_text": op2_html_text,
    "op3_secret_scan": op3_secret_scan,
    "op4_token_output": op4_token_output,
    "op5_simhash": op5_simhash,
    "op6_bpe": op6_bpe,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_language_id": op8_language_id,
    "op9_lz_fingerprint": op9_lz_fingerprint,
    "op10_line_dedup": op10_line_dedup,
}

ORACLE_SQL: dict[str, str] = {
    "op1_topk": """
        WITH whole AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
            FROM whole q JOIN whole c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v)
            WHERE q.vec_id % 50 = 0
        )
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
        FROM scored
        QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
    """,
    "op10_line_dedup": """
        WITH lines AS (
            SELECT rowid_ AS r, doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i
            FROM (SELECT row_number() OVER () AS rowid_, * FROM documents)
        ), bad AS (
            SELECT trim(line, ' ') AS k FROM lines WHERE trim(line, ' ') <> ''
            GROUP BY 1 HAVING count(DISTINCT coalesce(source, '(none)')) >= 6
        )
        SELECT any_value(doc_id) AS doc_id,
               coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE k IS NULL), '') AS text,
               count(k) AS n_removed
        FROM lines LEFT JOIN bad ON trim(line, ' ') = k
        GROUP BY r
    """,
}
