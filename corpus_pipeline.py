"""A pipeline that prepares documents for training: five stages, each one of the llm operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webweft.llm import langid, linededup, nearcopies, packing, secrets
from webweft.llm.common import fresh_name, materialize, named


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; those without a letter and the ambiguous go."""
    lang, score, unsure = (fresh_name(docs, n) for n in ("_lang", "_score", "_unsure"))
    found = langid.predict(docs, langid.train(docs), out=lang, score=score, ambiguous=unsure)
    kept = found.filter((found[lang] != langid.UNDETERMINED) & ~found[unsure])
    return kept.select(*map(named, docs.columns))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that spread over many sources. Copies and near copies of a
    text vote once, so a text that was copied stays whole for :func:`near_dedup`."""
    return linededup.remove_widespread_lines(docs, copies_once=True)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies."""
    return nearcopies.drop_near_copies(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts masked."""
    forest = secrets.train(secrets.labelled_findings(spark))
    findings = fresh_name(docs, "_findings")
    found = secrets.scan(docs, forest, findings_col=findings)
    return secrets.redact(found, findings_col=findings).select(*map(named, docs.columns))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the packed sequences."""
    return packing.pack_sum_of_squares(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("secret_scan", secret_scan),
    ("best_fit_packing", best_fit_packing),
]

#: SQL can express neither the fingerprints nor the forest nor the token ids.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
