"""The pipeline's stages, each on its own input."""

import random

import corpus_pipeline
from pyspark.sql import functions as F

from webweft.llm.common import materialize


def test_stages(spark):
    rng = random.Random(8)
    vocab = {lang: ["".join(rng.choices(letters, k=rng.randint(2, 8))) for _ in range(400)] for lang, letters in (("en", "abcdefgh"), ("fr", "ijklmnop"))}
    rows = []
    for i in range(80):
        lang = ("en", "fr")[i % 2]
        rows.append((i, f"The same notice on all sites.\n{' '.join(rng.choices(vocab[lang], k=60))}", lang, f"src{i % 8}", 0))
    rows += [(100, rows[0][1], "en", "src1", 0), (101, "123 456 !!", "en", "src1", 0), (102, None, None, "src2", 0), (103, 'abc def token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" gah', "en", "src3", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({"lang_pred": F.lit("x"), "findings": F.lit(1), "_found": F.lit(2), "a.b": F.lit(3)})
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, materialize(stage(spark, docs, ""), f"test-{name}")
        seen[name] = docs
        if name != "best_fit_packing":
            assert docs.columns == before.columns
    ids = {n: {r.doc_id for r in d.select("doc_id").collect()} for n, d in seen.items()}
    assert ids["language_id"] == set(range(80)) | {100, 103}
    assert ids["line_dedup"] == ids["language_id"] and seen["line_dedup"].filter(F.col("text").contains("notice")).count() == 0
    assert ids["near_dedup"] == set(range(80)) | {103}
    assert seen["secret_scan"].filter(F.col("text").contains("04dbebab")).count() == 0 and ids["secret_scan"] == ids["near_dedup"]
    assert ids["best_fit_packing"] == ids["secret_scan"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_copied_texts_keep_their_lines(spark):
    rng = random.Random(9)
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 9))) for _ in range(3000)]
    lines = lambda n: [" ".join(rng.choices(words, k=20)) for _ in range(n)]
    near = lines(12)
    rows = [(i, "\n".join(lines(4) + ["The same notice on all sites."]), f"s{i % 10}") for i in range(40)]
    exact = "\n".join(lines(12))
    rows += [(100 + i, exact, f"s{i % 12}") for i in range(20)]
    rows += [(200 + i, "\n".join([*near[:i % 12], near[i % 12] + f" changed{i}", *near[i % 12 + 1 :]]), f"s{i % 12}") for i in range(20)]
    docs = spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    found = materialize(corpus_pipeline.line_dedup(spark, docs, ""), "test-copied")
    got = {r.doc_id: r.text for r in found.collect()}
    assert got == {i: t.replace("\nThe same notice on all sites.", "") for i, t, _ in rows}
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, found, "").collect()}
    assert kept == set(range(40)) | {100, 200}
