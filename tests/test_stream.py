"""Streams of pages."""

import webweft as w
from webweft.streaming.crawl import each_batch, page_stream, start


def test_resumes_where_it_stopped(spark, tmp_path):
    pages, out, check = (str(tmp_path / d) for d in ("pages", "out", "check"))
    chain = w.find("a").set("href", "@href")

    def add(i):
        spark.createDataFrame([(i, f"http://h/{i}", f"<a href={i}>x</a>")], "page_id long, url string, html string").coalesce(1).write.mode("append").parquet(pages)

    add(1)
    start(chain, page_stream(spark, pages), out, check).awaitTermination()
    add(2)
    start(chain, page_stream(spark, pages), out, check).awaitTermination()
    assert sorted(tuple(r) for r in spark.read.parquet(out).select("page_id", "href").collect()) == [(1, "1"), (2, "2")]


def test_nested_results_by_batch(spark, tmp_path):
    store = spark.createDataFrame([("http://h/1", "<title>one")], "url string, html string")
    spark.createDataFrame([(1, "http://h/0", "<a href=/1>x</a>")], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages"))
    got = []
    chain = w.set("titles", w.follow("a").set("t", "title"))
    each_batch(chain, page_stream(spark, str(tmp_path / "pages")), lambda df, n: got.extend(df.collect()), str(tmp_path / "check"), store).awaitTermination()
    assert got[0].asDict(recursive=True) == {"page_id": 1, "titles": [{"t": "one"}]}
