"""Queries against their SQL on pages whose titles were cut inside a reference."""

import os

import duckdb
import pytest

from webweft.queries import ORACLE_SQL, QUERIES

CUT = ["token = &quot", "token = &quo", "a &amp", "a &am", "&ampquot; b&", "&copy 2 &middot 3", "&quot;a&quot; &amp;quot; &amp;amp; &copy; &middot;", "&amp&quot;&ampere;"]
NAMES = ["q01_find_title", "q44_form_matrix", "q09_h1_text", "q14_set_multi", "q16_selector_union", "q17_do_merge", "q18_get_next", "q19_nested_get", "q29_repeated_set", "q30_submit", "q33_follow", "q36_array_root", "q37_post", "q38_login", "q39_do_follow"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A folder with these pages, in the shape of the driver's."""
    where = str(tmp_path_factory.mktemp("cut"))
    html = '<!DOCTYPE html><html lang="en"><head><title>{0}</title></head><body><nav><ul><li><a href="/x">{0}</a></li></ul></nav><article><h1>{0}</h1><p>text</p></article><footer>{0}</footer></body></html>'
    pages = [(i, f"http://h/{i}", html.format(text)) for i, text in enumerate(CUT)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{where}/pages.parquet")
    return where


@pytest.mark.parametrize("name", NAMES)
def test_cut_references_equal_sql(name, spark, tables):
    sql = duckdb.connect()
    sql.sql(f"CREATE VIEW pages AS SELECT * FROM '{os.path.join(tables, 'pages.parquet')}/*.parquet'")
    got, want = QUERIES[name](spark, tables), sql.sql(ORACLE_SQL[name])
    order = [want.columns.index(c) for c in got.columns]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(repr(tuple(r[i] for i in order)) for r in want.fetchall())
