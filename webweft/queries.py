"""The registered queries over the reference tables, and the SQL that says what they mean."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions import text, urls
from .plans.chain import Chain
from .plans.spec import INDEX, Fn
from .sources.pages import Snapshot

#: Page keys as URLs: what a chain that pages by number asks for.
NUMBERED = "http://snapshot/?page_id="


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pages(spark: SparkSession, sf_dir: str) -> Chain:
    return Chain().over(_table(spark, sf_dir, "pages"))


def _numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").withColumn("url", F.concat(F.lit(NUMBERED), F.col("page_id").cast("string")))


def q01_find_title(spark, sf_dir):
    return _pages(spark, sf_dir).find("head > title").set("title").to_df()


def q02_find_links(spark, sf_dir):
    return _pages(spark, sf_dir).find("a").set("href", "@href").to_df()


def q03_find_links_indexed(spark, sf_dir):
    return _pages(spark, sf_dir).find("nav a").set({"i": INDEX, "href": "@href"}).to_df()


def q04_link_text(spark, sf_dir):
    return _pages(spark, sf_dir).find("a").set("link_text").to_df()


def q05_resolve_url(spark, sf_dir):
    return _pages(spark, sf_dir).find("a").set("link", Fn(lambda n, d: urls.resolve(n.url, n.attr("href")))).to_df()


def q06_footer_text(spark, sf_dir):
    return _pages(spark, sf_dir).set("footer", "footer").to_df()


def q07_ad_text(spark, sf_dir):
    return _pages(spark, sf_dir).set("ad", "div.ad").to_df()


def q08_count_p(spark, sf_dir):
    return _pages(spark, sf_dir).set("n", Fn(lambda n, d: len(n.find("p")), T.LongType())).to_df()


def q09_h1_text(spark, sf_dir):
    return _pages(spark, sf_dir).set("h1", "article h1").to_df()


def q10_lang_attr(spark, sf_dir):
    return _pages(spark, sf_dir).set("lang", "html@lang").to_df()


def q11_filter_exists(spark, sf_dir):
    return _pages(spark, sf_dir).filter('//html[@lang="fr"]').to_df()


def q11_success_exists(spark, sf_dir):
    return _pages(spark, sf_dir).success('//html[@lang="fr"]').to_df()


def q11_fail_missing(spark, sf_dir):
    return _pages(spark, sf_dir).fail('//html[@lang="fr"]').to_df()


def q12_contains_link(spark, sf_dir):
    return _pages(spark, sf_dir).find("a").contains("th").set("link_text").to_df()


def q13_match_link(spark, sf_dir):
    return _pages(spark, sf_dir).find("a").match("^[A-Z]").set("link_text").to_df()


def q14_set_multi(spark, sf_dir):
    return _pages(spark, sf_dir).set({"title": "title", "lang": "html@lang", "footer": "footer"}).to_df()


def q15_nested_links(spark, sf_dir):
    links = Chain().find("a").set("href", "@href")
    df = _pages(spark, sf_dir).set("links", links).to_df()
    return df.select("page_id", F.array_join("links.href", "|").alias("hrefs"))


def q16_selector_union(spark, sf_dir):
    return _pages(spark, sf_dir).find(["title", "h1"]).set({"i": INDEX, "content": None}).to_df()


def q17_do_merge(spark, sf_dir):
    links = Chain().set("links", ["a@href"])
    df = _pages(spark, sf_dir).do(Chain().set("title", "title"), links).to_df()
    return df.select("page_id", "title", F.size("links").cast("long").alias("n_links"))


def q18_get_next(spark, sf_dir):
    pages = _numbered(spark, sf_dir)
    target = F.concat(F.lit(NUMBERED), (F.col("page_id") + 1).cast("string"))
    return Chain().over(pages).get(target).set("next_title", "title").to_df(Snapshot(pages))


def q19_nested_get(spark, sf_dir):
    pages = _numbered(spark, sf_dir)
    following = Chain().get(lambda n, d: NUMBERED + str(int(n.url.rpartition("=")[2]) + 1)).set("title", "title")
    df = Chain().over(pages).set({"title": "title", "following": following}).to_df(Snapshot(pages))
    return df.select("page_id", "title", F.get("following", F.lit(0))["title"].alias("next_title"))


def q20_paginate_param(spark, sf_dir):
    pages = _numbered(spark, sf_dir)
    seeds = pages.filter(F.col("page_id") % 50 == 0).withColumnRenamed("page_id", "seed")
    chain = Chain().over(seeds.withColumn("page_id", F.col("seed")).drop("page_id"), "seed")
    asked = Fn(lambda n, d: int(n.url.rpartition("=")[2]), T.LongType())
    df = chain.get(F.concat(F.lit(NUMBERED), F.col("seed").cast("string"))).paginate(lambda n, d: NUMBERED + str(int(n.url.rpartition("=")[2]) + 1), 3)
    return df.set("page_id", asked).to_df(Snapshot(pages))


def q21_internal_links(spark, sf_dir):
    return _pages(spark, sf_dir).set("n", Fn(lambda n, d: len(n.find("a:internal")), T.LongType())).to_df()


def q22_process_response(spark, sf_dir):
    chain = _pages(spark, sf_dir).process_response(lambda html: F.replace(html, F.lit("<b>"), F.lit("<i>")))
    return chain.set("n", Fn(lambda n, d: len(n.find("i")), T.LongType())).to_df()


def q23_doc_contains(spark, sf_dir):
    return _table(spark, sf_dir, "documents").filter(text.contains(F.col("text"), "the")).select("doc_id")


def q23_doc_match(spark, sf_dir):
    return _table(spark, sf_dir, "documents").filter(text.matches(F.col("text"), "[0-9]{3}")).select("doc_id")


def q24_conv_nested(spark, sf_dir):
    turns = _table(spark, sf_dir, "conversations")
    return turns.groupBy("conv_id").agg(text.gathered(F.col("role"), F.col("turn"), ">").alias("roles"))


def q25_url_parts(spark, sf_dir):
    url = F.col("url")
    return _table(spark, sf_dir, "pages").select("page_id", urls.host(url).alias("host"), urls.path(url).alias("path"), urls.query(url).alias("query"))


def q26_then_fan_out(spark, sf_dir):
    chain = _pages(spark, sf_dir).then(lambda n, d: [(n, {"part": p}) for p in ("title", "footer")], {"part": T.StringType()})
    return chain.to_df()


def q27_skip_last(spark, sf_dir):
    return _pages(spark, sf_dir).find("nav li:skip-last > a").set("href", "@href").to_df()


def q28_first_last(spark, sf_dir):
    return _pages(spark, sf_dir).set({"first": "li:first a@href", "last": "nav li:last > a@href"}).to_df()


def q29_repeated_set(spark, sf_dir):
    df = _pages(spark, sf_dir).set("v", "title").set("v", "html@lang").to_df()
    return df.select("page_id", F.array_join("v", "|").alias("v"))


def q30_submit(spark, sf_dir):
    """Forms around each page's number, submitted to the snapshot."""
    pages = _numbered(spark, sf_dir)
    form = F.concat(F.lit('<form action="http://snapshot/"><input type="hidden" name="page_id" value="'), F.col("page_id").cast("string"), F.lit('"></form>'))
    chain = Chain().over(pages.withColumn("html", form)).submit("form")
    return chain.set("title", "title").to_df(Snapshot(pages))


def q31_title_source(spark, sf_dir):
    return _pages(spark, sf_dir).set({"source": "meta:source", "html": "li:first > a:html"}).to_df()


def q32_errors(spark, sf_dir):
    return _pages(spark, sf_dir).success('//html[@lang="fr"]').errors().select(F.col("_src").cast("long").alias("page_id"), "message")


def _linked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The numbered pages, and the same numbers with markup that links to the next one."""
    pages = _numbered(spark, sf_dir)
    html = F.concat(F.lit('<title>at</title><a href="/?page_id='), (F.col("page_id") + 1).cast("string"), F.lit('">next</a>'))
    return pages, pages.withColumn("html", html)


def q33_follow(spark, sf_dir):
    pages, linked = _linked(spark, sf_dir)
    return Chain().over(linked).follow("a").set("next_title", "title").to_df(Snapshot(pages))


def q34_paginate_number(spark, sf_dir):
    """Pages by a parameter that counts up, two after each seed."""
    pages = _numbered(spark, sf_dir)
    seeds = pages.filter(F.col("page_id") % 50 == 0).select(F.col("page_id").alias("seed"), "url", "html")
    chain = Chain().over(seeds, "seed").paginate({"page_id": 1}, 2)
    return chain.set("page_id", Fn(lambda n, d: int(n.url.rpartition("=")[2]), T.LongType())).to_df(Snapshot(pages))


def q35_select(spark, sf_dir):
    return _pages(spark, sf_dir).find("body").select("a").set("href", "@href").to_df()


def q36_array_root(spark, sf_dir):
    df = _pages(spark, sf_dir).set(["title", "a@href"]).to_df()
    return df.select("page_id", F.array_join("value", "|").alias("items"))


def q37_post(spark, sf_dir):
    pages = _numbered(spark, sf_dir)
    target = F.concat(F.lit(NUMBERED), (F.col("page_id") + 1).cast("string"))
    return Chain().over(pages).post(target).set("next_title", "title").to_df(Snapshot(pages.withColumn("method", F.lit("POST"))))


def q38_login(spark, sf_dir):
    """Login forms around each page's number; the page is what the right name and password lead to."""
    pages, number = _numbered(spark, sf_dir), F.col("page_id").cast("string")
    form = F.concat(F.lit('<form action="/in" method="post"><input type="hidden" name="page_id" value="'), number, F.lit('"><input name="user"><input type="password" name="pass"></form>'))
    inside = pages.withColumns({"url": F.concat(F.lit("http://snapshot/in?page_id="), number, F.lit("&user=me&pass=secret")), "method": F.lit("post")})
    return Chain().over(pages.withColumn("html", form)).login("me", "secret").set("title", "title").to_df(Snapshot(inside))


def q39_do_follow(spark, sf_dir):
    pages, linked = _linked(spark, sf_dir)
    df = Chain().over(linked).set("here", "title").do(Chain().follow("a").set("next_title", "title")).to_df(Snapshot(pages))
    return df.select("page_id", "here", F.array_join("next_title", "|").alias("next_title"))


def q40_query_params(spark, sf_dir):
    url = F.concat(F.lit("http://h/p?a=1&b=x%20y&a="), F.col("page_id").cast("string"))
    params = urls.query_params(url)
    return _table(spark, sf_dir, "pages").select("page_id", params["a"].alias("a"), params["b"].alias("b"))


def q41_first_integer(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", urls.first_integer(F.col("url")).alias("n"))


def q42_response_type(spark, sf_dir):
    kinds = F.array(F.lit("text/html; charset=utf-8"), F.lit("application/xhtml+xml"), F.lit("image/png"), F.lit(None).cast("string"))
    return _table(spark, sf_dir, "pages").select("page_id", urls.response_type(F.get(kinds, (F.col("page_id") % 4).cast("int"))).alias("type"))


def q43_parse(spark, sf_dir):
    return Chain().parse(spark, "<ul><li>one<li>two &amp; three</ul>").find("li").set("item").to_df()


def q44_form_matrix(spark, sf_dir):
    """Controls of each kind: only what the form would send leads to the page."""
    pages, number = _numbered(spark, sf_dir), F.col("page_id").cast("string")
    before = (
        '<form action="/f"><input name="a" value="1"><input type="checkbox" name="b" checked><input type="checkbox" name="c"><select name="d"><option>x<option selected value="y">Y</select>'
        '<textarea name="e">t u</textarea><input name="g" value="no" disabled><input type="hidden" name="page_id" value="'
    )
    form = F.concat(F.lit(before), number, F.lit('"><input type="submit" name="s" value="go"></form>'))
    sent = pages.withColumn("url", F.concat(F.lit("http://snapshot/f?a=1&b=on&d=y&e=t+u&page_id="), number, F.lit("&s=go")))
    return Chain().over(pages.withColumn("html", form)).submit("form").set("title", "title").to_df(Snapshot(sent))


def q45_paginate_link(spark, sf_dir):
    """Pages by their link to the next one, as many as the first says."""
    pages, linked = _linked(spark, sf_dir)
    linked = linked.withColumn("html", F.concat("html", F.lit("<b>2 more</b>")))
    seeds = linked.filter(F.col("page_id") % 50 == 0).select(F.col("page_id").alias("seed"), "url", "html")
    chain = Chain().over(seeds, "seed").paginate("a", "b")
    return chain.set("page_id", Fn(lambda n, d: int(n.url.rpartition("=")[2]), T.LongType())).to_df(Snapshot(linked))


def q46_rejected(spark, sf_dir):
    """Responses that a hook rejects, as the log has them."""
    pages = _numbered(spark, sf_dir)
    chain = Chain().over(pages).process_response(lambda html: F.when(html.contains('lang="fr"'), html))
    return chain.find("title").errors().select(F.col("_src").cast("long").alias("page_id"), "message")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {n: f for n, f in list(globals().items()) if n.startswith("q") and n[1:3].isdigit()}


def _decoded(x: str) -> str:
    """Entities of the test pages in SQL, the ampersand last."""
    out = x
    for name, char in (("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·")):
        out = f"replace({out}, '{name}', '{char}')"
    return f"trim(regexp_replace({out}, '&amp;?', '&', 'g'))"


_TITLE = _decoded("regexp_extract(html, '<title>([^<]*)</title>', 1)")
_FOOTER = _decoded("regexp_extract(html, '<footer>([^<]*)', 1)")
_FOOTER_OR_NULL = f"CASE WHEN html LIKE '%<footer>%' THEN {_FOOTER} END"
_HREFS = "regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)"
_TEXTS = "regexp_extract_all(html, '<a href=\"[^\"]*\">([^<]*)</a>', 1)"
_LANG = "regexp_extract(html, '<html lang=\"([^\"]*)\"', 1)"
_LINK_TEXT = f"SELECT page_id, {_decoded('t')} AS link_text FROM (SELECT page_id, unnest({_TEXTS}) AS t FROM pages)"

_NEXT = f"SELECT a.page_id, b.next_title FROM pages a JOIN (SELECT page_id, {_TITLE} AS next_title FROM pages) b ON b.page_id = a.page_id + 1"
_WALKED = """
    WITH RECURSIVE r(seed, page_id, d) AS (
        SELECT page_id, page_id, 1 FROM pages WHERE page_id % 50 = 0
        UNION ALL
        SELECT r.seed, p.page_id, r.d + 1 FROM r JOIN pages p ON p.page_id = r.page_id + 1 WHERE r.d < {}
    )
    SELECT seed, page_id FROM r
"""

ORACLE_SQL: dict[str, str] = {
    "q01_find_title": f"SELECT page_id, {_TITLE} AS title FROM pages",
    "q02_find_links": f"SELECT page_id, unnest({_HREFS}) AS href FROM pages",
    "q03_find_links_indexed": f"SELECT page_id, CAST(unnest(range(len(h))) AS BIGINT) AS i, unnest(h) AS href FROM (SELECT page_id, {_HREFS} AS h FROM pages)",
    "q04_link_text": _LINK_TEXT,
    "q05_resolve_url": f"SELECT page_id, regexp_extract(url, '^(https?://[^/]+)', 1) || unnest({_HREFS}) AS link FROM pages",
    "q06_footer_text": f"SELECT page_id, {_FOOTER_OR_NULL} AS footer FROM pages",
    "q07_ad_text": f"SELECT page_id, {_decoded(chr(39).join(('regexp_extract(html, ', '<div class=\"ad\">([^<]*)</div>', ', 1)')))} AS ad FROM pages",
    "q08_count_p": "SELECT page_id, CAST(len(regexp_extract_all(html, '<p>')) AS BIGINT) AS n FROM pages",
    "q09_h1_text": f"SELECT page_id, {_decoded(chr(39).join(('regexp_extract(html, ', '<h1>([^<]*)</h1>', ', 1)')))} AS h1 FROM pages",
    "q10_lang_attr": f"SELECT page_id, {_LANG} AS lang FROM pages",
    "q11_filter_exists": "SELECT page_id FROM pages WHERE regexp_matches(html, '<html lang=\"fr\"')",
    "q11_success_exists": "SELECT page_id FROM pages WHERE regexp_matches(html, '<html lang=\"fr\"')",
    "q11_fail_missing": "SELECT page_id FROM pages WHERE NOT regexp_matches(html, '<html lang=\"fr\"')",
    "q12_contains_link": f"SELECT * FROM ({_LINK_TEXT}) WHERE contains(link_text, 'th')",
    "q13_match_link": f"SELECT * FROM ({_LINK_TEXT}) WHERE regexp_matches(link_text, '^[A-Z]')",
    "q14_set_multi": f"SELECT page_id, {_TITLE} AS title, {_LANG} AS lang, {_FOOTER_OR_NULL} AS footer FROM pages",
    "q15_nested_links": f"SELECT page_id, array_to_string({_HREFS}, '|') AS hrefs FROM pages",
    "q16_selector_union": f"SELECT page_id, CAST(0 AS BIGINT) AS i, {_TITLE} AS content FROM pages UNION ALL SELECT page_id, 1, {_decoded(chr(39).join(('regexp_extract(html, ', '<h1>([^<]*)</h1>', ', 1)')))} FROM pages",
    "q17_do_merge": f"SELECT page_id, {_TITLE} AS title, CAST(len(regexp_extract_all(html, '<a href=')) AS BIGINT) AS n_links FROM pages",
    "q18_get_next": _NEXT,
    "q19_nested_get": f"SELECT a.page_id, a.title, b.title AS next_title FROM (SELECT page_id, {_TITLE} AS title FROM pages) a LEFT JOIN (SELECT page_id, {_TITLE} AS title FROM pages) b ON b.page_id = a.page_id + 1",
    "q20_paginate_param": _WALKED.format(4),
    "q21_internal_links": f"""
        SELECT page_id, CAST(len(list_filter({_HREFS}, lambda h: regexp_extract(regexp_extract(url, '^(https?://[^/]+)', 1) || h, '^https?://([^/]+)', 1)
                         = regexp_extract(url, '^https?://([^/]+)', 1))) AS BIGINT) AS n
        FROM pages
    """,
    "q22_process_response": "SELECT page_id, CAST(len(regexp_extract_all(replace(html, '<b>', '<i>'), '<i>')) AS BIGINT) AS n FROM pages",
    "q23_doc_contains": "SELECT doc_id FROM documents WHERE contains(text, 'the')",
    "q23_doc_match": "SELECT doc_id FROM documents WHERE regexp_matches(text, '[0-9]{3}')",
    "q24_conv_nested": "SELECT conv_id, string_agg(role, '>' ORDER BY turn) AS roles FROM conversations GROUP BY conv_id",
    "q25_url_parts": "SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS path, regexp_extract(url, '[?]([^#]*)', 1) AS query FROM pages",
    "q26_then_fan_out": "SELECT page_id, unnest(['title', 'footer']) AS part FROM pages",
    "q27_skip_last": f"SELECT page_id, unnest(list_slice(h, 1, len(h) - 1)) AS href FROM (SELECT page_id, {_HREFS} AS h FROM pages)",
    "q28_first_last": f"SELECT page_id, {_HREFS}[1] AS first, {_HREFS}[-1] AS last FROM pages",
    "q29_repeated_set": f"SELECT page_id, {_TITLE} || '|' || {_LANG} AS v FROM pages",
    "q30_submit": f"SELECT page_id, {_TITLE} AS title FROM pages",
    "q31_title_source": f"""
        SELECT page_id, regexp_extract(html, '<meta[^>]*>') AS source,
               replace({_decoded("regexp_extract(html, '<a href=\"[^\"]*\">([^<]*)</a>', 1)")}, '&', '&amp;') AS html
        FROM pages
    """,
    "q33_follow": _NEXT,
    "q34_paginate_number": _WALKED.format(3),
    "q35_select": f"SELECT page_id, unnest({_HREFS}) AS href FROM pages",
    "q36_array_root": f"SELECT page_id, {_TITLE} || '|' || array_to_string({_HREFS}, '|') AS items FROM pages",
    "q37_post": _NEXT,
    "q38_login": f"SELECT page_id, {_TITLE} AS title FROM pages",
    "q39_do_follow": f"SELECT a.page_id, 'at' AS here, coalesce(b.title, '') AS next_title FROM pages a LEFT JOIN (SELECT page_id, {_TITLE} AS title FROM pages) b ON b.page_id = a.page_id + 1",
    "q40_query_params": "SELECT page_id, CAST(page_id AS VARCHAR) AS a, 'x y' AS b FROM pages",
    "q41_first_integer": "SELECT page_id, coalesce(TRY_CAST(regexp_extract(regexp_replace(url, '[^0-9.]+', '', 'g'), '^([0-9]+)', 1) AS INTEGER), 0) AS n FROM pages",
    "q42_response_type": "SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'html' WHEN 1 THEN 'xml' WHEN 2 THEN 'image/png' END AS type FROM pages",
    "q43_parse": "SELECT CAST(0 AS BIGINT) AS page_id, unnest(['one', 'two & three']) AS item",
    "q44_form_matrix": f"SELECT page_id, {_TITLE} AS title FROM pages",
    "q45_paginate_link": _WALKED.format(3),
    "q46_rejected": "SELECT page_id, '(process_response) rejected' AS message FROM pages WHERE NOT contains(html, 'lang=\"fr\"')",
    "q32_errors": "SELECT page_id, '(success) //html[@lang=\"fr\"] not found' AS message FROM pages WHERE NOT regexp_matches(html, '<html lang=\"fr\"')",
}
