"""Chains as plans, on the small documents that the operators were specified with."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import webweft as w

SET = '<html><head><title>TITLE</title></head><body><div id="content">CONTENT</div><a href="/1">1</a><a href="/2">2</a></body></html>'
PAGES = [
    (1, "http://h/set", SET),
    (2, "http://h/1", '<title>1</title><a href="/2">2</a><a href="/3">3</a>'),
    (3, "http://h/2", "<title>2</title>"),
    (4, "http://h/3", "<title>3</title>"),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(PAGES, "page_id long, url string, html string")


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_set_in_all_shapes(pages):
    chain = w.get("http://h/set").set(
        {"title": "title", "fake": "nothing", "inner": "div:html", "source": "title:source", "object": {"id": "div@id", "fake": "x"}, "find": w.find("div"), "array": ["a"],
         "follow": w.follow("a").set("title", "title"), "mixed": ["a", w.follow("a").set("title", "title")],
         "nested": w.follow("a").set({"title": "title", "pages": w.follow("a").set("page", "title")})}
    )
    r = chain.to_df(pages).first().asDict(recursive=True)
    assert r["title"] == "TITLE" and r["fake"] is None and r["inner"] == "CONTENT" and r["source"] == "<title>TITLE</title>"
    assert r["object"] == {"id": "content", "fake": None} and r["find"] == ["CONTENT"] and r["array"] == ["1", "2"]
    assert r["follow"] == [{"title": "1"}, {"title": "2"}]
    assert r["nested"] == [{"title": "1", "pages": [{"page": "2"}, {"page": "3"}]}, {"title": "2", "pages": []}]
    loose = json.loads(chain.to_json(pages).first().data)
    assert "fake" not in loose and loose["find"] == "CONTENT" and loose["object"] == {"id": "content"}
    assert loose["nested"] == [{"title": "1", "pages": [{"page": "2"}, {"page": "3"}]}, {"title": "2"}]


def test_array_root(pages):
    assert json.loads(w.get("http://h/set").set(["title", "a"]).to_json(pages).first().data) == ["TITLE", "1", "2"]


def test_find_select_and_index(pages):
    df = w.over(pages).find("a").set({"href": "@href", "text": None, "i": w.INDEX, "last": w.LAST}).to_df()
    assert rows(df.filter("page_id = 1")) == [(1, "/1", "1", 0, False), (1, "/2", "2", 1, True)]
    assert rows(w.over(pages).find("body").select("a").set("t").to_df().filter("page_id = 2")) == [(2, "2"), (2, "3")]
    assert rows(w.over(pages).find(["title", "div"]).set("t").to_df().filter("page_id = 1")) == [(1, "TITLE"), (1, "CONTENT")]


def test_predicates(pages):
    start = w.over(pages)
    assert rows(start.filter("div").to_df()) == [(1,)]
    assert rows(start.fail("a").to_df().orderBy("page_id")) == [(3,), (4,)]
    assert rows(start.success("div").to_df()) == [(1,)]
    assert rows(start.find("a").contains("3").set("t").to_df()) == [(2, "3")]
    assert rows(start.find("title").match("^[A-Z]+$").set("t").to_df()) == [(1, "TITLE")]


def test_requests(pages):
    start = w.over(pages).find("a")
    assert sorted(rows(start.get(lambda n, d: n.attr("href")).set("z", "title").to_df(pages))) == [(1, "1"), (1, "2"), (2, "2"), (2, "3")]
    by_column = w.over(pages).get(F.concat(F.lit("http://h/"), F.col("page_id").cast("string"))).set("z", "title").to_df(pages)
    assert sorted(rows(by_column)) == [(1, "1"), (2, "2"), (3, "3")]
    errors = w.over(pages).filter("div").get("/missing").errors(pages)
    assert rows(errors) == [("1", "(get) http://h/missing: not found")]


def test_status_empty_and_redirects(spark):
    store = spark.createDataFrame(
        [("http://h/a", 200, "<p>a"), ("http://h/b", 404, "<p>b"), ("http://h/c", 501, "<p>c"), ("http://h/d", 200, "")], "url string, status int, html string"
    )
    ask = spark.createDataFrame([(i, f"http://h/{x}", "<p>") for i, x in enumerate("abcd")], "page_id long, url string, html string")
    chain = w.over(ask).get(lambda n, d: n.url).set("p", "p")
    assert sorted(rows(chain.to_df(store))) == [(0, "a"), (2, "c")]
    assert sorted(rows(chain.to_df(w.Snapshot(store, ignore_http_errors=True)))) == [(0, "a"), (1, "b"), (2, "c")]
    messages = sorted(r.message for r in chain.errors(store).collect())
    assert messages == ["(get) http://h/b: status 404", "(get) http://h/d: Data is empty"]
    hops = spark.createDataFrame([("http://h/x", "http://h/y"), ("http://h/y", "http://h/a")], "src string, dst string")
    assert w.get("http://h/x").set("p", "p").to_df(w.Snapshot(store, redirects=hops)).first().p == "a"


def test_paginate(spark):
    pages = spark.createDataFrame([(f"http://h/p?page={i}", f'<div>{i}</div><a rel=next href="?page={i + 1}">n</a>') for i in range(1, 6)], "url string, html string")
    start = w.get("http://h/p?page=1")

    def got(chain):
        return sorted(tuple(r) for r in chain.set("d", "div").to_df(pages).collect())

    assert got(start.paginate('a[rel="next"]', 2)) == [("1",), ("2",), ("3",)]  # a limit of 2 is 2 more pages
    assert got(start.paginate({"page": 1}, 1)) == [("1",), ("2",)]
    assert len(got(start.paginate({"page": 1}))) == 5
    assert got(start.paginate(lambda n, d: n.first("a").attr("href"), 1)) == [("1",), ("2",)]
    assert got(start.paginate({"page": 1}, "div")) == [("1",), ("2",), ("3",), ("4",), ("5",)][:5]
    seen = start.paginate({"page": 1}, 2).to_df(pages, with_request=True).collect()
    assert sorted(r.request["count"] for r in seen) == [1, 2, 3]


def test_pagination_counts_exactly_and_keeps_to_no_hidden_limit(spark):
    start = "http://h/p?page="
    pages = spark.range(999_998, 1_000_120).select(F.concat(F.lit(start), F.col("id").cast("string")).alias("url"), F.lit("<p>x").alias("html"))
    chain = w.get(start + "999998").set("p", "p")
    seen = w.get(start + "999998").paginate({"page": 1}, 3).set("p", "p").to_df(pages, with_request=True).collect()
    assert sorted(r.request["url"] for r in seen) == sorted(f"{start}{n}" for n in (999_998, 999_999, 1_000_000, 1_000_001))
    assert chain.to_df(pages).count() == 1
    with pytest.raises(RuntimeError, match="goes on after 4 pages"):
        w.get(start + "999998").paginate({"page": 1}, max_pages=4).to_df(pages)
    assert w.get(start + "999998").paginate({"page": 1}, 3, max_pages=2).to_df(pages).count() == 4  # a limit given wins


def test_nested_results_go_back_to_their_own_row(spark, pages):
    some = spark.createDataFrame([(None, "http://h/set", SET), (7, "http://h/1", PAGES[1][2]), (7, "http://h/set", SET)], "page_id long, url string, html string")
    df = w.over(some).set({"t": "title", "next": w.follow("a").set("x", "title")}).to_df(pages)
    got = sorted(((r.page_id, r.t, [x.x for x in r.next]) for r in df.collect()), key=repr)
    assert got == [(7, "1", ["2", "3"]), (7, "TITLE", ["1", "2"]), (None, "TITLE", ["1", "2"])]


def test_rejected_and_empty_documents_are_errors(pages):
    hook = w.over(pages).filter("title").process_response(lambda html: F.when(html.contains("TITLE"), html))
    assert rows(hook.find("div").set("d").to_df()) == [(1, "CONTENT")]
    assert sorted(r.message for r in hook.find("div").errors().collect()).count("(process_response) rejected") == 3
    assert rows(w.over(pages.withColumn("html", F.lit(" "))).find("p").errors().filter("message like '(parse)%'").select("message").distinct()) == [("(parse) the document is empty",)]


def test_sinks_and_log(pages, tmp_path):
    called = []
    w.over(pages).find("title").set("t").done(str(tmp_path / "out"), lambda: called.append(1))
    assert called == [1] and pages.sparkSession.read.parquet(str(tmp_path / "out")).count() == 4
    chain = w.over(pages).find("a").log("links").set("t")
    assert chain.to_df().count() == 4 and chain.observed["links"].get["rows"] == 4
    note = str(tmp_path / "note")

    def seen(row):
        with open(note, "a") as f:
            f.write(row["t"] + "\n")

    w.over(pages).find("title").set("t").data(seen)
    assert sorted(open(note).read().split()) == ["1", "2", "3", "TITLE"]


def test_submit_and_login(spark):
    form = w.parse(spark, '<form action="/go" method=POST><input name=u><input type=password name=p><input type=submit name=k></form>', "http://h/x")
    store = spark.createDataFrame(
        [("http://h/go?u=me&p=&k=Submit+Query", "post", "<p>submitted"), ("http://h/go?u=me&p=pw&k=Submit+Query", "post", "<p>in")], "url string, method string, html string"
    )
    assert form.submit("form", {"u": "me"}).set("r", "p").to_df(store).first().r == "submitted"
    assert form.login("me", "pw").set("r", "p").to_df(store).first().r == "in"
    assert [r.message for r in form.find("input").login("a", "b").errors(store).collect()] == ["(login) no login form"] * 3


def test_then_and_do(pages):
    fan = w.over(pages).filter("div").find("a").then(lambda n, d: [(n, {"x": n.text()}), (n, {"x": "again"})], {"x": T.StringType()})
    assert rows(fan.to_df()) == [(1, "1"), (1, "again"), (1, "2"), (1, "again")]
    tap = w.over(pages).filter("div").then(lambda n, d: d.update(x="set"), {"x": T.StringType()})
    assert rows(tap.to_df()) == [(1, "set")]
    done = w.over(pages).filter("div").set("t", "title").do(w.set("n", w.Fn(lambda n, d: len(n.find("a")), T.IntegerType())), w.follow("a").set("x", "title")).to_df(pages)
    assert rows(done) == [(1, "TITLE", 2, ["1", "2"])]


def test_repeated_set_appends(pages):
    assert rows(w.over(pages).filter("div").set("v", "title").set("v", "div").to_df()) == [(1, ["TITLE", "CONTENT"])]


def test_process_response_and_options(pages):
    chain = w.over(pages).filter("div").process_response(lambda html: F.replace(html, F.lit("TITLE"), F.lit("changed"))).set("t", "title")
    assert rows(chain.to_df()) == [(1, "changed")]
    options = w.config({"tries": 5}).header("a", "1").header("b", "2").cookie("c", "x").cookie("c", None).options
    assert options == {"tries": 5, "headers": {"a": "1", "b": "2"}, "cookies": {}}
    with pytest.raises(NotImplementedError):
        w.find("a").click("a")
    with pytest.raises(ValueError):
        w.find("a").set({"k": {}})


def test_the_plan_parses_once_and_prunes(pages):
    df = w.over(pages).find("a").set({"href": "@href", "t": None}).filter("b").to_df()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "Exchange" not in plan
    pushed = df.filter("page_id = 2")._jdf.queryExecution().executedPlan().toString()
    assert pushed.index("ArrowEvalPython") < pushed.index("page_id#") or "Filter" in pushed.split("ArrowEvalPython")[-1]


def test_nulls_and_empty_tables(spark):
    some = spark.createDataFrame([(1, None, None), (2, "http://h", ""), (3, "http://h", "<a>x")], "page_id long, url string, html string")
    assert rows(w.over(some).find("a").set("t").to_df()) == [(3, "x")]
    assert rows(w.over(some.limit(0)).find("a").set("t").to_df()) == []


def test_partial_nested_rows(pages):
    strict, loose = w.find("a").contains("1"), w.find("a").contains("1").partial()
    assert rows(w.over(pages).filter("div").set({"x": strict, "y": loose}).to_df()) == [(1, ["1"], ["1", "2"])]


def test_fetcher_settings():
    fetcher = w.HttpFetcher(headers={"a": "1"}).with_options(w.config({"tries": 5, "auth": ("u", "p")}).header("b", "2").cookie("c", "3").proxy("http://p").delay(0.5).options)
    assert (fetcher.tries, fetcher.proxies, fetcher.delay) == (5, ("http://p",), 0.5)
    ask = fetcher.request("http://h/ä b?x=1", "post")
    assert (ask.full_url, ask.data, ask.get_method()) == ("http://h/%C3%A4%20b", b"x=1", "POST")
    assert ask.headers["A"] == "1" and ask.headers["B"] == "2" and ask.headers["Cookie"] == "c=3" and ask.headers["Authorization"] == "Basic dTpw"


def test_live_fetch(spark):
    """Against a server in this process: redirects, statuses and repeated links."""
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    asked, referers = [], []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            asked.append(self.path)
            referers.append((self.path, self.headers.get("Referer"), self.headers.get("X-Own")))
            found = {"/": "<a href=/x>1</a><a href=/x>2</a><a href=/r>3</a><a href=/no>4</a>", "/x": "<title>x</title>"}.get(self.path)
            self.send_response(302 if self.path == "/r" else 200 if found else 404)
            if self.path == "/r":
                self.send_header("Location", "/x")
            self.end_headers()
            self.wfile.write((found or "").encode())

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        base = f"http://127.0.0.1:{server.server_port}/"
        df = w.get(base).follow("a").set("t", "title").to_df(w.HttpFetcher(tries=1, concurrency=2), spark=spark)
        assert rows(df) == [("x",)] * 3
        assert asked.count("/no") == 1 and ("/x", base, None) in referers
        asked.clear()
        referers.clear()
        nested = w.get(base).set({"n": w.config("headers", {"X-Own": "1"}).follow("a").set("t", "title")}).to_df(w.HttpFetcher(tries=1), spark=spark)
        assert [x.t for x in nested.first().n] == ["x"] * 3
        assert asked.count("/") == 1 and ("/", None, None) in referers and ("/x", base, "1") in referers  # asked for once; options hold for the nested chain only
    finally:
        server.shutdown()
