"""Where documents come from: tables of pages, literal markup, and stores that answer requests."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from typing import ClassVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.urls import normalized

#: Defaults of requests.
TRIES, REDIRECTS, TIMEOUT_S, CONCURRENCY = 3, 3, 30, 5


def literal(spark: SparkSession, html: str, base_url: str | None = None) -> DataFrame:
    """A table of one page."""
    return spark.createDataFrame([(0, base_url, html)], "page_id long, url string, html string")


def from_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


@dataclass(frozen=True)
class Snapshot:
    """Pages loaded before, by URL. What isn't there is an error like a page not found.

    ``url`` may be a column expression. Optional columns: ``method``, ``status`` and
    ``content_type``. Responses with a status from 400 to 500 are errors unless
    ``ignore_http_errors``, as are empty ones. ``redirects`` (src, dst) are followed up to
    REDIRECTS times. URLs are assumed to be unique in each method.
    """

    pages: DataFrame
    url: str | Column = "url"
    html: str | Column = "html"
    redirects: DataFrame | None = None
    ignore_http_errors: bool = False

    def with_options(self, options: dict) -> Snapshot:
        return replace(self, ignore_http_errors=options.get("ignore_http_errors", self.ignore_http_errors))

    def answer(self, requests: DataFrame, outer: bool = False) -> DataFrame:
        """``requests`` (with ``_rurl``, ``_method``) joined with ``_nurl, _nhtml, _status``.

        An equi-join on the normalized URL; Spark picks the strategy by size and splits hot URLs.
        """
        own, columns = self.pages, set(self.pages.columns)
        pages = own.select(
            normalized(F.col(self.url) if isinstance(self.url, str) else self.url).alias("_key"),
            (F.col(self.html) if isinstance(self.html, str) else self.html).alias("_nhtml"),
            (F.col("status").cast("int") if "status" in columns else F.lit(200)).alias("_status"),
            *([F.lower(F.col("method")).alias("_pmethod")] if "method" in columns else []),
        )
        asked = requests.withColumn("_rkey", normalized(F.col("_rurl")))
        for _ in range(REDIRECTS if self.redirects is not None else 0):
            hop = self.redirects.select(normalized(F.col("src")).alias("_from"), normalized(F.col("dst")).alias("_to"))
            asked = asked.join(hop, F.col("_rkey") == F.col("_from"), "left").withColumn("_rkey", F.coalesce("_to", "_rkey")).drop("_from", "_to")
        on = F.col("_rkey") == F.col("_key")
        if "method" in columns:
            on = on & (F.col("_method") == F.col("_pmethod"))
        found = asked.join(pages, on, "left" if outer else "inner").withColumn("_nurl", F.col("_rkey"))
        if not outer:
            found = found.filter(self.good())
        return found.drop("_key", "_rkey", "_pmethod")

    def good(self) -> Column:
        fine = F.length("_nhtml") > 0
        return fine if self.ignore_http_errors else fine & ~F.col("_status").between(400, 500)


@dataclass(frozen=True)
class HttpFetcher:
    """Loads pages over HTTP in Arrow batches, at most ``concurrency`` tasks at a time.

    Off unless given to a chain. Each URL is asked for once and the answers are joined back, so
    repeated links cost one request. ``user_agent`` may be a function, called once per request.
    Proxies are taken in turn; one that fails is not tried again for that request. ``delay``
    spaces the requests of a task, in seconds. A redirect's last URL becomes the document's. The
    document that asks is the referer.
    """

    tries: int = TRIES
    timeout_s: float = TIMEOUT_S
    concurrency: int = CONCURRENCY
    redirects: int = REDIRECTS
    user_agent: str | Callable[[], str] = "webweft"
    headers: dict | None = None
    cookies: dict | None = None
    auth: tuple[str, str] | None = None
    proxies: tuple[str, ...] = ()
    delay: float = 0
    ignore_http_errors: bool = False

    #: Names under which chains know the settings.
    OPTIONS: ClassVar[dict[str, str]] = {
        "tries": "tries", "timeout": "timeout_s", "concurrency": "concurrency", "follow": "redirects", "user_agent": "user_agent", "headers": "headers",
        "cookies": "cookies", "proxies": "proxies", "delay": "delay", "ignore_http_errors": "ignore_http_errors", "auth": "auth",
    }

    def with_options(self, options: dict) -> HttpFetcher:
        """These settings with a chain's options over them; maps are merged."""
        new = {}
        for name, field in self.OPTIONS.items():
            if name in options:
                value, now = options[name], getattr(self, field)
                new[field] = {**(now or {}), **value} if isinstance(value, dict) else tuple(value) if isinstance(value, list) else value
        return replace(self, **new)

    def answer(self, requests: DataFrame, outer: bool = False) -> DataFrame:
        settings = self

        def load(batches: Iterator) -> Iterator:
            for pdf in batches:
                got = []
                for url, method, referer in zip(pdf["_furl"], pdf["_fmethod"], pdf["_from"], strict=True):
                    got.append(settings.fetch(url, method, referer))
                    time.sleep(settings.delay)
                yield pdf.drop(columns="_from").assign(_nurl=[g[0] for g in got], _nhtml=[g[1] for g in got], _status=[g[2] for g in got])

        # Of the documents that ask for a URL, the first by its own is the referer.
        asked = requests.groupBy(F.col("_rurl").alias("_furl"), F.col("_method").alias("_fmethod")).agg(F.min("_url").alias("_from")).repartition(self.concurrency)
        answers = asked.mapInPandas(load, "_furl string, _fmethod string, _nurl string, _nhtml string, _status int")
        on = (F.col("_rurl") == F.col("_furl")) & (F.col("_method") == F.col("_fmethod"))
        found = requests.join(answers, on, "left" if outer else "inner").drop("_furl", "_fmethod")
        return found if outer else found.filter(self.good())

    def good(self) -> Column:
        fine = F.length("_nhtml") > 0
        return fine if self.ignore_http_errors else fine & ~F.col("_status").between(400, 500)

    def request(self, url: str, method: str, referer: str | None = None):
        """The request as the standard library knows it: parameters in the body of a post."""
        import base64
        import urllib.request
        from urllib.parse import quote, urlsplit, urlunsplit

        parts = urlsplit(url)
        path = quote(parts.path, safe="/%:@!$&'()*+,;=~-._")
        body = parts.query.encode() if method == "post" else None
        safe = urlunsplit((parts.scheme, parts.netloc, path, "" if method == "post" else quote(parts.query, safe="/%:@!$&'()*+,;=~-._?"), ""))
        agent = self.user_agent() if callable(self.user_agent) else self.user_agent
        headers = {"User-Agent": agent, **({"Referer": referer} if referer else {}), **(self.headers or {})}
        if self.cookies:
            headers["Cookie"] = "; ".join(f"{k}={v}" for k, v in self.cookies.items())
        if self.auth:
            headers["Authorization"] = "Basic " + base64.b64encode(":".join(self.auth).encode()).decode()
        return urllib.request.Request(safe, data=body, method=method.upper(), headers=headers)

    def fetch(self, url: str, method: str, referer: str | None = None) -> tuple[str, str | None, int | None]:
        """URL in the end, body and status; nulls if there was no answer in ``tries`` attempts."""
        import urllib.error
        import urllib.request

        ask, proxies, last = self.request(url, method, referer), list(self.proxies), (url, None, None)
        for attempt in range(self.tries):
            redirect = urllib.request.HTTPRedirectHandler()
            redirect.max_redirections = self.redirects
            proxy = proxies[attempt % len(proxies)] if proxies else None
            opener = urllib.request.build_opener(redirect, *([urllib.request.ProxyHandler({"http": proxy, "https": proxy})] if proxy else []))
            try:
                with opener.open(ask, timeout=self.timeout_s) as r:
                    return r.geturl(), r.read().decode(r.headers.get_content_charset() or "utf-8", "replace"), r.status
            except urllib.error.HTTPError as e:
                last = (url, e.read().decode("utf-8", "replace"), e.code)
            except (OSError, ValueError):
                last = (url, None, None)
                proxies = [p for p in proxies if p != proxy] or proxies
            time.sleep(min(2**attempt * 0.1, 2))
        return last
