"""URLs: native columns for plans, and the same rules for Python callers."""

from __future__ import annotations

import re
from urllib.parse import parse_qsl, urlencode, urljoin, urlsplit, urlunsplit

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalized(url: Column) -> Column:
    """Key under which a snapshot is looked up: without fragment and outer blanks."""
    return F.regexp_replace(F.trim(url), "#.*$", "")


def host(url: Column) -> Column:
    return F.regexp_extract(url, "^https?://([^/?#]+)", 1)


def path(url: Column) -> Column:
    return F.regexp_extract(url, "^https?://[^/?#]+([^?#]*)", 1)


def query(url: Column) -> Column:
    return F.regexp_extract(url, "[?]([^#]*)", 1)


def query_params(url: Column) -> Column:
    """The query as map<string,string>; of a repeated name the last one counts."""
    pairs = F.filter(F.split(query(url), "&"), lambda p: p != "")
    entries = F.transform(pairs, lambda p: F.struct(F.try_url_decode(F.regexp_extract(p, "^([^=]*)", 1)).alias("key"), F.try_url_decode(F.regexp_extract(p, "^[^=]*=?(.*)$", 1)).alias("value")))
    names = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    last = F.transform(names, lambda n: F.element_at(F.filter(entries, lambda e: e["key"] == n), -1)["value"])
    return F.map_from_arrays(names, last)


def first_integer(text: Column) -> Column:
    """The leading integer of a text's digits, 0 without one."""
    digits = F.regexp_replace(text, "[^0-9.]+", "")
    return F.coalesce(F.regexp_extract(digits, "^([0-9]+)", 1).try_cast("int"), F.lit(0))


def response_type(content_type: Column) -> Column:
    """xml, html, the type as it stands, or null; xml is looked for first."""
    return F.when(content_type.contains("xml"), "xml").when(content_type.contains("html"), "html").otherwise(content_type)


def trimmed(text: Column) -> Column:
    """Without outer white space of any kind, the byte-order mark included."""
    return F.regexp_replace(text, "^[\\s\\u00a0\\ufeff\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+|[\\s\\u00a0\\ufeff\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+$", "")


# ------------------------------------------------------------------ for Python callers


def strip(text: str) -> str:
    return text.strip().strip("﻿").strip()


def resolve(base: str | None, url: str) -> str:
    """Absolute URL: relative to ``base``, or completed to http where there is none."""
    url = url.strip()
    if base:
        return urljoin(base, url)
    if url.startswith("//"):
        return "http:" + url
    return url if url.startswith("http") else "http://" + url


def with_params(url: str, params: dict) -> str:
    """``url`` with ``params`` over its own query."""
    parts = urlsplit(url)
    own = [(k, v) for k, v in parse_qsl(parts.query, keep_blank_values=True) if k not in params]
    more = [(k, str(x)) for k, v in params.items() for x in (v if isinstance(v, (list, tuple)) else [v])]
    return urlunsplit((parts.scheme, parts.netloc, parts.path, urlencode(own + more), parts.fragment))


def leading_integer(text: str) -> int:
    """The integer that a text's digits and points begin with, 0 without one."""
    found = re.match("[0-9]+", re.sub("[^0-9.]+", "", text))
    return int(found[0]) if found else 0


def params_of(url: str) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for k, v in parse_qsl(urlsplit(url).query, keep_blank_values=True):
        out.setdefault(k, []).append(v)
    return out
