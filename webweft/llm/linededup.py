"""Removal of lines that spread over many sites, with DataFrame functions only.

A line's spread is its number of distinct sites. Every task builds a HyperLogLog sketch per line
hash, and the sketches merge by aggregation; only for lines whose estimate is near the threshold
are their pairs of line and site gathered and counted exactly.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh_name, joined_apart, materialize, named

#: Sites from which on a line is boilerplate.
MIN_SITES = 6
#: log2 of a sketch's registers: a standard error of about 1.6 %.
SKETCH_LOG2 = 12
#: Estimates within this share of the threshold are counted exactly; ten standard errors at least.
MARGIN = 0.25
#: Where copies vote once: share of all families of texts that a line must stand in as well.
MIN_SHARE = 0.001
#: A text of which more than this share is lines that recur is a copy itself and has no vote.
MOST_RECURRING = 0.5
#: Rows of one text are dealt to so many tasks when texts meet their widespread lines.
SALTS = 16


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _key(line: Column) -> Column:
    """A line's 64-bit hash; lines that differ in outer white space only count as the same."""
    return F.xxhash64(F.trim(line))


def _different_lines(text: Column) -> Column:
    """A row per different line of a text that isn't blank: its hash and length."""
    told = F.filter(_lines(text), lambda x: F.trim(x) != "")
    return F.explode(F.array_distinct(F.transform(told, lambda x: F.struct(_key(x).alias("key"), F.length(F.trim(x)).alias("n"))))).alias("line")


def family(text: Column) -> Column:
    """A hash that copies of a text share, and most near copies: the smallest of its three-word runs."""

    def later(words: Column, n: int) -> Column:
        return F.slice(words, n + 1, F.greatest(F.size(words) - n, F.lit(0)))

    def smallest(words: Column) -> Column:
        pairs = F.zip_with(words, later(words, 1), lambda a, b: F.xxhash64(a, b))
        return F.array_min(F.zip_with(pairs, later(words, 2), lambda h, c: F.xxhash64(h, c)))

    # The words are a lambda's variable, so the text is split once.
    return F.get(F.transform(F.array(F.split(F.lower(text), " ")), smallest), F.lit(0))


def _reaching(lines: DataFrame, of: str, least: int) -> DataFrame:
    """``key`` of the lines that come with ``least`` different values of column ``of`` or more."""
    # Each task sketches its own rows of a line first, so a common line is a few sketches wherever it stands.
    spread = lines.groupBy("key").agg(F.hll_sketch_estimate(F.hll_sketch_agg(of, SKETCH_LOG2)).alias("about"))
    spread = materialize(spread.filter(F.col("about") >= least * (1 - MARGIN)), "spread")
    sure = F.col("about") > least * (1 + MARGIN)
    near = lines.join(spread.filter(~sure).select("key"), "key", "left_semi").select("key", of).distinct()
    exact = near.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    return spread.filter(sure).select("key").unionByName(exact.select("key"))


def widespread(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """``key`` of each line of ``key, site`` that occurs on ``min_sites`` sites or more."""
    return _reaching(lines, "site", min_sites)


def widespread_in_families(lines: DataFrame, families: int, min_sites: int = MIN_SITES, min_share: float = MIN_SHARE) -> DataFrame:
    """``key`` of each line that is on ``min_sites`` sites or more, and in as many families of texts
    and ``min_share`` of all of them, texts that mostly consist of such lines aside.

    ``lines``: ``key, n`` (length), ``site, text_key, family`` and ``whole`` (the text's length).
    Copies are one family, so is most of a group of near copies; where their other lines recur as
    well, they have no vote. What remains of a line's families is its spread by different texts.
    """
    least = max(min_sites, math.ceil(min_share * families))
    often = materialize(_reaching(lines, "family", least), "often")
    recurring = materialize(lines.join(often, "key", "left_semi").join(widespread(lines, min_sites), "key", "left_semi"), "recurring")
    copied = recurring.select("text_key", "key", "n", "whole").distinct().groupBy("text_key").agg(F.sum("n").alias("n"), F.max("whole").alias("whole"))
    voting = copied.filter(F.col("n") <= MOST_RECURRING * F.col("whole")).select("text_key")
    return _reaching(joined_apart(recurring, voting, "text_key", "left_semi"), "family", least)


def remove_widespread_lines(df: DataFrame, text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES, removed_col: str | None = None, copies_once: bool = False, min_share: float = MIN_SHARE) -> DataFrame:
    """``df`` with all lines taken out of its texts that occur on ``min_sites`` sites or more.

    Keeps all rows and columns; ``removed_col`` adds the number of lines that were taken out.
    Lines are parted by the line feed and compared without outer spaces; blank ones stay. A
    null site is a site of its own. A null text stays null (0 removed), a text without any such
    line stays as it is, one of such lines only becomes empty. Repeated rows stay repeated. An
    empty table gives an empty table.

    With ``copies_once`` copies of one text vote once, and a line must stand in ``min_share`` of
    the families of texts as well (see :func:`widespread_in_families`). A text that is merely
    copied to many sites then keeps its lines.

    Lines' hashes are written once and all counts are made from them. Each text is then joined
    with the array of its own widespread lines' hashes, at every size, which shuffles the texts
    once; a text is one row at any time. Copies of one text are dealt to SALTS tasks by the
    partition that they come from, and Spark splits what is still too large.
    """
    own, bad_col, salt = (fresh_name(df, c) for c in ("_text_key", "_bad_lines", "_salt"))
    text = named(text_col).cast("string")
    rows = df.select(text.alias("text"), F.xxhash64(named(site_col)).alias("site")).filter("text is not null")
    if copies_once:
        rows = rows.withColumns({"text_key": F.xxhash64("text"), "family": family(F.col("text")), "whole": F.length("text")})
        lines = materialize(rows.select("site", "text_key", "family", "whole", _different_lines(F.col("text"))).select("site", "text_key", "family", "whole", "line.*"), "lines")
        found = widespread_in_families(lines, lines.select("family").distinct().count(), min_sites, min_share)
    else:
        rows = rows.withColumn("text_key", F.xxhash64("text"))
        lines = materialize(rows.select("site", "text_key", _different_lines(F.col("text"))).select("site", "text_key", "line.key"), "lines")
        found = widespread(lines, min_sites)
    keys = materialize(found, "widespread")
    # Rows of one text have the same lines, so its hash leads back to it (texts that collide would
    # share their hashes, and a hash only takes out lines that are widespread anyway). Always by a
    # salted merge join: how many lines are widespread grows with the table.
    bad = lines.join(keys, "key", "left_semi").select("text_key", "key").distinct().groupBy("text_key").agg(F.collect_list("key").alias(bad_col))
    bad = materialize(bad.withColumnRenamed("text_key", own), "bad-lines")
    salted = bad.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    step = df.withColumn(own, F.xxhash64(text)).withColumn(salt, F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    step = step.join(salted.hint("merge"), [own, salt], "left")
    touched, is_bad = text.isNotNull() & F.col(bad_col).isNotNull(), lambda x: F.array_contains(F.col(bad_col), _key(x))
    kept = F.filter(_lines(text), lambda x: ~is_bad(x))
    new_text = F.when(touched, F.array_join(kept, "\n")).otherwise(text)
    out = {c: (new_text.alias(c) if c == text_col else named(c)) for c in df.columns}
    extra = []
    if removed_col:
        n = F.when(touched, F.size(_lines(text)) - F.size(kept)).otherwise(0)
        extra.append(n.cast("long").alias(removed_col))
    return step.select(*out.values(), *extra)
