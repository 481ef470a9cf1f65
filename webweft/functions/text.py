"""Native columns over texts, where no document has to be parsed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def contains(text: Column, part: str) -> Column:
    return F.contains(text, F.lit(part))


def matches(text: Column, pattern: str) -> Column:
    return text.rlike(pattern)


def gathered(value: Column, order: Column, separator: str) -> Column:
    """An aggregate: values in order, joined."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), value.alias("v")))), lambda x: x["v"]), separator)
