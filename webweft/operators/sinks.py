"""Ends and taps of chains."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def data(df: DataFrame, call: Callable[[dict], None]) -> None:
    """Call a function with each row's data, on the executors; rows never come to the driver."""

    def each(rows) -> None:
        for r in rows:
            call(r.asDict(recursive=True))

    df.foreachPartition(each)


def tap(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """The same rows, and an observation of how many passed by, known after the first action."""
    seen = Observation(name)
    return df.observe(seen, F.count("*").alias("rows")), seen


def done(df: DataFrame, path: str, call: Callable[[], None]) -> None:
    """Write a chain's rows as Parquet and then call a function once."""
    df.write.parquet(path)
    call()
