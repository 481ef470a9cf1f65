"""Chains over pages that keep arriving: micro-batches through the same plans."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..plans.chain import Chain

PAGES = "page_id long, url string, html string"


def page_stream(spark: SparkSession, path: str, schema: str = PAGES, files_per_batch: int | None = None) -> DataFrame:
    """Pages from Parquet files as they come into a folder."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def start(chain: Chain, pages: DataFrame, out: str, checkpoint: str, store: Any = None, key: str | None = "page_id", every: str | None = None) -> StreamingQuery:
    """Run a chain over a stream of pages into Parquet files.

    Without ``every`` it takes what is there and ends (what is done at the end then is up to the
    caller, after ``awaitTermination``); with it, a batch begins that often, which also spaces
    requests. Stopping the query pauses the work, starting it again with the same ``checkpoint``
    resumes it, each page once. Chains that gather nested results over several documents need
    whole groups and run batch by batch through :func:`each_batch`.
    """
    df = chain.over(pages, key).to_df(store)
    writer = df.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append")
    return writer.trigger(**({"processingTime": every} if every else {"availableNow": True})).start(out)


def each_batch(chain: Chain, pages: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, store: Any = None, key: str | None = "page_id", every: str | None = None) -> StreamingQuery:
    """Run a chain as a batch plan on each micro-batch and hand the result to ``sink``."""

    def run(batch: DataFrame, number: int) -> None:
        sink(chain.over(batch, key).to_df(store), number)

    writer = pages.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return writer.trigger(**({"processingTime": every} if every else {"availableNow": True})).start()
