"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHARED_KEY = "spark.checkpoint.dir"
CLEANUP_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    A cluster names it in ``spark.checkpoint.dir``. Only where that is unset and Spark
    runs in one process is a local temporary folder made.
    """
    named = spark.conf.get(SHARED_KEY, None) or spark.sparkContext.getConf().get(SHARED_KEY)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError(f"{SHARED_KEY} must name a folder that all executors share")
    own = spark.sparkContext.getCheckpointDir()
    if not own:
        own = "file://" + tempfile.mkdtemp(prefix="webweft-")
        spark.sparkContext.setCheckpointDir(own)
        own = spark.sparkContext.getCheckpointDir()
    return own.rstrip("/")


@contextmanager
def shuffles_released(spark: SparkSession) -> Iterator[None]:
    """Within it, a query's shuffle files go when the query ends: what it wrote is read instead."""
    before = spark.conf.get(CLEANUP_KEY, None)
    spark.conf.set(CLEANUP_KEY, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP_KEY)
        else:
            spark.conf.set(CLEANUP_KEY, before)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    This cuts the lineage: an executor that is lost later takes nothing with it that is
    not in the written table. The folder goes when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/webweft-{label}-{uuid.uuid4().hex}"
    with shuffles_released(spark):
        df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out._webweft_path = path
    return out


def append(df: DataFrame, table: DataFrame) -> None:
    """Add rows to a table of :func:`materialize`; :func:`reread` gives the table with them."""
    with shuffles_released(df.sparkSession):
        df.write.mode("append").parquet(table._webweft_path)


def reread(table: DataFrame) -> DataFrame:
    return table.sparkSession.read.schema(table.schema).parquet(table._webweft_path)


def release(df: DataFrame) -> None:
    """Delete a table of :func:`materialize` that nothing reads any more."""
    spark, path = df.sparkSession, df._webweft_path
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def joined_apart(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """``left`` joined on ``key`` with the aggregates ``right``, so that Spark can split a hot key.

    It only splits joins whose sides are both dealt out for the join itself. An aggregation by
    the key has dealt its rows out before, so the join is on the key's hash as well.
    """
    dealt = fresh_name(left, "_dealt")
    return left.withColumn(dealt, F.xxhash64(key)).join(right.withColumn(dealt, F.xxhash64(key)).hint("merge"), [dealt, key], how).drop(dealt)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fresh_name(df: DataFrame, want: str) -> str:
    """A column name that no column of ``df`` has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while want.lower() in taken:
        want = "_" + want
    return want


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file lies on this machine (the default of path parameters)."""
    root = os.environ.get("WEBWEFT_TOKENIZERS")
    if root:
        return os.path.join(root, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def named(column: str) -> Column:
    """The column of that very name, dots and all."""
    return F.col("`" + column.replace("`", "``") + "`")
