"""Helpers shared by the pipeline operators: settled tables, bindings, lower-casing, bounded Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words are runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; a scratch one only on a local master."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    scratch = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    spark.sparkContext.setCheckpointDir(f"file://{scratch}")
    return f"file://{scratch}"


@contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is written inside go when the write ends, and do not lie about until the driver's next collection."""
    option = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(option)
    spark.conf.set(option, "true")
    try:
        yield
    finally:
        spark.conf.set(option, before)


def settle(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage is cut, and later passes see the same rows.

    The rows survive the loss of any executor, and the shuffles that made them are swept from the disk. The table's own file sizes then tell Spark whether it may be broadcast.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm-{uuid.uuid4().hex}/{name}"
    with swept(spark):
        df.write.parquet(path, partitionBy=partition_by)
    return spark.read.schema(df.schema).parquet(path)


def settle_in_buckets(df: DataFrame, name: str, column: str, buckets: int) -> tuple[DataFrame, str]:
    """``settle`` as an external table in ``buckets`` buckets of ``column``, and its name: rows grouped by the column are not shuffled.

    The folder is one of those of ``settle``; drop the table when nothing reads it any more.
    """
    spark = df.sparkSession
    table = f"llm_{uuid.uuid4().hex}"
    with swept(spark):
        df.write.bucketBy(buckets, column).option("path", f"{shared_folder(spark)}/{table.replace('_', '-')}/{name}").format("parquet").saveAsTable(table)
    return spark.table(table), table


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and use it many times inside one expression."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII text takes the fast built-in, which does the same there."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Few rows per Arrow batch, so that a batch of very long texts stays small in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def crc32_of_ids(ids: Column) -> Column:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    @F.pandas_udf("long")
    def crc(values: pd.Series) -> pd.Series:
        import zlib

        import numpy as np

        return pd.Series([zlib.crc32(np.asarray(v, dtype="<i4").tobytes()) for v in values], dtype="int64")

    return crc(ids)
