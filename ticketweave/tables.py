"""Lazy access to a folder of Parquet tables, with zone-less times turned into UTC timestamps once."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticketweave.session import prepare


TEXT_TABLES = {"documents", "pages", "conversations"}


class Tables:
    """``Tables(spark, folder).orders`` reads ``folder/orders.parquet``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = prepare(spark)
        self.root = root.rstrip("/")

    def read(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.root}/{name}.parquet")
        zoneless = [f.name for f in df.schema.fields if isinstance(f.dataType, T.TimestampNTZType)]
        return df.withColumns({c: F.col(c).cast("timestamp") for c in zoneless}) if zoneless else df

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        df = self.read(name)
        return self.spread(df) if name in TEXT_TABLES else df

    def as_filed(self, name: str) -> DataFrame:
        """A text table as its files hold it, without a shuffle of the texts, where every core has a file to read; spread otherwise."""
        df = self.read(name)
        return df if len(df.inputFiles()) >= self.spark.sparkContext.defaultParallelism else self.spread(df)

    def spread(self, df: DataFrame) -> DataFrame:
        """Deal the rows evenly to tasks before CPU-heavy text work: one for each core, or four for each split of a large table.

        Splits tell nothing of the rows in them: a file is cut by bytes, but a row group is read by one task, so most splits of
        a file with few row groups are empty and one holds all rows.
        """
        cores, splits = self.spark.sparkContext.defaultParallelism, df.rdd.getNumPartitions()
        return df.repartition(cores if splits < cores else 4 * splits)

    @cached_property
    def tickets(self) -> DataFrame:
        from ticketweave.plans import fixtures
        return self.spread(self.events).selectExpr(*fixtures.columns(fixtures.TICKETS))

    @cached_property
    def log_lines(self) -> DataFrame:
        from ticketweave.plans import fixtures
        return self.spread(self.events).selectExpr(*fixtures.columns(fixtures.LOG_LINES))
