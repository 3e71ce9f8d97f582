"""Sinks: sessions, chunks, graphs, CSV, and keyed upserts."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketweave.functions.text import stable_id

_C, _L = F.col, F.lit


def save_session(df: DataFrame, root: str, session_id: str) -> None:
    """Replace one session; other sessions in the folder stay."""
    (df.withColumn("session_id", _L(session_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("session_id").parquet(root))


def load_session(spark: SparkSession, root: str, session_id: str) -> DataFrame:
    """Read one session; the partition filter prunes all others."""
    return spark.read.parquet(root).filter(_C("session_id") == session_id).drop("session_id")


def write_chunks(df: DataFrame, root: str, collection: Column, id_cols: Sequence[str]) -> None:
    """Idempotent: ids come from content keys, and a collection is replaced as a whole."""
    rows = df.withColumn("point_id", stable_id("", [F.concat_ws("|", *id_cols)], 32)).withColumn("collection", collection)
    unique = rows.dropDuplicates(["collection", "point_id"])
    unique.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("collection").parquet(root)


def write_graph(nodes: DataFrame, edges: DataFrame, root: str) -> None:
    nodes.write.mode("overwrite").parquet(f"{root}/nodes")
    edges.write.mode("overwrite").partitionBy("rel_type").parquet(f"{root}/edges")


def export_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    """CSV parts with headers; arrays and structs are written as JSON."""
    flat = [F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else _C(c) for c, t in df.dtypes]
    df.select(*flat).write.mode("overwrite").option("header", True).option("sep", sep).csv(path)


def touched_buckets(spark: SparkSession, root: str, buckets: list[int]) -> DataFrame:
    """The store's rows of the buckets given; their numbers stand in the filter, so other buckets' files are never opened."""
    return spark.read.parquet(root).filter(_C("_bucket").isin(buckets))


def upsert_keyed(batch: DataFrame, root: str, key: str, ts: str, buckets: int = 64, batch_id: int = 0) -> None:
    """Merge a batch into a Parquet store: the latest row per key wins, of equal times the one of the later batch.

    The store is partitioned by a hash bucket of the key: only buckets the batch touches are read and rewritten; a store
    keeps the number of ``buckets`` it was begun with. The merged rows are written to a staging folder of their own before
    they replace the old buckets. A batch that comes again under its ``batch_id`` changes nothing.
    """
    spark = batch.sparkSession
    bucketed = batch.withColumns({"_bucket": F.pmod(F.xxhash64(_C(key)), _L(buckets)).cast("int"), "_batch": _L(batch_id).cast("long")})
    touched = [r[0] for r in bucketed.select("_bucket").distinct().collect()]  # at most ``buckets`` numbers
    if not touched:
        return
    merged = bucketed
    if _exists(spark, root):
        merged = touched_buckets(spark, root, touched).unionByName(bucketed, allowMissingColumns=True)
    cols = [c for c in merged.columns if c not in (key, "_bucket")]
    newest = F.struct(_C(ts), F.coalesce("_batch", _L(-1)), F.xxhash64(*cols))
    latest = merged.groupBy("_bucket", key).agg(F.max_by(F.struct(*cols), newest).alias("r")).select("_bucket", key, "r.*")
    staging = f"{root.rstrip('/')}__staging/{uuid.uuid4().hex}"
    latest.write.partitionBy("_bucket").parquet(staging)
    (spark.read.schema(latest.schema).parquet(staging).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_bucket").parquet(root))


def recent(df: DataFrame, ts: str, as_of: Column, hours: int = 24) -> DataFrame:
    """Records updated since ``hours`` before ``as_of``; there is no upper bound."""
    return df.filter(F.unix_micros(as_of) - F.unix_micros(_C(ts)) <= hours * 3_600_000_000)


def incremental_upsert(batch: DataFrame, root: str, key: str, ts: str, as_of: Column, hours: int = 24) -> None:
    upsert_keyed(recent(batch, ts, as_of, hours), root, key, ts)


def read_store(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(root).drop("_bucket", "_batch")


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
