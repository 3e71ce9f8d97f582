"""Exact duplicates by deterministic block naming.

A text is cut into blocks of fixed size. Equal blocks get the same integer name, different ones different names: distinct
blocks are sorted inside their hash bucket, and a name is the bucket with the block's place in it. Adjacent names are then
paired and the pairs named in the same way, level by level, until one name is left for each text. Two texts end with the
same name at the same level exactly if they are equal; no step trusts a hash alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticketweave.llm.common import ascii_lower, let, settle

BLOCK_BYTES = 4096


def _places(items: DataFrame, content: list[str], name: str) -> DataFrame:
    """(bucket, content, place) of the distinct items that share a bucket with another; every other item has place 0.

    Distinct items are few per bucket by construction, as the bucket is a 64-bit hash: a bucket is sorted in one task.
    """
    crowded = settle(items.distinct().groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("bucket"), f"{name}-crowded")
    sorted_place = F.row_number().over(Window.partitionBy("bucket").orderBy(*content)) - 1
    return settle(items.join(crowded, "bucket", "left_semi").distinct().withColumn("place", sorted_place), f"{name}-places")


def _named(rows: DataFrame, content: list[str], name: str) -> DataFrame:
    """Replace the content columns by a name: ``bucket`` and ``place``."""
    rows = rows.withColumn("bucket", F.xxhash64(*content))
    places = _places(rows.select("bucket", *content), content, name)
    return rows.join(places, ["bucket", *content], "left").withColumn("place", F.coalesce("place", F.lit(0))).drop(*content)


def text_identities(docs: DataFrame, key: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of ``docs``: row (long), id, sha (of the normalised text), and its identity level, bucket, place.

    A null text counts as empty; an empty text is one empty block. Rows that repeat stay apart by their row number.
    """
    def cut(raw: Column) -> Column:
        starts = F.sequence(F.lit(0), F.floor(F.greatest(F.octet_length(raw) - 1, F.lit(0)) / block_bytes).cast("int"))
        return F.struct(F.sha2(raw, 256).alias("sha"), F.transform(starts, lambda i: F.substring(raw, i * block_bytes + 1, F.lit(block_bytes))).alias("blocks"))

    whole = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("id"), let(ascii_lower(F.coalesce(F.col(text), F.lit(""))).cast("binary"), cut).alias("cut"))
    blocks = whole.select("row", "id", "cut.sha", F.size("cut.blocks").alias("n"), F.posexplode("cut.blocks").alias("pos", "block"))
    names = settle(_named(blocks, ["block"], "blocks"), "names-0")
    most, level, found = names.agg(F.max("n")).first()[0] or 0, 0, []
    while True:
        found.append(names.filter("n = 1").select("row", "id", "sha", F.lit(level).alias("level"), "bucket", "place"))
        if most <= 1:
            break
        most, level = (most + 1) // 2, level + 1
        side = {"l": F.col("pos") % 2 == 0, "r": F.col("pos") % 2 == 1}
        pairs = names.filter("n > 1").groupBy("row", F.floor(F.col("pos") / 2).cast("int").alias("pos")).agg(
            F.first("id").alias("id"), F.first("sha").alias("sha"), F.floor((F.first("n") + 1) / 2).cast("int").alias("n"),
            *[F.coalesce(F.max(F.when(on, F.col(c))), F.lit(none)).alias(f"{s}_{c}") for s, on in side.items() for c, none in (("bucket", 0), ("place", -1))])
        pairs = settle(pairs, f"pairs-{level}")
        names = settle(_named(pairs, ["l_bucket", "l_place", "r_bucket", "r_place"], f"pairs-{level}"), f"names-{level}")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def exact_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. Of equal texts the row with the largest
    ``key`` stays, a null key being the smallest; of rows that repeat even the key exactly one stays. An empty table gives none.
    """
    rows = text_identities(docs, key, text, block_bytes)
    identity = ["level", "bucket", "place"]
    groups = rows.groupBy(*identity).agg(F.max(F.struct("id", "row")).alias("top"), F.count(F.lit(1)).alias("group_size"))
    return rows.join(groups, identity).select(
        F.col("id").alias("doc_id"), F.col("top.id").alias("keep_id"), "group_size", (F.col("row") == F.col("top.row")).alias("kept"), F.col("sha").alias("text_sha256"))


def keep_one_of_equal(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, all columns as they were; rows that repeat key and text count once."""
    kept = exact_duplicates(docs, key, text).filter("kept").select(F.struct("doc_id", "text_sha256").alias("_kept"))
    sha = F.sha2(ascii_lower(F.coalesce(F.col(text), F.lit(""))).cast("binary"), 256)
    marked = docs.select(F.struct("*").alias("_doc"), F.struct(F.col(key).alias("doc_id"), sha.alias("text_sha256")).alias("_mine"))
    met = marked.join(kept, F.col("_mine").eqNullSafe(F.col("_kept")), "left_semi")
    once = F.row_number().over(Window.partitionBy("_mine").orderBy(F.lit(1)))
    return met.withColumn("_once", once).filter("_once = 1").select("_doc.*")
