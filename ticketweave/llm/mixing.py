"""Mixing sources to target weights: hash-random order inside each source, distributed prefix sums, a cut at the exact budget."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticketweave.llm.common import word_count

#: Ranges of the random key inside a source: a source is ordered range by range, so a hot one is spread over as many tasks.
RANGE_BITS = 12


def source_targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """One row per source: null_source, source (null as empty), source_size, target.

    Sources in code point order, null last, take ``weights`` in turn and share ``share`` of all words; no target passes
    ``cap`` times its source, and the excess goes to the others by weight. With sources ordered by cap per weight, those
    filled to the brim come first, and one division gives the level of all others. ``sizes`` has one row per source.
    """
    by_name, everything = Window.orderBy("null_source", "source"), Window.partitionBy(F.lit(1))
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    rows = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int")))
    rows = rows.withColumn("brim", cap * F.col("source_size") / F.col("weight"))
    before = Window.orderBy("brim", "null_source", "source").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("place", F.row_number().over(Window.orderBy("brim", "null_source", "source")))
    left = share * F.sum("source_size").over(everything) - F.coalesce(F.sum(cap * F.col("source_size")).over(before), F.lit(0.0))
    level = left / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    rows = rows.withColumn("level", level)
    chosen = F.min_by("level", F.when(F.col("level") <= F.col("brim"), F.col("place"))).over(everything)
    target = F.least(cap * F.col("source_size"), F.coalesce(chosen, F.lit(0.0)) * F.col("weight"))
    return rows.select("null_source", "source", "source_size", target.alias("target"))


def _keyed(docs: DataFrame, key: str, text: str, source: str, size: Column | None, seed: int) -> DataFrame:
    rand = F.xxhash64(F.lit(seed), F.col(key))
    return docs.select(
        F.struct("*").alias("doc"), F.col(key).alias("id"), F.col(source).isNull().cast("int").alias("null_source"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"),
        (word_count(F.col(text)) if size is None else size).alias("size"), rand.alias("rand"), F.shiftrightunsigned(rand, 64 - RANGE_BITS).alias("range"))


def mix(
    docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, key: str = "doc_id", text: str = "text", source: str = "source",
    size: Column | None = None, seed: int = 17,
) -> DataFrame:
    """Each row of ``docs`` as struct ``doc`` with id, size, source_size, target, taken.

    ``taken`` counts the words the mix takes of the row: whole epochs of its source first, then rows in random order until
    the rounded target is met; the row at the cut gives its first words only, so a source's sum is exact. ``size`` overrides
    the word count. Null texts and empty ones have size 0 and give 0. The order depends on ``seed`` and the key alone, ties
    being broken by key and size; rows that repeat both are alike. An empty table gives no row.
    """
    place = ["null_source", "source", "range"]
    keyed = _keyed(docs, key, text, source, size, seed)
    ranges = keyed.groupBy(*place).agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("null_source", "source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    upto = ranges.withColumn("before", F.coalesce(F.sum("words").over(earlier), F.lit(0))).drop("words")
    targets = source_targets(ranges.groupBy("null_source", "source").agg(F.sum("words").alias("source_size")), weights, share, cap)
    upto = upto.join(targets, ["null_source", "source"])
    inside = Window.partitionBy(*place).orderBy("rand", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    budget = F.floor(F.col("target") + 0.5).cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0))
    rows = keyed.join(upto, place).withColumn("before", F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    rows = rows.withColumn("epochs", epochs.cast("long")).withColumn("rest", budget - F.col("epochs") * F.col("source_size"))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("before")))
    return rows.select("doc", "id", "size", "source_size", "target", (F.col("epochs") * F.col("size") + part).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, text: str = "text", n_chars: str | None = "n_chars", **how) -> DataFrame:
    """The mixed corpus with the columns of ``docs``: a row comes once for each time it is taken.

    The one row at a source's cut keeps its first ``taken`` words, joined by blanks; rows of which nothing is taken go.
    """
    rows = mix(docs, text=text, **how).filter("taken > 0")
    whole = F.array_repeat(F.lit(None).cast("long"), F.floor(F.col("taken") / F.col("size")).cast("int"))
    parts = F.when(F.col("taken") % F.col("size") > 0, F.array(F.col("taken") % F.col("size"))).otherwise(F.array().cast("array<long>"))
    rows = rows.select("doc", F.explode(F.concat(whole, parts)).alias("first"))
    cut = F.array_join(F.slice(F.regexp_extract_all(F.col(f"doc.{text}"), F.lit(r"[^\x20\x09-\x0D]+"), 0), 1, F.col("first").cast("int")), " ")
    new = F.when(F.col("first").isNull(), F.col(f"doc.{text}")).otherwise(cut)
    columns = []
    for c in docs.columns:
        col = F.col("doc").getField(c)
        if c == text:
            col = new
        elif c == n_chars:
            col = F.when(F.col("first").isNull(), col).otherwise(F.char_length(cut).cast(docs.schema[c].dataType))
        columns.append(col.alias(c))
    return rows.select(*columns)
