"""Ordered work (previous row, running total, exact quantile, first k) that survives hot keys.

A plain window sorts one key in one task. Here the key is first split into buckets that follow the
sort order; each bucket is handled alone and only one summary row per bucket is ordered per key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticketweave.lineage import written


def previous_values(
    df: DataFrame, keys: Sequence[str], ts: str, cols: Sequence[str], tie: Sequence[str] = (),
    unit: str = "day", out: str = "prev",
) -> DataFrame:
    """Add struct ``out`` with ``cols`` of the preceding row of the same key in ``ts``, ``tie`` order.

    ``unit`` is the bucket width: a task holds at most one key's rows of one bucket.
    """
    keys, order = list(keys), [F.col(ts), *[F.col(t) for t in tie]]
    src = df.filter(F.col(ts).isNotNull()).withColumn("_b", F.date_trunc(unit, F.col(ts)))
    vals = F.struct(*[F.col(c) for c in cols])
    inside = src.withColumn("_p", F.lag(vals).over(Window.partitionBy(*keys, "_b").orderBy(*order)))
    tails = src.groupBy(*keys, "_b").agg(F.max_by(vals, F.struct(*order)).alias("_tail"))
    carry = tails.select(
        *keys, "_b", F.lag("_tail").over(Window.partitionBy(*keys).orderBy("_b")).alias("_carry"))
    return (inside.join(carry, [*keys, "_b"], "left")
            .withColumn(out, F.coalesce("_p", "_carry")).drop("_b", "_p", "_carry"))


def last_known(
    df: DataFrame, keys: Sequence[str], ts: str, col: str, tie: Sequence[str] = (),
    bucket: Column | None = None, out: str = "known",
) -> DataFrame:
    """Carry the last non-null ``col`` forward along ``ts``, ``tie``, the current row included.

    ``bucket`` must grow with the order; default is the day of ``ts``.
    """
    keys = list(keys)
    order = [F.col(ts), *[F.col(t) for t in tie]]
    src = df.withColumn("_b", F.date_trunc("day", F.col(ts)) if bucket is None else bucket)
    w = Window.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inside = src.withColumn("_p", F.last(col, ignorenulls=True).over(w))
    tails = (src.filter(F.col(col).isNotNull()).groupBy(*keys, "_b")
             .agg(F.max_by(col, F.struct(*order)).alias("_tail")))
    heads = src.select(*keys, "_b").distinct().join(tails, [*keys, "_b"], "left")
    wb = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carry = heads.select(*keys, "_b", F.last("_tail", ignorenulls=True).over(wb).alias("_carry"))
    return (inside.join(carry, [*keys, "_b"], "left")
            .withColumn(out, F.coalesce("_p", "_carry")).drop("_b", "_p", "_carry"))


def in_ranges(df: DataFrame, order: Sequence[Column], cells: int | None = None, out: str = "_cell") -> DataFrame:
    """``df`` with the number of the range that each row falls in: ranges follow ``order`` and hold about equally many rows.

    Spark samples the bounds. The rows are written once, so that later passes see the same ranges. Rows that are equal in
    ``order`` share a range; ``cells`` is the number of ranges, by default that of shuffle partitions.
    """
    spread = df.repartitionByRange(cells, *order) if cells else df.repartitionByRange(*order)
    return written(spread.withColumn(out, F.spark_partition_id()), "ranges")


def running_total(df: DataFrame, order: Sequence[Column], value: str, out: str, cells: int | None = None) -> DataFrame:
    """Global running sum of ``value`` along ``order``, which no two rows share.

    Each range of the order is summed alone; only one row per range is ordered globally.
    """
    ranged = in_ranges(df, order, cells)
    upto = Window.partitionBy("_cell").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    sums = ranged.groupBy("_cell").agg(F.sum(value).alias("_s"))
    earlier = Window.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("_cell", F.coalesce(F.sum("_s").over(earlier), F.lit(0)).alias("_before"))
    return (ranged.withColumn("_in", F.sum(value).over(upto)).join(before, "_cell")
            .withColumn(out, F.col("_in") + F.col("_before")).drop("_cell", "_in", "_before"))


def exact_quantile(df: DataFrame, col: str, q: float = 0.5, out: str = "quantile", cells: int | None = None) -> DataFrame:
    """Exact interpolated quantile as a one-row frame; null where there are no values.

    Values are counted, so a frequent one is a single row, and the distinct values are cut into ranges of about equal size,
    so a value far off moves no bound. Only the one or two ranges that hold the wanted ranks are ordered.
    """
    counts = df.filter(F.col(col).isNotNull()).groupBy(F.col(col).cast("double").alias("v")).agg(F.count("*").alias("n"))
    celled = in_ranges(counts, [F.col("v")], cells, "cell")
    sums = celled.groupBy("cell").agg(F.sum("n").alias("cn"))
    wb = Window.orderBy("cell")
    totals = sums.select(
        "cell",
        (F.sum("cn").over(wb.rowsBetween(Window.unboundedPreceding, 0)) - F.col("cn")).alias("before"),
        F.col("cn"),
        F.sum("cn").over(Window.partitionBy(F.lit(1))).alias("total"))
    rank = (F.col("total") - 1) * F.lit(q)
    wanted = totals.filter(
        (F.col("before") <= F.ceil(rank)) & (F.col("before") + F.col("cn") > F.floor(rank)))
    wv = Window.partitionBy("cell").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    spans = (celled.join(wanted, "cell")
             .withColumn("upto", F.col("before") + F.sum("n").over(wv))
             .withColumn("start", F.col("upto") - F.col("n")))
    hit = lambda r: F.max(F.when((F.col("start") <= r) & (r < F.col("upto")), F.col("v")))
    picked = spans.agg(hit(F.floor(rank)).alias("a"), hit(F.ceil(rank)).alias("b"), F.max(rank - F.floor(rank)).alias("f"))
    return picked.select((F.col("a") + (F.col("b") - F.col("a")) * F.col("f")).alias(out))


def first_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """Rows 1..k of each key with their position ``rn``; Spark prunes each map partition to k rows before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= k)


def k_samples(df: DataFrame, keys: Sequence[str], value: str, k: int, out: str) -> DataFrame:
    """The k smallest distinct ``value`` of each key as one sorted array."""
    distinct = df.filter(F.col(value).isNotNull()).select(*keys, value).distinct()
    return (first_k(distinct, keys, [F.col(value)], k).groupBy(*keys)
            .agg(F.sort_array(F.collect_list(value)).alias(out)))


def _running_extreme(df: DataFrame, keys: Sequence[str], ts: str, values: dict[str, Column], unit: str, forward: bool) -> DataFrame:
    keys, names = list(keys), list(values)
    src = df.withColumn("_b", F.date_trunc(unit, F.col(ts))).withColumns({f"_v_{n}": c for n, c in values.items()})
    best = F.max if forward else F.min
    lo, hi = (Window.unboundedPreceding, Window.currentRow) if forward else (Window.currentRow, Window.unboundedFollowing)
    inside_w = Window.partitionBy(*keys, "_b").orderBy(ts).rangeBetween(lo, hi)
    inside = src.withColumns({f"_p_{n}": best(f"_v_{n}").over(inside_w) for n in names})
    ends = src.groupBy(*keys, "_b").agg(*[best(f"_v_{n}").alias(f"_e_{n}") for n in names])
    lo, hi = (Window.unboundedPreceding, -1) if forward else (1, Window.unboundedFollowing)
    ends_w = Window.partitionBy(*keys).orderBy("_b").rowsBetween(lo, hi)
    carry = ends.select(*keys, "_b", *[best(f"_e_{n}").over(ends_w).alias(f"_c_{n}") for n in names])
    out = inside.join(carry, [*keys, "_b"], "left")
    return out.withColumns({n: F.coalesce(f"_p_{n}", f"_c_{n}") for n in names}).drop(
        "_b", *[f"_{x}_{n}" for n in names for x in "vpc"])


def latest_before(df: DataFrame, keys: Sequence[str], ts: str, values: dict[str, Column], unit: str = "day") -> DataFrame:
    """Per row the greatest value (time first) seen for its keys at or before ``ts``; as-of join without pairs."""
    return _running_extreme(df, keys, ts, values, unit, True)


def earliest_after(df: DataFrame, keys: Sequence[str], ts: str, values: dict[str, Column], unit: str = "day") -> DataFrame:
    """Per row the smallest value (time first) seen for its keys at or after ``ts``."""
    return _running_extreme(df, keys, ts, values, unit, False)
