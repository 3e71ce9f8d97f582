"""Near-equal vectors: iterative quantisation to balanced binary codes, multi-index Hamming tables, rerank with the vectors.

On a bounded sample of distinct vectors, principal axes and a rotation are learned that bring the rotated sample as near to the
corners of a cube as it goes (alternating signs and an orthogonal fit); signs of rotated vectors are the code. Several
rotations, learned from different beginnings, give several codes. Codes are cut into substrings, each a table of buckets;
vectors that share a bucket meet, and the first table in which two meet owns the pair, so that it is formed once. The join
itself tests the Hamming distance of whole codes; what passes is settled by the cosine of the vectors in double precision.

Equal vectors are one node. A crowded bucket is cut into blocks: a task compares two blocks by a matrix product and returns a
row per vector (its links, and the smallest vector of its group in the two blocks), never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketweave.llm.common import settle, small_batches
from ticketweave.llm.near_dedup import components

#: Numbers in the sample that a rotation is learned from (8,192 vectors of 64), and the fewest vectors of it.
SAMPLE_NUMBERS, SAMPLE_LEAST = 1 << 19, 256
#: Codes, bits of each at most, bits of a table's bucket at most, rounds of learning, share of links at the threshold to be met.
CODES, BITS, WIDTH, ROUNDS, RECALL = 6, 64, 16, 30, 0.99
#: Members from which on a bucket is compared in blocks of about so many.
CROWD, BLOCK = 256, 1024
#: Standard deviations that a Hamming distance may lie above what a pair at the threshold has on average.
SLACK = 7.0


class Index(NamedTuple):
    """Learned codes: ``mean``, one projection for each code, bits of a bucket, and the Hamming distance to look at."""

    mean: np.ndarray
    projections: list[np.ndarray]
    width: int
    distance: int

    @property
    def tables(self) -> list[tuple[int, int]]:
        """(code, first bit) of every table."""
        bits = self.projections[0].shape[1]
        return [(c, b) for c in range(len(self.projections)) for b in range(0, bits - self.width + 1, self.width)]

    def codes(self, units: np.ndarray) -> list[np.ndarray]:
        found = []
        for p in self.projections:
            bits = ((units - self.mean) @ p >= 0).astype(np.uint64)
            found.append((bits << np.arange(bits.shape[1], dtype=np.uint64)).sum(axis=1, dtype=np.uint64).view(np.int64))
        return found


def unit_rows(vectors: pa.Array, size: int | None = None) -> np.ndarray:
    """Vectors of a list column as rows of length one in double precision, filled up with zeros to ``size``."""
    lengths = np.diff(vectors.offsets.to_numpy())
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    size = size or int(lengths.max(initial=0))
    rows = np.zeros((len(lengths), size))
    rows[np.arange(size) < lengths[:, None]] = flat
    rows /= np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def learn(units: np.ndarray, threshold: float, codes: int = CODES, seed: int = 7) -> Index:
    """Iterative quantisation of sampled unit vectors; the bucket width follows from how often bits of a pair at the threshold differ."""
    rng = np.random.default_rng(seed)
    mean = units.mean(axis=0)
    centred = units - mean
    bits = min(BITS, units.shape[1])
    _, axes = np.linalg.eigh(centred.T @ centred)
    axes = axes[:, ::-1][:, :bits]
    flat, projections = centred @ axes, []
    for _ in range(codes):
        rotation = np.linalg.qr(rng.standard_normal((bits, bits)))[0]
        for _ in range(ROUNDS):
            u, _, vt = np.linalg.svd(np.where(flat @ rotation >= 0, 1.0, -1.0).T @ flat)
            rotation = (u @ vt).T
        projections.append(axes @ rotation)
    # Centring keeps the distance of two vectors but shortens them, so the angle between them grows.
    short = max(0.05, float(np.quantile(np.sqrt((centred * centred).sum(axis=1)), 0.1)))
    angle = 2 * np.arcsin(min(1.0, np.sqrt(2 - 2 * threshold) / 2 / short))
    differ = angle / np.pi
    met = lambda w: 1 - (1 - (1 - differ) ** w) ** (codes * (bits // w))
    width = next((w for w in range(min(WIDTH, bits), 1, -1) if met(w) >= RECALL), 1)
    total = codes * bits
    return Index(mean, projections, width, int(np.ceil(total * differ + SLACK * np.sqrt(total * differ * (1 - differ)))))


def _coded(index: Index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                units = unit_rows(batch.column(1), len(index.mean))
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in index.codes(units))], names=["node", *(f"c{i}" for i in range(len(index.projections)))])

    return run


def _same_side(index: Index, a: str, b: str) -> tuple[Column, Column]:
    """Whether two rows lie near enough, and the first table in which their codes agree."""
    xor = [F.col(f"c{i}{a}").bitwiseXOR(F.col(f"c{i}{b}")) for i in range(len(index.projections))]
    near = sum(F.bit_count(x) for x in xor) <= index.distance
    mask = (1 << index.width) - 1
    first = F.coalesce(*[F.when(xor[c].bitwiseAND(F.lit(_signed(mask << b))) == 0, F.lit(t)) for t, (c, b) in enumerate(index.tables)])
    return near, first


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _verified(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = unit_rows(batch.column("va")), unit_rows(batch.column("vb"))
                yield batch.select(["a", "b", "many_a", "many_b"]).filter(pa.array((x * y).sum(axis=1) >= threshold))

    return run


def _block_links(index: Index, threshold: float):
    """Links between (or in) blocks of one bucket, a row for each vector that has some."""
    def run(key: tuple, table: pa.Table) -> pa.Table:
        t, lo, hi = (key[i].as_py() for i in (1, 3, 4))
        table = table.combine_chunks()
        node, many, block = (table.column(c).to_numpy() for c in ("node", "many", "block"))
        units = unit_rows(table.column("v").combine_chunks())
        codes = [table.column(f"c{i}").to_numpy().view(np.uint64) for i in range(len(index.projections))]
        left, right = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
        linked = np.zeros((len(node), len(node)), dtype=bool)
        met = units[left] @ units[right].T >= threshold
        mask = np.uint64((1 << index.width) - 1)
        for c, b in index.tables[:t]:  # pairs that an earlier table owns
            part = (codes[c] >> np.uint64(b)) & mask
            met &= part[left][:, None] != part[right][None, :]
        linked[np.ix_(left, right)] = met
        linked |= linked.T
        np.fill_diagonal(linked, False)
        links = linked @ many
        to = node.copy()
        while True:
            low = np.minimum(to, np.where(linked, to[None, :], np.iinfo(np.int64).max).min(axis=1, initial=np.iinfo(np.int64).max))
            if (low == to).all():
                break
            to = low
        some = np.flatnonzero(links)
        return pa.table({"node": node[some], "links": links[some], "to": to[some]})

    return run


def near_equal_vectors(vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding", threshold: float = 0.95) -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id, kept.

    Pairs found with cosine >= ``threshold`` are linked, none below it; what is found is measured against brute force in the
    tests. Vectors of different lengths are never linked; those that are null, empty, zero or hold null or non-finite
    components link with nothing. ``n_links`` counts other rows linked directly, copies included; ``component_id`` is the
    smallest key reachable, and the row with that key is kept. Rows that repeat a key with another vector are looked at one by
    one; a null key never names a component unless all its members lack one. Other columns are not looked at; an empty
    table gives no rows. Rotations are learned from a sample of ``SAMPLE_NUMBERS`` numbers; every row is indexed and looked up.
    """
    spark = vectors.sparkSession
    small_batches(spark, 4096)
    number = vectors.schema[embedding].dataType.elementType.simpleString()
    v = F.col(embedding) if number in ("float", "double") else F.col(embedding).cast("array<double>")
    sound = F.forall(v, lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(key).alias("vec_id"), F.when(sound, v).alias("v"))
    grouped = rows.filter("v IS NOT NULL").groupBy("v").agg(F.min("vec_id").alias("low"), F.count(F.lit(1)).alias("many"))
    classes = settle(grouped.withColumn("node", F.monotonically_increasing_id()), "classes")
    alone = rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    size = classes.agg(F.max(F.size("v"))).first()[0]
    if size is None:
        return alone
    sample = classes.orderBy(F.xxhash64("v"), "node").limit(max(SAMPLE_LEAST, SAMPLE_NUMBERS // size)).select("v")
    index = learn(unit_rows(sample.toArrow().column(0).combine_chunks(), size), threshold)
    columns = [f"c{i}" for i in range(len(index.projections))]
    coded = classes.select("node", "v").mapInArrow(_coded(index), ", ".join(["node long", *(f"{c} long" for c in columns)]))
    # In float rounding a vector's own tests may differ by machine: codes are settled once.
    coded = settle(coded, "codes").join(classes.select("node", "many", F.size("v").alias("dim")), "node")
    mask = (1 << index.width) - 1
    places = F.array(*[F.struct(F.lit(t).alias("t"), F.shiftrightunsigned(f"c{c}", b).bitwiseAND(F.lit(mask)).alias("bucket")) for t, (c, b) in enumerate(index.tables)])
    placed = coded.select("node", "dim", *columns, F.inline(places))
    where = ["dim", "t", "bucket"]
    sizes = settle(placed.groupBy(*where).agg(F.count(F.lit(1)).alias("members")).filter("members > 1"), "buckets")
    few = placed.join(sizes.filter(F.col("members") <= CROWD).select(*where), where)
    other = few.select(*where, F.col("node").alias("node_b"), *[F.col(c).alias(f"{c}_b") for c in columns])
    near, first = _same_side(index, "", "_b")
    pairs = few.join(other, where).filter((F.col("node") < F.col("node_b")) & near & (first == F.col("t"))).select(F.col("node").alias("a"), F.col("node_b").alias("b"))
    side = lambda s: classes.select(F.col("node").alias(s), F.col("v").alias(f"v{s}"), F.col("many").alias(f"many_{s}"))
    links = settle(pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(_verified(threshold), "a long, b long, many_a long, many_b long"), "links")
    # Crowded buckets: every block meets every block.
    crowds = sizes.filter(F.col("members") > CROWD).withColumn("blocks", F.ceil(F.col("members") / BLOCK).cast("int"))
    crowded = placed.join(crowds.drop("members"), where).withColumn("block", F.pmod(F.xxhash64("node", "t"), F.col("blocks")).cast("int"))
    paired = crowded.select("node", *where, *columns, "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("with"))
    paired = paired.withColumns({"lo": F.least("block", "with"), "hi": F.greatest("block", "with")}).join(classes.select("node", "v", "many"), "node")
    dense = settle(paired.groupBy(*where, "lo", "hi").applyInArrow(_block_links(index, threshold), "node long, links long, to long"), "dense")
    told = links.select(F.col("a").alias("node"), F.col("many_b").alias("links")).unionByName(links.select(F.col("b").alias("node"), F.col("many_a").alias("links"))).unionByName(dense.select("node", "links"))
    counted = told.groupBy("node").agg(F.sum("links").alias("links"))
    label = components(links.select("a", "b").unionByName(dense.select(F.col("node").alias("a"), F.col("to").alias("b"))))
    known = classes.join(counted, "node", "left").join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = known.groupBy("component").agg(F.min("low").alias("component_id"))
    known = known.join(named, "component").select("v", (F.col("many") - 1 + F.coalesce("links", F.lit(0))).alias("n"), "component_id", F.lit(True).alias("found"))
    out = rows.join(known, "v", "left")
    component = F.when(F.col("found"), F.col("component_id")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id")).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
