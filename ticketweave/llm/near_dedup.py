"""Near duplicates by HyperMinHash signatures, and the connected groups they form.

A document's set of word shingles is dealt to registers; each keeps the smallest hash as its count of leading zeros and the
mantissa bits that follow. Some registers in a row make a band, and documents that share a band meet. Equal sets are one node,
named by their content. So that a large group is never paired with itself, some rounds only let nodes meet pivots: first every
node meets the most connected node of its bands, then nodes meet a few members of the largest groups in their bands that are
not theirs; links found join groups, and bands left with one group drop out. What is left of other groups in a band then meets
whole. There the join itself tests sizes, a parity sketch of the sets and two bits of every register, which drops most pairs
of documents that only share a passage, and tells a pair in the first band that it shares. Pairs whose collision-corrected estimate is hopeless are left; all others are
verified on their full sets, which only they need.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticketweave.llm.common import settle, small_batches

REGISTERS, MANTISSA_BITS = 256, 10
BUCKET_BITS = REGISTERS.bit_length() - 1
#: Bits of the parity sketch: each shingle turns one bit over, so two sketches differ where only one set has shingles.
SKETCH_BITS = 1024
#: Rounds, while one pair in ten is a link, in which nodes meet pivots of other groups, and how many of them a node meets in a round.
ROUNDS, PIVOTS = 4, 8
#: Members of a band up to which all its pairs are looked at as they stand; those of larger bands are parted by their sizes first.
FEW = 32
#: Standard deviations that an estimate may lie below the threshold before a pair is left unverified. A pair right at the
#: threshold is left so with a chance of about one in a billion by each of the three tests.
SLACK = 6.0
#: Share of registers that agree by chance for sets of equal size, times 2 to the mantissa bits (published constant).
COLLISION = 0.169919487159739093975315012348


def band_rows(percent: int) -> int:
    """Registers in a band. A pair right at 85 (80) percent shares none of the bands with a chance of one (three) in a million;
    longer bands keep apart documents that only share a passage."""
    return 7 if percent >= 85 else 6


_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


class Shingler:
    """Distinct shingles of a text as sorted 64-bit hashes, the register number in the top bits."""

    def __init__(self, words: int, limit: int = 400_000):
        import xxhash

        self.words, self.limit, self.known, self.hash = words, limit, {}, xxhash.xxh64_intdigest

    def __call__(self, text: str | None) -> np.ndarray:
        found = (text or "").encode().lower().split()
        if not found:
            return np.empty(0, dtype=np.uint64)
        known = self.known
        try:
            h = np.fromiter(map(known.__getitem__, found), np.uint64, len(found))
        except KeyError:
            if len(known) > self.limit:
                known.clear()
            for w in found:
                if w not in known:
                    known[w] = self.hash(w)
            h = np.fromiter(map(known.__getitem__, found), np.uint64, len(found))
        k = min(self.words, len(found))
        x = np.full(len(found) - k + 1, k, dtype=np.uint64)
        for j in range(k):
            x = (x ^ (x >> np.uint64(29))) * _M1 + h[j:len(found) - k + 1 + j]
        x = (x ^ (x >> np.uint64(32))) * _M2
        x = (x ^ (x >> np.uint64(29))) * _M3
        return np.unique(x ^ (x >> np.uint64(32)))


def registers(shingles: np.ndarray) -> np.ndarray:
    """16-bit registers of a non-empty set; an empty register repeats the next filled one, changed by the distance."""
    top = np.uint64(64 - BUCKET_BITS)
    at = np.searchsorted(shingles, np.arange(REGISTERS, dtype=np.uint64) << top)
    at_in = np.minimum(at, len(shingles) - 1)
    filled = (shingles[at_in] >> top) == np.arange(REGISTERS, dtype=np.uint64)
    filled &= at < len(shingles)
    low = (shingles[at_in] & np.uint64((1 << (64 - BUCKET_BITS)) - 1)) >> np.uint64(64 - BUCKET_BITS - 52)
    fraction, exponent = np.frexp(low.astype(np.float64))
    mantissa = np.floor((np.maximum(fraction, 0.5) * 2 - 1) * (1 << MANTISSA_BITS)).astype(np.int64)
    value = ((52 - exponent.astype(np.int64)) << MANTISSA_BITS) | mantissa
    places = np.flatnonzero(filled)
    after = np.searchsorted(places, np.arange(REGISTERS))
    source = places[after % len(places)]
    distance = (source - np.arange(REGISTERS)) % REGISTERS
    return ((value[source] + distance * 7919) & 0xFFFF).astype("<u2")


def band_values(found: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit value for each band of registers, of one set or of a set in each row; equal bands have equal values."""
    bands = found.shape[-1] // rows
    parts = found[..., : bands * rows].reshape(*found.shape[:-1], bands, rows).astype(np.uint64)
    x = np.full(parts.shape[:-1], rows, dtype=np.uint64)
    for j in range(rows):
        x = (x ^ (x >> np.uint64(31))) * _M2 + parts[..., j]
    return ((x ^ (x >> np.uint64(29))) * _M3).view("<i8")


def bit_planes(found: np.ndarray) -> np.ndarray:
    """The two lowest bits of all registers as 64-bit planes: first the lowest ones, then the others."""
    planes = np.stack([(found >> np.uint16(k)) & np.uint16(1) for k in range(2)]).astype(np.uint8)
    return np.packbits(planes, axis=1, bitorder="little").view("<i8").ravel()


def parity_sketch(shingles: np.ndarray) -> np.ndarray:
    odd = np.bincount((shingles & np.uint64(SKETCH_BITS - 1)).astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def _name(shingles: np.ndarray) -> tuple[int, int]:
    """The set's own name, 128 bits of hash as two integers."""
    import xxhash

    name = xxhash.xxh3_128_digest(shingles.tobytes())
    return int.from_bytes(name[:8], "little", signed=True), int.from_bytes(name[8:], "little", signed=True)


def _signatures(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(words)
        none = np.empty(0, "<i8")
        for batch in batches:
            sizes, names, found, planes, sketches = [], [], [], [], []
            for text in batch.column(2).to_pylist():
                s = shingles(text)
                sizes.append(len(s))
                names.append(_name(s))
                kept = registers(s) if len(s) else None
                found.append(kept.view("<i8") if len(s) else none)
                planes.append(bit_planes(kept) if len(s) else none)
                sketches.append(parity_sketch(s) if len(s) else none)
            lists = [pa.array(x, pa.list_(pa.int64())) for x in (found, planes, sketches)]
            longs = [pa.array(x, pa.int64()) for x in (sizes, [a for a, _ in names], [b for _, b in names])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *longs, *lists], names=["id", "mark", "n", "d1", "d2", "registers", "planes", "sketch"])

    return run


def _bands(rows: int):
    """(node, registers) to (node, bands): a band's value follows from the registers, so it need not be stored with them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column(1).flatten().to_numpy().view("<u2").reshape(batch.num_rows, REGISTERS)
            values = band_values(found, rows)
            ends = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * (REGISTERS // rows))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, pa.array(values.ravel()))], names=["node", "bands"])

    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(words)
        for batch in batches:
            found = [shingles(t) for t in batch.column(1).to_pylist()]
            names = [_name(s) for s in found]
            longs = [pa.array(x, pa.int64()) for x in ([len(s) for s in found], [a for a, _ in names], [b for _, b in names])]
            yield pa.RecordBatch.from_arrays([*longs, pa.array([s.view("<i8") for s in found], pa.list_(pa.int64()))], names=["n", "d1", "d2", "shingles"])

    return run


def components(edges: DataFrame) -> DataFrame:
    """(node, component): smallest node reachable. Every round maps nodes to their smallest neighbour and keeps only the edges
    between what is left, so stars vanish in two or three rounds."""
    ends = settle(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    label, steps = ends.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("component", F.col("node")), []
    while not ends.isEmpty():
        both = ends.unionByName(ends.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = settle(both.groupBy(F.col("a").alias("component")).agg(F.least(F.min("b"), F.col("a")).alias("to")), "step")
        steps.append(step)
        left = ends.join(step.select(F.col("component").alias("a"), F.col("to").alias("ta")), "a").join(step.select(F.col("component").alias("b"), F.col("to").alias("tb")), "b")
        ends = settle(left.filter("ta <> tb").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct(), "edges")
        if len(steps) == 4:  # so that the last plan stays short
            label, steps = settle(_renamed(label, steps), "labels"), []
    return settle(_renamed(label, steps), "labels")


def _renamed(label: DataFrame, steps: list[DataFrame]) -> DataFrame:
    for step in steps:
        label = label.join(step, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    return label


def _hopeful(a: Column, b: Column, na: Column, nb: Column, percent: int) -> Column:
    """Whether the corrected estimate of two nodes' similarity may belong to a pair at the threshold."""
    t = percent / 100
    agree = F.aggregate(F.zip_with(a, b, lambda x, y: x.bitwiseXOR(y)), F.lit(0), lambda n, z: n + sum(
        F.when(z.bitwiseAND(F.lit(0xFFFF << (16 * k) if k < 3 else -(1 << 48))) == 0, 1).otherwise(0) for k in range(4)))
    ratio = na / nb
    chance = COLLISION / (1 << MANTISSA_BITS) * 4 * ratio / ((1 + ratio) * (1 + ratio))
    share = agree / REGISTERS
    estimate = (share - chance) / (1 - chance)
    seen = F.least(F.greatest(na, nb), F.lit(REGISTERS))
    return (100 * F.least(na, nb) >= percent * F.greatest(na, nb)) & (estimate >= t - SLACK * F.sqrt(F.lit(t * (1 - t)) / seen))


def _few_odd(n: Column, m: Column, differ: Column, percent: int) -> Column:
    """Whether two sketches that differ in ``differ`` bits may belong to sets of ``n`` and ``m`` shingles at the threshold."""
    bits, d = float(SKETCH_BITS), (n + m) * ((100 - percent) / (100 + percent))
    a, b = F.pow(F.lit(1 - 2 / bits), d), F.pow(F.lit(1 - 4 / bits), d)
    mean = (1 - a) * (bits / 2)
    variance = mean + (1 - 2 * a + b) * (bits * (bits - 1) / 4) - mean * mean
    return differ <= mean + SLACK * F.sqrt(F.greatest(variance, F.lit(1.0)))


def _compatible(percent: int) -> Column:
    """Whether sizes, sketches and bit planes of two nodes, columns with and without ``_b``, may belong to a pair at the threshold."""
    half = REGISTERS // 64
    odd = sum(F.bit_count(F.col(f"o{k}").bitwiseXOR(F.col(f"o{k}_b"))) for k in range(SKETCH_BITS // 64))
    differ = sum(F.bit_count(F.col(f"p{k}").bitwiseXOR(F.col(f"p{k}_b")).bitwiseOR(F.col(f"p{k + half}").bitwiseXOR(F.col(f"p{k + half}_b")))) for k in range(half))
    share = 0.75 * (1 - percent / 100)
    most = REGISTERS * (share + SLACK * (share * (1 - share)) ** 0.5 / F.sqrt(F.least(F.col("n_b"), F.lit(REGISTERS))))
    return (100 * F.col("n") >= percent * F.col("n_b")) & _few_odd(F.col("n"), F.col("n_b"), odd, percent) & (differ <= most)


def _first_shared() -> Column:
    """Whether ``band`` is the first band that two nodes, columns with and without ``_b``, share: they meet in all, but are one pair."""
    return F.array_position(F.zip_with("bands", "bands_b", lambda x, y: x == y), True) == F.col("band") + 1


def _estimated(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, n_a, n_b) among ``pairs`` whose sketches and estimate leave hope."""
    side = lambda s: nodes.select(F.col("node").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("registers", "sketch", "n")])
    met = pairs.join(side("a"), "a").join(side("b"), "b")
    odd = F.aggregate(F.zip_with("sketch_a", "sketch_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    alike = (100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")) & _few_odd(F.col("n_a"), F.col("n_b"), odd, percent)
    return met.filter(alike).filter(_hopeful(F.col("registers_a"), F.col("registers_b"), F.col("n_a"), F.col("n_b"), percent)).select("a", "b", "n_a", "n_b")


def _verified(pairs: DataFrame, nodes: DataFrame, src: DataFrame, words: int, percent: int) -> DataFrame:
    """Edges (a, b) among ``pairs`` whose full sets reach ``percent`` percent. A set is found again by a key, and told by its name."""
    asked = nodes.join(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node", "left_semi").select("node", "n", "d1", "d2", F.struct("low").alias("_low"))
    texts = src.select(F.struct(F.col("id").alias("low")).alias("_low"), "text").join(asked.select("_low").distinct(), "_low", "left_semi")
    sets = texts.mapInArrow(_sets(words), "n long, d1 long, d2 long, shingles array<long>")
    sets = settle(sets.join(asked.drop("_low"), ["n", "d1", "d2"]).groupBy("node").agg(F.first("shingles").alias("shingles")), "sets")
    full = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")
    both = F.size(F.array_intersect("sa", "sb")).cast("long")
    return full.withColumn("both", both).filter(100 * F.col("both") >= percent * (F.col("n_a") + F.col("n_b") - F.col("both"))).select("a", "b")


def _pair(a: Column, b: Column) -> tuple[Column, Column]:
    return F.least(a, b).alias("a"), F.greatest(a, b).alias("b")


def _pivot_pairs(met: DataFrame, group: DataFrame, turn: int) -> DataFrame:
    """Pairs (a, b) of nodes and members of the largest groups in their bands that are not their own: few for each node."""
    sizes = group.groupBy("component").agg(F.count(F.lit(1)).alias("members"))
    known = group.join(sizes, "component")
    rank = F.struct(F.coalesce("members", F.lit(1)).alias("members"), F.xxhash64("node", F.lit(turn)).alias("draw"), "node", F.coalesce("component", "node").alias("component"))
    grouped = met.select("node", "band", "value").join(known, "node", "left").select("band", "value", "node", rank.alias("rank"))
    pivots = grouped.groupBy("band", "value").agg(F.max("rank").alias("top"), F.min("rank.component").alias("lo"), F.max("rank.component").alias("hi")).filter("lo <> hi")
    asked = grouped.join(pivots.select("band", "value", "top"), ["band", "value"]).filter("rank.component <> top.component").select("node", "top").distinct()
    best = Window.partitionBy("node").orderBy(F.desc("top"))  # a node has as many rows as bands at most
    return asked.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= PIVOTS).select(*_pair(F.col("node"), F.col("top.node"))).distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept, mark (64 bits of hash of the row's text).

    Words are what lies between ASCII white space after lower-casing A-Z; a text with fewer than ``words`` words is one
    shingle, one without words has none and is linked with nothing. Documents are linked when 100 * intersection >= percent *
    union of their shingle sets. ``component_id`` is the smallest key reachable; the row with that key is kept. Texts are told
    apart by their sets, not their keys: rows that repeat a key are looked at one by one, and rows without a key link like any
    others. A null key never is a component's name unless all its members lack one; then they are all kept. Other columns
    are not looked at; an empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    kind = docs.schema[key].dataType.simpleString()
    src = docs.select(F.col(key).alias("id"), F.xxhash64(F.col(text)).alias("mark"), F.col(text).alias("text"))
    lists = ", ".join(f"{c} array<long>" for c in ("registers", "planes", "sketch"))
    signed = settle(src.mapInArrow(_signatures(words), f"id {kind}, mark long, n long, d1 long, d2 long, {lists}"), "signatures")
    name = ["n", "d1", "d2"]
    named = signed.filter("n > 0").groupBy(*name).agg(F.min("id").alias("low"), F.first(F.struct("registers", "planes", "sketch")).alias("s"))
    nodes = settle(named.select(F.monotonically_increasing_id().alias("node"), *name, "low", "s.*"), "nodes")
    rows = nodes.select("node", "registers").mapInArrow(_bands(band_rows(percent)), "node long, bands array<long>").select("node", F.posexplode("bands").alias("band", "value"))
    crowds = rows.groupBy("band", "value").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    met = settle(rows.join(crowds, ["band", "value"]), "bands")
    centre = met.groupBy("node").agg(F.sum("size").alias("weight"))
    met = settle(met.join(centre, "node"), "weighted")
    # Each node against one pivot: the most connected among those of its bands, itself left out.
    pivots = met.groupBy("band", "value").agg(F.max(F.struct("weight", "node")).alias("top"))
    best = met.join(pivots, ["band", "value"]).filter("node <> top.node").groupBy("node").agg(F.max("top").alias("top"))
    links = settle(_verified(settle(_estimated(best.select(*_pair(F.col("node"), F.col("top.node"))).distinct(), nodes, percent), "hopeful"), nodes, src, words, percent), "links")
    group = components(links)
    for turn in range(ROUNDS):
        hopeful = settle(_estimated(_pivot_pairs(met, group, turn), nodes, percent), "hopeful")
        found = settle(_verified(hopeful, nodes, src, words, percent), "links")
        links = links.unionByName(found)
        if 10 * found.count() < hopeful.count() or hopeful.isEmpty():  # what still meets is mostly not alike: pivots find no more
            break
        group = components(links)
    grouped = met.select("node", "band", "value").join(group, "node", "left").select("band", "value", "node", F.coalesce("component", "node").alias("component"))
    mixed = grouped.groupBy("band", "value").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("size")).filter("lo <> hi")
    grouped = settle(grouped.join(mixed.select("band", "value", (F.col("size") <= FEW).alias("few")), ["band", "value"]), "mixed")
    # Nodes of two groups share no other bands, so only these are told apart.
    places = F.sequence(F.lit(0), F.lit(REGISTERS // band_rows(percent) - 1))
    bands = grouped.groupBy("node").agg(F.map_from_entries(F.collect_list(F.struct("band", "value"))).alias("at")).select("node", F.transform(places, lambda k: F.try_element_at("at", k)).alias("bands"))
    # Sizes of linked sets are less than two steps of this scale apart; the smaller set of a pair looks for the larger one.
    step = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100 / percent))).cast("int").alias("step")
    bits = [F.get(c, F.lit(k)).alias(f"{s}{k}") for c, s, size in (("planes", "p", REGISTERS // 32), ("sketch", "o", SKETCH_BITS // 64)) for k in range(size)]
    grouped = settle(grouped.join(bands, "node").join(nodes.select("node", "n", step, *bits), "node"), "mixed")
    other = lambda side: side.select("band", "value", "step", *[F.col(c).alias(f"{c}_b") for c in side.columns if c not in ("band", "value", "step")])
    apart = (F.col("component") != F.col("component_b")) & ((F.col("n") < F.col("n_b")) | ((F.col("n") == F.col("n_b")) & (F.col("node") < F.col("node_b"))))
    found = apart & _compatible(percent) & _first_shared()
    few = grouped.filter("few").drop("few").repartition("band", "value")  # both sides of the join read this one shuffle
    many = grouped.filter("NOT few").drop("few")
    larger = many.select(F.explode(F.array("step", F.col("step") - 1)).alias("step"), *[c for c in many.columns if c != "step"])
    met_few = few.drop("step").join(other(few).drop("step"), ["band", "value"]).filter(found).select(*_pair(F.col("node"), F.col("node_b")))
    met_many = many.join(other(larger), ["band", "value", "step"]).filter(found).select(*_pair(F.col("node"), F.col("node_b")))
    rest = met_few.unionByName(met_many).distinct()
    last = _verified(settle(_estimated(rest, nodes, percent), "hopeful"), nodes, src, words, percent)
    label = components(links.unionByName(last))
    group = nodes.select("node", *name, "low").join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
    lowest = group.groupBy("component").agg(F.min("low").alias("component_id"))
    out = signed.select("id", "mark", *name).join(group.join(lowest, "component").select(*name, "component_id"), name, "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"), "mark")


def keep_one_of_near(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay, one document of each group, all columns as they were.

    A row is found again by its key and a hash of its text, so that of different texts under one key each has its own fate;
    rows that repeat both stay or go together.
    """
    kept = near_duplicates(docs, key, text, words, percent).filter("kept").select(F.struct(F.col("doc_id").alias("id"), "mark").alias("_kept")).distinct()
    marked = docs.select(F.struct("*").alias("_doc"), F.struct(F.col(key).alias("id"), F.xxhash64(F.col(text)).alias("mark")).alias("_mine"))
    return marked.join(kept, F.col("_mine").eqNullSafe(F.col("_kept")), "left_semi").select("_doc.*")
