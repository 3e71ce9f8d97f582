"""Shared join kernels: phrases inside texts, and pairs of similar token sets, without pairing everything."""

from __future__ import annotations

import json
import math
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticketweave.lineage import discard, written

#: Characters of a gram. Shorter phrases are their own grams.
GRAM = 4
#: Texts whose grams a task holds together.
ROWS = 256


def grams_of(text: str | None, n: int) -> np.ndarray:
    """Distinct runs of ``n`` code points as 64-bit numbers: equal runs have equal numbers, and a rare clash only costs a look."""
    points = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    if len(points) < n:
        return np.empty(0, dtype=np.int64)
    code = np.full(len(points) - n + 1, n, dtype=np.uint64)
    for k in range(n):
        code = (code ^ (code >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + points[k:len(points) - n + 1 + k]
    return np.unique(code.view(np.int64))


def _gram_lists(lengths: Sequence[int], phrases: bool = False):
    """(key, text) to (key, grams) for runs of all ``lengths``; a phrase has runs of ``GRAM``, or is one when it is shorter."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                found = [[grams_of(t, n) for n in ([min(GRAM, len(t))] if phrases else lengths)] for t in batch.column(1).to_pylist()]
                bounds = np.cumsum([0, *(sum(map(len, x)) for x in found)]).astype(np.int32)
                flat = np.concatenate([np.empty(0, np.int64), *(y for x in found for y in x)])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat))], names=["key", "grams"])

    return run


def _gram_counts(lengths: Sequence[int]):
    """Texts to (gram, texts): in how many of them each run occurs, added up for some texts at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                found = [grams_of(t, n) for t in whole.column(0).slice(at, ROWS).to_pylist() for n in lengths]
                gram, texts = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(texts.astype(np.int64))], names=["gram", "texts"])

    return run


def phrase_keys(texts: DataFrame, text: str, phrases: DataFrame) -> DataFrame:
    """(phrase, gram, n): every phrase that can occur in the texts, with the gram of it that the fewest texts hold.

    A phrase with a gram that no text holds is left out. Grams of texts are counted per task before anything is shuffled, so
    that a gram travels once for some hundred texts and not once per text.
    """
    named = phrases.select("phrase", F.col("phrase").alias("text")).mapInArrow(_gram_lists((), phrases=True), "phrase string, grams array<long>")
    wanted = named.select("phrase", F.explode("grams").alias("gram"))
    # Runs shorter than a gram are looked for in the texts' grams only where a phrase is that short.
    short = [r[0] for r in phrases.select(F.length("phrase").alias("n")).filter(F.col("n") < GRAM).distinct().collect()]  # three lengths at most
    held = texts.select(text).mapInArrow(_gram_counts([GRAM, *sorted(short)]), "gram long, texts long")
    counts = held.groupBy("gram").agg(F.sum("texts").alias("texts"))
    met = wanted.join(counts, "gram", "left").groupBy("phrase").agg(F.min(F.struct(F.coalesce("texts", F.lit(0)).alias("texts"), "gram")).alias("rarest"))
    return written(met.filter("rarest.texts > 0").select("phrase", "rarest.gram", F.least(F.length("phrase"), F.lit(GRAM)).alias("n")), "phrase-keys")


def phrase_hits(docs: DataFrame, key: str, text: str, phrases: DataFrame, phrase: str) -> DataFrame:
    """(key, phrase) for every lower-cased phrase contained anywhere in the lower-cased text; ``key`` is unique.

    A selective-gram join, alike for any number of phrases: texts meet a phrase only on the phrase's rarest gram, first as
    (key, gram) rows; then each text comes in once for all phrases that may lie in it, and ``contains`` decides. Null texts
    and null or empty phrases hit nothing.
    """
    low = docs.select(F.col(key).alias("_key"), F.lower(text).alias("_text"))
    distinct = phrases.select(F.lower(phrase).alias("phrase")).filter("phrase <> ''").distinct()
    keys = phrase_keys(low, "_text", distinct)
    lengths = sorted(r[0] for r in keys.select("n").distinct().collect())  # four at most
    if not lengths:
        return low.select(F.col("_key").alias(key), F.lit("").alias("phrase")).limit(0)
    keys, kind = keys.drop("n"), T.StructType([T.StructField("_key", low.schema["_key"].dataType), T.StructField("grams", T.ArrayType(T.LongType()))])
    met = low.mapInArrow(_gram_lists(lengths), kind).select("_key", F.explode("grams").alias("gram"))
    # The distinct grams are far fewer than the phrases: they thin the texts' grams out before the phrases come in.
    may = met.join(keys.select("gram").distinct(), "gram", "left_semi").join(keys, "gram").groupBy("_key").agg(F.collect_set("phrase").alias("_may"))
    found = low.join(may, "_key").select(F.col("_key").alias(key), F.explode(F.filter("_may", lambda p: F.contains(F.col("_text"), p))).alias("phrase"))
    return found


#: Tokens whose frequency all tasks know; the others count as equally rare.
KNOWN = 1 << 22
#: 2^FIELD bits tell tasks which nodes are still in question.
FIELD = 24
#: Bits of the sketch of a set.
BITS = 1024
#: What a task holds of the nodes that it looks at together: sketches, tokens of sets.
SKETCHES, TOKENS = 1 << 16, 1 << 21
#: Keys of a block when classes are expanded: two blocks make a million pairs.
KEYS = 1024


def expand(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """``pairs`` (l, r, ...) of classes as pairs of their members: ``left`` is (l, _k_l), ``right`` is (r, _k_r).

    Members travel in blocks of keys and are unfolded where two blocks have met, so pairs of members are never shuffled, and
    the blocks of a large class go to different tasks.
    """
    def blocks(side: DataFrame, name: str) -> DataFrame:
        sizes = side.groupBy(name).agg(F.ceil(F.count("*") / KEYS).alias("_of"))
        dealt = side.join(sizes, name).withColumn(f"_b_{name}", F.pmod(F.xxhash64(f"_k_{name}", F.lit(name)), F.col("_of")))
        return dealt.groupBy(name, f"_b_{name}").agg(F.collect_list(F.struct(f"_k_{name}")).alias(f"_ks_{name}"))  # a list leaves out plain nulls

    lb, rb = written(blocks(left, "l"), "left-blocks"), written(blocks(right, "r"), "right-blocks")
    meet = pairs.join(lb.select("l", "_b_l"), "l").join(rb.select("r", "_b_r"), "r").join(lb, ["l", "_b_l"])
    # As many tasks as partitions: few bytes make many pairs, so sizes do not tell the work.
    meet = meet.repartition(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "r", "_b_r").join(rb, ["r", "_b_r"])
    rest = [c for c in pairs.columns if c not in ("l", "r")]
    one = meet.select(F.explode("_ks_l").alias("_l"), "_ks_r", *rest)
    return one.select("_l", F.explode("_ks_r").alias("_r"), *rest).select(F.col("_l._k_l"), F.col("_r._k_r"), *rest)


def _token_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists of token numbers to (tok, sets), added up for a batch."""
    for batch in batches:
        tok, sets = np.unique(batch.column(0).flatten().to_numpy(zero_copy_only=False), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(tok), pa.array(sets.astype(np.int64))], names=["tok", "sets"])


def _known(counts: DataFrame) -> tuple[np.ndarray, np.ndarray, bool]:
    """The most frequent tokens (at most ``KNOWN``), ordered by number, their frequencies, and whether all others are in one set."""
    least, total = 2, 0
    for sets, n in sorted(((r["sets"], r["n"]) for r in counts.filter("sets > 1").groupBy("sets").agg(F.count("*").alias("n")).collect()), reverse=True):
        total += n
        if total > KNOWN:
            least = sets + 1
            break
    found = counts.filter(F.col("sets") >= least).toArrow()
    tok, sets = (found.column(c).to_numpy() for c in ("tok", "sets"))
    order = np.argsort(tok)
    return tok[order], sets[order], least == 2


def _prefixes(tok: np.ndarray, sets: np.ndarray, alone: bool, threshold: float):
    """(row, token numbers) to (row, n, p, tok): the rarest tokens of each set, one of which a similar set must hold.

    Tokens are ordered by what is known of their frequency, then by number; any order that all sets share would do. Where the
    others are ``alone`` in one set, they keep their places but meet nothing.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            size = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            often = np.zeros(len(flat), dtype=np.int64)
            if len(tok):
                at = np.minimum(np.searchsorted(tok, flat), len(tok) - 1)
                often = np.where(tok[at] == flat, sets[at], 0)
            row = np.repeat(np.arange(len(size)), size)
            order = np.lexsort((flat, often, row))
            p = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
            keep = p < np.repeat(size - np.ceil(size * threshold - 1e-9).astype(np.int64) + 1, size)
            keep = np.flatnonzero(keep & (often[order] > 0) if alone else keep)
            of = row[order[keep]]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of)), pa.array(size[of].astype(np.int32)), pa.array(p[keep].astype(np.int32)), pa.array(flat[order[keep]])], names=["node", "n", "p", "tok"])

    return run


def _sets(side: DataFrame, key: str, tokens: str, on: tuple[str, ...], left: bool, right: bool) -> DataFrame:
    rows = side.dropna(subset=[key, *on]).filter(F.size(tokens) > 0)
    same = F.to_json(F.array(*[F.col(c).cast("string") for c in on])) if on else F.lit("")
    return rows.select(F.col(key).alias("_k"), same.alias("_on"), F.array_sort(F.col(tokens)).alias("_set"), F.lit(left).alias("_left"), F.lit(right).alias("_right"))


def similar_sets(
    left: DataFrame, right: DataFrame, left_key: str, right_key: str, tokens: str, threshold: float, measure: str = "jaccard", on: tuple[str, ...] = (),
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(scored, left members, right members): pairs (l, r, score) of distinct sets that reach ``threshold``, and the rows (l, _k_l)
    and (r, _k_r) that hold each set.

    Equal sets are one node. A set of n tokens can only reach the threshold if one of its n - ceil(t*n) + 1 rarest tokens is
    among those of the other set. Nodes that meet on such a token (and on ``on``) are left out by their sizes and by the number
    of tokens that can still follow a shared one, then by bit sketches. What is left is compared exactly, token by token; sets
    come in once for many pairs (``_together``).
    Tokens meet as 64-bit numbers; a clash only costs a comparison.
    """
    alone = left is right and left_key == right_key
    rows = _sets(left, left_key, tokens, on, True, alone)
    if not alone:
        rows = rows.unionByName(_sets(right, right_key, tokens, on, False, True))
    # The rows are made once, where they are read; nothing of them is shuffled until nodes are known.
    sets = written(rows.withColumns({"_row": F.monotonically_increasing_id(), "_digest": F.unhex(F.sha2(F.to_json(F.struct("_on", "_set")), 256))}), "sets", "zstd")
    nodes = written(sets.groupBy("_digest").agg(F.min("_row").alias("node"), F.max("_left").alias("_left"), F.max("_right").alias("_right")), "nodes")
    rows = written(sets.select("_digest", "_k", "_left", "_right").join(nodes.select("_digest", "node"), "_digest").drop("_digest"), "members")
    members = [rows.filter(flag).select(F.col("node").alias(name), F.col("_k").alias(f"_k_{name}")) for name, flag in (("l", "_left"), ("r", "_right"))]

    numbers = sets.select("_row", F.transform("_set", lambda x: F.xxhash64(x, F.col("_on"))).alias("toks"))
    counts = written(numbers.select("toks").mapInArrow(_token_counts, "tok long, sets long").groupBy("tok").agg(F.sum("sets").alias("sets")), "tokens")
    first = numbers.mapInArrow(_prefixes(*_known(counts), threshold), "node long, n int, p int, tok long")
    first = written(first.join(nodes.select("node", "_left", "_right"), "node"), "prefixes")
    discard(counts)
    kept = lambda name: first if alone else first.filter("_left" if name == "l" else "_right")
    side = lambda name: kept(name).select("tok", F.col("node").alias(name), F.col("n").alias(f"n_{name}"), F.col("p").alias(f"p_{name}"))
    n_l, n_r = F.col("n_l"), F.col("n_r")
    met = side("l").join(side("r"), "tok").filter((n_r >= n_l * threshold - 1e-9) & (n_l >= n_r * threshold - 1e-9))
    # A pair of nodes that stand on both sides is compared once.
    met = met.filter("l < r" if alone else "l <> r")
    need = F.ceil((n_l + n_r) * threshold / (1 + threshold) - 1e-6) if measure == "jaccard" else F.ceil(F.greatest(n_l, n_r) * threshold - 1e-6)
    # The first token that a pair shares tells whether enough can follow; of pairs that may pass it is never left out.
    opened = written(met.filter(F.least(n_l - F.col("p_l"), n_r - F.col("p_r")) >= need).select("l", "r").distinct(), "open-pairs")
    discard(first)
    sketches = numbers.mapInArrow(_sketches, "node long, n int, bits binary").join(nodes.select("node"), "node")
    sketches = written(sketches, "sketches")
    near = _together(opened, sketches, _may_reach(threshold, measure), "l long, r long", sketches.select("node", F.lit(1).alias("weight")), SKETCHES, "near-pairs")
    discard(opened)
    # Only sets of these nodes leave the tasks that read them, packed.
    field = _bit_field(near.select(F.explode(F.array("l", "r")).alias("node")))
    whole = sets.select(F.col("_row").alias("node"), "_on", F.to_json("_set").alias("tokens")).mapInArrow(_packed(field), "node long, packed binary")
    scored = _together(near, whole, _scores(threshold, measure), "l long, r long, score double", sketches.select("node", F.col("n").alias("weight")), TOKENS, "scored")
    discard(near, sketches)
    if alone:
        scored = scored.unionByName(scored.select(F.col("r").alias("l"), F.col("l").alias("r"), "score"))
    same = nodes.filter("_left and _right").select(F.col("node").alias("l"), F.col("node").alias("r"), F.lit(1.0).alias("score"))
    return scored.unionByName(same), *members


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, token numbers) to (node, n, bits): which of ``BITS`` classes of tokens a set holds."""
    for whole in batches:
        for at in range(0, whole.num_rows, ROWS):
            batch = whole.slice(at, ROWS)
            size = pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False)
            held = np.zeros((len(size), BITS), dtype=bool)
            held[np.repeat(np.arange(len(size)), size), batch.column(1).flatten().to_numpy(zero_copy_only=False) & (BITS - 1)] = True
            bits = np.packbits(held, axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size.astype(np.int32)), pa.array([x.tobytes() for x in bits], pa.binary())], names=["node", "n", "bits"])


def _may_reach(threshold: float, measure: str):
    """Pairs and the sketches of their nodes to the pairs that may reach the threshold: a set cannot lack more of the other's
    classes than tokens may be missing."""
    def run(asked: pa.Table, given: pa.Table) -> pa.Table:
        node, n = given.column("node").to_numpy(), given.column("n").to_numpy().astype(np.int64)
        bits = np.frombuffer(b"".join(given.column("bits").to_pylist()), dtype=np.uint64).reshape(-1, BITS // 64)
        order = np.argsort(node)
        at = [order[np.searchsorted(node[order], asked.column(c).to_numpy())] for c in ("l", "r")]
        keep = []
        for k in range(0, asked.num_rows, 1 << 14):
            l, r = (x[k:k + (1 << 14)] for x in at)
            need = np.ceil((n[l] + n[r]) * threshold / (1 + threshold) - 1e-6) if measure == "jaccard" else np.ceil(np.maximum(n[l], n[r]) * threshold - 1e-6)
            lacks = lambda a, b: np.bitwise_count(bits[a] & ~bits[b]).sum(axis=1, dtype=np.int64)
            keep.append((lacks(l, r) <= n[l] - need) & (lacks(r, l) <= n[r] - need))
        return asked.select(["l", "r"]).filter(pa.array(np.concatenate([np.empty(0, bool), *keep])))

    return run


def _slots(nodes: np.ndarray) -> np.ndarray:
    return ((nodes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - FIELD)).astype(np.int64)


def _bit_field(nodes: DataFrame) -> np.ndarray:
    """Words of a field of 2^FIELD bits that tells which nodes may be among these; false alarms only cost."""
    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = np.unique(_slots(batch.column(0).to_numpy()))
            yield pa.RecordBatch.from_arrays([pa.array(slot >> 6), pa.array((np.uint64(1) << (slot & 63).astype(np.uint64)).view(np.int64))], names=["word", "mask"])

    found = nodes.mapInArrow(words, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    field = np.zeros(1 << (FIELD - 6), dtype=np.int64)
    field[found.column("word").to_numpy()] = found.column("mask").to_numpy()
    return field.view(np.uint64)


def _packed(field: np.ndarray):
    """(node, on, tokens) to (node, packed) of nodes that the field tells."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            slot = _slots(whole.column(0).to_numpy())
            batch = whole.filter(pa.array((field[slot >> 6] >> (slot & 63).astype(np.uint64)) & np.uint64(1) == 1))
            raw = [f"{o}\n{t}".encode("utf-8", "surrogatepass") for o, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([zlib.compress(x) for x in raw], pa.binary())], names=["node", "packed"])

    return run


def _scores(threshold: float, measure: str):
    """Pairs and the packed sets of their nodes to the pairs that reach the threshold, with their scores."""
    def run(asked: pa.Table, given: pa.Table) -> pa.Table:
        of, one = {}, {}  # a token that many sets hold is one string
        for node, packed in zip(given.column("node").to_pylist(), given.column("packed").to_pylist()):
            on, tokens = zlib.decompress(packed).decode("utf-8", "surrogatepass").split("\n", 1)
            of[node] = on, frozenset(one.setdefault(t, t) for t in json.loads(tokens))
        out = []
        for l, r in zip(asked.column("l").to_pylist(), asked.column("r").to_pylist()):
            (on_l, a), (on_r, b) = of[l], of[r]
            both = len(a & b) if on_l == on_r else 0
            score = both / (len(a) + len(b) - both if measure == "jaccard" else max(len(a), len(b)))
            if score >= threshold:
                out.append((l, r, score))
        return pa.table({c: pa.array([x[k] for x in out], kind) for k, (c, kind) in enumerate((("l", pa.int64()), ("r", pa.int64()), ("score", pa.float64())))})

    return run


def _together(pairs: DataFrame, given: DataFrame, look, schema: str, weights: DataFrame, held: int, name: str) -> DataFrame:
    """``look`` at ``pairs`` (l, r) with what is ``given`` (node, ...) of their nodes, some pairs at a time, written as ``name``.

    Nodes are dealt to cells of a grid by their smallest neighbours, a neighbourhood that weighs much in parts; a cell holds nodes
    of some ``held`` ``weights`` (node, weight). So a node travels once for each other part that it has neighbours in, at most
    once for each row of the grid, and not for each pair.
    """
    ends = pairs.select(F.col("l").alias("node"), F.col("r").alias("other")).unionByName(pairs.select(F.col("r").alias("node"), F.col("l").alias("other")))
    near = written(ends.groupBy("node").agg(F.least("node", F.min("other")).alias("near"), F.count("*").alias("ends")).join(weights, "node"), "near")
    whole, most = near.agg(F.coalesce(F.sum("weight"), F.lit(0)), F.coalesce(F.sum(F.col("weight") * F.col("ends")), F.lit(0))).first()
    rows = max(1, math.ceil(2 * whole / held))
    parts = near.join(near.groupBy("near").agg(F.ceil(F.sum("weight") * 8 / held).alias("of")), "near")
    parts = written(parts.select("node", F.pmod(F.xxhash64("near", F.pmod(F.xxhash64("node"), F.col("of"))), F.lit(rows)).cast("int").alias("part")), "parts")
    at = lambda side: parts.select(F.col("node").alias(side), F.col("part").alias(f"p_{side}"))
    # Cells with few pairs share a task.
    groups = max(1, min(rows * (rows + 1) // 2, math.ceil(most / held)))
    group = F.pmod(F.xxhash64(F.least("p_l", "p_r"), F.greatest("p_l", "p_r")), F.lit(groups)).cast("int")
    met = written(pairs.join(at("l"), "l").join(at("r"), "r").select("l", "r", group.alias("group")), "grouped-pairs")
    wanted = met.select("group", F.col("l").alias("node")).unionByName(met.select("group", F.col("r").alias("node"))).distinct()
    seen = written(met.select(F.col("group").alias("asked"), "l", "r").groupBy("asked").cogroup(wanted.join(given, "node").groupBy("group")).applyInArrow(look, schema), name)
    discard(near, parts, met)
    return seen


def similar_pairs(
    left: DataFrame, right: DataFrame, left_key: str, right_key: str, tokens: str, threshold: float, measure: str = "jaccard", on: tuple[str, ...] = (),
) -> DataFrame:
    """(l, r, score): keys of set pairs whose similarity reaches ``threshold``, found through shared rare tokens (``similar_sets``)."""
    pairs = expand(*similar_sets(left, right, left_key, right_key, tokens, threshold, measure, on))
    return pairs.select(F.col("_k_l").alias("l"), F.col("_k_r").alias("r"), "score")
