"""Phrase collocations: suffixes of word runs, sent to tasks by their leading words and sorted there by multikey quicksort.

Every word starts a suffix of at most ``longest`` words. Words and word pairs are counted first; what is too rare ends a
suffix, so that only suffixes of three frequent words or more travel, each distinct one once per chunk of a map task with its
count. Of these, a task sends only suffixes whose words stand in triples that may be frequent: triples are summed beforehand
in a counting field, of which a task sends the slots it touched, a row for each part of the field. Suffixes go to a task by language and three leading words. There an array of suffix pointers is parted three ways at one
word position at a time (below, equal to, above a pivot): the part equal to the pivot goes on at the next position, its
weight is the count of the phrase read so far, and parts lighter than the least count are given up at once.

Words travel as 64-bit hashes under a seed for which no two words of the corpus collide. Bit fields of a fixed size tell tasks
which words, pairs and triples may be frequent; what passes them wrongly is dropped by the exact counts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticketweave.llm.common import settle, small_batches

#: Pieces end at these and at line feeds.
SEPARATORS = [".", ",", ";", ":", "!", "?", "\v", "\f", "\r"]
#: A bit field has 2 to this many bits (8 MB; 15 at least), whatever the corpus holds.
FIELD_BITS = 26
#: A counting field is sent and summed in parts of 2 to this many slots.
PART_BITS = 16
#: Text a task looks at together, and suffixes it gathers before it sends the distinct ones.
CHUNK_BYTES, GATHERED = 8 << 20, 1 << 20
NO_LANGUAGE = "und"
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _M1
    return (x ^ (x >> np.uint64(29))) * _M2


def _slot(x: np.ndarray, bits: int) -> np.ndarray:
    return (_mix(x) >> np.uint64(64 - bits)).astype(np.int64)


class BitField:
    """Whether slots are set in a packed field."""

    def __init__(self, packed: bytes):
        self.packed = np.frombuffer(packed, np.uint8)

    def __call__(self, slots: np.ndarray) -> np.ndarray:
        return (self.packed[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1 == 1


class Chunk:
    """Words of some texts in order: ``code`` (0 where a piece ends, else 1 + place in ``words``), ``owner`` (place in ``langs``)."""

    def __init__(self, texts: pa.Array, langs: pa.Array, seed: int, bits: int):
        import xxhash

        self.bits = bits
        flat = pc.binary_join_element_wise(pc.ascii_lower(texts), "\n", "")
        for mark in SEPARATORS:
            flat = pc.replace_substring(flat, mark, "\n")
        lists = pc.split_pattern(pc.replace_substring(pc.replace_substring(flat, "\n", " \n "), "\t", " "), " ")
        found, spoken = lists.flatten().dictionary_encode(), langs.dictionary_encode()
        owner = np.repeat(spoken.indices.to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy()))
        self.words, self.langs = found.dictionary, spoken.dictionary
        listed, place = self.words.to_pylist(), found.indices.to_numpy(zero_copy_only=False)
        number = np.array([0 if w == "\n" else -1 if w == "" else i for i, w in enumerate(listed, 1)], dtype=np.int64)
        used = number[place] >= 0
        self.code, self.owner = number[place[used]], owner[used].astype(np.int64)
        self.hash = np.array([0, *(xxhash.xxh64_intdigest(w, seed) for w in listed)], dtype=np.uint64)
        self.lang_hash = np.array([xxhash.xxh64_intdigest(s, seed) for s in self.langs.to_pylist()], dtype=np.uint64)

    def word_slots(self, owner: np.ndarray, code: np.ndarray) -> np.ndarray:
        return _slot(self.hash[code] + self.lang_hash[owner], self.bits)

    def pair_slots(self, owner: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return _slot(_mix(self.hash[a] + self.lang_hash[owner]) + self.hash[b], self.bits)

    def triple_slots(self, at: np.ndarray) -> np.ndarray:
        """Slots of the language and the three words from each place on."""
        pair = _mix(self.hash[self.code[at]] + self.lang_hash[self.owner[at]]) + self.hash[self.code[at + 1]]
        return _slot(_mix(pair) + self.hash[self.code[at + 2]], self.bits)

    def pairs(self, words: BitField) -> np.ndarray:
        """For each place, whether it and the next hold words that ``words`` lets pass."""
        passed = (self.code > 0) & words(self.word_slots(self.owner, self.code))
        return passed & np.append(passed[1:], False)

    def triples(self, words: BitField, pairs: BitField) -> np.ndarray:
        """For each place, whether the three words from it on stand in two pairs that ``pairs`` lets pass."""
        good = self.pairs(words)
        at = np.flatnonzero(good)
        good[at] = pairs(self.pair_slots(self.owner[at], self.code[at], self.code[at + 1]))
        return good & np.append(good[1:], False)


def _chunks(batches: Iterator[pa.RecordBatch], seed: int, bits: int) -> Iterator[Chunk]:
    texts, langs, held = [], [], 0
    for batch in batches:
        texts.append(batch.column(0))
        langs.append(batch.column(1))
        held += batch.column(0).nbytes
        if held >= CHUNK_BYTES:
            yield Chunk(pa.concat_arrays(texts), pa.concat_arrays(langs), seed, bits)
            texts, langs, held = [], [], 0
    if texts:
        yield Chunk(pa.concat_arrays(texts), pa.concat_arrays(langs), seed, bits)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _word_counts(seed: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in _chunks(batches, seed, bits):
            at = c.code > 0
            key, n = np.unique(c.owner[at] * len(c.hash) + c.code[at], return_counts=True)
            owner, code = key // len(c.hash), key % len(c.hash)
            yield pa.RecordBatch.from_arrays([c.langs.take(pa.array(owner)), c.words.take(pa.array(code - 1)), _signed(c.hash[code]), pa.array(c.word_slots(owner, code)), pa.array(n)], names=["lang", "word", "h", "slot", "n"])

    return run


def _pair_counts(seed: int, bits: int, words: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = BitField(words)
        for c in _chunks(batches, seed, bits):
            at = np.flatnonzero(c.pairs(field))
            size = len(c.hash)
            key, n = np.unique((c.owner[at] * size + c.code[at]) * size + c.code[at + 1], return_counts=True)
            owner, a, b = key // size // size, key // size % size, key % size
            yield pa.RecordBatch.from_arrays([c.langs.take(pa.array(owner)), _signed(c.hash[a]), _signed(c.hash[b]), pa.array(c.pair_slots(owner, a, b)), pa.array(n)], names=["lang", "w0", "w1", "slot", "n"])

    return run


def _triple_counts(seed: int, bits: int, words: bytes, pairs: bytes, least: int):
    """(part, places, counts): how often triples fall on slots, up to ``least``; a row holds the slots of a part that have any."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field, pair_field = BitField(words), BitField(pairs)
        slots, counts, held = [], [], 0

        def summed() -> pa.RecordBatch:
            slot, at = np.unique(np.concatenate(slots), return_inverse=True)
            n = np.minimum(np.bincount(at, weights=np.concatenate(counts)), least).astype("<u4")
            places = (slot & ((1 << PART_BITS) - 1)).astype("<u2")
            part, first = np.unique(slot >> PART_BITS, return_index=True)
            runs = list(zip(first, np.append(first[1:], len(slot))))
            return pa.RecordBatch.from_arrays([pa.array(part), *(pa.array([x[i:j].tobytes() for i, j in runs], pa.binary()) for x in (places, n))], names=["part", "places", "counts"])

        for c in _chunks(batches, seed, bits):
            slot, n = np.unique(c.triple_slots(np.flatnonzero(c.triples(field, pair_field))), return_counts=True)
            slots.append(slot)
            counts.append(n)
            held += len(slot)
            if held >= GATHERED:
                yield summed()
                slots, counts, held = [], [], 0
        if held:
            yield summed()

    return run


def _reached(least: int):
    """Slots that reach ``least``, from rows in order of their parts; one part is held at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums = None, np.zeros(1 << PART_BITS, dtype=np.int64)

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(sums >= least) + (now << PART_BITS))], names=["slot"])

        for batch in batches:
            for part, places, counts in zip(*(x.to_pylist() for x in batch.columns)):
                if part != now:
                    if now is not None:
                        yield told()
                    now = part
                    sums[:] = 0
                sums[np.frombuffer(places, "<u2")] += np.frombuffer(counts, "<u4")
        if now is not None:
            yield told()

    return run


def _suffixes(seed: int, bits: int, words: bytes, pairs: bytes, triples: bytes, longest: int):
    names = ["lang", *(f"w{i}" for i in range(longest))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field, pair_field, triple_field = BitField(words), BitField(pairs), BitField(triples)
        held, rows = [], 0

        def distinct() -> Iterator[pa.RecordBatch]:
            table = pa.concat_tables(held).group_by(names).aggregate([([], "count_all")])
            yield from table.select([*names, "count_all"]).rename_columns([*names, "n"]).combine_chunks().to_batches()

        for c in _chunks(batches, seed, bits):
            good = c.triples(field, pair_field)
            at = np.flatnonzero(good)
            good[at] = triple_field(c.triple_slots(at))
            starts = np.flatnonzero(good)
            alive, columns = np.ones(len(starts), dtype=bool), []
            for i in range(longest):
                if i > 2:  # the triple that ends at this word
                    alive = alive & good[np.minimum(starts + i - 2, len(good) - 1)]
                h = c.hash[c.code[np.minimum(starts + i, len(good) - 1)]].view(np.int64)
                columns.append(pa.array(h, mask=~alive))
            held.append(pa.table([c.langs.take(pa.array(c.owner[starts])), *columns], names=names))
            rows += len(starts)
            if rows >= GATHERED:
                yield from distinct()
                held, rows = [], 0
        if held:
            yield from distinct()

    return run


def multikey_quicksort(columns: list[np.ndarray], lengths: np.ndarray, weight: np.ndarray, least: int, emit: Callable[[int, int, int], None], shallow: int) -> None:
    """Sort suffix pointers three ways, position by position; ``emit(pointer, depth, count)`` for every prefix that weighs ``least`` or more.

    ``columns`` hold the key at each position, ``lengths`` how many positions a suffix has. Prefixes of ``shallow`` positions
    or fewer are walked through but not told.
    """
    parts = [(np.arange(len(weight)), 0)]
    while parts:
        at, depth = parts.pop()
        if not len(at) or weight[at].sum() < least:
            continue
        key = columns[depth][at]
        pivot = key[len(key) // 2]
        same = key == pivot
        if not same.all():
            parts.append((at[key < pivot], depth))
            parts.append((at[key > pivot], depth))
            at = at[same]
        total = int(weight[at].sum())
        if total < least:
            continue
        if depth + 1 > shallow:
            emit(int(at[0]), depth + 1, total)
        if depth + 1 < len(columns):
            parts.append((at[lengths[at] > depth + 1], depth + 1))


def _sorted_counts(least: int, longest: int, leading: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [b for b in batches if b.num_rows]
        if not rows:
            return
        table = pa.Table.from_batches(rows).combine_chunks()
        lang = table.column(0).combine_chunks().dictionary_encode()
        words = [table.column(1 + i) for i in range(longest)]
        columns = [lang.indices.to_numpy(zero_copy_only=False), *(pc.fill_null(w, 0).to_numpy() for w in words)]
        lengths = 1 + sum(w.is_valid().to_numpy().astype(np.int64) for w in words)
        found: list[tuple[int, int, int]] = []
        multikey_quicksort(columns, lengths, table.column("n").to_numpy(), least, lambda *x: found.append(x), leading)
        for i in range(0, len(found), 65536):
            part = found[i:i + 65536]
            lists = pa.array([[int(columns[d][p]) for d in range(1, depth)] for p, depth, _ in part], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([lang.dictionary.take(lang.indices.take(pa.array([p for p, _, _ in part]))), lists, pa.array([n for _, _, n in part], pa.int64())], names=["lang", "words", "f"])

    return run


def _field(slots: DataFrame, bits: int) -> bytes:
    """Bits of the slots in ``slots``, gathered as bitmaps of 4 KB: 2 to ``bits`` bits at most."""
    at = F.col("slot") + 1
    rows = slots.groupBy(F.expr("bitmap_bucket_number(slot + 1)").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")).collect()
    field = bytearray(1 << (bits - 3))
    for row in rows:
        field[(row["part"] - 1) * 4096:row["part"] * 4096] = row["bits"]
    return bytes(field)


def _exact_score(a: Column, n: Column, l: Column, r: Column) -> Column:
    """floor(1000 * a * n / (l * r)) over products of up to 38 digits."""
    wide = lambda c: c.cast("decimal(19,0)")
    return F.call_function("div", (F.lit(1000).cast("decimal(5,0)") * a.cast("decimal(14,0)")).cast("decimal(19,0)") * wide(n), wide(l) * wide(r)).cast("long")


def phrase_counts(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 100, longest: int = 5, field_bits: int = FIELD_BITS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(counts, totals, words): phrases of 1 to ``longest`` words found ``least`` times or more in a language (lang, words, f),
    words as hashes; all words of a language (lang, n); the frequent words themselves (h, word)."""
    spark = docs.sparkSession
    small_batches(spark)
    src = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce(F.col(lang).cast("string"), F.lit(NO_LANGUAGE)).alias("lang"))
    for seed in count():
        told = src.mapInArrow(_word_counts(seed, field_bits), "lang string, word string, h long, slot long, n long")
        words = settle(told.groupBy("lang", "word", "h", "slot").agg(F.sum("n").alias("n")), "words")
        if words.groupBy("h").agg(F.min("word").alias("lo"), F.max("word").alias("hi")).filter("lo < hi").isEmpty():
            break
    frequent = words.filter(F.col("n") >= least)
    word_field = _field(frequent, field_bits)
    told = src.mapInArrow(_pair_counts(seed, field_bits, word_field), "lang string, w0 long, w1 long, slot long, n long")
    pairs = settle(told.groupBy("lang", "w0", "w1", "slot").agg(F.sum("n").alias("n")).filter(F.col("n") >= least), "pairs")
    counts = frequent.select("lang", F.array("h").alias("words"), F.col("n").alias("f"))
    if longest >= 2:
        counts = counts.unionByName(pairs.select("lang", F.array("w0", "w1").alias("words"), F.col("n").alias("f")))
    if longest >= 3:
        kind = ", ".join(["lang string", *(f"w{i} long" for i in range(longest)), "n long"])
        pair_field = _field(pairs, field_bits)
        told = src.mapInArrow(_triple_counts(seed, field_bits, word_field, pair_field, least), "part long, places binary, counts binary")
        triple_field = _field(told.repartition("part").sortWithinPartitions("part").mapInArrow(_reached(least), "slot long"), field_bits)
        routed = src.mapInArrow(_suffixes(seed, field_bits, word_field, pair_field, triple_field, longest), kind).repartition("lang", "w0", "w1", "w2")
        counts = counts.unionByName(routed.mapInArrow(_sorted_counts(least, longest, 3), "lang string, words array<long>, f long"))
    return settle(counts, "counts"), words.groupBy("lang").agg(F.sum("n").alias("n")), frequent.select("h", "word").distinct()


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 100, longest: int = 5, absorb: int = 100, top: int = 2000, field_bits: int = FIELD_BITS) -> DataFrame:
    """The first ``top`` phrases of every language by score: lang, rank, phrase, a, l, r, n, score.

    Texts are lower-cased (A-Z), split into pieces at ``. , ; : ! ?`` and line ends, and those into words at blanks and tabs. A
    phrase of 2 to ``longest`` words found a >= ``least`` times is a candidate; each cut into two parts found l and r times
    scores floor(1000 * a * n / (l * r)), n being all words of the language, and the lowest cut counts, the first among
    equals. Candidates whose words lie in a longer one that is found at least ``absorb`` percent as often are dropped. Ties go
    by a, then by the phrase's bytes. A null text has no words; a null language is ``und`` and is one with that name; repeated
    rows count each; an empty table or one without candidates gives no rows. Other columns are not looked at.
    """
    counts, totals, words = phrase_counts(docs, text, lang, least, longest, field_bits)
    candidates = counts.filter(F.size("words") >= 2).withColumnRenamed("f", "a")
    part = lambda name, to: counts.select(F.col("lang"), F.col("words").alias(name), F.col("f").alias(to))
    cuts = candidates.select("lang", "words", "a", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cuts = cuts.withColumns({"first": F.slice("words", F.lit(1), F.col("k")), "rest": F.slice("words", F.col("k") + 1, F.size("words") - F.col("k"))})
    scored = cuts.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"]).join(totals, "lang")
    scored = scored.withColumn("score", _exact_score(F.col("a"), F.col("n"), F.col("l"), F.col("r")))
    lowest = scored.groupBy("lang", "words", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("low"))
    # Every run of words inside a candidate, with the best count of a longer phrase that holds it.
    spans = candidates.filter(F.size("words") > 2).select("lang", "words", "a", F.explode(F.sequence(F.lit(2), F.size("words") - 1)).alias("m"))
    inside = spans.select("lang", "a", "words", "m", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("m") + 1)).alias("at")).select("lang", F.slice("words", F.col("at"), F.col("m")).alias("words"), "a")
    around = inside.groupBy("lang", "words").agg(F.max("a").alias("longer"))
    kept = lowest.join(around, ["lang", "words"], "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < absorb * F.col("a")))
    spelled = kept.select("lang", "words", F.posexplode("words").alias("at", "h")).join(words, "h").groupBy("lang", "words").agg(F.sort_array(F.collect_list(F.struct("at", "word"))).alias("spelled"))
    named = kept.join(spelled, ["lang", "words"]).select("lang", F.array_join(F.col("spelled.word"), " ").alias("phrase"), "a", F.col("low.l").alias("l"), F.col("low.r").alias("r"), "n", F.col("low.score").alias("score"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = named.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
