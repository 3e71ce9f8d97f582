"""Quality rules and an n-gram perplexity band per language.

The language model reads code points as they stand: letters of any script, with case, digits and marks are told apart, and
n-grams of four of them are counted in all documents without a bound. Tasks count their chunk of the documents, Spark sums
the counts by language and n-gram and makes the modified Kneser-Ney estimates by joins and windows on n-grams. The estimates
of a chunk's own n-grams then come to the chunk, wherever they are held, so a model of any size is nowhere in one place. The
texts stay where the first pass has put them, in buckets by chunk.
Documents whose perplexity leaves their language's band on either side are rejected. Those that fail the base rules are
rejected anyway: the model does not learn from them, and their texts go no further than the first pass, which writes the
others down packed, with the counts.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticketweave.llm.common import settle, settle_in_buckets, small_batches

#: Code points of an n-gram, and the bits of one (0 is the start of a text): the last three fill a long, those before stand in another.
WIDE, POINT_BITS = 4, 21
#: Counts that a task holds before it sends them on.
SENT = 4_000_000
#: Bytes of texts that are packed into one row (a longer text is a row of its own).
PACKED = 4 << 20
#: Bytes of texts after which a task starts another chunk, and the bits of a chunk's number within its task.
CHUNK, CHUNK_BITS = 256 << 20, 24
#: Compression level of packed texts.
LEVEL = 6
RULES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: N-grams that a language needs for a model and band of its own, however many languages there are: about five pages of text.
#: Those with fewer share one with null.
LEAST = 10_000
OTHER = "\0other"
#: Half width of a band in robust deviations, and what is added for short texts (over the root of the n-grams).
WIDTH, SHORT = 5.0, 2.0
BINS = 1000


def wide_grams(texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """All n-grams of ``WIDE`` code points of the texts, each led in by start symbols: all but the last three, and those."""
    lead = np.zeros(WIDE - 1, dtype=np.uint64)
    parts = [x for t in texts for x in (lead, np.frombuffer((t or "").encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64) + np.uint64(1))]
    s = np.concatenate(parts) if parts else lead
    ends = np.flatnonzero(s[WIDE - 1:])  # a window that ends in a start symbol reaches from one text into the next

    def pack(first: int, last: int) -> np.ndarray:
        code = np.zeros(len(s) - WIDE + 1, dtype=np.uint64)
        for k in range(first, last):
            code = (code << np.uint64(POINT_BITS)) | s[k: len(s) - WIDE + 1 + k]
        return code[ends]

    return pack(0, WIDE - 3), pack(WIDE - 3, WIDE)


def hashed(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    return (high * np.uint64(0x9E3779B97F4A7C15)) ^ (low * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(1)) ^ low


def _summed(high: np.ndarray, low: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    h = hashed(high, low)
    at = np.argsort(h)
    first = np.flatnonzero(np.concatenate([[True], h[at][1:] != h[at][:-1]])) if len(h) else np.zeros(0, dtype=np.int64)
    return high[at][first], low[at][first], np.add.reduceat(n[at], first) if len(h) else n


def _pack(docs: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, docs.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", LEVEL))) as out:
        out.write_batch(docs)
    return sink.getvalue().to_pybytes()


def _slices(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """(first, length) of runs of rows of at most ``most`` bytes, or of one row."""
    first, held = 0, 0
    for i, size in enumerate(sizes):
        if i > first and held + size > most:
            yield first, i - first
            first, held = i, 0
        held += size
    if len(sizes) > first:
        yield first, len(sizes) - first


def _sent(chunk: int, rows: int, **columns: pa.Array) -> pa.RecordBatch:
    kinds = {"lang": pa.string(), "high": pa.int64(), "low": pa.int64(), "n": pa.int64(), "docs": pa.binary()}
    values = [columns.get(name, pa.nulls(rows, kind)) for name, kind in kinds.items()]
    return pa.RecordBatch.from_arrays([pa.array([chunk] * rows, pa.int64()), *values], names=["chunk", *kinds])


def _first_pass(least_words: int, repeat_percent: int, packed: int, most: int):
    """(task, doc_id, lang, text) to rows of counts (chunk, lang, high, low, n) and rows of packed documents (chunk, docs).

    Counts of a task are added up, and sent on whenever they get many.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, str], list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}

        def sent(least: int) -> Iterator[pa.RecordBatch]:
            for (chunk, lang), parts in list(held.items()):
                high, low, n = _summed(*[np.concatenate(x) for x in zip(*parts)])
                held[chunk, lang] = [(high, low, n)]
                if len(n) < least:
                    continue
                del held[chunk, lang]
                at = np.lexsort((low, high))
                for i in range(0, len(at), 100_000):
                    k = at[i:i + 100_000]
                    yield _sent(chunk, len(k), lang=pa.array([lang] * len(k), pa.string()), **{name: pa.array(x[k].astype(np.int64)) for name, x in (("high", high), ("low", low), ("n", n))})

        waiting, part, size = 0, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            col = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            chunk, langs, texts = (col["task"][0].as_py() << CHUNK_BITS) + part, col["lang"].to_pylist(), col["text"].to_pylist()
            rules = [word_rules(t) for t in texts]
            failed = [r[0] < least_words or 100 * r[4] > repeat_percent * r[0] for r in rules]
            by: dict[str, list[str | None]] = {}
            for lang, text, bad in zip(langs, texts, failed):
                if not bad:
                    by.setdefault(lang, []).append(text)
            for lang, passed in by.items():
                high, low = wide_grams(passed)
                if len(high):
                    held.setdefault((chunk, lang), []).append(_summed(high, low, np.ones(len(high), dtype=np.int64)))
                    waiting += len(held[chunk, lang][-1][0])
            kept = pa.array([None if bad else t for t, bad in zip(texts, failed)], pa.string())
            docs = pa.RecordBatch.from_arrays([col["doc_id"], col["lang"], kept, pa.array(failed, pa.bool_()), *[pa.array(v, pa.int64()) for v in zip(*rules)]],
                                              names=["doc_id", "lang", "text", "base_failed", *RULES])
            sizes = [0 if bad else 4 * len(t or "") for t, bad in zip(texts, failed)]
            packs = [_pack(docs.slice(*at)) for at in _slices(sizes, packed)]
            yield _sent(chunk, len(packs), docs=pa.array(packs, pa.binary()))
            size += sum(sizes)
            if size > most:
                yield from sent(1)
                waiting, part, size = 0, part + 1, 0
            if waiting > SENT:
                yield from sent(SENT // 4)
                waiting = sum(len(parts[0][0]) for parts in held.values())
                if waiting > SENT // 2:  # many languages of few n-grams each
                    yield from sent(1)
                    waiting = 0
        yield from sent(1)

    return run


def _low_bits(points: int) -> int:
    return (1 << (POINT_BITS * points)) - 1


def _context(order: int) -> list[Column]:
    """The gram of ``order`` without its last code point."""
    low = F.shiftright("low", POINT_BITS).bitwiseOR(F.shiftleft(F.col("high").bitwiseAND(F.lit(_low_bits(1))), 2 * POINT_BITS)) if order > 3 else F.shiftright("low", POINT_BITS)
    return [F.col("model"), F.shiftright("high", POINT_BITS), low]


def _suffix(order: int) -> list[Column]:
    """The last ``order`` code points of a gram."""
    high = F.col("high").bitwiseAND(F.lit(_low_bits(order - 3))) if order > 3 else F.lit(0).cast("long")
    return [F.col("model"), high.alias("high"), F.col("low").bitwiseAND(F.lit(_low_bits(min(order, 3)))).alias("low")]


def _discount_row() -> Column:
    """Modified Kneser-Ney discounts for counts 1, 2 and 3 or more, from the counts of counts of a group of counts ``c``."""
    n1, n2, n3, n4 = (F.count_if(F.col("c") == k).cast("double") for k in (1, 2, 3, 4))
    y = F.coalesce(F.try_divide(n1, n1 + 2 * n2), F.lit(0.5))
    d = [F.coalesce(1 - F.try_divide(2 * y * n2, n1), F.lit(0.5)), F.coalesce(2 - F.try_divide(3 * y * n3, n2), F.lit(1.0)), F.coalesce(3 - F.try_divide(4 * y * n4, n3), F.lit(1.5))]
    return F.array(*[F.least(F.greatest(x, F.lit(0.05)), F.lit(k - 0.05)) for k, x in enumerate(d, 1)])


def log_probabilities(counted: DataFrame) -> DataFrame:
    """(model, high, low, log_p) from (model, high, low, n): interpolated modified Kneser-Ney by joins and windows on the n-grams.

    Lower orders count in how many left contexts a gram stands.

    No model is gathered anywhere: an n-gram meets the others of its context, then the lower order's estimate of its suffix.
    """
    levels = {WIDE: settle(counted.select("model", "high", "low", F.col("n").alias("c")), "grams")}
    for order in range(WIDE - 1, 0, -1):
        levels[order] = settle(levels[order + 1].groupBy(*_suffix(order)).agg(F.count(F.lit(1)).alias("c")), "grams")
    below = None
    for order in range(1, WIDE + 1):
        grams_ = levels[order].join(settle(levels[order].groupBy("model").agg(_discount_row().alias("d")), "discounts"), "model")
        context = Window.partitionBy(*_context(order))
        rows = grams_.withColumn("taken", F.element_at("d", F.least("c", F.lit(3)).cast("int"))).select(
            "model", "high", "low", "c", "taken", F.sum("c").over(context).alias("total"), F.sum("taken").over(context).alias("left"), F.count(F.lit(1)).over(context).alias("kinds"))
        if below is None:
            rows = rows.withColumn("lower", 1 / (F.col("kinds") + 1))
        else:
            shorter = below.select("model", F.col("high").alias("s_high"), F.col("low").alias("s_low"), F.col("p").alias("lower"))
            rows = rows.select("*", *[c.alias(f"s_{n}") for n, c in zip(("high", "low"), _suffix(order - 1)[1:])]).join(shorter, ["model", "s_high", "s_low"])
        below = rows.select("model", "high", "low", ((F.col("c") - F.col("taken") + F.col("left") * F.col("lower")) / F.col("total")).alias("p"))
    return below.select("model", "high", "low", F.log("p").cast("float").alias("log_p"))


def _models(requests: DataFrame) -> DataFrame:
    """(lang, model): every language has its own, but those of fewer than ``LEAST`` n-grams share the common one with null."""
    totals = requests.groupBy("lang").agg(F.sum("n").alias("n"))
    return settle(totals.select("lang", F.when(F.col("n") >= LEAST, F.col("lang")).otherwise(OTHER).alias("model")), "models")


def word_rules(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one text."""
    text = text or ""
    raw = text.encode()
    words = raw.split()
    n = len(words)
    blanks = sum(map(raw.count, (b" ", b"\t", b"\n", b"\r", b"\x0b", b"\x0c")))
    marks = sum(map(raw.count, (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">")))
    lines = [x for x in raw.split(b"\n") if x.split()] if n else []
    repeated = 0
    if n > 8:
        h = np.fromiter(map(hash, words), dtype=np.int64, count=n).astype(np.uint64)
        window = np.zeros(n - 7, dtype=np.uint64)
        for k in range(8):
            window = window * np.uint64(0x9E3779B97F4A7C15) + (h[k:n - 7 + k] ^ (h[k:n - 7 + k] >> np.uint64(29)))
        ordered = np.sort(window)
        twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        if len(twice):
            at = np.flatnonzero(np.isin(window, twice))
            cover = np.zeros(n + 1, dtype=np.int64)
            np.add.at(cover, at, 1)
            np.add.at(cover, at + 8, -1)
            repeated = int((np.cumsum(cover)[:n] > 0).sum())
    return n, len(text) - blanks, marks, len(lines) - len(set(lines)), repeated


def _score(packed: pa.Table, found: pa.Table) -> pa.Table:
    """The documents of a chunk, measured by the chunk's own n-grams: these are held by language as sorted arrays of hashes."""
    parts, tables, scored = {}, {}, []
    for lang, grams in zip(found.column("lang").to_pylist(), found.column("found")):
        parts.setdefault(lang, []).append([grams.values.field(k).to_numpy(zero_copy_only=False) for k in range(3)])

    def log_perplexity(lang: str, text: str | None) -> tuple[float | None, int]:
        high, low = wide_grams([text])
        if not len(high):
            return None, 0
        if lang not in tables:
            wide, narrow, logs = (np.concatenate(x) for x in zip(*parts.pop(lang)))
            keys = hashed(wide.astype(np.uint64), narrow.astype(np.uint64))
            order = np.argsort(keys)
            tables[lang] = keys[order], logs[order]
        keys, logs = tables[lang]
        return float(-logs[np.searchsorted(keys, hashed(high, low))].mean(dtype=np.float64)), len(high)

    for pack in packed.column("docs"):
        docs = pa.ipc.open_stream(pack.as_buffer()).read_next_batch()
        got = [(None, 0) if bad else log_perplexity(lang, text) for lang, text, bad in zip(*(docs.column(n).to_pylist() for n in ("lang", "text", "base_failed")))]
        scored.append(pa.RecordBatch.from_arrays([*[docs.column(n) for n in ("doc_id", "lang", *RULES, "base_failed")], pa.array([p for p, _ in got], pa.float64()), pa.array([n for _, n in got], pa.int64())],
                                                 names=["doc_id", "lang", *RULES, "base_failed", "log_perplexity", "n_grams"]))
    return pa.Table.from_batches(scored)


def measure(passed: DataFrame, models: DataFrame, key_type: str) -> DataFrame:
    """doc_id, lang, the word rules, base_failed, log_perplexity (null for a failed or empty text) and n_grams of each document.

    What a chunk of documents needs of its models are the n-grams counted in it; they come to it by a join on n-grams. The
    packed documents are read in the buckets of chunks that they lie in.
    """
    of = passed.filter("n is not null").select("chunk", "lang", "high", "low", "n").join(models, "lang")
    logs = log_probabilities(of.groupBy("model", "high", "low").agg(F.sum("n").alias("n")))
    found = of.join(logs, ["model", "high", "low"]).groupBy("chunk", "lang", F.pmod("low", F.lit(8)).alias("part")).agg(F.collect_list(F.struct("high", "low", "log_p")).alias("found"))
    docs = passed.filter("docs is not null").select("chunk", "docs")
    rules = ", ".join(f"{n} long" for n in RULES)
    return docs.groupBy("chunk").cogroup(found.select(F.col("chunk").alias("of"), "lang", "found").groupBy("of")).applyInArrow(
        _score, f"doc_id {key_type}, lang string, {rules}, base_failed boolean, log_perplexity double, n_grams long")


def quality_rules(
    docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", width: float = WIDTH, short: float = SHORT, least_words: int = 20, repeat_percent: int = 30,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, the word rules, base_failed, kept, log_perplexity, band_low, band_high.

    ``base_failed``: fewer than ``least_words`` words, or more than ``repeat_percent`` percent in repeated windows. ``kept``:
    not that, and the log perplexity within its language's band, which is the median plus or minus ``width`` median
    deviations, wider for short texts. Null and empty texts have no words and fail. Documents that fail have no perplexity,
    and no model learns from them. Rows that repeat count each.
    """
    spark = docs.sparkSession
    small_batches(spark)
    src = docs.select(F.spark_partition_id().cast("long").alias("task"), F.col(key).alias("doc_id"), F.coalesce(F.col(lang).cast("string"), F.lit(OTHER)).alias("lang"), F.col(text).alias("text"))
    first = src.mapInArrow(_first_pass(least_words, repeat_percent, PACKED, CHUNK), "chunk long, lang string, high long, low long, n long, docs binary")
    passed, held = settle_in_buckets(first, "first-pass", "chunk", int(spark.conf.get("spark.sql.shuffle.partitions")))
    try:
        models = _models(passed.filter("n is not null"))
        rows = settle(measure(passed, models, src.schema["doc_id"].dataType.simpleString()), "quality").join(models, "lang", "left")
    finally:
        spark.sql(f"DROP TABLE {held}")
    # Medians over a histogram of rounded values: its size depends on the bins alone.
    sound = rows.filter(~F.col("base_failed")).groupBy("model", F.round(F.col("log_perplexity") * BINS).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    middle = sound.groupBy("model").agg((F.expr("percentile(bin, 0.5D, n)") / BINS).alias("middle"))
    off = sound.join(middle, "model").withColumn("off", F.abs(F.col("bin") / BINS - F.col("middle")))
    bands = off.groupBy("model", "middle").agg(F.greatest(F.expr("percentile(off, 0.5D, n)"), F.lit(0.01)).alias("spread"))
    bands = settle(bands, "bands")
    half = width * F.col("spread") + short / F.sqrt(F.greatest(F.col("n_grams"), F.lit(1)))
    banded = rows.join(bands, "model", "left").withColumn("band_low", F.col("middle") - half).withColumn("band_high", F.col("middle") + half)
    inside = F.coalesce(F.col("log_perplexity").between(F.col("band_low"), F.col("band_high")), F.lit(False))
    return banded.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & inside).alias("kept"),
                         "log_perplexity", "band_low", "band_high")
