"""Fill-in-middle by block rotation: sentinels go into the text's own buffer, and segments change places inside it.

A text is held as UTF-8 bytes in one bytearray. The two cuts, given in code points, are found by a scan for first bytes;
the sentinels are inserted at their segments' starts; two neighbouring blocks then change places by three reversals (each of
them, then both together). The inverse turns the same blocks back and takes the sentinels out, byte for byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticketweave.llm.common import small_batches

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Of 100 texts, how many are rearranged, and of 100 of those, how many show the suffix first.
RATE, SPM_RATE = 90, 20


def rotate(buffer: bytearray, start: int, mid: int, stop: int) -> None:
    """Let the blocks [start, mid) and [mid, stop) change places, in place, by three reversals."""
    for a, b in ((start, mid), (mid, stop), (start, stop)):
        buffer[a:b] = buffer[a:b][::-1]


def byte_cuts(buffer: bytes | bytearray, cuts: list[int]) -> list[int]:
    """Where in ``buffer`` the given numbers of code points end; a scan over first bytes, none for pure ASCII."""
    if buffer.isascii():
        return cuts
    import numpy as np

    first = np.flatnonzero((np.frombuffer(buffer, dtype=np.uint8) & 0xC0) != 0x80)
    return [int(first[c]) if c < len(first) else len(buffer) for c in cuts]


def arrange(text: str, low: int, high: int, form: str) -> bytes:
    """``text`` cut after ``low`` and ``high`` code points, in the order of ``form``: plain, psm or spm."""
    buffer = bytearray(text.encode())
    if form == "plain":
        return bytes(buffer)
    at, to = byte_cuts(buffer, [low, high])
    for place, mark in ((to, SUFFIX), (at, MIDDLE), (0, PREFIX)):
        buffer[place:place] = mark
    middle, suffix = at + len(PREFIX), to + len(PREFIX) + len(MIDDLE)
    rotate(buffer, 0 if form == "spm" else middle, suffix, len(buffer))
    return bytes(buffer)


def restore(output: str, form: str) -> bytes:
    """The text that ``arrange`` was given, from its output and form alone."""
    buffer = bytearray(output.encode())
    if form == "plain":
        return bytes(buffer)
    middle, size = buffer.index(MIDDLE), len(buffer)
    if form == "spm":
        block = buffer.index(PREFIX)  # where the suffix ends
        rotate(buffer, 0, block, size)
        middle, suffix = middle - block, size - block
    else:
        block = buffer.index(SUFFIX)
        rotate(buffer, block, middle, size)
        middle, suffix = block, block + size - middle
    for place, mark in ((suffix, SUFFIX), (middle, MIDDLE), (0, PREFIX)):
        if buffer[place:place + len(mark)] != mark:
            raise ValueError("the output does not have the form it is said to have")
        del buffer[place:place + len(mark)]
    return bytes(buffer)


def transform(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n, form, prefix_chars, middle_chars, output.

    Cuts and form come from the first four 8-digit groups h1 to h4 of sha256("1:" + key): the prefix ends after the smaller of
    h1 % (n + 1) and h2 % (n + 1) code points, the middle after the larger. Plain are empty texts, texts that hold a sentinel,
    and those with h3 % 100 >= 90; of the others those with h4 % 100 < 20 are spm, the rest psm. Null and empty texts give an
    empty plain output; a null key hashes as "1:"; rows that repeat are done each, alike; an empty table gives none.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[key].dataType
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("doc_id"), whole.alias("text"), F.char_length(whole).cast("long").alias("n"), digest.alias("h"))
    h = [F.conv(F.substring("h", 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]
    marked = F.col("text").contains(PREFIX.decode()) | F.col("text").contains(SUFFIX.decode()) | F.col("text").contains(MIDDLE.decode())
    form = F.when((F.col("n") == 0) | marked | (h[2] % 100 >= RATE), "plain").when(h[3] % 100 < SPM_RATE, "spm").otherwise("psm")
    a, b = h[0] % (F.col("n") + 1), h[1] % (F.col("n") + 1)
    cut = rows.select("doc_id", "text", "n", form.alias("form"), F.least(a, b).alias("low"), F.greatest(a, b).alias("high"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = dict(zip(batch.schema.names, batch.columns))
            done = [arrange(*row).decode() for row in zip(*(col[c].to_pylist() for c in ("text", "low", "high", "form")))]
            yield pa.RecordBatch.from_arrays([*(col[c] for c in ("doc_id", "n", "form", "low", "high")), pa.array(done, pa.string())], names=["doc_id", "n", "form", "low", "high", "output"])

    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("n", T.LongType()), T.StructField("form", T.StringType()),
                           T.StructField("low", T.LongType()), T.StructField("high", T.LongType()), T.StructField("output", T.StringType())])
    done = cut.mapInArrow(run, schema)
    cut_up = F.col("form") != "plain"
    return done.select("doc_id", "n", "form", F.when(cut_up, F.col("low")).alias("prefix_chars"), F.when(cut_up, F.col("high") - F.col("low")).alias("middle_chars"), "output")


def restored(done: DataFrame) -> DataFrame:
    """``done`` (with columns output and form) and column ``restored``: the text rebuilt from these two alone."""
    names = done.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            outputs, forms = (batch.column(names.index(c)).to_pylist() for c in ("output", "form"))
            back = [restore(o, f).decode() for o, f in zip(outputs, forms)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(back, pa.string())], names=[*names, "restored"])

    return done.mapInArrow(run, T.StructType([*done.schema.fields, T.StructField("restored", T.StringType())]))
