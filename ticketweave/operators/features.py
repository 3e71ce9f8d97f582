"""Text features as relations: terms, their counts, and unit-length tf-idf weights."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ticketweave.functions.text import fold_accents
from ticketweave.lineage import written
from ticketweave.operators.ordered import first_k

_C, _L = F.col, F.lit
#: Words of two or more letters, digits, underscores or hyphens.
WORD = r"[\p{L}\p{N}_-]{2,}"


def word_list(text: Column) -> Column:
    return F.regexp_extract_all(fold_accents(text), _L(WORD), _L(0))


def word_terms(text: Column) -> Column:
    """Words, folded to plain lower case, and pairs of neighbouring words."""
    words = word_list(text)
    pairs = lambda w: F.zip_with(F.slice(w, 1, F.greatest(F.size(w) - 1, _L(0))), F.slice(w, 2, F.greatest(F.size(w) - 1, _L(0))), lambda a, b: F.concat(a, _L(" "), b))
    return F.flatten(F.transform(F.array(words), lambda w: F.concat(w, pairs(w))))


def char_terms(text: Column, lo: int = 3, hi: int = 5) -> Column:
    """Runs of ``lo`` to ``hi`` characters inside each word with a blank on both sides; a word too short for ``lo`` is one term."""
    def runs(word: Column) -> Column:
        sizes = F.sequence(_L(lo), F.greatest(_L(lo), F.least(_L(hi), F.length(word))))
        return F.flatten(F.transform(sizes, lambda n: F.transform(F.sequence(_L(1), F.greatest(F.length(word) - n + 1, _L(1))), lambda i: F.substring(word, i, n))))

    words = F.regexp_extract_all(F.lower(text), _L(r"\S+"), _L(0))
    return F.flatten(F.transform(words, lambda w: runs(F.concat(_L(" "), w, _L(" ")))))


def char_runs(word: str, lo: int = 3, hi: int = 5) -> list[str]:
    """The terms of :func:`char_terms` of one word that is lower-case already."""
    padded = f" {word} "
    if len(padded) < lo:
        return [padded]
    return [padded[i:i + n] for n in range(lo, min(hi, len(padded)) + 1) for i in range(len(padded) - n + 1)]


def _flat(column: pa.Array, pairs: bool) -> tuple[pa.Array, np.ndarray]:
    """The units of a batch end to end and the row of each: the words of texts between white space, or lists of words, with
    pairs of neighbours if ``pairs``."""
    if not pa.types.is_list(column.type):
        lists = [t.encode().split() if t else [] for t in column.to_pylist()]
        row = np.repeat(np.arange(len(lists)), np.fromiter(map(len, lists), "int64", len(lists)))
        return pa.array([w for one in lists for w in one], pa.binary()).cast(pa.string()), row
    sizes = pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False)
    words, row = pc.list_flatten(column), np.repeat(np.arange(len(column)), sizes)
    if not pairs or len(words) < 2:
        return words, row
    next_too = row[1:] == row[:-1]
    both = pc.binary_join_element_wise(words[:-1], words[1:], " ").filter(pa.array(next_too))
    return pa.concat_arrays([words, both]), np.concatenate([row, row[:-1][next_too]])


def _unit_totals(pairs: bool, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coded = _flat(batch.column(0), pairs)[0].dictionary_encode()
            n = np.bincount(coded.indices.to_numpy(zero_copy_only=False), minlength=len(coded.dictionary))
            yield pa.RecordBatch.from_arrays([coded.dictionary, pa.array(n, pa.int64())], schema=schema)

    return run


def _term_totals(expand: Callable[[str], list[str]], schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [expand(u) for u in batch.column(0).to_pylist()]
            n = np.repeat(batch.column(1).to_numpy(), np.fromiter(map(len, lists), "int64", len(lists)))
            coded = pa.array([x for one in lists for x in one], pa.string()).dictionary_encode()
            totals = np.bincount(coded.indices.to_numpy(zero_copy_only=False), weights=n, minlength=len(coded.dictionary))
            yield pa.RecordBatch.from_arrays([coded.dictionary, pa.array(totals.astype("int64"))], schema=schema)

    return run


#: Units whose vocabulary places a task remembers.
_REMEMBERED = 1 << 19


def _counted(vocabulary: list[str], expand: Callable[[str], list[str]] | None, pairs: bool, schema: pa.Schema):
    """(key, ids, tfs) of rows (key, units) sorted by key: places in the vocabulary and counts, one row for each key.

    A key's counts are kept from row to row and batch to batch, so a key holds no more than the vocabulary, however often it comes.
    """
    width = len(vocabulary)
    step = max(1, (1 << 21) // max(width, 1))  # rows of a dense table of counts

    def out(keys: list, table: np.ndarray) -> pa.RecordBatch:
        rows, ids = np.nonzero(table)
        offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=len(keys)))]).astype("int32"))
        lists = lambda values: pa.ListArray.from_arrays(offsets, pa.array(values))
        return pa.RecordBatch.from_arrays([pa.array(keys, schema.field(0).type), lists(ids.astype("int32")), lists(table[rows, ids].astype("int64"))], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, place, seen = pa.array(vocabulary, pa.string()), {t: i for i, t in enumerate(vocabulary)}, {}

        def places(units: pa.Array) -> tuple[np.ndarray, np.ndarray]:
            """Vocabulary places of the terms of distinct units, end to end, and how many each unit has."""
            if expand is None:
                at = pc.index_in(units, value_set=known).fill_null(-1).to_numpy(zero_copy_only=False)
                return at[at >= 0], (at >= 0).astype("int64")
            if len(seen) > _REMEMBERED:
                seen.clear()
            lists = []
            for u in units.to_pylist():
                ids = seen.get(u)
                if ids is None:
                    ids = seen[u] = [place[x] for x in expand(u) if x in place]
                lists.append(ids)
            return np.fromiter(chain.from_iterable(lists), "int64"), np.fromiter(map(len, lists), "int64", len(lists))

        open_key, open_row = None, None
        for batch in batches:
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                keys = part.column(0).to_pylist()
                units, row = _flat(part.column(1), pairs)
                coded = units.dictionary_encode()
                at, sizes = places(coded.dictionary)
                begins = np.cumsum(sizes) - sizes
                unit = coded.indices.to_numpy(zero_copy_only=False)
                n = sizes[unit]
                source = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - begins[unit], n)
                group = np.cumsum([i > 0 and k != keys[i - 1] for i, k in enumerate(keys)])
                table = np.bincount(np.repeat(group[row] * width, n) + at[source], minlength=(group[-1] + 1) * width).reshape(-1, width)
                firsts = [keys[i] for i in np.flatnonzero(np.diff(group, prepend=-1))]
                if open_row is not None and open_key == firsts[0]:
                    table[0] += open_row
                elif open_row is not None:
                    yield out([open_key], open_row[None])
                open_key, open_row = firsts[-1], table[-1].copy()
                if len(firsts) > 1:
                    yield out(firsts[:-1], table[:-1])
        if open_row is not None:
            yield out([open_key], open_row[None])

    return run


def _weighed(terms: list[str], df: np.ndarray, idf: np.ndarray, sublinear: bool, schema: pa.Schema):
    """(key, term, tf, df, weight) of rows (key, ids, tfs); terms whose idf is nan are none."""
    names = pa.array(terms, pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(sizes)), sizes)
            ids, tf = (pc.list_flatten(batch.column(i)).to_numpy(zero_copy_only=False) for i in (1, 2))
            kept = ~np.isnan(idf[ids])
            row, ids, tf = row[kept], ids[kept], tf[kept]
            w = (1 + np.log(tf) if sublinear else tf.astype("float64")) * idf[ids]
            norm = np.sqrt(np.bincount(row, weights=w * w, minlength=len(sizes)))
            for a in range(0, len(row), 1 << 16):
                cut = slice(a, a + (1 << 16))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row[cut])), names.take(pa.array(ids[cut])), pa.array(tf[cut]), pa.array(df[ids[cut]]), pa.array(w[cut] / norm[row[cut]])], schema=schema)

    return run


def term_weights(df: DataFrame, key: str, text: str, terms: Callable[[Column], Column] = word_terms, max_features: int = 5000, min_df: int = 2, sublinear: bool = True) -> DataFrame:
    """(key, term, tf, df, weight): tf-idf weights that have length 1 for each document.

    tf is 1 + ln(count) if ``sublinear``, idf is ln((1 + documents) / (1 + df)) + 1. The vocabulary holds the ``max_features``
    terms seen most often (ties by term) among those in at least ``min_df`` documents, so its size is bounded and it goes to
    every task. ``key`` names a document; rows that repeat one count as one longer text. Null and empty texts have no terms but
    count as documents, null keys are one document, and an empty table gives none.

    ``terms`` gives a text's terms. Those of :func:`word_terms` and :func:`char_terms` are made in the tasks from words, the
    latter once for a word and not wherever it stands; no row is made for a term that is not among the most frequent.
    """
    units, pairs, expand = {word_terms: (word_list, True, None), char_terms: (F.lower, False, char_runs)}.get(terms, (terms, False, None))
    pieces = units(_C(text))
    counts = T.StructType([T.StructField("term", T.StringType()), T.StructField("_n", T.LongType())])
    totals = df.select(pieces.alias("_units")).mapInArrow(_unit_totals(pairs, to_arrow_schema(counts)), counts).groupBy("term").agg(F.sum("_n").alias("_n"))
    if expand is not None:
        totals = totals.mapInArrow(_term_totals(expand, to_arrow_schema(counts)), counts).groupBy("term").agg(F.sum("_n").alias("_n"))
    totals = written(totals.select("term", _C("_n").alias("_total")).filter(_C("_total") >= min_df), "totals")  # a document holds a term at least once
    documents, known_terms = df.select(key).distinct().count(), totals.count()
    by_key = df.select(_C(key).alias("_key"), pieces.alias("_units")).repartition("_key").sortWithinPartitions("_key")
    lists = T.StructType([T.StructField("_key", df.schema[key].dataType), T.StructField("_ids", T.ArrayType(T.IntegerType())), T.StructField("_tfs", T.ArrayType(T.LongType()))])
    asked = max_features + max_features // 10 + 1
    while True:  # terms too rare for min_df are few among the most frequent ones; where not, more are asked for
        vocabulary = [r[0] for r in totals.orderBy(F.desc("_total"), F.asc("term")).limit(asked).select("term").collect()]
        counted = written(by_key.mapInArrow(_counted(vocabulary, expand, pairs, to_arrow_schema(lists)), lists), "terms")
        held = {r[0]: r[1] for r in counted.select(F.explode("_ids").alias("i")).groupBy("i").agg(F.count("*")).collect()}
        chosen = [i for i in range(len(vocabulary)) if held.get(i, 0) >= min_df][:max_features]
        if len(chosen) == max_features or asked >= known_terms:
            break
        asked *= 2
    frequency, idf = np.zeros(len(vocabulary), "int64"), np.full(len(vocabulary), np.nan)
    frequency[chosen] = [held[i] for i in chosen]
    idf[chosen] = np.log((1.0 + documents) / (1 + frequency[chosen])) + 1
    result = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("term", T.StringType()), T.StructField("tf", T.LongType()), T.StructField("df", T.LongType()), T.StructField("weight", T.DoubleType())])
    return counted.mapInArrow(_weighed(vocabulary, frequency, idf, sublinear, to_arrow_schema(result)), result)


def heaviest_terms(weights: DataFrame, key: str, n: int) -> DataFrame:
    """The ``n`` heaviest terms of each document, ties by term, weights rounded to six places before they are ranked."""
    rounded = weights.withColumn("weight", F.round("weight", 6))
    return first_k(rounded, [key], [F.desc("weight"), F.asc("term")], n).withColumnRenamed("rn", "rank")
