"""Search, similarity, clustering and classification over documents and vectors."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import IDF, PCA, CountVectorizer, NGram, RegexTokenizer, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticketweave import fixed_values as fv
from ticketweave.functions.scores import keyword_boost, procedure_trust, quality_label
from ticketweave.functions.text import categorize, first_match, fold_accents, token_set
from ticketweave.lineage import written
from ticketweave.operators.matching import phrase_hits, similar_sets
from ticketweave.operators.ordered import first_k

_C, _L = F.col, F.lit
#: Whole words of plain letters: a run inside an accented word is none.
TOKEN = r"(?<![\p{L}\p{N}_])[a-z0-9_]{3,}(?![\p{L}\p{N}_])"
#: Scores are rounded to six places before they are ranked: what lies this near a bound is still looked at.
_NEAR = 2e-6


# ---------------------------------------------------------------- lexical search
def term_counts(df: DataFrame, key: str, text: str, pattern: str = TOKEN) -> DataFrame:
    """Inverted index rows (key, term, tf, dl), one document at a time inside the row."""
    toks = df.select(key, F.regexp_extract_all(F.lower(text), _L(pattern), _L(0)).alias("_t"))
    return (toks.select(key, F.size("_t").alias("dl"), F.explode("_t").alias("term"))
            .groupBy(key, "term", "dl").agg(F.count("*").alias("tf")))


def _impacts(docs: DataFrame, vocabulary: DataFrame, key: str, text: str, k1: float, b: float) -> DataFrame:
    """(key, term, w, n): the weight of each wanted term in each document but for its idf, and the number of documents."""
    toks = written(docs.select(key, F.regexp_extract_all(F.lower(text), _L(TOKEN), _L(0)).alias("_t")), "tokens")  # read twice
    stats = toks.agg(F.count("*").alias("n"), F.avg(F.size("_t")).alias("avg"))
    n, avg = stats.select("n").scalar(), stats.select(F.greatest(_L(1.0), "avg")).scalar()
    postings = (toks.select(key, F.size("_t").alias("dl"), F.explode("_t").alias("term")).join(vocabulary, "term", "left_semi")
                .groupBy(key, "term", "dl").agg(F.count("*").alias("tf")))
    return written(postings.select(key, "term", (_C("tf") * (k1 + 1) / (_C("tf") + k1 * (1 - b + b * _C("dl") / avg))).alias("w"), n.alias("n")), "impacts")


def scored_best(terms: DataFrame, impacts: DataFrame, query: str, key: str, k: int, seeds: int = 10) -> DataFrame:
    """(query, key, raw) of every document that may be among the ``k`` best of a query, each with its whole score.

    terms: query, term, qi (weight in the query), ub (the most that the term adds to any document), df; impacts: key, term, w.
    A query's rarest terms, as many as have ``seeds * k`` postings, give a floor of its k-th best score. The terms that add
    the least and together stay under the floor bring in no document of their own: they are looked up only for documents
    that the other terms found and that can still pass the floor. So no (query, document) row is made for a common word,
    unless a query has nothing rarer.
    """
    rare = Window.partitionBy(query).orderBy("df", "term").rowsBetween(Window.unboundedPreceding, -1)
    first = terms.withColumn("_before", F.coalesce(F.sum("df").over(rare), _L(0))).filter(_C("_before") < seeds * k)
    add = lambda rows: rows.groupBy(query, key).agg(F.sum(_C("qi") * _C("w")).alias("raw"))
    told = first_k(add(first.select(query, "term", "qi").join(impacts.select(key, "term", "w"), "term")), [query], [F.desc("raw")], k)
    floor = told.filter(_C("rn") == k).select(query, _C("raw").alias("_floor"))
    small = Window.partitionBy(query).orderBy("ub", "term").rowsBetween(Window.unboundedPreceding, 0)
    ruled = terms.join(floor, query, "left").withColumn("_sum", F.sum("ub").over(small))
    ruled = written(ruled.withColumn("_idle", F.coalesce(_C("_sum") < _C("_floor") - _NEAR, _L(False))), "ruled")
    idle = ruled.filter("_idle").select(query, "term", "qi")
    rest = ruled.filter("_idle").groupBy(query).agg(F.max("_sum").alias("_rest"), F.max("_floor").alias("_floor"))
    found = add(ruled.filter("not _idle").select(query, "term", "qi").join(impacts.select(key, "term", "w"), "term")).join(rest, query, "left")
    found = written(found.filter(_C("_rest").isNull() | (_C("raw") + _C("_rest") >= _C("_floor") - _NEAR)).select(query, key, "raw"), "found")
    more = found.select(query, key).join(idle, query).join(impacts.select(key, "term", "w"), [key, "term"])
    return found.unionByName(add(more)).groupBy(query, key).agg(F.sum("raw").alias("raw"))


def bm25(docs: DataFrame, queries: DataFrame, key: str, text: str, query: str, query_text: str, k: int = 5, k1: float = 1.5, b: float = 0.75, boosts: DataFrame | None = None) -> DataFrame:
    """Top ``k`` documents per query. Repeated query terms count as often as they occur.

    Only terms that occur in some query leave the documents, and :func:`scored_best` scores only documents that can be among
    the best. ``boosts`` (query, phrase) adds .2 per phrase found in a document among the 2k best.
    """
    q_terms = term_counts(queries, query, query_text).select(query, "term", _C("tf").alias("qtf"))
    impacts = _impacts(docs, q_terms.select("term").distinct(), key, text, k1, b)
    df = impacts.groupBy("term").agg(F.count("*").alias("df"), F.max("w").alias("top"), F.max("n").alias("n"))
    qi = _C("qtf") * F.log((_C("n") - _C("df") + 0.5) / (_C("df") + 0.5) + 1.0)
    terms = written(q_terms.join(df, "term").select(query, "term", qi.alias("qi"), (qi * _C("top")).alias("ub"), "df"), "terms")
    pooled = k if boosts is None else 2 * k
    scored = scored_best(terms, impacts, query, key, pooled)
    pool = first_k(scored.withColumn("score", F.round("raw", 6)), [query], [F.desc("score"), F.asc(key)], pooled)
    if boosts is None:
        return pool.select(query, key, "score", _C("rn").alias("rank"))
    pool = written(pool.drop("rn"), "pool")
    # Only the pool is rewarded, so phrases are looked for in its documents alone.
    hits = phrase_hits(docs.join(pool.select(key).distinct(), key, "left_semi"), key, text, boosts, "phrase")
    named = boosts.select(query, F.lower("phrase").alias("phrase")).distinct()
    bonus = hits.join(named, "phrase").groupBy(query, key).agg((F.count("*") * 0.2).alias("bonus"))
    final = pool.join(bonus, [query, key], "left").withColumn("score", F.round(_C("score") + F.coalesce("bonus", _L(0.0)), 6))
    return first_k(final, [query], [F.desc("score"), F.asc(key)], k).select(query, key, "score", _C("rn").alias("rank"))


SEARCH_STOP = ["les", "des", "une", "que", "qui", "sur", "dans", "avec", "pour", "mais", "est", "pas", "veux", "faut", "peut", "faire"]


def keyword_search(queries: DataFrame, docs: DataFrame, query: str, query_text: str, key: str, title: str, body: str, k: int, floor: float = 0.15) -> DataFrame:
    """Shared words over query words plus .15 per title hit, accents folded, score capped at .95 after ranking."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(fold_accents(c), _L(r"[\p{L}\p{N}_]{3,}"), _L(0)))
    q = queries.select(query, F.filter(words(_C(query_text)), lambda w: ~w.isin(SEARCH_STOP)).alias("_q")).filter(F.size("_q") > 0)
    q = q.select(query, F.size("_q").alias("n_q"), F.explode("_q").alias("word"))
    d = docs.select(key, words(F.concat_ws(" ", title, body)).alias("_d"), words(F.coalesce(_C(title), _L(""))).alias("_t"))
    d = d.select(key, "_t", F.explode("_d").alias("word")).select(key, "word", F.array_contains("_t", _C("word")).alias("in_title"))
    score = F.count("*") / F.max("n_q") + 0.15 * F.count_if("in_title")
    scored = q.join(d, "word").groupBy(query, key).agg(F.round(score, 6).alias("s")).filter(_C("s") >= floor)
    best = first_k(scored, [query], [F.desc("s"), F.asc(key)], k)
    return best.select(query, key, F.least("s", _L(0.95)).alias("score"), _C("rn").alias("rank"))


def similar_issues(queries: DataFrame, history: DataFrame | None, query: str, key: str, text: str, vector_hits: DataFrame | None = None, threshold: float = 0.6, k: int = 10) -> DataFrame:
    """Past issues with Jaccard above ``threshold``, merged with vector hits (query, key, score), best first.

    Without a ``history`` all queries are each other's. Queries of equal tokens find the same issues, and issues of equal tokens
    score alike: sets are ranked for sets, with the ``k`` smallest keys of each, and then told to the queries.
    """
    q = queries.select(_C(query).alias("qid"), token_set(text).alias("_tok"))
    h = q if history is None else history.select(_C(key).alias("did"), token_set(text).alias("_tok"))
    scored, asked, held = similar_sets(q, h, "qid", "qid" if history is None else "did", "_tok", threshold)
    few = first_k(held, ["r"], [F.asc("_k_r")], k).drop("rn")
    near = scored.filter(_C("score") > threshold).withColumn("score", F.round("score", 6)).join(few, "r")
    best = first_k(near, ["l"], [F.desc("score"), F.asc("_k_r")], k).drop("rn")
    rows = asked.join(best, "l").select(_C("_k_l").alias(query), _C("_k_r").alias(key), "score", _L("diagnostics").alias("source"))
    if vector_hits is not None:
        rows = rows.unionByName(vector_hits.select(query, key, F.round("score", 6).alias("score"), _L("history").alias("source")))
    return first_k(rows, [query], [F.desc("score"), F.asc(key), F.asc("source")], k).withColumnRenamed("rn", "rank")


# ---------------------------------------------------------------- vectors
#: Pivots of the vector partitions: a sample of so many distinct vectors at most.
PIVOTS = 64
#: Bytes of vectors that a task holds of either side.
BLOCK_BYTES = 32 << 20
#: Scores that a task holds at a time, whatever the sizes of the two blocks.
BLOCK_SCORES = 2 << 20
# Scores are rounded to six places, so partitions within this distance of the bound are still looked at.
_ROUNDING = 2e-6


def _units(vectors: pd.Series) -> np.ndarray:
    m = np.asarray(np.vstack(vectors.to_numpy()), dtype="float64")
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)


def _assign(pivots: np.ndarray, key: str, vector: str):
    """Nearest pivot of every vector and the angle to it; zero vectors, which have no angle, are partition -1."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                units = _units(pdf[vector])
                cosines = units @ pivots.T
                near = cosines.argmax(axis=1)
                angle = np.arccos(np.clip(cosines[np.arange(len(units)), near], -1, 1))
                yield pd.DataFrame({key: pdf[key], vector: pdf[vector], "_p": np.where(units.any(axis=1), near, -1), "_angle": angle})

    return run


def _partitions_asked(pivots: np.ndarray, counts: np.ndarray, radii: np.ndarray, zeros: bool, k: int, threshold: float | None, key: str, vector: str):
    """(query, vector, partition) for every partition that may hold one of the query's best ``k``.

    By the triangle inequality an item lies between angle - radius and angle + radius from the query. The nearest partitions
    that together hold ``k`` items bound the k-th best angle; partitions that begin beyond it are left out.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            units = _units(pdf[vector])
            angle = np.arccos(np.clip(units @ pivots.T, -1, 1))
            low = np.cos(np.clip(angle - radii, 0, np.pi))  # the best cosine a partition may hold
            worst = np.cos(np.clip(angle + radii, 0, np.pi))
            order = np.argsort(-worst, axis=1)
            enough = np.cumsum(counts[order], axis=1) >= k
            bound = np.where(enough.any(axis=1), np.take_along_axis(worst, order, 1)[np.arange(len(units)), enough.argmax(axis=1)], -2.0)
            if zeros:  # zero vectors score 0 and may be among the best
                bound = np.minimum(bound, 0.0)
            if threshold is not None:
                bound = np.maximum(bound, threshold)
            asked = (low >= bound[:, None] - _ROUNDING) | ~units.any(axis=1)[:, None]
            asked &= counts > 0
            rows, parts = np.nonzero(asked)
            if zeros:
                rows, parts = np.append(rows, np.arange(len(units))), np.append(parts, np.full(len(units), -1))
            yield pd.DataFrame({"_q": pdf[key].to_numpy()[rows], "_v": pdf[vector].to_numpy()[rows], "_p": parts.astype("int64")})

    return run


def _block_best(key: str, vector: str, k: int, held: int = BLOCK_SCORES):
    """The best ``k`` items of a block for each query of another, some queries at a time: ``held`` scores at most, or one query's."""
    def run(a: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if a.empty or c.empty:
            return pd.DataFrame({"query_id": [], "item_id": [], "score": []})
        a = a.sort_values(key, kind="stable")
        keys, items, step, parts = a[key].to_numpy(), _units(a[vector]).T, max(1, held // len(a)), []
        for i in range(0, len(c), step):
            asking = c.iloc[i:i + step]
            sims = np.round(_units(asking["_v"]) @ items, 6)
            top = np.argsort(-sims, axis=1, kind="stable")[:, :k]
            at = np.repeat(np.arange(len(asking)), top.shape[1])
            parts.append(pd.DataFrame({"query_id": asking["_q"].to_numpy()[at], "item_id": keys[top.ravel()], "score": sims[at, top.ravel()]}))
        return pd.concat(parts, ignore_index=True)

    return run


def knn(items: DataFrame, queries: DataFrame, key: str, vector: str, query: str, k: int, threshold: float | None = None, pivots: int = PIVOTS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Exact cosine top ``k``: (query_id, item_id, score, rank), ties by item; scores below ``threshold`` are left out.

    Items are partitioned by their nearest pivot (a sample of distinct vectors), and only a partition's size and radius are
    gathered, a row for each pivot. Queries go to the partitions that the triangle inequality cannot rule out. Partitions and
    the queries that ask them are cut into blocks of at most about ``block_bytes``, each pair of blocks is a task, and ``k`` rows
    per query and block come back. Rows whose vector is null are left out; a zero vector scores 0 with everything.
    """
    items, queries = items.filter(_C(vector).isNotNull()), queries.filter(_C(vector).isNotNull())
    id_type, of_items, of_queries = items.schema[key].dataType, items.schema[vector].dataType, queries.schema[vector].dataType
    result = T.StructType([T.StructField("query_id", queries.schema[query].dataType), T.StructField("item_id", id_type), T.StructField("score", T.DoubleType())])
    zero = F.forall(vector, lambda x: x == 0)
    chosen = [r[0] for r in items.filter(~zero).select(vector).distinct().orderBy(F.xxhash64(vector)).limit(pivots).collect()]
    if not chosen:  # nothing but zero vectors: any pivot does
        chosen = [r[0] for r in items.select(vector).limit(1).collect()]
    if not chosen:
        return items.sparkSession.createDataFrame([], result).withColumn("rank", _L(1))
    centres = _units(pd.Series([np.asarray(c) for c in chosen]))
    schema = T.StructType([T.StructField(key, id_type), T.StructField(vector, of_items), T.StructField("_p", T.LongType()), T.StructField("_angle", T.DoubleType())])
    placed = written(items.select(key, vector).mapInPandas(_assign(centres, key, vector), schema), "placed")
    told = {r["_p"]: r for r in placed.groupBy("_p").agg(F.count("*").alias("n"), F.max("_angle").alias("radius")).collect()}  # a row a pivot
    counts = np.array([told[i]["n"] if i in told else 0 for i in range(len(centres))])
    radii = np.array([told[i]["radius"] if i in told else 0.0 for i in range(len(centres))])
    schema = T.StructType([T.StructField("_q", queries.schema[query].dataType), T.StructField("_v", of_queries), T.StructField("_p", T.LongType())])
    asked = queries.select(query, vector).mapInPandas(_partitions_asked(centres, counts, radii, -1 in told, k, threshold, query, vector), schema)
    asked = written(asked, "asked")
    rows = max(1, block_bytes // (8 * centres.shape[1]))
    sides = placed.groupBy("_p").agg(F.ceil(F.count("*") / rows).alias("_ni")).join(asked.groupBy("_p").agg(F.ceil(F.count("*") / rows).alias("_nq")), "_p")
    others = lambda n: F.explode(F.sequence(_L(0).cast("long"), _C(n) - 1))
    left = placed.join(sides, "_p").withColumn("_bi", F.pmod(F.xxhash64(key), "_ni")).withColumn("_bq", others("_nq")).select(key, vector, "_p", "_bi", "_bq")
    right = asked.join(sides, "_p").withColumn("_bq", F.pmod(F.xxhash64("_q"), "_nq")).withColumn("_bi", others("_ni")).select("_q", "_v", "_p", "_bi", "_bq")

    where = ["_p", "_bi", "_bq"]
    parts = left.groupBy(*where).cogroup(right.groupBy(*where)).applyInPandas(_block_best(key, vector, k), result)
    if threshold is not None:
        parts = parts.filter(_C("score") >= threshold)
    return first_k(parts, ["query_id"], [F.desc("score"), F.asc("item_id")], k).withColumnRenamed("rn", "rank")


def hybrid_search(queries: DataFrame, docs: DataFrame, query: str, query_text: str, key: str, name: str, semantic: DataFrame, k: int, stop: Sequence[str] = ()) -> DataFrame:
    """Exact name hits, else names containing a query word, then semantic hits; a document appears once per query.

    ``semantic`` carries (query, key, score).
    """
    words = F.array_distinct(F.regexp_extract_all(F.lower(query_text), _L(r"[\p{L}\p{N}_]{3,}"), _L(0)))
    q = queries.select(query, F.explode(words).alias("word")).distinct()
    # Documents met by one word score alike and rank by key: a word's first k stand for all of them.
    named = docs.select(key, F.lower(name).alias("word")).distinct()
    few = lambda rows: first_k(rows, ["word"], [F.asc(key)], k).drop("rn")
    exact = q.join(few(named.join(q.select("word").distinct(), "word", "left_semi")), "word").select(query, key, _L(1.0).alias("score"), _L("exact").alias("match_type"), _L(0).alias("tier")).distinct()
    answered = q.join(named.select("word").distinct(), "word", "left_semi").select(query).distinct()
    rest = q.join(answered, query, "left_anti").filter((F.length("word") >= 4) & ~_C("word").isin(list(stop)))
    names = named.select(_C("word").alias("name")).distinct()
    hits = phrase_hits(names, "name", "name", rest, "word").join(named.withColumnRenamed("word", "name"), "name").select(key, _C("phrase").alias("word")).distinct()
    fuzzy = rest.join(few(hits), "word").select(query, key, _L(0.9).alias("score"), _L("fuzzy_keyword").alias("match_type"), _L(1).alias("tier")).distinct()
    sem = semantic.select(query, key, _C("score").cast("double").alias("score"), _L("semantic").alias("match_type"), _L(2).alias("tier"))
    merged = exact.unionByName(fuzzy).unionByName(sem).groupBy(query, key).agg(F.min(F.struct("tier", (-_C("score")).alias("s"), "match_type")).alias("m"))
    flat = merged.select(query, key, _C("m.tier").alias("tier"), F.round(-_C("m.s"), 6).alias("score"), _C("m.match_type").alias("match_type"))
    return first_k(flat, [query], [F.asc("tier"), F.desc("score"), F.asc(key)], k).drop("tier").withColumnRenamed("rn", "rank")


def hier_predict(queries: DataFrame, train: DataFrame, query: str, vector: str, key: str, label: str, text: str, label_names: dict[int, str] | None = None, k: int = 5) -> DataFrame:
    """Level-1 label by .6 neighbour vote and .4 keyword vote, with confidence .40 / .35 / .25 and agreement.

    Neighbours come from :func:`knn`; votes and keyword shares are summed per (query, label).
    """
    near = knn(train, queries, key, vector, query, k).join(train.select(_C(key).alias("item_id"), _C(label).cast("string").alias("l1")), "item_id")
    votes = near.groupBy(_C("query_id").alias(query), "l1").agg(F.sum("score").alias("s"), F.count("*").alias("c"))
    tops = near.groupBy(_C("query_id").alias(query)).agg(F.max("score").alias("top_sim"), F.sum("score").alias("total"), F.count("*").alias("n"))
    boost = queries.select(query, keyword_boost(_C(text)).alias("kb"))
    kw = boost.select(query, F.explode("kb.shares").alias("x")).select(query, _C("x.l1").alias("l1"), _C("x.share").alias("share"))
    both = votes.join(kw, [query, "l1"], "full").join(tops, query)
    total = F.when(_C("total") == 0, 1.0).otherwise(_C("total"))
    hybrid = F.round(0.60 * F.coalesce("s", _L(0.0)) / total + 0.40 * F.coalesce("share", _L(0.0)), 6)
    best = first_k(both.withColumn("h", hybrid), [query], [F.desc("h"), F.asc("l1")], 1)
    joined = best.join(boost.select(query, _C("kb.boost").alias("boost")), query)
    agree = F.coalesce("c", _L(0)) / F.greatest("n", _L(1))
    conf = F.round(0.40 * _C("top_sim") + 0.35 * agree + 0.25 * _C("boost"), 4)
    return joined.select(query, _C("l1").alias("level_1"), conf.alias("level_1_confidence"), F.round(agree, 4).alias("neighbor_agreement"), F.round("boost", 4).alias("keyword_boost"),
                         F.when(conf >= 0.75, "HIGH").when(conf >= 0.50, "MEDIUM").otherwise("LOW").alias("tier"))


# ---------------------------------------------------------------- terms, features, models
#: Terms of texts that a task counts at a time, and (group, term) rows that it adds up before it sends them.
TERMS, SUMS = 1 << 20, 1 << 21


def _term_shares(group: str):
    """(group, terms) of texts to (group, term, w, n): shares of the texts' terms and texts, added up in the task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        total = lambda: pa.concat_tables(held).group_by([group, "term"]).aggregate([("w", "sum"), ("n", "sum")]).rename_columns([group, "term", "w", "n"])
        for whole in batches:
            ends = np.cumsum(pc.list_value_length(whole.column(1)).to_numpy(zero_copy_only=False))
            at = 0
            while at < whole.num_rows:
                done = int(ends[at - 1]) if at else 0
                to = max(at + 1, int(np.searchsorted(ends, done + TERMS)))
                batch, at = whole.slice(at, to - at), to
                size = pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False)
                terms = pa.table({"row": np.repeat(np.arange(len(size)), size), "term": batch.column(1).flatten()})
                terms = terms.group_by(["row", "term"]).aggregate([([], "count_all")])
                row = terms.column("row").to_numpy()
                held.append(pa.table({group: batch.column(0).take(pa.array(row)), "term": terms.column("term"), "w": terms.column("count_all").to_numpy() / size[row], "n": np.ones(len(row), np.int64)}))
                if sum(x.num_rows for x in held) > SUMS:
                    held = [total()]
                    if held[0].num_rows > SUMS // 2:
                        yield from held.pop().to_batches(max_chunksize=1 << 16)
        if held:
            yield from total().to_batches(max_chunksize=1 << 16)

    return run


def top_terms(df: DataFrame, group: str, key: str, text: str, n: int = 8, stop: Sequence[str] = tuple(fv.KEYWORD_STOP_WORDS), pattern: str = r"[\p{L}_]{3,}") -> DataFrame:
    """Terms with the highest mean tf-idf per group (tf over document length, idf ln(N/df)).

    A text's terms are counted where it is read, and tasks add up (group, term) before anything is sent: it travels once, by
    term, for both the sums and the idf. Texts that share a group and key count as one document, so only those meet by key.
    """
    total = df.agg(F.count("*")).scalar()
    sizes = written(df.groupBy(group).agg(F.count("*").alias("size")), "group-sizes")
    again = written(df.groupBy(group, key).agg(F.count("*").alias("_n")).filter("_n > 1").select(_C(group).alias("_g"), _C(key).alias("_k")), "repeated-keys")
    terms = lambda rows: rows.select(group, key, F.filter(F.regexp_extract_all(F.lower(text), _L(pattern), _L(0)), lambda w: ~w.isin(list(stop))).alias("_t")).filter(F.size("_t") > 0)
    once, many = df, None
    if not again.isEmpty():
        same = _C(group).eqNullSafe(_C("_g")) & _C(key).eqNullSafe(_C("_k"))
        once, many = df.join(again, same, "left_anti"), df.join(again, same, "left_semi")
    kind = T.StructType([df.select(group).schema[0], T.StructField("term", T.StringType()), T.StructField("w", T.DoubleType()), T.StructField("n", T.LongType())])
    parts = terms(once).select(group, "_t").mapInArrow(_term_shares(group), kind)
    if many is not None:
        tf = terms(many).select(group, key, F.size("_t").alias("dl"), F.explode("_t").alias("term")).groupBy(group, key, "term", "dl").agg(F.count("*").alias("c"))
        parts = parts.unionByName(tf.select(group, "term", (_C("c") / _C("dl")).alias("w"), _L(1).cast("long").alias("n")))
    per_group = parts.repartition("term").groupBy("term", group).agg(F.sum("w").alias("w"), F.sum("n").alias("gdf"))
    scored = per_group.withColumn("idf", F.log(total / F.sum("gdf").over(Window.partitionBy("term")))).join(sizes, group)
    scored = scored.withColumn("score", F.round(_C("w") * _C("idf") / _C("size"), 6))
    return first_k(scored, [group], [F.desc("score"), F.asc("term")], n).select(group, "term", "score", _C("rn").alias("rank"))


def tfidf_stages(text: str = "text", max_features: int = 5000, min_df: int = 2, bigrams: bool = True, out: str = "features") -> list:
    """Tokenise, count words and word pairs, weigh by IDF."""
    from pyspark.ml.feature import SQLTransformer, VectorAssembler
    stages = [RegexTokenizer(inputCol=text, outputCol="_w", pattern=r"[^\p{L}\p{N}_]+", minTokenLength=2),
              CountVectorizer(inputCol="_w", outputCol="_c1", vocabSize=max_features, minDF=min_df), IDF(inputCol="_c1", outputCol="_i1")]
    parts = ["_i1"]
    if bigrams:
        stages += [NGram(n=2, inputCol="_w", outputCol="_w2"), CountVectorizer(inputCol="_w2", outputCol="_c2", vocabSize=max_features, minDF=min_df), IDF(inputCol="_c2", outputCol="_i2")]
        parts.append("_i2")
    stages.append(VectorAssembler(inputCols=parts, outputCol=out))
    return stages


def char_ngrams(text: Column, lo: int = 3, hi: int = 5) -> Column:
    """All character n-grams of lengths lo..hi as an array."""
    def grams(n: int) -> Column:
        return F.transform(F.sequence(_L(1), F.greatest(F.length(text) - (n - 1), _L(1))), lambda i: F.substring(text, i, _L(n)))

    return F.flatten(F.array(*[grams(n) for n in range(lo, hi + 1)]))


def fit_on_words(stages: Sequence, df: DataFrame, *columns: str) -> tuple[PipelineModel, DataFrame]:
    """(fitted pipeline, ``columns`` and words of the rows it was fitted on).

    Each stage reads the rows at least once; texts are cut into words once and written for all of them.
    """
    at = next(i for i, s in enumerate(stages) if isinstance(s, RegexTokenizer))
    words = written(stages[at].transform(df).select(*columns, stages[at].getOutputCol()), "words")
    rest = Pipeline(stages=[*stages[:at], *stages[at + 1:]]).fit(words).stages
    return PipelineModel([*rest[:at], stages[at], *rest[at:]]), words


def tfidf(df: DataFrame, text: str, max_features: int = 5000, min_df: int = 2) -> DataFrame:
    model, words = fit_on_words(tfidf_stages(text, max_features, min_df), df, *df.columns)
    return PipelineModel(model.stages[1:]).transform(words)


def cluster_tickets(df: DataFrame, text: str, min_size: int = 5, dims: int = 10, seed: int = 42) -> DataFrame:
    """TF-IDF, PCA to at most ``dims`` dimensions, KMeans with k = clamp(n / min_size, 3, 20)."""
    n = df.count()
    k = max(3, min(20, n // min_size))
    stages = tfidf_stages(text, max_features=500, bigrams=False) + [PCA(k=dims, inputCol="features", outputCol="reduced"), KMeans(k=k, seed=seed, featuresCol="reduced", predictionCol="cluster_id")]
    model, words = fit_on_words(stages, df, *df.columns)
    return PipelineModel(model.stages[1:]).transform(words)


def train_classifier(df: DataFrame, text: str, label: str, key: str, min_rows: int = 2, holdout: float = 0.2, max_features: int = 5000) -> tuple[PipelineModel, DataFrame]:
    """Balanced logistic regression on TF-IDF; (model, held-out rows). Classes below ``min_rows`` are left out.

    The split takes a fixed share of every class by a hash of the key, so it is repeatable.
    """
    counts = df.groupBy(label).agg(F.count("*").alias("_n")).filter(_C("_n") >= min_rows)
    classes = counts.agg(F.count("*")).scalar()
    total = counts.agg(F.sum("_n")).scalar()
    kept = df.join(counts, label).withColumn("_weight", total / (classes * _C("_n")))
    slot = F.pmod(F.xxhash64(_C(key).cast("string")), _L(1000))
    train, test = kept.filter(slot >= int(holdout * 1000)), kept.filter(slot < int(holdout * 1000))
    stages = [StringIndexer(inputCol=label, outputCol="_y", handleInvalid="skip"), *tfidf_stages(text, max_features, bigrams=False),
              LogisticRegression(labelCol="_y", featuresCol="features", weightCol="_weight", maxIter=50, regParam=0.01, probabilityCol="_prob", predictionCol="_pred")]
    return fit_on_words(stages, train, label, "_weight")[0], test


def predict(model: PipelineModel, df: DataFrame, key: str) -> DataFrame:
    """Long (key, label, probability) rows, one per class; the rows need no label."""
    labels = model.stages[0].labels
    scored = PipelineModel(model.stages[1:]).transform(df).select(key, F.posexplode(vector_to_array("_prob")).alias("_i", "probability"))
    return scored.select(key, first_match([(_C("_i") == i, _L(l)) for i, l in enumerate(labels)], _L(None).cast("string")).alias("label"), "probability")


#: Stands between the two levels of a joint label.
_JOINT = "\x1f"


def train_l2(df: DataFrame, text: str, l1: str, l2: str, key: str, min_rows: int = 5, min_classes: int = 2) -> PipelineModel:
    """One multinomial model over joint labels (l1, l2), however many level-1 values there are.

    Level-1 values with fewer than ``min_rows`` rows or ``min_classes`` labels are left out, and rows that lack a label.
    """
    rows = df.filter(_C(l1).isNotNull() & _C(l2).isNotNull())
    fit = rows.groupBy(l1).agg(F.count("*").alias("_rows"), F.count_distinct(l2).alias("_labels")).filter((_C("_rows") >= min_rows) & (_C("_labels") >= min_classes))
    joint = rows.join(fit, l1, "left_semi").withColumn("_joint", F.concat_ws(_JOINT, _C(l1).cast("string"), _C(l2).cast("string")))
    return train_classifier(joint, text, "_joint", key, min_rows=1, holdout=0.0, max_features=1000)[0]


def predict_l2(model: PipelineModel, df: DataFrame, key: str, l1: str) -> DataFrame:
    """(key, level_1, label, probability): joint classes of the row's level-1 value alone, which add up to 1.

    Rows whose level-1 value the model does not know give nothing; ``key`` is unique.
    """
    joint = predict(model, df, key)
    own = joint.join(df.select(key, _C(l1).cast("string").alias("level_1")), key).filter(F.split_part("label", _L(_JOINT), _L(1)) == _C("level_1"))
    total = own.groupBy(key).agg(F.sum("probability").alias("_total"))
    return own.join(total, key).select(key, "level_1", F.split_part("label", _L(_JOINT), _L(2)).alias("label"), (_C("probability") / _C("_total")).alias("probability"))


# ---------------------------------------------------------------- learned patterns
def pattern_score(visits: Column, success: Column, failure: Column, created: Column, as_of: Column) -> Column:
    age = F.date_diff(F.to_date(as_of), F.to_date(created))
    base = F.least(0.85 + 0.02 * visits, _L(0.95))
    age_factor = F.when(age > 60, 0.80).when(age > 30, 0.85).when(age > 14, 0.92).otherwise(1.0)
    seen = success + failure
    ok = F.when(seen > 0, F.when(success / F.greatest(seen, _L(1)) < 0.6, 0.70).otherwise(1.0)).otherwise(0.90)
    return F.round(base * age_factor * ok, 4)


def decay_patterns(df: DataFrame, score: str, created: str, last_used: str, as_of: Column, inactive: int = 14, prune: float = 0.20) -> DataFrame:
    """Lower unused and old patterns and drop those below ``prune``."""
    idle = F.date_diff(F.to_date(as_of), F.to_date(F.coalesce(last_used, created)))
    age = F.date_diff(F.to_date(as_of), F.to_date(created))
    new = _C(score) * F.when(idle > inactive, 0.98).otherwise(1.0) * F.when(age > 60, 0.90).otherwise(1.0)
    return df.withColumn("_new", new).filter(_C("_new") >= prune).withColumn("new_score", F.round("_new", 4)).drop("_new")


def patterns_for_entities(patterns: DataFrame, wanted: DataFrame, entity: str, group: str, score: str, key: str, per_entity: int = 3, k: int = 5) -> DataFrame:
    """Best patterns per wanted entity (three each), merged to the best ``k`` distinct ones per group."""
    best = first_k(patterns.withColumn("_e", F.upper(entity)), ["_e"], [F.desc(score), F.asc(key)], per_entity).drop("rn")
    names = wanted.select(group, F.explode(F.array_distinct(F.array(F.upper(entity), F.upper(F.element_at(F.split(entity, ":"), -1))))).alias("_e")).distinct()
    rows = names.join(best.select("_e", key, score), "_e").select(group, key, score).distinct()
    return first_k(rows, [group], [F.desc(score), F.asc(key)], k).withColumnRenamed("rn", "rank")


LAYER_WEIGHT = {"controller": 1, "service": 3, "validator": 3, "repository": 2}


def score_nodes(queries: DataFrame, nodes: DataFrame, query: str, text: str, key: str, method: str, entity: str, exceptions: str, operation: str, other: str, layer: str, k: int = 6, floor: int = 2, layers: dict[str, int] = LAYER_WEIGHT) -> DataFrame:
    """Code nodes by query tokens: 5 in the method, 4 entity, 3 exception, 2 operation, 1 elsewhere, plus the layer weight."""
    toks = queries.select(query, F.explode(F.array_distinct(F.regexp_extract_all(F.lower(text), _L(r"[a-zéèàùâêîôûç]+"), _L(0)))).alias("phrase"))
    blob = nodes.select(key, F.lower(F.concat_ws(" ", method, entity, operation, exceptions, other)).alias("_blob"))
    hits = phrase_hits(blob, key, "_blob", toks, "phrase").join(nodes.select(key, *[F.lower(c).alias(f"_{i}") for i, c in enumerate((method, entity, exceptions, operation))]), key)
    points = F.when(F.contains("_0", "phrase"), 5).when(F.contains("_1", "phrase"), 4).when(F.contains("_2", "phrase"), 3).when(F.contains("_3", "phrase"), 2).otherwise(1)
    per_token = hits.select(key, "phrase", points.alias("p"))
    sums = toks.join(per_token, "phrase").groupBy(query, key).agg(F.sum("p").alias("s"))
    weight = first_match([(_C(layer) == l, _L(w)) for l, w in layers.items()], _L(0))
    scored = sums.join(nodes.select(key, weight.alias("_w")), key).withColumn("score", (_C("s") + _C("_w")).cast("long")).filter(_C("score") >= floor)
    return first_k(scored, [query], [F.desc("score"), F.asc(key)], k).select(query, key, "score", _C("rn").alias("rank"))


# ---------------------------------------------------------------- procedures
def generate_procedures(clusters: DataFrame, records: DataFrame, matches: DataFrame, min_trust: float = 0.45) -> DataFrame:
    """Procedures from clusters and their matched log records.

    clusters: cluster_id, cluster_name, incident_type, application, size, trust_score, codes[]; records: record_id,
    exception, error_pattern, frequency, validated, probable_root_cause; matches: cluster_id, record_id, rank (few per cluster).
    """
    m = matches.join(records, "record_id")
    per = m.groupBy("cluster_id").agg(
        F.count("*").alias("n_logs"), F.max("frequency").alias("max_freq"), F.bool_or("validated").alias("has_catalog"),
        F.array_sort(F.collect_list(F.struct("rank", "error_pattern", "exception", "probable_root_cause"))).alias("logs"))
    j = clusters.join(per, "cluster_id", "left")
    logs = F.coalesce("logs", F.array().cast(per.schema["logs"].dataType))
    n_logs, has = F.coalesce("n_logs", _L(0)), F.coalesce("has_catalog", _L(False))
    ok = lambda c: (F.coalesce(c, _L("")) != "")
    patterns = F.transform(F.filter(logs, lambda x: ok(x["error_pattern"]) & ~F.contains(x["error_pattern"], _L("<CATALOG>"))), lambda x: F.concat(_L("Log contient: « "), F.substring(x["error_pattern"], 1, 100), _L(" »")))
    codes = F.transform("codes", lambda c: F.concat(_L("Code erreur "), c, _L(" affiché")))
    excs = F.transform(F.filter(logs, lambda x: ok(x["exception"])), lambda x: F.concat(_L("Exception "), x["exception"], _L(" dans les logs applicatifs")))
    symptoms = F.slice(F.array_distinct(F.concat(patterns, codes, excs)), 1, 8)
    causes = F.slice(F.array_distinct(F.transform(F.filter(logs, lambda x: ok(x["probable_root_cause"])), lambda x: x["probable_root_cause"])), 1, 5)
    trust = procedure_trust(_C("trust_score"), _C("size"), n_logs, has, F.coalesce("max_freq", _L(0)))
    times = {"provisioning_failure": "2–4h (avec coordination réseau)", "data_inconsistency": "1–2h", "system_integration_error": "1–3h (selon disponibilité système tiers)",
             "command_failure": "30min–1h", "network_equipment_issue": "4–8h (intervention terrain possible)", "access_management_error": "15–30min"}
    out = j.select("cluster_id", F.concat(F.initcap(F.replace("cluster_name", _L("_"), _L(" "))), _L(" — procédure N3")).alias("title"), "incident_type", "application",
                   symptoms.alias("symptoms"), causes.alias("root_causes"), trust.alias("trust_score"), _C("size").alias("ticket_count"), n_logs.alias("n_logs"),
                   first_match([(_C("incident_type") == t, _L(v)) for t, v in times.items()], _L("1–2h")).alias("estimated_time"),
                   F.array_join(F.filter(F.array(_L("ticket_cluster"), F.when(n_logs > 0, "log_derived"), F.when(has, "catalog_validated")), lambda x: x.isNotNull()), ",").alias("source_types"))
    return out.filter(_C("trust_score") >= min_trust)


CANDIDATE_CATEGORIES = [
    ("Suppression", ["suppression", "supprimer", "impossible de supprimer"]), ("VLAN", ["vlan", "vlan bloqué", "vlan occupé"]),
    ("DSLAM", ["dslam", "compteurs dslam", "broche"]), ("Acces", ["accès", "access", "double accès"]), ("ND", ["nd inconnu", "nd introuvable", "noeud de distribution"]),
    ("Carte", ["carte", "card", "suppression carte"]), ("Erreur_Interne", ["erreur interne", "internal error", "b4002"]),
    ("Configuration", ["configuration", "format", "paramètre"]), ("Cohérence_Data", ["incohérence", "données incorrectes", "incoherence"]), ("IHM", ["ihm", "interface", "script"]),
]


def build_candidates(df: DataFrame, key: str, title: str, text: str, score: str) -> DataFrame:
    """Canonical candidates from scored sheets: usable quality labels become HIGH, MEDIUM or LOW trust."""
    label = quality_label(_C(score))
    trust = F.when(label == "canonique", "HIGH").when(label == "bonne", "MEDIUM").when(label == "partielle", "LOW")
    return df.select(key, title, categorize(F.concat_ws(" ", title, text), CANDIDATE_CATEGORIES, "Général").alias("category"), trust.alias("trust_level"), _C(score).alias("stored_score")).filter("trust_level is not null")
