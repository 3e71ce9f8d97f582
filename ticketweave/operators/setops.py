"""Unions, differences and de-duplication of timelines, results, edges and records."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketweave.operators.joins import drop_contradictions

_C, _L = F.col, F.lit


def build_timeline(logs: DataFrame, checks: DataFrame, commands: DataFrame, steps: DataFrame, min_score: float = 0.0) -> DataFrame:
    """Four sources as one event table (ts, event, source, level, details); undated rows come last.

    logs: ts, level, exception, error_code, equipment, message, caused_by, score; checks: query_name, row_count,
    truncated; commands: command, host, success, output; steps: title, content.
    """
    none = _L(None).cast("string")
    undated = _L(None).cast("timestamp")
    text = F.concat_ws("  ", F.nullif("exception", _L("")), F.concat(_L("code="), F.nullif("error_code", _L(""))),
                       F.concat(_L("équip="), F.nullif("equipment", _L(""))), F.nullif(F.trim(F.substring("message", 1, 120)), _L("")))
    a = logs.filter(_C("score") >= min_score).select(
        "ts", F.coalesce(F.nullif(text, _L("")), _L("Événement log détecté")).alias("event"), _L("log").alias("source"),
        F.when(_C("level").isin("ERROR", "FATAL", "WARN"), _C("level")).otherwise("INFO").alias("level"),
        F.when(_C("caused_by").isNotNull() & ~_C("caused_by").eqNullSafe(_C("exception")), F.concat(_L("Caused by: "), _C("caused_by"))).alias("details"))
    b = checks.select(
        undated.alias("ts"),
        F.when(_C("row_count") == 0, F.concat(_L("DB ["), _C("query_name"), _L("] : aucune donnée résiduelle trouvée")))
        .otherwise(F.concat(_L("DB ["), _C("query_name"), _L("] : "), _C("row_count").cast("string"), _L(" enregistrement(s) résiduel(s)"), F.when(_C("truncated"), " (tronqué)").otherwise(""))).alias("event"),
        _L("db").alias("source"), F.when(_C("row_count") > 0, "WARN").otherwise("INFO").alias("level"), none.alias("details"))
    c = commands.select(
        undated.alias("ts"), F.concat(_L("SSH ["), _C("command"), _L("] @ "), _C("host"), _L(" : "), F.when(_C("success"), "OK").otherwise("ERREUR")).alias("event"),
        _L("ssh").alias("source"), F.when(_C("success"), "INFO").otherwise("ERROR").alias("level"),
        F.when(_C("success") & (F.length("output") > 0), F.substring("output", 1, 200)).alias("details"))
    line = r"(?m)^\s*(\d+)[.)]\s*(.+)$"
    nums, texts = F.regexp_extract_all("content", _L(line), _L(1)), F.regexp_extract_all("content", _L(line), _L(2))
    numbered = F.transform(F.slice(F.arrays_zip(nums.alias("n"), texts.alias("t")), 1, 5), lambda s: F.struct(
        F.concat(_L("[FR] Étape "), s["n"], _L(": "), F.substring(s["t"], 1, 120)).alias("event"), none.alias("details")))
    whole = F.array(F.struct(F.concat(_L("[FR] "), F.substring("title", 1, 120)).alias("event"), F.nullif(F.substring("content", 1, 300), _L("")).alias("details")))
    d = (steps.select(F.explode(F.when(F.size(nums) > 0, numbered).otherwise(whole)).alias("e"))
         .select(undated.alias("ts"), "e.event", _L("fr").alias("source"), _L("INFO").alias("level"), "e.details"))
    return reduce(DataFrame.unionByName, [a, b, c, d]).orderBy(F.asc_nulls_last("ts"), "source", "event")


def residual_counts(tables: Mapping[str, tuple[DataFrame, str]], keys: Sequence[str | int] | None = None) -> DataFrame:
    """(entity, source, n) per table for the given entities, or for all."""
    def one(name: str, df: DataFrame, key: str) -> DataFrame:
        src = df if keys is None else df.filter(_C(key).isin(list(keys)))
        return src.groupBy(_C(key).alias("entity")).agg(F.count("*").alias("n")).select("entity", _L(name).alias("source"), "n")
    return reduce(DataFrame.unionByName, [one(n, d, k) for n, (d, k) in tables.items()])


def merge_ranked(lists: Sequence[DataFrame], keys: Sequence[str], title: str, score: str, tie: str) -> DataFrame:
    """Result lists in order of priority; the first occurrence of a title (case-insensitive) wins."""
    ranked = reduce(DataFrame.unionByName, [d.withColumn("source_rank", _L(i)) for i, d in enumerate(lists)])
    cols = [c for c in ranked.columns if c not in (*keys, "_t")]
    order = F.struct("source_rank", (-_C(score)).alias("s"), tie)
    return (ranked.withColumn("_t", F.lower(title)).groupBy(*keys, "_t").agg(F.min_by(F.struct(*cols), order).alias("r")).select(*keys, "r.*"))


TRUST_ORDER = {"HIGH": 3, "MEDIUM": 2, "LOW": 1}


def dedupe_candidates(df: DataFrame, category: str, codes: str, trust: str, key: str) -> DataFrame:
    """One candidate per category and code set: the first by ``key``, with the best trust of all."""
    rank = F.coalesce(F.element_at(F.create_map(*[_L(x) for kv in TRUST_ORDER.items() for x in kv]), _C(trust)), _L(0))
    code_key = F.array_join(F.array_sort(codes), ",")
    return (df.withColumn("code_key", code_key).groupBy(category, "code_key")
            .agg(F.min(key).alias(key), F.max_by(trust, rank).alias(trust), F.count("*").alias("n_merged")))


def merge_edges(df: DataFrame, src: str, kind: str, dst: str, source: str, confidence: str) -> DataFrame:
    """Unique edges; those several sources state become high confidence with all sources named."""
    per_source = df.filter((F.coalesce(_C(src).cast("string"), _L("")) != "") & (F.coalesce(_C(dst).cast("string"), _L("")) != ""))
    distinct = per_source.groupBy(src, kind, dst, source).agg(F.max(confidence).alias(confidence))
    return distinct.groupBy(src, kind, dst).agg(
        F.array_join(F.array_sort(F.collect_set(source)), " + ").alias("sources"),
        F.when(F.count("*") > 1, "high").otherwise(F.max(confidence)).alias("confidence"))


def new_only(batch: DataFrame, store: DataFrame, key: str) -> DataFrame:
    """Store plus the batch rows whose id is not in it; a repeated id inside the batch enters once."""
    fresh = batch.join(store.select(key), key, "left_anti").dropDuplicates([key])
    return store.unionByName(fresh)


def merge_corrections(train: DataFrame, corrections: DataFrame, text: str, label: str) -> DataFrame:
    """Training rows plus corrections without contradictions."""
    return train.select(text, label).unionByName(drop_contradictions(corrections, text, label).select(text, label))


def dedupe_provenance(df: DataFrame, kind: str, name: str, confidence: str, tie: str) -> DataFrame:
    """First record per (type, name) in ``tie`` order, as one partial aggregate."""
    cols = [c for c in df.columns if c not in (kind, name)]
    return df.groupBy(kind, name).agg(F.min_by(F.struct(*cols), _C(tie)).alias("r")).select(kind, name, "r.*")


def key_difference(a: DataFrame, b: DataFrame, key_a: Column, key_b: Column) -> DataFrame:
    """Keys only one side has, with the side."""
    left, right = a.select(key_a.alias("k")).filter("k <> ''").distinct(), b.select(key_b.alias("k")).filter("k <> ''").distinct()
    only = lambda x, y, side: x.join(y, "k", "left_anti").select("k", _L(side).alias("side"))
    return only(left, right, "only_a").unionByName(only(right, left, "only_b"))
