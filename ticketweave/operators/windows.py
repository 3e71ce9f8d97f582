"""Ordered analytics: Pareto, anomalies, baselines, histories, sections, queues and filters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticketweave import fixed_values as fv
from ticketweave.functions.text import any_of, first_match, matches_any
from ticketweave.operators.ordered import first_k, last_known, previous_values, running_total

_C, _L = F.col, F.lit


def pareto(df: DataFrame, col: str, weight: str | None = None, cells: int | None = None) -> DataFrame:
    """Count, share and cumulative share per value, largest first; blanks count as one class."""
    name = F.coalesce(F.nullif(F.trim(_C(col).cast("string")), _L("")), _L("Non classé"))
    measure = F.count("*") if weight is None else F.sum(weight)
    counts = df.groupBy(name.alias("label")).agg(measure.alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    # Labels of equal counts, of which a long tail has millions, are cut by the label as well.
    run = running_total(counts, [F.desc("n"), F.asc("label")], "n", "cum", cells)
    return run.select("label", "n", F.round(_C("n") / total * 100, 2).alias("pct"), F.round(_C("cum") / total * 100, 2).alias("cumulative_pct"))


def volume_anomalies(df: DataFrame, ts: str, z: float = 1.8) -> DataFrame:
    """Days whose volume lies ``z`` sample deviations from the mean."""
    days = df.filter(_C(ts).isNotNull()).groupBy(F.to_date(ts).alias("day")).agg(F.count("*").alias("volume"))
    stats = days.agg(F.avg("volume").alias("m"), F.stddev_samp("volume").alias("s"), F.count("*").alias("k"))
    m, k = stats.select("m").scalar(), stats.select("k").scalar()
    s = stats.select(F.when(F.coalesce("s", _L(0.0)) == 0, 1.0).otherwise(_C("s"))).scalar()
    score = (_C("volume") - m) / s
    return days.filter((k >= 3) & (F.abs(score) >= z)).select(
        "day", "volume", F.round((_C("volume") - m) / m * 100, 1).alias("delta_pct"), F.when(score > 0, "spike").otherwise("drop").alias("direction"))


def score_drift(daily: DataFrame, day: str, score: str, n: int = 7, threshold: float = 0.15) -> DataFrame:
    """Drop of a daily score against the mean of its ``n`` preceding entries. One row per day comes in."""
    w = Window.orderBy(day).rowsBetween(-n, -1)
    base = daily.select(_C(day), F.round(score, 4).alias("today_avg"))
    out = base.withColumn("baseline_avg", F.round(F.coalesce(F.avg("today_avg").over(w), _C("today_avg")), 4))
    delta = F.when(_C("baseline_avg") > 0, F.round((_C("baseline_avg") - _C("today_avg")) / _C("baseline_avg"), 4)).otherwise(0.0)
    return out.withColumn("delta_pct", delta).withColumn("drift_detected", _C("delta_pct") > threshold)


RETRY_TYPES = ["retry_attempt", "timeout", "mq_error", "script_running", "rollback", "constraint_violation", "dlq_event"]
BENIGN_TYPES = ["orchestra_sync", "42c_interaction", "mq_receive", "db_eqpt_state", "db_epc_state", "mq_send"]


def retry_loops(df: DataFrame, entity: str, kind: str, ts: str, fast: Sequence[str] = tuple(RETRY_TYPES), benign: Sequence[str] = tuple(BENIGN_TYPES), fast_min: int = 5, slow_min: int = 8) -> DataFrame:
    """Repeated events per entity and type. The mean gap is span / (n - 1), so no ordering is needed."""
    agg = df.filter(~_C(kind).isin(list(benign))).groupBy(entity, kind).agg(
        F.count("*").alias("occurrences"), F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen"), F.count(ts).alias("_k"))
    span = (F.unix_micros("last_seen") - F.unix_micros("first_seen")) / 1e6
    return (agg.filter(_C("occurrences") >= F.when(_C(kind).isin(list(fast)), fast_min).otherwise(slow_min))
            .withColumn("interval_seconds", F.when(_C("_k") >= 2, F.round(span / (_C("_k") - 1), 3))).drop("_k"))


def root_event(df: DataFrame, entity: str, ts: str, key: str, critical: Column, error: Column, stale: Column) -> DataFrame:
    """Earliest critical fresh event per entity, else earliest error; stale ones only when nothing fresh exists."""
    tier = F.when(critical, 0).when(error, 1)
    order = F.struct(tier.alias("t"), ts, key)
    agg = df.groupBy(entity).agg(
        F.min(F.when(~stale & tier.isNotNull(), order)).alias("fresh"), F.min(F.when(tier.isNotNull(), order)).alias("any"), F.bool_or(~stale).alias("has_fresh"))
    pick = F.when(_C("has_fresh"), _C("fresh")).otherwise(_C("any"))
    return agg.withColumn("p", pick).filter("p is not null").select(
        entity, _C(f"p.{key}").alias("root_id"), _C(f"p.{ts}").alias("root_ts"), F.when(_C("p.t") == 0, "critical").otherwise("error").alias("tier"))


def last_messages(df: DataFrame, conv: str, order: str, role: str, text: str, n: int = 8) -> DataFrame:
    """Last ``n`` messages of each conversation in time order, only user and assistant ones with text."""
    kept = first_k(df, [conv], [F.desc(order)], n).filter(_C(role).isin("user", "assistant") & (F.coalesce(F.length(text), _L(0)) > 0))
    return kept.drop("rn")


def carry_entity(df: DataFrame, conv: str, order: str, entity: str, chunk: int = 1024) -> DataFrame:
    """Last known entity at each turn, turns cut into chunks so that a huge conversation spreads over tasks."""
    return last_known(df, [conv], order, entity, bucket=F.floor(_C(order) / chunk), out="known_entity")


def check_transitions(df: DataFrame, entity: str, ts: str, key: str, state: str, fsm: Mapping[str, Sequence[str]], unit: str = "day") -> DataFrame:
    """State changes of each entity judged against the allowed pairs; the first state has no predecessor."""
    steps = previous_values(df.select(entity, ts, key, state), [entity], ts, [state], [key], unit)
    allowed = any_of([(_C(f"prev.{state}") == s) & _C(state).isin(list(to)) for s, to in fsm.items() if to])
    return steps.filter("prev is not null").select(entity, key, ts, _C(f"prev.{state}").alias("from_state"), _C(state).alias("to_state"), F.coalesce(allowed, _L(False)).alias("is_valid"))


def stuck_states(df: DataFrame, entity: str, ts: str, key: str, state: str, fsm: Mapping[str, Sequence[str]]) -> DataFrame:
    """Entities whose last state is known and not terminal."""
    last = df.groupBy(entity).agg(F.max(F.struct(ts, key, state)).alias("m"))
    nexts = first_match([(_C(f"m.{state}") == s, _L("|".join(to))) for s, to in fsm.items() if to], _L(None).cast("string"))
    return last.withColumn("allowed_next", nexts).filter("allowed_next is not null").select(entity, _C(f"m.{state}").alias("state"), _C(f"m.{ts}").alias("since"), "allowed_next")


SECTION_WORDS = {
    "context": ["contexte", "description", "présentation", "objet"],
    "symptoms": ["symptôme", "symptome", "problème", "probleme", "erreur", "message d'erreur"],
    "causes": ["cause", "origine", "raison", "diagnostic"],
    "procedure": ["procédure", "procedure", "résolution", "resolution", "action", "étapes", "étape", "marche à suivre", "manipulation"],
    "risks": ["risque", "attention", "avertissement", "impact", "précaution"],
    "checks": ["vérification", "verification", "contrôle", "controle", "check"],
}


def sectionize(df: DataFrame, doc: str, order: str, text: str, heading: str, words: Mapping[str, Sequence[str]] = SECTION_WORDS, min_len: int = 10, cap: int = 20, chunk: int = 4096) -> DataFrame:
    """Assign paragraphs to the section opened last and keep the first ``cap`` long lines of each section."""
    low = F.lower(text)
    opener = F.when(_C(heading) | (F.length(text) < 80), first_match([(matches_any(low, w), _L(s)) for s, w in words.items()], _L(None).cast("string")))
    filled = last_known(df.withColumn("_o", opener), [doc], order, "_o", bucket=F.floor(_C(order) / chunk), out="section").drop("_o")
    kept = filled.filter(_C("section").isNotNull() & (F.length(text) > min_len))
    return first_k(kept, [doc, "section"], [F.asc(order)], cap).withColumnRenamed("rn", "line_rank")


def rank_candidates(df: DataFrame, group: Sequence[str], cause: str, confidence: str, source: str) -> DataFrame:
    """Best candidate per root cause, ranked 1..n within its group by confidence, source and cause (all descending)."""
    keys = [*group, cause]
    best = df.groupBy(*keys).agg(F.max(F.struct(confidence, source)).alias("b")).select(*keys, "b.*")
    w = Window.partitionBy(*group).orderBy(F.desc(confidence), F.desc(source), F.desc(cause))
    return best.withColumn("rank", F.row_number().over(w))


def ticket_batches(df: DataFrame, cluster: str, key: str, text: str, n: int = 8) -> DataFrame:
    """One chunk per cluster with up to ``n`` tickets."""
    sizes = df.groupBy(cluster).agg(F.count("*").alias("ticket_count"))
    packed = first_k(df, [cluster], [F.asc(key)], n).groupBy(cluster).agg(F.array_sort(F.collect_list(F.struct("rn", _C(key).alias("k"), _C(text).alias("t")))).alias("a"))
    body = F.array_join(F.transform("a", lambda x: F.concat(_L("["), x["k"].cast("string"), _L("] "), x["t"])), "\n---\n")
    return packed.join(sizes, cluster).select(
        cluster, F.concat(_L("BATCH_"), _C("a")[0]["k"].cast("string"), _L("_x"), F.size("a").cast("string")).alias("chunk_id"),
        F.concat(_L("Exemples de tickets similaires ("), _C(cluster).cast("string"), _L("):\n"), body).alias("content"), "ticket_count")


# ---------------------------------------------------------------- queues and listings
def pending_queue(df: DataFrame, n: int, status: str, priority: str, created: str, tie: str, kind: str | None = None, kind_is: str | None = None, offset: int = 0) -> DataFrame:
    """Pending tasks by priority, then age."""
    q = df.filter(_C(status) == "pending")
    q = q.filter(_C(kind) == kind_is) if kind and kind_is is not None else q
    q = q.orderBy(F.desc(priority), F.asc(created), F.asc(tie)).offset(offset).limit(n)
    return q.withColumn("priority_label", F.when(_C(priority) >= 9, "high").when(_C(priority) >= 6, "medium").otherwise("low"))


REASON_PRIORITY = {"LOW_CONFIDENCE": 1, "MEDIUM_CONFIDENCE": 2, "UNKNOWN": 1, "RARE_CLASS": 2, "DRIFTED": 1, "NEW_PATTERN": 1}


def review_queue(df: DataFrame, n: int, reason: str, confidence: str, tie: str) -> DataFrame:
    """Rows to label next: by the priority of their reason, then least confident."""
    prio = first_match([(_C(reason) == r, _L(p)) for r, p in REASON_PRIORITY.items()], _L(3))
    return df.withColumn("priority", prio).withColumn("confidence_3", F.round(confidence, 3)).orderBy("priority", "confidence_3", tie).limit(n)


def list_clusters(df: DataFrame, size: str, min_size: int, tie: str, n: int, kind: str | None = None, kind_is: str | None = None) -> DataFrame:
    q = df.filter(_C(size) >= min_size)
    q = q.filter(_C(kind) == kind_is) if kind and kind_is is not None else q
    return q.orderBy(F.desc(size), F.asc(tie)).limit(n)


def topk(df: DataFrame, score: str, tie: str, k: int, floor: float | None = None) -> DataFrame:
    q = df if floor is None else df.filter(_C(score) > floor)
    return q.orderBy(F.desc(score), F.asc(tie)).limit(k)


def listing(df: DataFrame, filters: Mapping[str, object], order: Sequence[Column], offset: int, limit: int) -> DataFrame:
    """Equality filters, order, offset and limit; the sort keeps only offset + limit rows per task."""
    for col, value in filters.items():
        if value is not None:
            df = df.filter(_C(col) == value)
    return df.orderBy(*order).offset(offset).limit(limit)


# ---------------------------------------------------------------- filters
def threshold_or_topk(df: DataFrame, keys: Sequence[str], score: str, tie: str, threshold: float, k: int = 3) -> DataFrame:
    """Rows at the threshold; groups where none passes keep their best ``k`` anyway."""
    passed = df.filter(_C(score) >= threshold)
    rest = df.join(passed.select(*keys).distinct(), list(keys), "left_anti")
    return passed.unionByName(first_k(rest, keys, [F.desc(score), F.asc(tie)], k).drop("rn"))


def guard_blocks(df: DataFrame, text: Sequence[str], source: str, kind: str, score: str, locked: Sequence[str], excluded: Sequence[str], phase: str, keep_sources: Sequence[str] = ("diagnostic_engine",), keep_types: Sequence[str] = ("database_table",)) -> DataFrame:
    """Blocks that fit the incident: kept types pass, excluded systems go, locked systems must be named, score by phase."""
    threshold = fv.PHASE_THRESHOLDS[phase]
    if threshold is None:
        return df.limit(0)
    up = F.upper(F.concat_ws(" ", *text))
    always = _C(source).isin([*keep_sources, *keep_types]) | _C(kind).isin(list(keep_types))
    hundred = F.when(_C(score) <= 1.0, _C(score) * 100.0).otherwise(_C(score))
    fits = ~matches_any(up, [e.upper() for e in excluded]) if locked else _L(True)
    if phase != "diagnostic":
        if locked:
            fits = fits & matches_any(up, [s.upper() for s in locked])
        fits = fits & (hundred >= threshold)
    return df.filter(always | fits)


def flag_review(df: DataFrame, confidence: str, solution: str, threshold: float = 0.55) -> DataFrame:
    return df.withColumn("requires_human_review", (_C(confidence) < threshold) & (F.coalesce(F.trim(solution), _L("")) == ""))


def evidence_row(df: DataFrame, name: str, max_rows: int) -> DataFrame:
    """Row count (capped at ``max_rows``), truncation mark and confidence of one named check."""
    counted = df.limit(max_rows).agg(F.count("*").alias("row_count"))
    return counted.select(_L(name).alias("query_name"), "row_count", (_C("row_count") >= max_rows).alias("truncated"),
                          F.when(_C("row_count") > 0, 0.97).otherwise(0.5).alias("confidence"),
                          F.when(_C("row_count") == 0, "Insufficient evidence").alias("error"))


def with_durations(df: DataFrame, opened: str, closed: str) -> DataFrame:
    """MTTR in days, date, month and ISO week of the opening."""
    return (df.withColumn("mttr_days", F.round((F.unix_micros(_C(closed)) - F.unix_micros(_C(opened))) / 8.64e10, 6))
            .withColumn("day", F.to_date(opened)).withColumn("month", F.date_format(opened, "yyyy-MM"))
            .withColumn("week_start", F.to_date(F.date_trunc("week", opened))))
