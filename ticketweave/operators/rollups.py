"""Rollups of tickets, log events, corrections and reviews."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticketweave import fixed_values as fv
from ticketweave.functions.text import matches_any, stable_id
from ticketweave.operators.ordered import exact_quantile, first_k, k_samples

_C = F.col


def _ladder(value: Column, steps: Sequence[tuple], pick: int) -> Column:
    """First step whose threshold ``value`` reaches; the last step is the default."""
    out = F.lit(steps[-1][pick])
    for step in reversed(steps[:-1]):
        out = F.when(value >= step[0], F.lit(step[pick])).otherwise(out)
    return out


def value_counts(df: DataFrame, col: str, out: str = "n") -> DataFrame:
    return df.groupBy(col).agg(F.count("*").alias(out))


# ---------------------------------------------------------------- logs
def error_patterns(
    df: DataFrame, code: str = "error_code", level: str = "level", ts: str = "ts",
    service: str = "service", endpoint: str = "endpoint", upstream: str = "upstream_system",
    incident: str = "incident_type", message: str = "message",
) -> DataFrame:
    """One row per error code (else level): volume, distinct members, span, samples, trust band and action."""
    keyed = df.withColumn("pattern", F.coalesce(code, level))
    stats = keyed.groupBy("pattern").agg(
        F.count("*").alias("n"),
        *[F.count_distinct(F.when(_C(c) != "", _C(c))).alias(f"n_{name}")
          for c, name in ((service, "services"), (endpoint, "endpoints"), (upstream, "upstreams"), (incident, "incident_types"))],
        F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen"))
    samples = k_samples(keyed.withColumn("_m", F.substring(message, 1, 200)), ["pattern"], "_m", 3, "samples")
    return (stats.join(samples, "pattern", "left")
            .withColumn("trust_score", _ladder(_C("n"), fv.PATTERN_ACTIONS, 1))
            .withColumn("recommended_action", _ladder(_C("n"), fv.PATTERN_ACTIONS, 2)))


def pattern_members(df: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """The full member sets of each pattern in long form (key, kind, member), so no row grows with the data."""
    long = df.select(key, F.explode(F.array(*[
        F.struct(F.lit(c).alias("kind"), _C(c).cast("string").alias("member")) for c in cols])).alias("m"))
    return long.select(key, "m.kind", "m.member").filter((_C("member") != "")).distinct()


def mine_templates(
    df: DataFrame, template: str, exception: str, message: str, ts: str, sets: Sequence[str] = (), min_freq: int = 2,
) -> DataFrame:
    """Group by (exception, template) and keep frequent ones with up to five message samples."""
    keyed = df.withColumn("_e", F.coalesce(_C(exception), F.lit("")))
    keys = ["_e", template]
    stats = (keyed.groupBy(*keys).agg(
        F.count("*").alias("frequency"), F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen"),
        *[F.count_distinct(s).alias(f"n_{s}") for s in sets]).filter(_C("frequency") >= min_freq))
    samples = k_samples(keyed.withColumn("_m", F.substring(message, 1, 200)), keys, "_m", 5, "messages_sample")
    return (stats.join(samples, keys).withColumn("record_id", stable_id("LOG-", [_C("_e"), _C(template)], 12))
            .withColumnRenamed("_e", "exception"))


# ---------------------------------------------------------------- tickets
def ticket_distributions(df: DataFrame, dims: Sequence[str], codes: str, top: int = 20) -> DataFrame:
    """Long table (dimension, value, n) of each dimension, and of the ``top`` error codes."""
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(d).alias("dimension"), _C(d).cast("string").alias("value")) for d in dims])).alias("d"))
    counts = long.select("d.*").filter("value is not null").groupBy("dimension", "value").agg(F.count("*").alias("n"))
    top_codes = (df.select(F.explode(codes).alias("value")).groupBy("value").agg(F.count("*").alias("n"))
                 .orderBy(F.desc("n"), "value").limit(top).select(F.lit("error_code").alias("dimension"), "value", "n"))
    return counts.unionByName(top_codes)


def cluster_candidates(df: DataFrame, category: str, codes: str, summary: str, min_count: int = 3, keep: int = 10) -> DataFrame:
    """Categories worth a procedure: volume, share, dominant code and three samples."""
    total = df.agg(F.count("*")).scalar()
    base = df.groupBy(category).agg(F.count("*").alias("ticket_count")).filter(
        (_C("ticket_count") >= min_count) & (_C(category) != fv.DEFAULT_CATEGORY))
    code_counts = df.select(category, F.explode(codes).alias("code")).groupBy(category, "code").agg(F.count("*").alias("n"))
    dominant = first_k(code_counts, [category], [F.desc("n"), F.asc("code")], 1).select(
        category, _C("code").alias("dominant_error_code"))
    return (base.join(dominant, category, "left").join(k_samples(df, [category], summary, 3, "samples"), category, "left")
            .withColumn("percentage", F.round(_C("ticket_count") / total * 100, 1))
            .withColumn("canonical_candidate", _C("ticket_count") >= keep))


def resolution_rate(df: DataFrame, status: str) -> DataFrame:
    resolved = matches_any(F.lower(status), fv.RESOLVED_STATUS_WORDS)
    return df.agg(F.count("*").alias("total"), F.count_if(resolved).alias("resolved"),
                  F.round(F.count_if(resolved) / F.count("*") * 100, 1).alias("resolution_rate"))


def ticket_summary(df: DataFrame, intent: str, kind: str, lang: str, confidence: str, codes: str, review: str, top: int = 15) -> DataFrame:
    """Totals and top values as one long (metric, value, n) table."""
    totals = df.agg(
        F.count("*").cast("double").alias("total_tickets"), F.count_if(review).cast("double").alias("needs_human_review"),
        F.round(F.avg(confidence), 3).alias("avg_confidence"),
        F.count_if(F.size(codes) > 0).cast("double").alias("tickets_with_error_codes"))
    totals = totals.unpivot([], totals.columns, "value", "n").select(F.lit("total").alias("metric"), "value", "n")

    def best(col: str, n: int | None) -> DataFrame:
        counts = df.groupBy(_C(col).alias("value")).agg(F.count("*").cast("double").alias("n"))
        counts = counts if n is None else counts.orderBy(F.desc("n"), "value").limit(n)
        return counts.select(F.lit(col).alias("metric"), "value", "n")

    return totals.unionByName(best(intent, top)).unionByName(best(kind, top)).unionByName(best(lang, None))


def top_keywords(df: DataFrame, text: str, n: int = 50, pattern: str = fv.KEYWORD_PATTERN, stop: Sequence[str] = tuple(fv.KEYWORD_STOP_WORDS)) -> DataFrame:
    """Corpus-wide word frequency; the stop list is folded into the plan, words meet partially aggregated."""
    words = df.select(F.explode(F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))).alias("word"))
    return (words.filter(~_C("word").isin(list(stop))).groupBy("word").agg(F.count("*").alias("n"))
            .orderBy(F.desc("n"), "word").limit(n))


def dataset_stats(df: DataFrame, duration: str, dims: Sequence[str], top: int = 5) -> DataFrame:
    """Long table: volume, exact median duration and the top values of each dimension."""
    volume = df.agg(F.count("*").cast("double").alias("stat")).select(
        F.lit("volume").alias("metric"), F.lit("").alias("value"), "stat")
    median = exact_quantile(df, duration, 0.5, "stat").select(F.lit("mttr_median").alias("metric"), F.lit("").alias("value"), "stat")
    tops = [top_values(df, d, top).select(F.lit(d).alias("metric"), "value", _C("n").cast("double").alias("stat")) for d in dims]
    return reduce(DataFrame.unionByName, [volume, median, *tops])


def timeseries(df: DataFrame, ts: str, by: Sequence[str] = ()) -> DataFrame:
    return df.filter(_C(ts).isNotNull()).groupBy(F.to_date(ts).alias("day"), *by).agg(F.count("*").alias("volume"))


def top_values(df: DataFrame, col: str, n: int) -> DataFrame:
    """Top values, blanks left out, with the row total of the whole table."""
    total = df.agg(F.count("*")).scalar()
    return (df.filter(_C(col).isNotNull() & (F.trim(_C(col).cast("string")) != ""))
            .groupBy(_C(col).cast("string").alias("value")).agg(F.count("*").alias("n"))
            .orderBy(F.desc("n"), "value").limit(n).withColumn("total", total))


def kpi_summary(df: DataFrame, ts: str, duration: str, cause: str, category: str, codes: str, top: int = 10) -> DataFrame:
    """Executive figures as a long (metric, value, stat, pct) table; pct is of all rows."""
    volume = df.agg(F.count("*")).scalar()
    head = df.agg(F.count("*").cast("double").alias("volume"),
                  F.min(F.unix_date(F.to_date(ts))).cast("double").alias("first_day"),
                  F.max(F.unix_date(F.to_date(ts))).cast("double").alias("last_day"))
    head = head.unpivot([], head.columns, "metric", "stat").select(
        "metric", F.lit("").alias("value"), "stat", F.lit(None).cast("double").alias("pct"))
    median = exact_quantile(df, duration, 0.5, "stat").select(
        F.lit("mttr_median").alias("metric"), F.lit("").alias("value"), "stat", F.lit(None).cast("double").alias("pct"))

    def best(frame: DataFrame, name: str, share: bool) -> DataFrame:
        counted = (frame.filter("value <> ''").groupBy("value").agg(F.count("*").alias("n"))
                   .orderBy(F.desc("n"), "value").limit(top))
        pct = F.round(_C("n") / volume * 100, 1) if share else F.lit(None).cast("double")
        return counted.select(F.lit(name).alias("metric"), "value", _C("n").cast("double").alias("stat"), pct.alias("pct"))

    return (head.unionByName(median)
            .unionByName(best(df.select(_C(cause).alias("value")), "top_cause", True))
            .unionByName(best(df.select(_C(category).alias("value")), "top_category", True))
            .unionByName(best(df.select(F.explode(codes).alias("value")), "top_code", False)))


def weekly_volume(df: DataFrame, ts: str) -> DataFrame:
    return df.filter(_C(ts).isNotNull()).groupBy(F.to_date(F.date_trunc("week", ts)).alias("week")).agg(F.count("*").alias("volume"))


def correction_stats(df: DataFrame, label: str, kind: str, ts: str, tie: str, recent: int = 10) -> DataFrame:
    """Totals per label and per type, and the most recent rows, as one long table."""
    total = df.agg(F.count("*").alias("n")).select(F.lit("total").alias("metric"), F.lit("").alias("value"), "n")
    by = lambda c, name: value_counts(df, c).select(F.lit(name).alias("metric"), F.coalesce(_C(c), F.lit("Unknown")).alias("value"), "n")
    latest = (df.orderBy(F.desc(ts), F.desc(tie)).limit(recent)
              .select(F.lit("recent").alias("metric"), _C(tie).cast("string").alias("value"), F.lit(1).cast("long").alias("n")))
    return total.unionByName(by(label, "by_label")).unionByName(by(kind, "by_type")).unionByName(latest)


# ---------------------------------------------------------------- reviews and reports
def review_metrics(df: DataFrame, as_of: Column, kind: str, status: str, done_at: str, priority: str) -> DataFrame:
    """Overall row (type null) and one row per type from a single rollup."""
    done = _C(status).isin("validated", "rejected")
    n_done, n_ok = F.count_if(done), F.count_if(_C(status) == "validated")
    return df.rollup(kind).agg(
        F.count("*").alias("total"), n_done.alias("total_validations"), n_ok.alias("approved"),
        F.count_if(_C(status) == "rejected").alias("rejected"),
        F.count_if(_C(status) == "pending").alias("pending"),
        F.count_if((_C(status) == "pending") & (_C(priority) >= 9)).alias("high_priority_pending"),
        F.count_if(done & (_C(done_at) >= as_of - F.expr("INTERVAL 7 DAYS"))).alias("weekly_validations"),
        F.round(F.coalesce(F.try_divide(n_ok * 100.0, n_done), F.lit(0.0)), 2).alias("accuracy_rate"),
        F.round(n_done / F.greatest(F.count("*"), F.lit(1)) * 100, 1).alias("validation_rate"))


def report_patterns(df: DataFrame, component: str, severity: str, status: str, opened: str, closed: str, top: int = 10) -> DataFrame:
    """Incident-report patterns as a long (metric, value, stat) table."""
    resolved = _C(status) == "resolved"
    hours = (F.unix_micros(_C(closed)) - F.unix_micros(_C(opened))) / 3.6e9
    head = df.agg(
        F.count("*").cast("double").alias("total"), F.count_if(resolved).cast("double").alias("resolved"),
        F.round(F.count_if(resolved) / F.greatest(F.count("*"), F.lit(1)) * 100, 2).alias("resolution_rate"),
        F.coalesce(F.round(F.avg(F.when(resolved, hours)), 2), F.lit(0.0)).alias("avg_resolution_hours"))
    head = head.unpivot([], head.columns, "metric", "stat").select("metric", F.lit("").alias("value"), "stat")
    comp = value_counts(df, component).orderBy(F.desc("n"), component).limit(top)
    return (head
            .unionByName(comp.select(F.lit("component").alias("metric"), _C(component).cast("string").alias("value"), _C("n").cast("double").alias("stat")))
            .unionByName(value_counts(df, severity).select(F.lit("severity").alias("metric"), _C(severity).cast("string").alias("value"), _C("n").cast("double").alias("stat"))))


def status_breakdown(df: DataFrame, status: str, buckets: Mapping[str, Sequence[str]] = fv.STATUS_BUCKETS) -> DataFrame:
    """Counts per bucket (open, in progress, ...) and per raw status."""
    counts = value_counts(df, status)
    bucketed = counts.agg(*[F.coalesce(F.sum(F.when(_C(status).isin(list(v)), _C("n"))), F.lit(0)).alias(b) for b, v in buckets.items()])
    bucketed = bucketed.unpivot([], list(buckets), "value", "n").select(F.lit("bucket").alias("metric"), "value", "n")
    return bucketed.unionByName(counts.select(F.lit("status").alias("metric"), F.coalesce(_C(status), F.lit("Unknown")).alias("value"), "n"))


def queue_stats(df: DataFrame, status: str, reason: str) -> DataFrame:
    reviewed = _C(status).isin("reviewed", "corrected")
    head = df.agg(
        F.count("*").cast("double").alias("total"), F.count_if(_C(status) == "pending").cast("double").alias("pending"),
        F.count_if(reviewed).cast("double").alias("reviewed"), F.count_if(_C(status) == "corrected").cast("double").alias("corrected"),
        F.round(F.count_if(reviewed) / F.greatest(F.count("*"), F.lit(1)) * 100, 1).alias("review_rate"))
    head = head.unpivot([], head.columns, "value", "stat").select(F.lit("total").alias("metric"), "value", "stat")
    return head.unionByName(value_counts(df, reason).select(
        F.lit("by_reason").alias("metric"), F.coalesce(_C(reason), F.lit("?")).alias("value"), _C("n").cast("double").alias("stat")))


def review_ledger(events: DataFrame, task: str, ts: str, tie: str, action: str, base_priority: str) -> DataFrame:
    """Current status, priority and net trust per task from its review actions.

    approve +.15, reject -.20, correct and escalate change no trust; escalate sets priority 10.
    """
    status = (F.when(_C(action) == "approve", "validated").when(_C(action) == "correct", "validated")
              .when(_C(action) == "reject", "rejected"))
    delta = F.when(_C(action) == "approve", F.lit(0.15)).when(_C(action) == "reject", F.lit(-0.20)).otherwise(F.lit(0.0))
    order = F.struct(ts, tie)
    return events.groupBy(task).agg(
        F.count("*").alias("n_actions"),
        F.coalesce(F.max_by(status, F.when(status.isNotNull(), order)), F.lit("pending")).alias("status"),
        F.when(F.bool_or(_C(action) == "escalate"), F.lit(10)).otherwise(F.max(base_priority)).alias("priority"),
        F.round(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.sum(delta))), 4).alias("net_trust"))


def update_trust(kb: DataFrame, tasks: DataFrame, as_of: Column, status: str, done_at: str, trust: str) -> DataFrame:
    """More than five approvals in seven days lift every trust above .6 by .02, capped at .95."""
    recent = tasks.filter((_C(status) == "validated") & (_C(done_at) > as_of - F.expr("INTERVAL 7 DAYS")))
    approved = recent.agg(F.count("*")).scalar()
    lifted = (approved > 5) & (_C(trust) > 0.6)
    return kb.withColumn("new_trust", F.when(lifted, F.round(F.least(F.lit(0.95), _C(trust) + 0.02), 4)).otherwise(_C(trust)))


# ---------------------------------------------------------------- learning
def _hypothesis_confidence(success: Column, failure: Column, visits: Column, factor: Column) -> Column:
    rate = F.when(success + failure == 0, F.lit(0.5)).otherwise(success / (success + failure))
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (rate * 0.7 + F.log(1 + visits) * 0.08) * factor)), 4)


def hypothesis_stats(df: DataFrame, hypothesis: str, outcome: str, ts: str, factors: DataFrame | None = None) -> DataFrame:
    """Visits, outcomes, composite confidence and tier per hypothesis; ``factors`` (hypothesis, factor) suppress."""
    agg = df.groupBy(hypothesis).agg(
        F.count("*").alias("visit_count"), F.count_if(_C(outcome) == "success").alias("success_count"),
        F.count_if(_C(outcome) == "failure").alias("failure_count"), F.max(ts).alias("last_seen"))
    if factors is None:
        agg = agg.withColumn("factor", F.lit(1.0))
    else:
        agg = agg.join(factors, hypothesis, "left").withColumn("factor", F.coalesce("factor", F.lit(1.0)))
    score = _hypothesis_confidence(_C("success_count"), _C("failure_count"), _C("visit_count"), _C("factor"))
    return agg.withColumn("confidence", score).withColumn(
        "tier", F.when(_C("confidence") >= 0.70, "HIGH").when(_C("confidence") >= 0.40, "MEDIUM").otherwise("LOW"))


def suppression(reports: DataFrame, hypothesis: str, threshold: int = 3) -> DataFrame:
    """Penalty and multiplicative factor of hypotheses reported at least ``threshold`` times."""
    extra = _C("n_reports") - threshold + 1
    return (reports.filter(_C(hypothesis).isNotNull()).groupBy(hypothesis).agg(F.count("*").alias("n_reports"))
            .filter(_C("n_reports") >= threshold)
            .withColumn("delta", F.round(-F.least(F.lit(0.5), extra * 0.1), 4))
            .withColumn("factor", F.round(F.pow(F.lit(0.8), extra), 4)))


def rebalance(edges: DataFrame, weight: str) -> DataFrame:
    """Divide all weights by the global maximum once it exceeds 1.05."""
    top = edges.agg(F.max(weight)).scalar()
    return edges.withColumn("new_weight", F.when(top > 1.05, F.round(_C(weight) / top, 4)).otherwise(_C(weight)))


def compact(df: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """Keep the first row of each id, then the last ``n`` of those."""
    firsts = df.groupBy(key).agg(F.min_by(F.struct(*df.columns), _C(order)).alias("r")).select("r.*")
    return firsts.orderBy(F.desc(order)).limit(n)


def promote_patterns(df: DataFrame, stats: DataFrame | None, hypothesis: str, entity: str, score: str, tie: str, min_count: int = 3, min_rate: float = 0.7) -> DataFrame:
    """Weak patterns seen often enough and successful enough; the best-scored one represents the group.

    ``stats`` holds (hypothesis, success_rate); groups without it fall back on their mean score.
    """
    groups = df.groupBy(_C(hypothesis), F.upper(entity).alias("entity_key")).agg(
        F.count("*").alias("turn_count"), F.avg(score).alias("mean_score"),
        F.max_by(F.struct(*[c for c in df.columns if c != hypothesis]), F.struct(_C(score), -_C(tie))).alias("best")).filter(_C("turn_count") >= min_count)
    groups = groups.join(stats, hypothesis, "left") if stats is not None else groups.withColumn("success_rate", F.lit(None).cast("double"))
    return (groups.withColumn("rate", F.coalesce("success_rate", "mean_score")).filter(_C("rate") >= min_rate)
            .withColumn("confidence", F.lit(0.80)))


def entity_memory(df: DataFrame, entity: str, cause: str, pattern: str, outcome: str, ts: str, keep: int = 20) -> DataFrame:
    """Cause frequencies and the last distinct success / failure patterns per entity, newest first."""
    keyed = df.withColumn("entity_key", F.upper(entity))
    causes = (keyed.groupBy("entity_key", cause).agg(F.count("*").alias("n")).groupBy("entity_key")
              .agg(F.array_sort(F.collect_list(F.struct(_C(cause).alias("cause"), "n"))).alias("frequent_causes"),
                   F.sum("n").alias("n_outcomes")))
    # A pattern keeps the place of its first arrival: repeats are ignored while it is listed.
    firsts = keyed.filter(_C(outcome).isin("success", "failure")).groupBy("entity_key", outcome, pattern).agg(F.min(ts).alias("at"))
    last = first_k(firsts, ["entity_key", outcome], [F.desc("at"), F.asc(pattern)], keep)
    lists = last.groupBy("entity_key").agg(*[
        F.transform(F.array_sort(F.collect_list(F.when(_C(outcome) == o, F.struct("rn", _C(pattern).alias("p"))))), lambda x: x["p"]).alias(f"{o}_patterns")
        for o in ("success", "failure")])
    return causes.join(lists, "entity_key", "left")


def draft_procedures(df: DataFrame, app: str, kind: str, response: str, reason: str, order: str, max_steps: int | None = None) -> DataFrame:
    """Draft (application, type) procedures: one row per group of two or more corrections."""
    named = df.withColumn("proc_key", F.concat_ws("::", app, kind))
    return (named.groupBy(app, kind, "proc_key").agg(
                F.count("*").alias("n_corrections"), F.count_distinct(F.when(_C(reason) != "", _C(reason))).alias("n_symptoms"))
            .filter(_C("n_corrections") >= 2)
            .withColumn("procedure_id", stable_id("DRAFT-", [_C("proc_key")], 8))
            .withColumn("title", F.concat(F.lit("[DRAFT N3] "), _C(kind), F.lit(" — "), _C(app)))
            .withColumn("trust_score", F.lit(0.70)).drop("proc_key"))


def draft_steps(df: DataFrame, app: str, kind: str, response: str, order: str) -> DataFrame:
    """Numbered resolution steps of each draft, one row per step, so a hot group stays spread over tasks."""
    kept = df.filter(F.length(response) > 0).withColumn("_t", F.substring(response, 1, 300))
    steps = kept.groupBy(app, kind, "_t").agg(F.min(order).alias("_o"))
    bucket = steps.withColumn("_b", F.floor(_C("_o") / 4096))
    inside = bucket.withColumn("_i", F.row_number().over(Window.partitionBy(app, kind, "_b").orderBy("_o", "_t")))
    sizes = bucket.groupBy(app, kind, "_b").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_off", F.coalesce(F.sum("_n").over(
        Window.partitionBy(app, kind).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    return (inside.join(before, [app, kind, "_b"]).withColumn("step", _C("_i") + _C("_off"))
            .select(app, kind, "step", F.concat(_C("step"), F.lit(". "), _C("_t")).alias("text")))


def solution_index(df: DataFrame, label: str, solution: str, top: int = 20, per_label: int = 10) -> DataFrame:
    """Known solutions of the most frequent labels as one text per label."""
    valid = df.filter(_C(label).isNotNull() & (F.length(solution) > 10)).withColumn("_s", F.trim(solution))
    labels = value_counts(valid, label, "ticket_count").orderBy(F.desc("ticket_count"), label).limit(top)
    kept = k_samples(valid, [label], "_s", per_label, "solutions")
    return labels.join(kept, label).withColumn("solution_text", F.array_join(
        F.transform("solutions", lambda s: F.concat(F.lit("• "), F.substring(s, 1, 500))), "\n---\n"))


def summarize_clusters(df: DataFrame, cluster: str, kind: str, app: str, intent: str, codes: str) -> DataFrame:
    """Size, majority type and application, top codes and intents, name and trust band per cluster."""
    def majority(col: str, out: str) -> DataFrame:
        counts = df.groupBy(cluster, col).agg(F.count("*").alias("n"))
        return first_k(counts, [cluster], [F.desc("n"), F.asc(col)], 1).select(cluster, _C(col).alias(out))

    def best(counts: DataFrame, value: str, out: str) -> DataFrame:
        return (first_k(counts, [cluster], [F.desc("n"), F.asc(value)], 3).groupBy(cluster)
                .agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", _C(value).alias("v")))), lambda x: x["v"]).alias(out)))

    code_counts = df.select(cluster, F.explode(codes).alias("code")).groupBy(cluster, "code").agg(F.count("*").alias("n"))
    intents = df.groupBy(cluster, intent).agg(F.count("*").alias("n"))
    out = (df.groupBy(cluster).agg(F.count("*").alias("size"))
           .join(majority(kind, "incident_type"), cluster).join(majority(app, "application"), cluster)
           .join(best(code_counts, "code", "top_error_codes"), cluster, "left").join(best(intents, intent, "top_intents"), cluster))
    first = F.lower(F.replace(F.get("top_error_codes", F.lit(0)), F.lit(" "), F.lit("_")))
    return (out.withColumn("trust_score", _ladder(_C("size"), [(20, 0.65), (10, 0.55), (5, 0.48), (0, 0.35)], 1))
            .withColumn("cluster_name", F.when(first.isNotNull(), F.concat_ws("_", first, F.split_part(_C("incident_type"), F.lit("."), F.lit(1))))
                        .otherwise(F.concat(F.lit("cluster_"), F.substring(F.md5(_C("incident_type").cast("binary")), 1, 8)))))


def artifact_stats(df: DataFrame, language: str, lines: str, size: str) -> DataFrame:
    """Files, lines and bytes per language, with the grand total as the row without language."""
    return df.rollup(language).agg(F.count("*").alias("files"), F.sum(lines).alias("lines"), F.sum(size).alias("bytes"))


def movement_profile(df: DataFrame, entity: str, ts: str, state: str, service: str, before: str) -> DataFrame:
    """Long profile per entity: span, counts per service and histogram of ``before -> state`` steps."""
    return (df.select(entity, ts, F.explode(F.array(
                F.struct(F.lit("all").alias("kind"), F.lit("").alias("name")),
                F.struct(F.lit("service").alias("kind"), _C(service).cast("string").alias("name")),
                F.struct(F.lit("transition").alias("kind"), F.concat(F.coalesce(_C(before), F.lit("")), F.lit("→"), _C(state)).alias("name")))).alias("m"))
            .groupBy(entity, "m.kind", "m.name").agg(F.count("*").alias("n"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts")))


def ticket_patterns(df: DataFrame, text: str, status: str, summary: str, resolved: Sequence[str] = ("Resolved", "Closed", "Done")) -> DataFrame:
    """Light patterns: key is the first four-digit code, else the first keyword."""
    code = F.nullif(F.regexp_extract(text, r"\b(\d{4})\b", 1), F.lit(""))
    words = F.regexp_extract_all(F.lower(text), F.lit(fv.KEYWORD_PATTERN), F.lit(0))
    word = F.get(F.filter(words, lambda w: ~w.isin(fv.KEYWORD_STOP_WORDS)), F.lit(0))
    keyed = df.withColumn("pattern", F.coalesce(code, word, F.lit("unknown")))
    stats = keyed.groupBy("pattern").agg(F.count("*").alias("n"), F.bool_or(_C(status).isin(list(resolved))).alias("has_resolution"))
    samples = k_samples(keyed.withColumn("_s", F.substring(summary, 1, 80)), ["pattern"], "_s", 3, "samples")
    return stats.join(samples, "pattern", "left").withColumn("hash", F.substring(F.md5(_C("pattern").cast("binary")), 1, 8))


def daily_activity(df: DataFrame, as_of: str, ts: str, conversation: str, days: int = 7) -> DataFrame:
    """Conversations and messages of each of the last ``days`` days before ``as_of``, empty days included."""
    spark = df.sparkSession
    calendar = spark.range(days).select(F.date_sub(F.lit(as_of).cast("date"), F.col("id").cast("int") + 1).alias("day"))
    first, last = F.date_sub(F.lit(as_of).cast("date"), days), F.lit(as_of).cast("date")
    counts = (df.filter((_C(ts) >= first) & (_C(ts) < last)).groupBy(F.to_date(ts).alias("day"))
              .agg(F.count_distinct(conversation).alias("conversations"), F.count("*").alias("messages")))
    return calendar.join(counts, "day", "left").na.fill(0, ["conversations", "messages"])


# ---------------------------------------------------------------- evidence
_FLAGS = {
    "check_residual_references": ("has_residuals", 0.98), "check_active_services": ("has_active_services", 0.97),
    "check_mrt_dslam_links": ("has_active_links", 0.96), "check_vc_counters": ("has_occupied_vc", 0.96),
    "get_blocked_tps": ("has_blocked_tp", 0.97), "check_shared_port_links": ("has_shared_ports", 0.96),
    "check_port_remarks_anomaly": ("has_charset_anomaly", 0.93), "check_blocked_dlm": ("has_blocked_dlm", 0.95),
    "get_equipment_id": ("found", None), "check_equipment_status": ("found", None),
}


def normalize_evidence(df: DataFrame, query: str, amount: str, member: str) -> DataFrame:
    """Evidence rows of named checks -> one row per check with its flag, count, total and confidence."""
    flag = F.lit("has_data")
    conf = F.lit(0.97)
    for name, (f, cf) in _FLAGS.items():
        flag = F.when(_C(query) == name, F.lit(f)).otherwise(flag)
        conf = F.when(_C(query) == name, F.lit(cf).cast("double")).otherwise(conf)
    agg = df.groupBy(query).agg(F.count("*").alias("n"), F.sum(amount).alias("total"), F.count_distinct(member).alias("n_members"))
    raised = F.when(_C(query) == "check_residual_references", _C("total") > 0).otherwise(_C("n") > 0)
    return agg.withColumn("flag", flag).withColumn("raised", raised).withColumn("confidence", conf)


def log_evidence_summary(df: DataFrame, patterns: DataFrame, pattern: str, code: str) -> DataFrame:
    """Match count and distinct codes per search pattern, with known pattern info attached to each code."""
    per_code = df.groupBy(pattern, code).agg(F.count("*").alias("n"))
    joined = per_code.join(patterns, code, "left")
    return joined.groupBy(pattern).agg(
        F.sum("n").alias("match_count"), F.count(code).alias("n_codes"),
        F.count("root_cause").alias("n_known"), F.min("root_cause").alias("first_root_cause"))


def telling_signatures(signatures: DataFrame, on: str, causes: str, known: str, known_conf: str, k: int = 5) -> DataFrame:
    """(on, causes, known, known_conf): few rows for each ``on`` that give an event the probable causes that all its signatures give.

    Those are the best ``k`` causes listed, the ``k`` highest confidences of a known resolution (its text depends on the event
    alone), and one row that names nothing where a signature does, which still lets the heuristic stand.
    """
    listed = F.coalesce(F.size(causes) > 0, F.lit(False))
    single = signatures.filter(listed).select(on, F.explode(causes).alias("_x")).distinct()
    best = first_k(single, [on], [F.desc("_x.probability"), F.asc("_x.cause")], k)
    first = best.select(on, F.array("_x").alias(causes), F.lit(None).cast(signatures.schema[known].dataType).alias(known), F.lit(None).cast("double").alias(known_conf))
    rest = signatures.filter(~listed).select(on, F.lit(None).cast(signatures.schema[causes].dataType).alias(causes), known, _C(known_conf).cast("double").alias(known_conf))
    told = rest.filter(_C(known).isNotNull()).groupBy(on, causes, F.coalesce(known_conf, F.lit(0.5)).alias(known_conf)).agg(F.first(known).alias(known))
    told = first_k(told, [on], [F.desc(known_conf)], k).select(on, causes, known, known_conf)
    return first.unionByName(told).unionByName(rest.filter(_C(known).isNull()).select(on, causes, known, F.lit(None).cast("double").alias(known_conf)).dropDuplicates([on]))


def probable_causes(matches: DataFrame, event: str, causes: str, known: str, known_conf: str, error_type: str, module: str, k: int = 5) -> DataFrame:
    """Top causes per event: listed causes, else the known resolution, else a heuristic at .4."""
    kind = F.coalesce(_C(error_type), F.lit("erreur"))
    where = F.coalesce(_C(module), F.lit("module"))
    fallback = F.when(_C(known).isNotNull(), F.array(F.struct(
        F.concat(F.lit("Pattern connu: "), kind, F.lit(" dans "), where).alias("cause"),
        F.coalesce(_C(known_conf), F.lit(0.5)).alias("probability"))))
    heuristic = F.when(_C(error_type).isNotNull(), F.array(F.struct(
        F.concat(_C(error_type), F.lit(" dans "), F.coalesce(_C(module), F.lit("module inconnu"))).alias("cause"), F.lit(0.4).alias("probability"))))
    real = F.coalesce(F.when(F.size(causes) > 0, _C(causes)), fallback)
    rows = matches.select(event, F.explode(real).alias("x")).select(event, "x.*")
    # The heuristic only stands when no match of the event names a cause.
    guess = (matches.select(event, F.explode(heuristic).alias("x")).select(event, "x.*")
             .join(rows.select(event).distinct(), event, "left_anti"))
    best = first_k(rows.unionByName(guess).distinct(), [event], [F.desc("probability"), F.asc("cause")], k)
    return best.withColumnRenamed("rn", "rank")


def operation_profile(nodes: DataFrame, name: str, role: str, value: str, operations: Sequence[str]) -> DataFrame:
    """Members per (operation keyword, role); keywords are folded into the projection, so each node is read once."""
    hits = F.filter(F.array(*[F.when(F.contains(F.lower(name), F.lit(o)), F.lit(o)) for o in operations]), lambda x: x.isNotNull())
    return (nodes.select(F.explode(hits).alias("operation"), role, value)
            .groupBy("operation", role).agg(F.count_distinct(value).alias("n_members"), F.min(value).alias("first_member"), F.max(value).alias("last_member")))
