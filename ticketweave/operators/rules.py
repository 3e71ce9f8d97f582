"""Rules over evidence, states, answers and checks; rules are SQL expressions folded into one projection."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketweave.functions.text import any_of, first_match, matches_any
from ticketweave.operators.ordered import first_k
from ticketweave.operators.windows import rank_candidates

_C, _L = F.col, F.lit


def _kept(rows: Sequence[Column]) -> Column:
    return F.filter(F.array(*rows), lambda x: x.isNotNull())


def evaluate_rules(df: DataFrame, key: str, intent: str, rules: Sequence[tuple[str, str, str, bool]]) -> DataFrame:
    """Rules (id, intent, SQL predicate, blocking) per row: verdict, fired and warning ids."""
    fired = lambda blocking: _kept([F.when((_C(intent) == i) & F.coalesce(F.expr(p), _L(False)), _L(r)) for r, i, p, b in rules if b == blocking]) if any(b == blocking for *_, b in rules) else F.array().cast("array<string>")
    out = df.select(key, intent, fired(True).alias("fired"), fired(False).alias("warnings"))
    return out.withColumn("blocked", F.size("fired") > 0)


STATE_FSM = {"P": ["A", "F", "S"], "A": ["F", "C", "S", "P"], "F": ["A", "S"], "C": ["S"], "S": []}


def diagnose_state(df: DataFrame, key: str, status: str, services: str, links: str, cards: str, ack: str, other: str, target: str, fsm: Mapping[str, Sequence[str]] = STATE_FSM) -> DataFrame:
    """Validity, transience, orphanhood, inconsistency and legality of the wanted transition per equipment."""
    st = F.upper(F.trim(_C(status)))
    known = st.isin(list(fsm))
    orphan = (st == "A") & (_C(services) == 0) & (_C(links) == 0) & (_C(cards) == 0)
    no_ack = st.isin("A", "P") & (_C(ack) == _L(False))
    differs = _C(other).isNotNull() & (F.upper(other) != st)
    legal = any_of([(st == s) & _C(target).isin(list(t)) for s, t in fsm.items() if t])
    no = lambda c: F.coalesce(c, _L(False))
    return df.select(
        key, F.when(no(orphan), "ORPHAN").when(no(known), st).otherwise("INCONSISTENT").alias("state"),
        no(known).alias("is_valid"), no(st == "P").alias("is_transient"), no(orphan).alias("is_orphan"), (no(no_ack) | no(differs)).alias("is_inconsistent"),
        F.when(_C(target).isNull(), _L(True)).otherwise(no(legal) & ~((_C(target) == "S") & no(st == "P"))).alias("transition_allowed"))


DLQ_SIGNALS = ["dead.letter", "dlq", "dead letter"]
TIMEOUT_SIGNALS = ["timeout", "timed out", "délai"]
ROLLBACK_SIGNALS = ["rollback", "rolled back"]


def sync_anomalies(df: DataFrame, key: str, status: str, ack: str, orchestra: str, other: str, log: str, services: str, links: str) -> DataFrame:
    """(key, anomaly, severity, confidence) rows from seven detectors, each a conditional struct of one array."""
    st, low = F.upper(_C(status)), F.lower(F.coalesce(_C(log), _L("")))
    active = st.isin("A", "ACTIF", "ACTIVE")
    mk = lambda cond, name, sev, conf: F.when(cond, F.struct(_L(name).alias("anomaly"), _L(sev).alias("severity"), _L(conf).alias("confidence")))
    rows = [
        mk(active & (_C(ack) == _L(False)), "SYNC_DB_MQ", "CRITICAL", 0.92), mk(st != F.upper(orchestra), "SYNC_DB_ORCH", "HIGH", 0.85),
        mk(st != F.upper(other), "SYNC_DB_42C", "HIGH", 0.85), mk(matches_any(low, DLQ_SIGNALS), "SYNC_DLQ", "CRITICAL", 0.85),
        mk(matches_any(low, TIMEOUT_SIGNALS), "SYNC_TIMEOUT", "HIGH", 0.85), mk(matches_any(low, ROLLBACK_SIGNALS), "SYNC_ROLLBACK", "HIGH", 0.85),
        mk(st.isin("A", "ACTIF") & (_C(services) == 0) & (_C(links) == 0), "SYNC_ORPHAN", "MEDIUM", 0.85)]
    return df.select(key, F.explode(_kept(rows)).alias("a")).select(key, "a.*")


# query -> (root cause, boost); root cause -> base confidence
CANDIDATE_QUERIES = [
    ("check_residual_references", "equipment_has_residual_data", 0.02), ("check_active_services", "equipment_has_residual_data", 0.01),
    ("check_vlan_residual_resources", "vlan_residual_resources", 0.0), ("get_blocked_tps", "tp_blocked_status_1", 0.0),
    ("check_vc_counters", "vc_counters_incorrect", 0.0), ("check_shared_port_links", "port_shared_between_links", 0.0),
    ("check_port_remarks_anomaly", "charset_anomaly_t_remarks", 0.0), ("check_blocked_dlm", "dlm_blocked", 0.0),
    ("check_bas_residual_data", "bas_residual_data", 0.0), ("check_operator_mrt_links", "operator_has_mrt_links", 0.0),
]
INTENT_FALLBACKS = {
    "delete_equipment": "equipment_has_residual_data", "delete_vlan": "vlan_residual_resources", "fix_blocked_tp": "tp_blocked_status_1",
    "fix_ihm_blocked": "ihm_blocked_dsm_param", "delete_bas": "bas_residual_data", "delete_operator": "operator_has_mrt_links", "delete_card": "card_deletion_blocked",
}


def resolution_candidates(evidence: DataFrame, case: str, query: str, raised: str, confidences: Mapping[str, float], incidents: DataFrame | None = None, intent: str = "intent", fresh: str = "fresh") -> DataFrame:
    """Ranked root causes per case from raised checks; an intent adds its fallback when fresh evidence backs it.

    ``evidence`` (case, query, raised); ``incidents`` (case, intent, fresh).
    """
    base = lambda cause: first_match([(cause == c, _L(float(v))) for c, v in confidences.items()], _L(None).cast("double"))
    hit = first_match([(_C(query) == q, F.struct(_L(c).alias("root_cause"), _L(b).alias("boost"))) for q, c, b in CANDIDATE_QUERIES], _L(None).cast("struct<root_cause:string,boost:double>"))
    found = evidence.filter(raised).select(case, hit.alias("h")).select(case, "h.*", _L("live_db").alias("source"))
    rows = found.filter(base(_C("root_cause")).isNotNull()).withColumn("confidence", F.least(_L(1.0), base(_C("root_cause")) + _C("boost"))).drop("boost")
    if incidents is not None:
        fb = first_match([(_C(intent) == i, _L(c)) for i, c in INTENT_FALLBACKS.items()], _L(None).cast("string"))
        extra = (incidents.filter(fresh).select(case, fb.alias("root_cause")).filter("root_cause is not null")
                 .join(rows.select(case, "root_cause").distinct(), [case, "root_cause"], "left_anti"))
        extra = extra.withColumn("confidence", base(_C("root_cause")) - 0.10).filter("confidence >= 0.5").select(case, "root_cause", _L("intent_fallback").alias("source"), "confidence")
        rows = rows.unionByName(extra)
    return rank_candidates(rows.withColumn("confidence", F.round("confidence", 6)), [case], "root_cause", "confidence", "source")


def fresh_only(df: DataFrame, ts: str, as_of: Column, max_age: int = 3600) -> DataFrame:
    """Evidence with a time that is neither in the future nor older than ``max_age`` seconds."""
    age = (F.unix_micros(as_of) - F.unix_micros(_C(ts))) / 1e6
    return df.filter(_C(ts).isNotNull() & (age >= 0) & (age <= max_age))


def tag_stale(df: DataFrame, ts: str, severity: str, tags: str, as_of: Column, hours: int = 48) -> DataFrame:
    """Future rows get a tag; rows older than ``hours`` get a tag and lose error severity."""
    future = _C(ts) > as_of
    stale = ~future & (F.unix_micros(as_of) - F.unix_micros(_C(ts)) > hours * 3_600_000_000)
    add = lambda t: F.array_distinct(F.array_append(_C(tags), _L(t)))
    return (df.withColumn(tags, F.when(future, add("future_timestamp")).when(stale, add("stale")).otherwise(_C(tags)))
            .withColumn(severity, F.when(stale & _C(severity).isin("error", "critical"), "info").otherwise(_C(severity))))


# ordered event patterns on the lower-cased line: (pattern, type, severity)
EVENT_PATTERNS = [
    (r"jmsexception|messagenotdeliveredexception|javax\.jms", "mq_error", "error"), (r"dead\.letter|dlq|dead.letter.queue", "dlq_event", "critical"),
    (r"ack|acknowledgement|acknowledged", "mq_ack", "info"), (r"send.*message|message.*sent|publish.*topic", "mq_send", "info"),
    (r"consume|received.*message|message.*received", "mq_receive", "info"), (r"connectionfactory|broker.*unreachable|cannot connect.*broker", "mq_broker_down", "critical"),
    (r"createmovement|makemouvement", "epc_movement_start", "info"), (r"completemovement|completedeletion", "epc_movement_complete", "info"),
    (r"makingfile.*state|state.*makingfile|mkfl_state", "makingfile_state_change", "info"), (r"constraintviolationexception", "constraint_violation", "error"),
    (r"internal_error", "internal_error", "error"), (r"affectationexception|dslam.affectation", "affectation_error", "error"),
    (r"brochesearchexception|erreur.30[0-9]|port.*attribuable.*false", "broche_error", "error"), (r"connectorcreationvlanexception", "vlan_creation_error", "error"),
    (r"erreur.1300|noeud.ip.absent|eqpt_status.*f", "error_1300", "error"), (r"retry|retrying|tentative.*\d+|attempt.*\d+", "retry_attempt", "warning"),
    (r"timeout|timed out|délai.*expiré", "timeout", "error"), (r"rollback|transaction.*rolled.back", "rollback", "warning"),
    (r"script.*running|es_state.*1|état.*running|lancement.*script", "script_running", "info"), (r"script.*done|es_state.*4|script.*terminé", "script_done", "info"),
    (r"script.*error|es_state.*2|script.*erreur", "script_error", "error"), (r"script.*warning|es_state.*3", "script_warning", "warning"),
    (r"eqpt_status.*=.*[afpcs]|update.*t_equipments.*status", "db_eqpt_state", "info"), (r"epcv_currentstate|epc.*state|epc.*état", "db_epc_state", "info"),
    (r"orchestra", "orchestra_sync", "info"), (r"42c|affectationmanager|manageaffectation", "42c_interaction", "info"),
    (r"orphan|residual|résiduel|stale", "orphan_detected", "warning"),
]
ERROR_WORDS = ["exception", "error", "erreur", "failed", "failure"]


def type_events(df: DataFrame, line: str, patterns: Sequence[tuple[str, str, str]] = tuple(EVENT_PATTERNS)) -> DataFrame:
    """Event type and severity by the first matching pattern, else error words; other lines are dropped."""
    low = F.lower(line)
    mk = lambda t, s: F.struct(_L(t).alias("typed"), _L(s).alias("severity"))
    hit = first_match([(low.rlike(p), mk(t, s)) for p, t, s in patterns], F.when(matches_any(low, ERROR_WORDS), mk("unclassified_error", "error")))
    return df.withColumn("_h", hit).filter("_h is not null").select(*df.columns, "_h.*")


SOURCE_BASE = {"user": 0.5, "kb": 0.7, "jira": 0.65, "log": 0.8, "diagnostic": 0.85, "ml": 0.75}


def correlate_sources(df: DataFrame, case: str, source: str, text: str, rules: Sequence[tuple[str, str]], min_conf: float = 0.0, k: int = 4) -> DataFrame:
    """Keyword hypotheses (label, pattern) per case with the share of its sources that agree.

    The best source confidence carries the hypothesis: base of the source plus .1 per hit in the case (at most .2).
    """
    base = first_match([(_C(source) == s, _L(v)) for s, v in SOURCE_BASE.items()], _L(0.5))
    low = F.lower(F.coalesce(_C(text), _L("")))
    hits = _kept([F.when(low.rlike(p), F.struct(_L(l).alias("label"), F.size(F.regexp_extract_all(low, _L(p), _L(0))).alias("n"))) for l, p in rules])
    sources = df.groupBy(case).agg(F.count_distinct(F.when(_C(source) != "user", _C(source))).alias("total"))
    found = (df.select(case, source, base.alias("b"), F.explode(hits).alias("h")).groupBy(case, "h.label")
             .agg(F.count_distinct(F.when(_C(source) != "user", _C(source))).alias("agree"), F.max("b").alias("b"), F.sum("h.n").alias("n")))
    conf = F.least(_C("b") + F.least(0.1 * _C("n"), _L(0.2)), _L(1.0))
    scored = found.join(sources, case).select(case, "label", F.round(conf, 6).alias("confidence"), F.when(_C("total") > 0, F.round(_C("agree") / _C("total"), 6)).otherwise(0.0).alias("agreement"))
    best = first_k(scored.filter(_C("confidence") >= min_conf), [case], [F.desc("agreement"), F.desc("confidence"), F.asc("label")], k)
    return best.withColumnRenamed("rn", "rank")


def recurring_components(df: DataFrame, text: str, pattern: str, min_count: int = 2) -> DataFrame:
    """Components named at least twice over all tickets, with confidence min(.4 + .1 n, .85)."""
    named = df.select(F.explode(F.regexp_extract_all(F.upper(text), _L(pattern), _L(0))).alias("component"))
    return named.groupBy("component").agg(F.count("*").alias("n")).filter(_C("n") >= min_count).withColumn("confidence", F.round(F.least(0.4 + 0.1 * _C("n"), _L(0.85)), 4))


SOURCE_WEIGHT = {"sfd": 1.5, "fr": 1.3, "incident": 1.0, "learned": 1.0, "log": 0.85, "diag_rule": 0.80, "kb": 0.70}


def score_hypotheses(df: DataFrame, case: str, source: str, text: str, catalog: Sequence[tuple[str, Sequence[str], Sequence[str]]], entity: str, suppressed: DataFrame | None = None, pattern_score: str | None = None) -> DataFrame:
    """Hypotheses (id, patterns, entities) per case from long evidence rows (case, source, text, entity).

    Base score is the share of patterns found anywhere in the case; each evidence row with a hit adds .05, each
    matching entity .1; ``suppressed`` (hypothesis_id, delta) lowers the result.
    """
    low = F.lower(F.coalesce(_C(text), _L("")))
    weight = first_match([(_C(source) == s, _L(w)) for s, w in SOURCE_WEIGHT.items()], _L(1.0))
    if pattern_score is not None:
        learned = F.least(F.round(0.7 + F.greatest(_L(0.0), F.least(_L(1.0), _C(pattern_score))) * 0.5, 4), _L(1.2))
        weight = F.when(_C(source) == "learned", learned).otherwise(weight)
    frames = F.array(*[F.struct(
        _L(h).alias("hypothesis_id"), _kept([F.when(low.rlike(p), _L(i)) for i, p in enumerate(ps)]).alias("found"), _L(len(ps)).alias("n_patterns"),
        F.when(F.upper(_C(entity)).isin([e.upper() for e in ents]), F.upper(_C(entity))).alias("ent")) for h, ps, ents in catalog])
    rows = df.select(case, source, weight.alias("w"), F.explode(frames).alias("f")).select(case, source, "w", "f.*").filter("size(found) > 0 or ent is not null")
    # Bits of the found patterns merge with bit_or, so a case of any size stays one partial aggregate.
    bits = F.aggregate("found", _L(0).cast("long"), lambda a, i: a.bitwiseOR(F.pow(_L(2), i).cast("long")))
    share = F.size("found") / _C("n_patterns")
    is_evidence = (F.size("found") > 0) & (_C(source) != "query")
    agg = rows.groupBy(case, "hypothesis_id").agg(
        F.bit_count(F.bit_or(bits)).alias("k"), F.max("n_patterns").alias("n_patterns"), F.count_if(is_evidence).alias("n_evidence"), F.count_distinct("ent").alias("n_ent"),
        F.max(F.when(is_evidence, share * _C("w"))).alias("best_evidence"))
    base = _C("k") / _C("n_patterns")
    conf = F.when(_C("n_evidence") > 0, F.least(_L(1.0), base + 0.1 * _C("n_ent") + 0.05 * _C("n_evidence"))).otherwise(F.least(_L(0.7), base + 0.1 * _C("n_ent")))
    out = agg.filter(base >= 0.05)
    if suppressed is not None:
        out = out.join(suppressed.select("hypothesis_id", "delta"), "hypothesis_id", "left")
        conf = F.greatest(_L(0.0), conf + F.coalesce("delta", _L(0.0)))
    return out.select(case, "hypothesis_id", F.round(conf, 6).alias("confidence"), "n_evidence", F.round("best_evidence", 6).alias("best_evidence"))


EVIDENCE_WEIGHTS = {"live_db": 100, "live_log": 90, "ssh": 85, "code": 80, "sfd": 70, "fr": 60, "incident": 50, "learned": 30}


def weigh_evidence(df: DataFrame, entity: str, kind: str, confidence: str, tie: str) -> DataFrame:
    """Strongest evidence and highest confidence per entity."""
    weight = first_match([(_C(kind) == k, _L(w)) for k, w in EVIDENCE_WEIGHTS.items()], _L(0))
    return df.withColumn("_w", weight).groupBy(entity).agg(
        F.max(confidence).alias("highest_confidence"), F.max("_w").alias("top_weight"),
        F.min(F.struct((-_C("_w")).alias("w"), (-_C(confidence)).alias("c"), tie, kind)).alias("b"), F.count("*").alias("n_evidence")).select(
        entity, "highest_confidence", "top_weight", _C(f"b.{kind}").alias("top_kind"), _C(f"b.{tie}").alias("top_id"), "n_evidence")


def contract_failures(answers: DataFrame, key: str, text: str, sections: Mapping[str, Sequence[str]], mentions: Sequence[str], forbidden: Sequence[str], generic: Sequence[str], code: str | None = None) -> DataFrame:
    """Failure codes per answer against a contract: sections with aliases, mentions, forbidden and generic patterns."""
    low = F.lower(F.coalesce(_C(text), _L("")))
    missing_section = any_of([~matches_any(low, aliases) for aliases in sections.values()])
    sql = lambda f: f.strip().upper().startswith(("DELETE", "UPDATE", "INSERT", "DROP", "ALTER", "TRUNCATE"))
    rows = [
        F.when(missing_section, "FORENSIC_ERROR"), F.when(matches_any(low, [f.lower() for f in forbidden if not sql(f)]), "HALLUCINATION"),
        F.when(matches_any(low, [f.lower() for f in forbidden if sql(f)]) | _C(text).rlike(r"(?i)\b(UPDATE|DELETE\s+FROM|INSERT\s+INTO|DROP\s+TABLE|TRUNCATE\s+TABLE|ALTER\s+TABLE)\b"), "SQL_MUTATION"),
        F.when(any_of([low.rlike(g) for g in generic]), "GENERIC_RESPONSE")]
    if mentions:
        rows.append(F.when(~matches_any(low, [m.lower() for m in mentions]), "MISSING_EVIDENCE"))
    if code:
        rows.append(F.when(~F.contains(low, _L(code.lower())), "MISSING_CODE_REFERENCE"))
    failures = F.array_sort(_kept([r.cast("string") for r in rows]))
    return answers.select(key, failures.alias("failures")).withColumn("passed", F.size("failures") == 0)


def contract_pass_rate(failures: DataFrame) -> DataFrame:
    return failures.agg(F.count("*").alias("n"), F.count_if("passed").alias("n_passed"), F.round(F.count_if("passed") / F.greatest(F.count("*"), _L(1)) * 100, 2).alias("pass_rate"))


# ---------------------------------------------------------------- named checks
class CheckSuite:
    """Named checks: a function of the tables, tags, and a row cap; intents name the checks to run."""

    def __init__(self, default_cap: int = 50):
        self.default_cap = default_cap
        self._checks: dict[str, tuple[Callable, tuple[str, ...], int]] = {}
        self._plans: dict[str, list[str]] = {}

    def add(self, name: str, fn: Callable, tags: Sequence[str] = (), cap: int | None = None) -> None:
        self._checks[name] = (fn, tuple(tags), cap or self.default_cap)

    def plan(self, intent: str, names: Sequence[str]) -> None:
        unknown = [n for n in names if n not in self._checks]
        if unknown:
            raise KeyError(f"checks not in the whitelist: {unknown}")
        self._plans[intent] = list(names)

    def rows(self, name: str, tables) -> DataFrame:
        fn, _, cap = self._checks[name]
        return fn(tables).limit(cap)

    def run(self, tables, intent: str) -> DataFrame:
        """(query_name, row_count, truncated, confidence, tags) of each check of the intent; counts stop at the cap."""
        from ticketweave.operators.windows import evidence_row
        parts = [evidence_row(self._checks[n][0](tables), n, self._checks[n][2]).withColumn("tags", _L(",".join(self._checks[n][1]))) for n in self._plans[intent]]
        return reduce(DataFrame.unionByName, parts)


def shared_links(df: DataFrame, key: str, member: str) -> DataFrame:
    """Keys more than one member hangs on."""
    return df.groupBy(key).agg(F.count_distinct(member).alias("n_links")).filter("n_links > 1")


def blocked_items(df: DataFrame, state: str, states: Sequence[str], name: str | None = None, like: str | None = None) -> DataFrame:
    q = df.filter(_C(state).isin(list(states)))
    return q if name is None else q.filter(_C(name).like(like))


def validate_answers(violations: DataFrame, answers: DataFrame, key: str, severity: str, evidence: str, hyp_conf: str, corr_conf: str) -> DataFrame:
    """Tier and score per answer from its violations, with the over-confidence downgrade."""
    agg = violations.groupBy(key).agg(*[F.count_if(_C(severity) == s).alias(f"n_{s}") for s in ("block", "warning", "info")])
    rows = answers.join(agg, key, "left").na.fill(0, ["n_block", "n_warning", "n_info"])
    tier = F.when(_C("n_block") > 0, "LOW").when((_C("n_warning") > 0) | (_C(evidence) == 0), "MEDIUM").otherwise("HIGH")
    down = (tier == "HIGH") & (_C(hyp_conf) > 0.9) & (_C(evidence) < 3)
    # The warning the downgrade itself raises comes after the counts that feed the score.
    score = 1.0 - 0.35 * _C("n_block") - 0.15 * _C("n_warning") - 0.05 * _C("n_info") + F.least(_C(evidence) * 0.05, _L(0.20))
    score = (score * 0.90 + _C(hyp_conf) * 0.10) * 0.95 + _C(corr_conf) * 0.05
    return rows.select(key, F.when(down, "MEDIUM").otherwise(tier).alias("tier"), F.round(F.greatest(_L(0.0), F.least(_L(1.0), score)), 3).alias("score"),
                       "n_block", "n_warning", "n_info", (F.when(down, "MEDIUM").otherwise(tier) != "HIGH").alias("needs_review"))


def validate_records(df: DataFrame, key: str, rules: Sequence[tuple[str, str]], fixes: Mapping[str, str] | None = None) -> DataFrame:
    """Failure codes per record from (code, SQL predicate that must hold); ``fixes`` (column -> SQL) apply first."""
    fixed = df.withColumns({c: F.expr(e) for c, e in fixes.items()}) if fixes else df
    bad = _kept([F.when(~F.coalesce(F.expr(p), _L(False)), _L(code)) for code, p in rules])
    return fixed.withColumn("failures", bad).withColumn("is_valid", F.size("failures") == 0)
