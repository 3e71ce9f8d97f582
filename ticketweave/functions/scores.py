"""Scores and trust values as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ticketweave import fixed_values as fv
from ticketweave.functions.text import count_patterns, count_true, count_words, first_match, let

_L = F.lit


def _points(value: Column, steps: Sequence[tuple[float, float]], default: float = 0) -> Column:
    return first_match([(value >= t, _L(p)) for t, p in steps], _L(default))


def ticket_confidence(intent_conf: Column, n_types: Column, has_codes: Column, known_type: Column, has_system: Column) -> Column:
    bonus = lambda c, v: F.when(c, _L(v)).otherwise(_L(0.0))
    total = intent_conf * 0.40 + F.least(n_types * 0.05, _L(0.20)) + bonus(has_codes, 0.15) + bonus(known_type, 0.20) + bonus(has_system, 0.05)
    return F.round(F.least(total, _L(0.97)), 3)


def ticket_trust(has_codes: Column, known_type: Column, long_text: Column) -> Column:
    bonus = lambda c: F.when(c, _L(0.05)).otherwise(_L(0.0))
    return F.round(F.least(0.25 + bonus(has_codes) + bonus(known_type) + bonus(long_text), _L(0.40)), 3)


def completeness(has_id: Column, has_codes: Column, has_system: Column, has_action: Column) -> Column:
    bonus = lambda c, v: F.when(c, _L(v)).otherwise(_L(0.0))
    return F.round(F.least(bonus(has_id, 0.30) + bonus(has_codes, 0.30) + bonus(has_system, 0.20) + bonus(has_action, 0.20), _L(1.0)), 3)


def document_score(
    text: Column, n_words: Column, n_sections: Column, n_codes: Column, actions: Sequence[str] = tuple(fv.ACTION_WORDS),
    technical: Sequence[str] = tuple(fv.TECHNICAL_WORDS), vague: Sequence[str] = tuple(fv.VAGUE_PHRASES),
) -> Column:
    """Quality of a document from 0 to 100."""
    low = F.lower(text)
    hits = lambda words: count_words(low, words)
    edge = r"(^|[^\p{L}\p{N}_])", r"([^\p{L}\p{N}_]|$)"
    # Phrases act as patterns between word edges; one that ends in a non-word sign needs no edge there.
    vague_hits = count_patterns(low, [edge[0] + p + (edge[1] if p[-1].isalnum() else "") for p in vague])
    ratio = F.least(vague_hits / F.greatest(n_words / 50, _L(1.0)), _L(1.0))
    return (_points(n_words, [(300, 20), (150, 14), (80, 8), (30, 4)]) + F.least(n_sections, _L(4)) * 5
            + F.least(hits(actions) * 2, _L(20)) + F.least(n_codes * 5, _L(10)) + F.least(hits(technical) * 2, _L(15))
            + F.greatest(_L(0), 15 - F.floor(ratio * 15))).cast("int")


def quality_label(score: Column) -> Column:
    return _points(score, [(80, "canonique"), (60, "bonne"), (30, "partielle")], "inutilisable")


def quality_trust(score: Column) -> Column:
    return _points(score, [(80, "high"), (60, "medium"), (30, "low")], "none")


def document_trust(source: Column, quality: Column, validated: Column, parts: Sequence[Column], cluster_size: Column, age_months: Column) -> Column:
    """0-100, truncated: source .40, completeness .25, validation .25, recency .10."""
    kind = F.when(source == "cluster", F.when(cluster_size >= 20, "cluster_large").otherwise("cluster_medium")).otherwise(source)
    s_source = F.coalesce(F.element_at(literal_map_double(fv.SOURCE_TRUST), kind), _L(0.30))
    complete = count_true(parts) / 3.0
    complete = F.when(quality > 0, F.greatest(complete, quality / 100.0)).otherwise(complete)
    total = 0.40 * s_source + 0.25 * complete + 0.25 * F.when(validated, 1.0).otherwise(0.0) + 0.10 * F.exp(-0.05 * age_months)
    return F.least(F.floor(total * 100), _L(100)).cast("int")


def literal_map_double(values: dict[str, float]) -> Column:
    return F.create_map(*[x for k, v in values.items() for x in (_L(k), _L(float(v)))])


def trust_label(score: Column, strong: int = 70, medium: int = 40) -> Column:
    return F.when(score >= strong, "strong").when(score >= medium, "moderate").when(score > 0, "weak").otherwise("insufficient")


def procedure_confidence(quality: Column, parts: Sequence[Column]) -> tuple[Column, Column]:
    """(trust, level) of a validated procedure: .50 source, .30 completeness, .20 validation."""
    trust = 0.50 * F.least(quality / 100.0, _L(1.0)) + 0.30 * count_true(parts) / 3.0 + 0.20
    return trust, _points(trust, [(0.80, "high"), (0.60, "medium"), (0.40, "low")], "very_low")


def canonical_points(level: Column, match: Column, usage: Column, success: Column) -> Column:
    base = F.when(level == "high", 40).when(level == "medium", 25).otherwise(10)
    proven = F.when((usage > 50) & (success > 0) & (success / F.greatest(usage, _L(1)) > 0.7), 10).otherwise(0)
    return base + _points(match, [(0.9, 20), (0.75, 12), (0.6, 6)]) + proven


def signature_points(exact: Column, frequency: Column, coherent: Column, stable: Column, cluster_conf: Column) -> Column:
    yes = lambda c, v: F.when(c, v).otherwise(0)
    return F.least(F.when(exact, 40).otherwise(15) + _points(frequency, [(50, 20), (10, 10), (3, 5)]) + yes(coherent, 20)
                   + yes(stable, 20) + yes(cluster_conf >= 0.75, 10), _L(100))


def ticket_points(count: Column, resolved: Column, hits: Column) -> Column:
    return _points(count, [(20, 15), (5, 8)], 3) + F.when(resolved, 10).otherwise(0) + F.least(hits * 2, _L(10))


def combined_points(scores: Column) -> Column:
    """Best score plus a truncated fifth of every other one, at most 100."""
    total = F.aggregate(scores, _L(0), lambda a, s: a + F.floor(s * 0.2).cast("int"))
    best = F.array_max(scores)
    return F.coalesce(F.least(best + total - F.floor(best * 0.2).cast("int"), _L(100)), _L(0))


def pattern_trust(frequency: Column, in_catalog: Column, related: Column, days: Column) -> Column:
    s_source = F.when(in_catalog, 0.78).otherwise(0.45)
    s_freq = F.least(F.log1p(frequency) / F.log1p(_L(200.0)), _L(1.0))
    s_valid = F.least(F.when(in_catalog, 0.70).otherwise(0.0) + F.when(related > 0, F.least(related * 0.15, _L(0.30))).otherwise(0.0), _L(1.0))
    s_recent = F.greatest(_L(0.0), 1.0 - days / 365)
    return F.round(F.least(0.35 * s_source + 0.25 * s_freq + 0.30 * s_valid + 0.10 * s_recent, _L(1.0)), 4)


def procedure_trust(cluster_trust: Column, size: Column, n_logs: Column, has_catalog: Column, max_freq: Column) -> Column:
    s_size = F.least(F.log1p(size) / F.log1p(_L(200.0)), _L(1.0))
    s_log = F.when(n_logs > 0, F.least(F.log1p(n_logs) / F.log1p(_L(10.0)) * 0.8 + F.log1p(max_freq) / F.log1p(_L(200.0)) * 0.2, _L(1.0))).otherwise(0.0)
    return F.round(F.least(0.40 * cluster_trust + 0.25 * s_size + 0.25 * s_log + 0.10 * F.when(has_catalog, 1.0).otherwise(0.0), _L(1.0)), 4)


def review_priority(trust: Column, incident: Column) -> Column:
    """Null above the automatic threshold, else 9, 7 or 4."""
    critical = incident.isin(fv.CRITICAL_INCIDENT_TYPES) & (trust < 0.70)
    return F.when(trust >= 0.80, _L(None).cast("int")).when(critical | (trust < 0.40), 9).when(trust < 0.60, 7).otherwise(4)


def answer_score(answer: Column, question: Column, unknown_names: Column, known_tables: Column, rca_required: Column) -> Column:
    """Struct of the five parts and the total (0-100) of an answer.

    ``unknown_names`` and ``known_tables`` count table names outside and inside the known list.
    """
    n = lambda kind: count_patterns(answer, fv.ANSWER_MARKERS[kind])
    evidence = F.least(n("evidence") * 4 + F.least(known_tables * 3, _L(10)), _L(25))
    risk = F.greatest(_L(0), 25 - (n("red_flag") * 5 + unknown_names * 4))
    depth = F.when(rca_required & (n("rca") == 0), 0).otherwise(F.least(n("rca") * 5, _L(20)))
    value = F.least(n("operational") * 4, _L(20))
    size = F.length(F.regexp_replace(answer, r"^\s+|\s+$", ""))
    base = F.when(size < 100, 2).when(size < 300, 5).when(size < 800, 8).otherwise(10)
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), _L(r"[\p{L}\p{N}_]{5,}"), _L(0)))
    asked = words(F.coalesce(question, _L("")))
    off = (F.size(asked) > 0) & (F.size(F.array_intersect(asked, words(answer))) / F.greatest(F.size(asked), _L(1)) < 0.2)
    complete = F.when(off, F.greatest(_L(0), base - 4)).otherwise(base)
    return F.struct(evidence.alias("evidence"), risk.alias("risk"), depth.alias("depth"), value.alias("value"), complete.alias("completeness"),
                    (evidence + risk + depth + value + complete).alias("total"))


def keyword_boost(text: Column, signals: Sequence[tuple[str, str, str, float]] = tuple(fv.KEYWORD_SIGNALS)) -> Column:
    """Array of (l1, share) plus the capped total, all in one struct per text."""
    low = F.lower(F.coalesce(text, _L("")))
    l1s = list(dict.fromkeys(s[1] for s in signals))
    table = F.array(*[F.struct(_L(k).alias("k"), _L(l1).alias("l1"), _L(float(w)).alias("w")) for k, l1, _, w in signals])
    hits = let(low, lambda t: F.filter(table, lambda x: F.contains(t, x["k"])))


    def of_label(h: Column, label: str) -> Column:
        return F.struct(_L(label).alias("l1"), F.aggregate(F.filter(h, lambda x: x["l1"] == label), _L(0.0), lambda a, x: a + x["w"]).alias("w"))

    per = let(hits, lambda h: F.array(*[of_label(h, l) for l in l1s]))
    total = F.aggregate(per, _L(0.0), lambda a, x: a + x["w"])
    shares = F.transform(F.filter(per, lambda x: x["w"] > 0), lambda x: F.struct(x["l1"].alias("l1"), (x["w"] / total).alias("share")))
    return F.struct(shares.alias("shares"), F.least(total, _L(1.0)).alias("boost"))


def keyword_boost_l2(text: Column, l1: str, signals: Sequence[tuple[str, str, str, float]] = tuple(fv.KEYWORD_SIGNALS)) -> Column:
    return keyword_boost(text, [(k, b, b, w) for k, a, b, w in signals if a == l1])
