"""Column functions over ticket, log and document text."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticketweave import fixed_values as fv

_L = F.lit


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---------------------------------------------------------------- small helpers
def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, _L(False))


def matches_any(text: Column, words: Sequence[str]) -> Column:
    """True if any of the literal words occurs; one pattern keeps the generated code small."""
    if len(words) <= 2:
        return any_of([F.contains(text, _L(w)) for w in words])
    return text.rlike("|".join(re.escape(w) for w in words))


def unicode_edges(pattern: str) -> str:
    """Word edges and case folding that count accented letters as letters, whatever the Java version."""
    return pattern.replace(r"\b", r"(?U:\b)").replace("(?i", "(?iu")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body``."""
    return F.get(F.transform(F.array(value), body), _L(0))


def count_words(text: Column, words: Sequence[str]) -> Column:
    """How many of the literal words occur in the text."""
    table = F.array(*[_L(w) for w in words])
    return let(text, lambda t: F.size(F.filter(table, lambda w: F.contains(t, w))))


def count_patterns(text: Column, patterns: Sequence[str]) -> Column:
    """How many of the patterns match the text."""
    return F.size(F.filter(F.array(*[text.rlike(unicode_edges(p)) for p in patterns]), lambda hit: hit))


def count_true(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, [F.when(c, 1).otherwise(0) for c in conditions], _L(0))


def first_match(rules: Sequence[tuple[Column, Column]], default: Column) -> Column:
    """Value of the first rule that holds."""
    return reduce(lambda out, r: F.when(r[0], r[1]).otherwise(out), reversed(list(rules)), default)


def literal_map(values: Mapping[str, str]) -> Column:
    return F.create_map(*[_L(x) for kv in values.items() for x in kv])


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda t: t != "")


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def stable_id(prefix: str, cols: Sequence[Column], n: int) -> Column:
    return F.concat(_L(prefix), F.upper(F.substring(F.md5(F.concat(*cols).cast("binary")), 1, n)))


# ---------------------------------------------------------------- clean-up
def clean_ticket_text(text: Column | str, typos: Mapping[str, str] = fv.TYPO_MAP) -> Column:
    """Drop control characters and politeness, fix known typos token by token, collapse whitespace."""
    t = F.regexp_replace(F.coalesce(_col(text), _L("")), r"[^\P{C}\n\t]", "")
    t = F.regexp_replace(t, "(?iu)" + "|".join(fv.NOISE_PHRASES), " ")
    table = literal_map(typos)
    bare = lambda w: F.regexp_replace(F.lower(w), r"^[.,;:!?()]+|[.,;:!?()]+$", "")
    return F.array_join(F.transform(words_of(t), lambda w: F.coalesce(F.element_at(table, bare(w)), w)), " ")


def expand_tokens(text: Column | str, table: Mapping[str, str] = fv.GLOSSARY) -> Column:
    lookup = literal_map(table)
    bare = lambda w: F.regexp_replace(F.lower(w), r"[.,;:!?]+$", "")
    return F.array_join(F.transform(words_of(_col(text)), lambda w: F.coalesce(F.element_at(lookup, bare(w)), w)), " ")


def normalize_for_ml(text: Column | str, stop: Sequence[str] = tuple(fv.ML_STOP_WORDS), synonyms: Mapping[str, str] = fv.ML_SYNONYMS, min_len: int = 2) -> Column:
    """Strip noise, turn codes and equipment into placeholders, lower-case, fold synonyms, drop weak tokens."""
    t = F.coalesce(_col(text), _L(""))
    for p in fv.ML_NOISE:
        t = F.regexp_replace(t, p, " ")
    for p, r in fv.ML_ERROR_CODES + fv.ML_EQUIPMENT:
        t = F.regexp_replace(t, unicode_edges(p), r)
    t = F.regexp_replace(F.lower(t), r"[^\p{L}\p{N}_\s\-]", " ")
    table = literal_map(synonyms)
    fold = lambda w: F.array_join(F.transform(F.split(w, "-"), lambda p: F.coalesce(F.element_at(table, p), p)), "-")
    kept = F.filter(F.transform(words_of(t), fold), lambda w: ~w.isin(list(stop)) & (F.length(w) >= min_len) & ~w.rlike(r"^\p{Nd}+$"))
    return F.array_join(kept, " ")


def fold_accents(text: Column | str) -> Column:
    return F.translate(F.lower(_col(text)), fv.ACCENTS_FROM, fv.ACCENTS_TO)


@F.pandas_udf(T.StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Unicode composition, the one text step Spark has no function for."""
    return text.str.normalize("NFC")


def repair_encoding(text: Column | str) -> Column:
    """Undo a latin-1 reading of UTF-8 where that yields French letters, then compose."""
    t = _col(text)
    suspicious = t.rlike("Ã.|Â.|â€")
    # Encoding is only lossless below U+0100; other rows keep their text.
    fixed = F.when(suspicious & ~t.rlike("[^\\x{00}-\\x{FF}]"), F.try_validate_utf8(F.encode(t, "ISO-8859-1").cast("string")))
    return nfc(F.when(fixed.rlike("[éèêëàâîïôùûüçÉÈÀ]"), fixed).otherwise(t))


def drop_lines(text: Column | str, patterns: Sequence[str] = tuple(fv.FILLER_LINES), inline: Sequence[str] = ()) -> Column:
    """Remove lines matching a pattern, strip inline fragments, keep at most one blank line in a row."""
    lines = F.filter(F.split(_col(text), "\n"), lambda s: ~any_of([s.rlike(unicode_edges(p)) for p in patterns]))
    if inline:
        lines = F.transform(lines, lambda s: reduce(lambda a, p: F.regexp_replace(a, p, ""), inline, s))
    return F.regexp_replace(F.regexp_replace(F.array_join(lines, "\n"), r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def snippet(text: Column | str, keyword: str, n: int = 120) -> Column:
    """Window around the first keyword, a third before and two thirds after, with ellipses where text is cut."""
    t = _col(text)
    pos = F.locate(keyword.lower(), F.lower(t)) - 1
    start = F.greatest(_L(0), pos - n // 3)
    end = F.least(F.length(t), pos + n * 2 // 3)
    body = F.regexp_replace(F.substring(t, start + 1, end - start), r"^\s+|\s+$", "")
    window = F.concat(F.when(start > 0, "…").otherwise(""), body, F.when(end < F.length(t), "…").otherwise(""))
    return F.when(pos < 0, F.substring(t, 1, n)).otherwise(window)


# ---------------------------------------------------------------- combined texts
def combined_text(parts: Sequence[str], limit: int | None = 2000) -> Column:
    """Parts joined by blanks; longer than ``limit`` is cut and marked with dots."""
    t = F.concat_ws(" ", *[F.coalesce(F.col(p), _L("")) for p in parts])
    return t if limit is None else F.when(F.length(t) > limit, F.concat(F.substring(t, 1, limit), _L("..."))).otherwise(t)


def weighted_text(report: str, solution: str, fallback: str) -> Column:
    """Report and twice the solution (else the summary), separated by [SEP], lower-case."""
    sol = F.when(F.trim(F.coalesce(F.col(solution), _L(""))) != "", F.col(solution)).otherwise(F.coalesce(F.col(fallback), _L("")))
    norm = lambda c: F.lower(collapse(c))
    parts = F.filter(F.array(norm(F.coalesce(F.col(report), _L(""))), norm(sol), norm(sol)), lambda p: p != "")
    return F.array_join(parts, " [SEP] ")


# ---------------------------------------------------------------- codes, levels, systems, times
def error_codes(text: Column | str, variant: str = "log") -> Column:
    """Sorted distinct codes of one documented variant."""
    t = F.coalesce(_col(text), _L(""))
    found = [F.transform(F.regexp_extract_all(t, _L(unicode_edges(p)), _L(g)), lambda x: F.upper(x)) for p, g in fv.ERROR_CODE_PATTERNS[variant]]
    if variant == "ticket":
        known = F.filter(F.array(*[F.when(F.contains(t, _L(k)), _L(k)) for k in fv.KNOWN_TICKET_CODES]), lambda x: x.isNotNull())
        found = [known, *found]
    return F.array_sort(F.array_distinct(F.flatten(F.array(*found))))


def canonical_codes(text: Column | str) -> Column:
    """Array of (canonical, confidence), years left out; the earliest pattern decides the confidence."""
    t = F.coalesce(_col(text), _L(""))
    one = lambda p, g, prefix, conf: F.transform(
        F.regexp_extract_all(t, _L(unicode_edges(p)), _L(g)),
        lambda x: F.struct(F.replace(F.upper(F.concat(_L(prefix), x)), _L(" "), _L("")).alias("code"), _L(conf).alias("confidence")))
    found = F.filter(F.flatten(F.array(*[one(*c) for c in fv.CANONICAL_CODES])), lambda s: ~s["code"].rlike(fv.YEAR_PATTERN))
    names = F.array_distinct(F.transform(found, lambda s: s["code"]))
    return F.transform(names, lambda n: F.get(F.filter(found, lambda s: s["code"] == n), _L(0)))


def log_level(text: Column | str) -> Column:
    up = F.upper(_col(text))
    rules = [(F.contains(up, _L(l)), _L("WARNING" if l == "WARN" else l)) for l in fv.LOG_LEVEL_ORDER]
    return first_match(rules, _L("INFO"))


def extract_ts(text: Column | str) -> Column:
    """First readable time: ISO, web server, day-first; anything without a date stays null."""
    t = _col(text)
    iso = F.regexp_extract(t, r"(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2})", 1)
    web = F.regexp_extract(t, r"(\d{2}/\w{3}/\d{4}:\d{2}:\d{2}:\d{2})", 1)
    day = F.regexp_extract(t, r"(\d{2}/\d{2}/\d{4} \d{2}:\d{2}:\d{2})", 1)
    return F.coalesce(
        F.try_to_timestamp(F.replace(iso, _L("T"), _L(" ")), _L("yyyy-MM-dd HH:mm:ss")),
        F.try_to_timestamp(web, _L("dd/MMM/yyyy:HH:mm:ss")),
        F.try_to_timestamp(day, _L("dd/MM/yyyy HH:mm:ss")))


def ts_text(text: Column | str) -> Column:
    """The time as written: ISO, web server or syslog, null when absent."""
    t = _col(text)
    pats = [r"(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:\d{2})?)", r"(\d{2}/\w{3}/\d{4}:\d{2}:\d{2}:\d{2})",
            r"(\w{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})"]
    return F.coalesce(*[F.nullif(F.regexp_extract(t, p, 1), _L("")) for p in pats])


def upstream_system(text: Column | str, systems: Sequence[str] = tuple(fv.UPSTREAM_SYSTEMS)) -> Column:
    up = F.upper(_col(text))
    return first_match([(F.contains(up, _L(s)), _L(s)) for s in systems], _L(None).cast("string"))


def systems_mentioned(text: Column | str, aliases: Mapping[str, Sequence[str]] = fv.SYSTEM_ALIASES) -> Column:
    low = F.lower(_col(text))
    return F.filter(F.array(*[F.when(matches_any(low, a), _L(s)) for s, a in aliases.items()]), lambda x: x.isNotNull())


def exception_class(text: Column | str, catalog: Mapping[str, str] = fv.EXCEPTION_SHORT) -> Column:
    """Fully qualified ``...exception.X`` name first, else a catalog name found anywhere."""
    t = _col(text)
    # A text without the package name cannot match, and the pattern tries every place of such a text in vain.
    fq = F.when(t.rlike(r"(?i)\.exception\."), F.regexp_extract(t, r"(?i)[\w.]+\.exception\.(?:[\w.]*\.)?(\w+(?:Exception|Error))", 1))
    listed = first_match([(F.contains(t, _L(c)), _L(c)) for c in catalog], _L(None).cast("string"))
    return F.coalesce(F.nullif(fq, _L("")), listed)


def message_code(text: Column | str, rules: Sequence[tuple[str, str]] = tuple(fv.MESSAGE_RULES)) -> Column:
    return let(F.lower(_col(text)), lambda low: first_match([(low.rlike(p), _L(code)) for p, code in rules], _L(None).cast("string")))


def exception_code(text: Column | str) -> Column:
    return let(exception_class(text), lambda cls: F.coalesce(F.element_at(literal_map(fv.EXCEPTION_SHORT), cls), cls, message_code(text)))


def to_template(text: Column | str) -> Column:
    """Replace variables by placeholders in a fixed order; later rules see earlier placeholders."""
    t = _col(text)
    for p, r in fv.TEMPLATE_VARIABLES:
        t = F.regexp_replace(t, unicode_edges(p), r)
    return collapse(t)


# ---------------------------------------------------------------- rows of rules on one text
def categorize(text: Column | str, rules: Sequence[tuple[str, Sequence[str]]] = tuple(fv.TICKET_CATEGORIES), default: str = fv.DEFAULT_CATEGORY) -> Column:
    low = F.lower(F.coalesce(_col(text), _L("")))
    return first_match([(matches_any(low, words), _L(name)) for name, words in rules], _L(default))


def detect_language(text: Column | str, fr: Sequence[str] = tuple(fv.FRENCH_WORDS), en: Sequence[str] = tuple(fv.ENGLISH_WORDS)) -> Column:
    tokens = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(_col(text), _L(""))), _L(r"[\p{L}\p{N}_]+"), _L(0)))
    hits = lambda words: F.size(F.array_intersect(tokens, F.array(*[_L(w) for w in words])))
    return F.when(hits(en) > hits(fr), "en").otherwise("fr")


def is_off_topic(text: Column | str) -> Column:
    low = F.lower(F.trim(_col(text)))
    return any_of([low.rlike(unicode_edges(p)) for p in fv.OFF_TOPIC])


def classify_intent(text: Column | str, patterns: Mapping[str, Sequence[str]], priority: Sequence[str]) -> Column:
    """Struct (intent, confidence): the first intent of ``priority`` with a hit, else the one with most hits."""
    low = F.lower(F.coalesce(_col(text), _L("")))
    hits = {i: count_words(low, ps) for i, ps in patterns.items()}
    conf = lambda n: F.least(0.40 + n * 0.15, _L(0.95))
    mk = lambda name, c: F.struct(_L(name).alias("intent"), c.cast("double").alias("confidence"))
    rest = [i for i in patterns if i not in priority]
    best = mk("unknown", _L(0.3))
    if rest:
        top = F.greatest(*[hits[i] for i in rest]) if len(rest) > 1 else hits[rest[0]]
        best = F.when(top > 0, first_match([(hits[i] == top, mk(i, conf(hits[i]))) for i in rest], mk("unknown", _L(0.3)))).otherwise(best)
    return first_match([(hits[i] > 0, mk(i, conf(hits[i]))) for i in priority if i in patterns], best)


def classify_intent_weighted(text: Column | str, profiles: Mapping[str, Sequence[tuple[Sequence[str], float]]], priority: Mapping[str, int]) -> Column:
    """Struct (intent, confidence): highest (priority, weighted score) among the intents with a hit."""
    low = F.lower(F.coalesce(_col(text), _L("")))
    scored = F.array(*[
        F.struct(_L(priority.get(i, 0)).alias("p"),
                 reduce(lambda a, b: a + b, [count_words(low, ph) * w for ph, w in groups]).alias("s"), _L(i).alias("intent"))
        for i, groups in profiles.items()])
    best = F.array_max(F.filter(scored, lambda x: x["s"] > 0))
    return F.when(best.isNull(), F.struct(_L("UNKNOWN").alias("intent"), _L(0.20).alias("confidence"))).otherwise(
        F.struct(best["intent"].alias("intent"), F.round(F.least(0.40 + best["s"] * 0.12, _L(0.97)), 3).alias("confidence")))


def route_multilabel(text: Column | str, rules: Sequence[tuple[str, str, float]], default: str = "runtime_diagnostic", multi: float = 0.55, primary: float = 0.40) -> Column:
    """Struct (primary, confidence, labels): best weight per category, labels at ``multi`` and above."""
    t = F.coalesce(_col(text), _L(""))
    cats = list(dict.fromkeys(c for _, c, _ in rules))
    weight = lambda c: F.array_max(F.array(_L(0.0), *[F.when(t.rlike(unicode_edges(p)), _L(w)) for p, k, w in rules if k == c]))
    scored = F.filter(F.array(*[F.struct((-weight(c)).alias("w"), _L(i).alias("i"), _L(c).alias("c")) for i, c in enumerate(cats)]), lambda s: s["w"] < 0)
    best = F.array_min(scored)
    weak = -best["w"] < primary
    head = F.when(best.isNull() | weak, _L(default)).otherwise(best["c"])
    conf = F.when(best.isNull(), _L(0.0)).when(weak, _L(0.3)).otherwise(-best["w"])
    labels = F.transform(F.array_sort(F.filter(scored, lambda s: -s["w"] >= multi)), lambda s: s["c"])
    labels = F.when(best.isNull(), F.array().cast("array<string>")).when(F.size(labels) == 0, F.array(head)).otherwise(labels)
    return F.struct(head.alias("primary"), conf.alias("confidence"), labels.alias("labels"))


def route_question(text: Column | str, rules: Sequence[dict], default: tuple[str, str] = ("causal_escalation", "normal")) -> Column:
    """Struct (category, confidence, urgency, secondary): rules carry category, urgency, weight and patterns."""
    t = F.coalesce(_col(text), _L(""))
    def scored(i: int, r: dict) -> Column:
        n = count_patterns(t, r["patterns"])
        conf = F.least(0.5 + 0.15 * n, _L(0.95)) * r.get("weight", 1.0)
        return F.struct(F.when(n > 0, -conf).otherwise(_L(0.0)).alias("w"), _L(i).alias("i"), _L(r["category"]).alias("c"), _L(r["urgency"]).alias("u"))
    hits = F.array_sort(F.filter(F.array(*[scored(i, r) for i, r in enumerate(rules)]), lambda s: s["w"] < 0))
    best = F.get(hits, _L(0))
    none = best.isNull()
    return F.struct(
        F.coalesce(best["c"], _L(default[0])).alias("category"),
        F.when(none, _L(0.2)).otherwise(F.least(-best["w"] / 2.0, _L(0.95))).alias("confidence"),
        F.coalesce(best["u"], _L(default[1])).alias("urgency"),
        F.transform(F.slice(hits, 2, 3), lambda s: s["c"]).alias("secondary"))


def tag_incident_type(text: Column | str, taxonomy: Mapping[str, Sequence[str]], priority: Sequence[str] = (), unknown: str = "unknown.insufficient_information") -> Column:
    """Type with most phrase hits; ties by explicit priority, else by taxonomy order."""
    low = F.lower(F.coalesce(_col(text), _L("")))
    order = [*[p for p in priority if p in taxonomy], *[t for t in taxonomy if t not in priority]]
    scored = F.array(*[F.struct((-count_words(low, [p.lower() for p in taxonomy[t]])).alias("n"), _L(i).alias("i"), _L(t).alias("t"))
                       for i, t in enumerate(order) if t != unknown])
    best = F.array_min(F.filter(scored, lambda s: s["n"] < 0))
    return F.coalesce(best["t"], _L(unknown))


def policy_violations(text: Column | str, rules: Sequence[tuple[str, str]] = tuple(fv.POLICY_RULES)) -> Column:
    """Array of (kind, value), one entry per violated rule."""
    t = F.coalesce(_col(text), _L(""))
    return F.filter(F.array(*[
        F.when(t.rlike(unicode_edges(p)), F.struct(_L(k).alias("kind"), F.regexp_replace(F.regexp_extract(t, unicode_edges(p), 0), r"^\s+|\s+$", "").alias("value"))) for k, p in rules]), lambda x: x.isNotNull())


# ---------------------------------------------------------------- similarity
def token_set(text: Column | str) -> Column:
    return F.array_distinct(words_of(F.lower(_col(text))))


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard of two token sets, 0 when both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(_L(0.0))


def overlap_max(a: Column, b: Column) -> Column:
    """Shared tokens over the larger set."""
    big = F.greatest(F.size(a), F.size(b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / big).otherwise(_L(0.0))
