"""Operators that turn text columns into rows: entities, traces, anonymised text, mined constraints."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketweave import fixed_values as fv
from ticketweave.functions import text as tx

_L = F.lit


def extract_entities(
    df: DataFrame, text: str, patterns: Mapping[str, Sequence[str]] = fv.ENTITY_PATTERNS,
    verbs: Sequence[str] = tuple(fv.ACTION_VERBS), systems: Mapping[str, Sequence[str]] = fv.SYSTEM_ALIASES,
) -> DataFrame:
    """Long form (entity_type, value, confidence) per input row, one row per distinct type and value."""
    t = F.coalesce(F.col(text), _L(""))
    low = F.lower(t)
    mk = lambda kind, v, conf: F.struct(_L(kind).alias("entity_type"), v.alias("value"), _L(conf).cast("double").alias("confidence"))
    groups = [F.transform(tx.error_codes(t, "text"), lambda c: mk("error_code", c, fv.ENTITY_CONFIDENCE["error_code"]))]
    for kind, pats in patterns.items():
        for p in map(tx.unicode_edges, pats):
            found = F.filter(F.transform(F.regexp_extract_all(t, _L(p), _L(1)), lambda v: F.upper(F.trim(v))), lambda v: F.length(v) >= 2)
            groups.append(F.transform(found, lambda v: mk(kind, v, fv.DEFAULT_ENTITY_CONFIDENCE)))
    present = lambda pairs, kind: F.filter(
        F.array(*[F.when(c, mk(kind, _L(v), fv.ENTITY_CONFIDENCE[kind])) for v, c in pairs]), lambda x: x.isNotNull())
    groups.append(present([(v, F.contains(low, _L(v))) for v in verbs], "action_verb"))
    groups.append(present([(s, tx.matches_any(low, a)) for s, a in systems.items()], "system_name"))
    # One pattern list gives one confidence per (type, value), so distinct keeps the maximum.
    # The outer form, as Spark would read every text a second time to see whether there is anything to explode.
    return df.withColumn("_e", F.explode_outer(F.array_distinct(F.flatten(F.array(*groups))))).filter("_e is not null").select(*df.columns, "_e.*")


def parse_trace(df: DataFrame, text: str, app: str) -> DataFrame:
    """Fields of a stack trace by the strategy that reads most from it, with the signature hash."""
    t = F.col(text)
    get = lambda p, g=1: F.nullif(F.regexp_extract(t, tx.unicode_edges(p), g), _L(""))
    last = lambda c, sep: F.element_at(F.split(c, sep), -1)
    stack = r"at\s+([\w.]+)\.([\w$]+)\("
    pyf = r'File "([^"]+)", line \d+, in (\w+)'
    stem = lambda c: F.replace(last(c, "/"), _L(".py"), _L(""))
    java_full = get(r"(java\.\w+\.\w+Exception|org\.\w+\.\w+Exception|[A-Z]\w*Exception)")
    distinct10 = lambda arr: F.slice(F.array_sort(F.array_distinct(arr)), 1, 10)
    none = _L(None).cast("string")
    ora = get(r"(?i)ORA-(\d+)")
    no_classes = F.array().cast("array<string>")
    strategies = {
        "java_spring": (last(java_full, r"\."), F.substring(F.trim(get(r"Exception[:\s]+(.+?)(?:\n|$)")), 1, 200), last(get(stack), r"\."), get(stack, 2),
                        distinct10(F.transform(F.regexp_extract_all(t, _L(r"at\s+([\w.]+)\.\w+\("), _L(1)), lambda c: last(c, r"\.")))),
        "python": (get(r"(\w+Error|\w+Exception|Traceback).*?:\s*(.+?)(?:\n|$)"), F.substring(F.trim(get(r"(\w+Error|\w+Exception|Traceback).*?:\s*(.+?)(?:\n|$)", 2)), 1, 200),
                   stem(get(pyf)), get(pyf, 2), distinct10(F.transform(F.regexp_extract_all(t, _L(pyf), _L(1)), stem))),
        "oracle": (F.when(ora.isNotNull(), F.concat(_L("ORA-"), ora)), F.substring(F.trim(get(r"(?i)ORA-\d+:\s*(.+?)(?:\n|$)")), 1, 200),
                   F.upper(get(r"(?i)\b(from|into|update|table)\s+(\w+)", 2)), none, no_classes),
        "network": (F.when(get(r"\b(\d{4})\b").isNotNull(), F.concat(_L("ERR_"), get(r"\b(\d{4})\b"))), none,
                    F.upper(get(r"(?i)\b(DSLAM|NE|BAS|ROUTEUR|VLAN|ND|NRO|CARTE|PORT)\b")), none, no_classes),
    }
    fields = ["error_type", "error_message", "module", "method", "affected_classes"]
    parsed = df.withColumns({f"_{name}": F.struct(*[c.alias(f) for f, c in zip(fields, cols)]) for name, cols in strategies.items()})
    # Keywords weigh the same for every strategy; ties go to the earlier one.
    rank = lambda i, name: F.struct(
        (F.size(F.col(f"_{name}.affected_classes")) + F.when(F.col(f"_{name}.error_type").isNotNull(), 5).otherwise(0)).alias("r"), _L(-i).alias("i"),
        _L(name).alias("strategy"), F.col(f"_{name}").alias("f"))
    best = F.array_sort(F.array(*[rank(i, n) for i, n in enumerate(strategies)]),
                        lambda a, b: F.when(a["r"] != b["r"], b["r"] - a["r"]).otherwise(b["i"] - a["i"]))
    words = F.regexp_extract_all(t, _L(tx.unicode_edges(r"\b[a-zA-Z_][a-zA-Z0-9_]{2,}\b")), _L(0))
    kept = F.filter(words, lambda w: ~F.lower(w).isin(fv.TRACE_STOP_WORDS))
    low = F.transform(kept, lambda w: F.lower(w))
    keywords = F.slice(F.filter(kept, lambda w, i: F.array_position(low, F.lower(w)) == i + 1), 1, 20)
    out = parsed.withColumn("_best", F.get(best, _L(0))).withColumn("log_keywords", keywords)
    out = out.select(*df.columns, "log_keywords", F.col("_best.strategy").alias("strategy"), "_best.f.*")
    blank = lambda c: F.coalesce(F.col(c), _L(""))
    return out.withColumn("signature_hash", F.md5(F.lower(F.concat_ws("|", F.coalesce(F.col(app).cast("string"), _L("")), blank("error_type"), blank("module"), blank("method"))).cast("binary")))


# ---------------------------------------------------------------- reversible anonymisation
def anonymize(df: DataFrame, key: str, text: str, patterns: Sequence[tuple[str, str]] = tuple(fv.PII_PATTERNS)) -> tuple[DataFrame, DataFrame]:
    """(rows with ``text`` replaced, mapping rows (key, token, original)).

    Patterns run in order, so a later one only sees what earlier ones left. Within a document the n-th
    distinct value of a prefix becomes ``[PREFIX_nn]``. All of it stays inside the row, nothing is shuffled.
    """
    pair = "array<struct<token:string,original:string>>"
    state = F.struct(F.coalesce(F.col(text), _L("")).alias("t"), F.array().cast(pair).alias("m"))
    for prefix, pattern in patterns:
        state = tx.let(state, _masking_step(prefix, tx.unicode_edges(pattern)))
    done = df.withColumn("_s", state)
    rows = done.withColumn(text, F.col("_s.t")).select(*df.columns)
    # The outer form, as Spark would mask every text a second time to see whether there is anything to explode.
    mapping = done.select(key, F.explode_outer("_s.m").alias("m")).filter("m is not null").select(key, "m.token", "m.original")
    return rows, mapping


def _masking_step(prefix: str, pattern: str):
    """Replace the matches of one pattern: mark them, then resolve mark by mark to the token of the distinct value."""
    def token(n: Column) -> Column:
        digits = n.cast("string")
        return F.concat(_L(f"[{prefix}_"), F.lpad(digits, F.greatest(_L(2), F.length(digits)), _L("0")), _L("]"))

    def step(s: Column) -> Column:
        def masked(found: Column) -> Column:
            pieces = F.split(F.regexp_replace(s["t"], f"({pattern})", "\u0001$1\u0001"), "\u0001")
            text = F.array_join(F.transform(pieces, lambda p, i: F.when(i % 2 == 1, token(F.array_position(found, p))).otherwise(p)), "")
            new = F.transform(found, lambda v, i: F.struct(token(i + 1).alias("token"), v.alias("original")))
            return F.when(F.size(found) == 0, s).otherwise(F.struct(text.alias("t"), F.concat(s["m"], new).alias("m")))

        return tx.let(F.array_distinct(F.regexp_extract_all(s["t"], _L(pattern), _L(0))), masked)

    return step


def restore(df: DataFrame, mapping: DataFrame, key: str, text: str) -> DataFrame:
    """Put the originals back; the mapping of one document is small and travels as an array."""
    per_doc = mapping.groupBy(key).agg(F.collect_list(F.struct("token", "original")).alias("_m"))
    joined = df.join(per_doc, key, "left")
    back = F.aggregate(F.coalesce("_m", F.array().cast("array<struct<token:string,original:string>>")), F.col(text), lambda acc, s: F.replace(acc, s["token"], s["original"]))
    return joined.withColumn(text, back).select(*df.columns)


# ---------------------------------------------------------------- policy, constraints, operations
def scan_policy(df: DataFrame, text: str, rules: Sequence[tuple[str, str]] = tuple(fv.POLICY_RULES)) -> DataFrame:
    """One row per (input row, violated rule)."""
    return df.withColumn("_v", F.explode(tx.policy_violations(text, rules))).select(*df.columns, "_v.*")


def mine_constraints(df: DataFrame, text: str, words: str = fv.CONSTRAINT_WORDS, entities: str = fv.ENTITY_WORDS, min_len: int = 15) -> DataFrame:
    """Lines stating a constraint, with a content-based rule id and the entities they name."""
    lines = df.select(*[c for c in df.columns if c != text], F.posexplode(F.split(text, "\n")).alias("line_no", "_line"))
    kept = lines.filter(F.col("_line").rlike(tx.unicode_edges(words)) & (F.length(F.trim("_line")) > min_len))
    return kept.select(
        "*", tx.stable_id("SFD-", [F.col("_line")], 8).alias("rule_id"), F.substring(F.trim("_line"), 1, 200).alias("description"),
        F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all("_line", _L(tx.unicode_edges(entities)), _L(0)), lambda e: F.upper(e)))).alias("entities")).drop("_line")


def mine_operations(df: DataFrame, text: str, method: str = fv.API_OPERATION, path: str = fv.API_PATH, reach: int = 200) -> DataFrame:
    """(method, path) pairs: each method word with the first path within ``reach`` characters from its start."""
    t, method = F.col(text), tx.unicode_edges(method)
    # Cutting before each method gives pieces; the text after a method is its piece plus what follows.
    parts = F.split(F.regexp_replace(t, method, "\u0001$1"), "\u0001")
    exploded = df.withColumn("_p", parts).select(
        *df.columns, F.posexplode("_p").alias("op_no", "_piece"), F.col("_p").alias("_all")).filter("op_no > 0")
    near = F.substring(F.array_join(F.slice("_all", F.col("op_no") + 1, F.size("_all")), ""), 1, reach)
    found = exploded.withColumn("method", F.regexp_extract("_piece", "^" + method, 1)).withColumn("path", F.regexp_extract(near, path, 1))
    return found.filter("path <> ''").drop("_piece", "_all", text)


# ---------------------------------------------------------------- sections and artifacts
def artifact_rows(df: DataFrame, path: str, content: str, languages: Mapping[str, str], ignored: Sequence[str] = ()) -> DataFrame:
    """Inventory of source files: extension allow-list, ignored folders, bytes, lines, language."""
    ext = F.lower(F.regexp_extract(path, r"(\.[A-Za-z0-9]+)$", 1))
    kept = df.withColumn("extension", ext).filter(F.col("extension").isin(list(languages)))
    for folder in ignored:
        kept = kept.filter(~F.contains(F.concat(_L("/"), F.col(path)), _L(f"/{folder}/")))
    return (kept.withColumn("language", F.element_at(tx.literal_map(languages), F.col("extension")))
            .withColumn("size_bytes", F.octet_length(content)).withColumn("n_lines", F.size(F.split(content, "\n")))
            .select(path, "extension", "language", "size_bytes", "n_lines"))


def extract_code_facts(df: DataFrame, key: str, content: str, patterns: Mapping[str, str]) -> DataFrame:
    """(key, kind, fact_no, fact) rows: every capture of each kind of pattern in the whole file text."""
    def captures(kind: str, pattern: str) -> Column:
        found = F.regexp_extract_all(content, _L(pattern), _L(1))
        return F.transform(found, lambda v, i: F.struct(_L(kind).alias("kind"), i.alias("fact_no"), v.alias("fact")))

    facts = F.flatten(F.array(*[captures(k, p) for k, p in patterns.items()]))
    return df.select(key, F.explode(facts).alias("f")).select(key, "f.*")


def flatten_json(df: DataFrame, payload: str, schema: str, fields: Mapping[str, Sequence[str]]) -> DataFrame:
    """Parse a JSON payload once and project fields, each the first non-null of its paths."""
    parsed = df.withColumn("_j", F.from_json(payload, schema))
    return parsed.select(*df.columns, *[F.coalesce(*[F.col(f"_j.{p}") for p in paths]).alias(name) for name, paths in fields.items()])


def search_text(parts: Sequence[tuple[str, Column]], sep: str = " | ") -> Column:
    """Labelled parts joined by ``sep``; empty parts are left out."""
    return F.concat_ws(sep, *[F.when(F.coalesce(c, _L("")) != "", F.concat(_L(label), c)) for label, c in parts])


def query_texts(intent: Column, code: Column, identifiers: Mapping[str, Column], system: Column, text: Column, n_words: int = 20) -> tuple[Column, Column]:
    """(primary, fallback) search texts of a ticket."""
    label = F.lower(F.replace(intent, _L("_"), _L(" ")))
    opt = lambda prefix, c: F.when(c.isNotNull(), F.concat(_L(prefix), c))
    head = F.array_join(F.slice(tx.words_of(text), 1, n_words), " ")
    primary = F.concat_ws(" ", label, opt("erreur ", code), *[opt(f"{k} ", c) for k, c in identifiers.items()], system, F.when(head != "", head))
    return primary, F.concat_ws(" ", label, opt("code ", code), system)


def conversation_signals(df: DataFrame, conv: str, turn: str, role: str, text: str, overrides: Sequence[tuple[str, str]], transitions: Sequence[tuple[str, str]], depositor: str, colleague: str, followup: Sequence[str]) -> DataFrame:
    """Intent override, phase transition, audience and follow-up flag per message, by ordered patterns."""
    t = F.lower(F.coalesce(F.col(text), _L("")))
    none = _L(None).cast("string")
    fold = lambda rules: tx.first_match([(t.rlike(p), _L(v)) for p, v in rules], none)
    # "A prior assistant turn exists" needs only the first assistant turn of the conversation.
    first_reply = df.filter(F.col(role) == "assistant").groupBy(conv).agg(F.min(turn).alias("_first"))
    joined = df.join(first_reply, conv, "left")
    prior = F.coalesce(F.col("_first") < F.col(turn), _L(False))
    short = F.length(F.trim(t)) < 120
    return joined.select(
        *df.columns, fold(overrides).alias("intent_override"), fold(transitions).alias("phase"),
        F.when(t.rlike(depositor) | (fold(transitions) == "closing"), "depositor").when(t.rlike(colleague), "colleague").otherwise("n3_engineer").alias("audience"),
        (prior & (short | tx.matches_any(t, followup))).alias("is_followup"))


def map_labels(df: DataFrame, label: str, mapping: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Old label -> (level_1, level_2, source): direct, else substring either way in mapping order, else unknown."""
    key = F.upper(F.trim(F.coalesce(F.col(label), _L(""))))
    mk = lambda a, b, s: F.struct(_L(a).alias("level_1"), _L(b).alias("level_2"), _L(s).alias("mapping_source"))
    direct = [(key == k, mk(a, b, "direct")) for k, a, b in mapping]
    fuzzy = [(F.contains(_L(k), key) | F.contains(key, _L(k)), mk(a, b, "fuzzy")) for k, a, b in mapping]
    return df.withColumn("_m", tx.first_match(direct + fuzzy, mk("UNKNOWN", "UNDETERMINED", "default"))).select(*df.columns, "_m.*")


def chunk_procedures(df: DataFrame, key: str, title: str, sections: Mapping[str, str], min_len: int = 1) -> DataFrame:
    """One chunk per filled section of a procedure."""
    rows = F.array(*[F.struct(_L(name).alias("section"), F.col(col).alias("content")) for name, col in sections.items()])
    out = df.select(key, title, F.explode(rows).alias("s")).select(key, title, "s.*").filter(F.length(F.trim("content")) >= min_len)
    return out.select(key, F.concat_ws("_", key, "section").alias("chunk_id"), "section", F.concat(F.col(title), _L("\n"), F.col("content")).alias("content"))
