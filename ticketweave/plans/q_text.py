"""Text queries: predicates (P01-P09), column functions (T01-T44), schema detection and flattening."""

from __future__ import annotations

from pyspark.sql import functions as F

from ticketweave import fixed_values as fv
from ticketweave.functions import scores as sc, text as tx
from ticketweave.operators import extract as ex, windows as wi
from ticketweave.plans.q_rollups import CATEGORY_SQL, tickets
from ticketweave.plans.registry import query
from ticketweave.plans.sqlkit import any_in, case, count_in, count_re, items, q, replace_all, table_map, union_found, words
from ticketweave.sources import readers

C, L = F.col, F.lit
NOISE = "(?i)" + "|".join(fv.NOISE_PHRASES)


# ---------------------------------------------------------------- predicates
@query("p01_text_columns", """SELECT ticket_id, CASE WHEN length(f) > 60 THEN concat(left(f, 60), '...') ELSE f END AS full_text, concat(resume, ' ', sig, ' ', solution, ' ', application) AS ml_text
FROM (SELECT *, concat(resume, ' ', sig, ' ', cause, ' ', solution) AS f FROM $tickets)""")
def _(t):
    return t.tickets.select("ticket_id", tx.combined_text(["resume", "sig", "cause", "solution"], 60).alias("full_text"), tx.combined_text(["resume", "sig", "solution", "application"], None).alias("ml_text"))


@query("p01_long_documents", "SELECT doc_id, length(CASE WHEN length(text) > 2000 THEN concat(left(text, 2000), '...') ELSE text END) AS n, md5(CASE WHEN length(text) > 2000 THEN concat(left(text, 2000), '...') ELSE text END) AS h FROM documents")
def _(t):
    return t.documents.select("doc_id", tx.combined_text(["text"]).alias("x")).select("doc_id", F.length("x").alias("n").cast("long"), F.md5(C("x").cast("binary")).alias("h"))


@query("p02_weighted_text", """SELECT ticket_id, concat_ws(' [SEP] ', lower(sig), lower(trim(s)), lower(trim(s))) AS weighted FROM (SELECT ticket_id, sig, regexp_replace(CASE WHEN trim(solution) <> '' THEN solution ELSE resume END, '\\s+', ' ', 'g') AS s FROM $tickets)""")
def _(t):
    return t.tickets.select("ticket_id", tx.weighted_text("sig", "solution", "resume").alias("weighted"))


@query("p04_threshold_or_topk", """WITH k AS (SELECT user_id, event_id, value FROM events), p AS (SELECT * FROM k WHERE value >= 250), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) rn FROM k WHERE user_id NOT IN (SELECT user_id FROM p))
SELECT * FROM p UNION ALL SELECT user_id, event_id, value FROM r WHERE rn <= 3""")
def _(t):
    return wi.threshold_or_topk(t.events.select("user_id", "event_id", "value"), ["user_id"], "value", "event_id", 250.0)


@query("p05_guard_blocks", """SELECT ticket_id FROM (SELECT *, upper(concat_ws(' ', resume, sig)) AS u, CASE WHEN value / 100 <= 1 THEN value ELSE value / 100 END AS s, CASE WHEN user_id % 20 = 0 THEN 'diagnostic_engine' ELSE 'kb' END AS src FROM $tickets)
WHERE src = 'diagnostic_engine' OR (NOT contains(u, 'SEBA') AND (contains(u, 'VLAN') OR contains(u, 'IPON') OR contains(u, 'DLM')) AND s >= 40)""")
def _(t):
    df = t.tickets.withColumn("s", C("value") / 100).withColumn("src", F.when(C("user_id") % 20 == 0, "diagnostic_engine").otherwise("kb")).withColumn("kind", L("text"))
    return wi.guard_blocks(df, ["resume", "sig"], "src", "kind", "s", ["VLAN", "IPON", "DLM"], ["SEBA"], "investigation").select("ticket_id")


_GREET = "CASE user_id % 6 WHEN 0 THEN 'Bonjour à tous' WHEN 1 THEN ' oui ' WHEN 2 THEN 'merci bien' WHEN 3 THEN 'ouille' ELSE resume END"


@query("p06_off_topic", f"SELECT ticket_id, {' OR '.join('regexp_matches(lower(trim(g)), ' + q(p) + ')' for p in fv.OFF_TOPIC)} AS off_topic FROM (SELECT ticket_id, {_GREET} AS g FROM $tickets)")
def _(t):
    return t.tickets.selectExpr("ticket_id", f"{_GREET} AS g").select("ticket_id", tx.is_off_topic("g").alias("off_topic"))


@query("p07_flag_review", "SELECT ticket_id, value / 100 < 0.55 AND trim(solution) = '' AS requires_human_review FROM $tickets")
def _(t):
    return wi.flag_review(t.tickets.withColumn("conf", C("value") / 100), "conf", "solution").select("ticket_id", "requires_human_review")


@query("p08_evidence_row", """SELECT 'blocked' AS query_name, least(count(*), 50)::BIGINT AS row_count, count(*) >= 50 AS truncated, CASE WHEN count(*) > 0 THEN 0.97 ELSE 0.5 END::DOUBLE AS confidence, CASE WHEN count(*) = 0 THEN 'Insufficient evidence' END AS error FROM orders WHERE o_orderstatus = 'P'
UNION ALL SELECT 'none', count(*), false, 0.5, 'Insufficient evidence' FROM orders WHERE o_orderstatus = 'X'""")
def _(t):
    return wi.evidence_row(t.orders.filter("o_orderstatus = 'P'"), "blocked", 50).unionByName(wi.evidence_row(t.orders.filter("o_orderstatus = 'X'"), "none", 50))


@query("p09_categorize", f"SELECT ticket_id, {CATEGORY_SQL} AS category FROM $tickets")
def _(t):
    return t.tickets.select("ticket_id", tx.categorize("resume").alias("category"))


# ---------------------------------------------------------------- clean-up
_CLEAN = f"regexp_replace(regexp_replace(resume, '[^\\P{{C}}\\n\\t]', '', 'g'), {q(NOISE)}, ' ', 'g')"
_BARE = "regexp_replace(lower(w), '^[.,;:!?()]+|[.,;:!?()]+$', '', 'g')"


@query("t01_clean_ticket_text", f"SELECT ticket_id, array_to_string(list_transform({words(_CLEAN)}, lambda w: coalesce({table_map(fv.TYPO_MAP)}[{_BARE}], w)), ' ') AS clean FROM $tickets")
def _(t):
    return t.tickets.select("ticket_id", tx.clean_ticket_text("resume").alias("clean"))


_ML = replace_all("concat(resume, ' ', sig)", [(p, " ") for p in fv.ML_NOISE] + fv.ML_ERROR_CODES + fv.ML_EQUIPMENT)
_ML = f"regexp_replace(lower({_ML}), '[^\\p{{L}}\\p{{N}}_\\s\\-]', ' ', 'g')"
_FOLD = f"array_to_string(list_transform(string_split(w, '-'), lambda p: coalesce({table_map(fv.ML_SYNONYMS)}[p], p)), '-')"


@query("t02_normalize_for_ml", f"""SELECT ticket_id, array_to_string(list_filter(list_transform({words(_ML)}, lambda w: {_FOLD}), lambda w: w NOT IN ({items(fv.ML_STOP_WORDS)}) AND length(w) >= 2 AND NOT regexp_matches(w, '^\\p{{Nd}}+$')), ' ') AS norm FROM $tickets""")
def _(t):
    return t.tickets.select("ticket_id", tx.normalize_for_ml(F.concat_ws(" ", "resume", "sig")).alias("norm"))


@query("t03_repair_encoding", "SELECT doc_id, NOT regexp_matches(text, '[^\\x00-\\x7F]') OR regexp_matches(text, '[éèêëàâîïôùûüçÉÈÀ]') AS restored FROM documents")
def _(t):
    broken = F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")
    return t.documents.withColumn("broken", broken).select("doc_id", (tx.repair_encoding("broken") == C("text")).alias("restored"))


@query("t04_fold_accents", f"SELECT doc_id, md5(translate(lower(text), '{fv.ACCENTS_FROM}', '{fv.ACCENTS_TO}')) AS h FROM documents")
def _(t):
    return t.documents.select("doc_id", F.md5(tx.fold_accents("text").cast("binary")).alias("h"))


@query("t05_error_codes", f"""SELECT ticket_id, array_to_string(list_sort(list_distinct({union_found('x', fv.ERROR_CODE_PATTERNS['log'])})), ',') AS log_codes, array_to_string(list_sort(list_distinct({union_found('x', fv.ERROR_CODE_PATTERNS['text'])})), ',') AS text_codes FROM (SELECT ticket_id, concat(resume, ' ', sig) AS x FROM $tickets)""")
def _(t):
    x = F.concat_ws(" ", "resume", "sig")
    return t.tickets.select("ticket_id", F.array_join(tx.error_codes(x, "log"), ",").alias("log_codes"), F.array_join(tx.error_codes(x, "text"), ",").alias("text_codes"))


_CANON = " UNION ALL ".join(f"SELECT ticket_id, {i} AS i, replace(upper(concat('{p}', unnest(regexp_extract_all(resume, {q(r)}, {g})))), ' ', '') AS code, {c} AS confidence FROM k" for i, (r, g, p, c) in enumerate(fv.CANONICAL_CODES))


@query("t05_canonical_codes", f"WITH k AS $tickets, c AS ({_CANON}) SELECT ticket_id, code, min_by(confidence, i)::DOUBLE AS confidence FROM c WHERE NOT regexp_matches(code, '^(19|20)\\d{{2}}$') GROUP BY 1, 2")
def _(t):
    return t.tickets.select("ticket_id", F.explode(tx.canonical_codes("resume")).alias("c")).select("ticket_id", "c.*")


_ENT = [f"SELECT ticket_id, 'error_code' AS entity_type, unnest({union_found('x', fv.ERROR_CODE_PATTERNS['text'])}) AS value, 0.95 AS confidence FROM k"]
for _k, _ps in fv.ENTITY_PATTERNS.items():
    _ENT += [f"SELECT ticket_id, '{_k}', upper(trim(unnest(regexp_extract_all(x, {q(p)}, 1)))), 0.80 FROM k" for p in _ps]
_ENT += [f"SELECT ticket_id, 'action_verb', {q(v)}, 0.90 FROM k WHERE contains(lower(x), {q(v)})" for v in fv.ACTION_VERBS]
_ENT += [f"SELECT ticket_id, 'system_name', '{s}', 0.99 FROM k WHERE {any_in('lower(x)', a)}" for s, a in fv.SYSTEM_ALIASES.items()]


@query("t06_extract_entities", f"WITH k AS (SELECT ticket_id, concat(resume, ' ', sig) AS x FROM $tickets), e AS ({' UNION ALL '.join(_ENT)}) SELECT ticket_id, entity_type, value, max(confidence)::DOUBLE AS confidence FROM e WHERE length(value) >= 2 GROUP BY 1, 2, 3")
def _(t):
    return ex.extract_entities(t.tickets.select("ticket_id", F.concat_ws(" ", "resume", "sig").alias("x")), "x").drop("x")


_TOK = "list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'))"


@query("t07_detect_language", f"SELECT doc_id, CASE WHEN len(list_intersect({_TOK}, [{items(fv.ENGLISH_WORDS)}])) > len(list_intersect({_TOK}, [{items(fv.FRENCH_WORDS)}])) THEN 'en' ELSE 'fr' END AS detected FROM documents")
def _(t):
    return t.documents.select("doc_id", tx.detect_language("text").alias("detected"))


@query("t08_expand_tokens", f"SELECT ticket_id, array_to_string(list_transform({words('resume')}, lambda w: coalesce({table_map(fv.GLOSSARY)}[regexp_replace(lower(w), '[.,;:!?]+$', '')], w)), ' ') AS expanded FROM $tickets")
def _(t):
    return t.tickets.select("ticket_id", tx.expand_tokens("resume").alias("expanded"))


LEVEL_SQL = case([(f"contains(upper(line), '{l}')", f"'{'WARNING' if l == 'WARN' else l}'") for l in fv.LOG_LEVEL_ORDER], "'INFO'")


@query("t09_log_level", f"SELECT line_id, {LEVEL_SQL} AS level FROM $log_lines")
def _(t):
    return t.log_lines.select("line_id", tx.log_level("line").alias("level"))


@query("t10_extract_ts", """SELECT line_id, coalesce(try_strptime(replace(nullif(regexp_extract(line, '(\\d{4}-\\d{2}-\\d{2}[T ]\\d{2}:\\d{2}:\\d{2})', 1), ''), 'T', ' '), '%Y-%m-%d %H:%M:%S'), try_strptime(nullif(regexp_extract(line, '(\\d{2}/\\w{3}/\\d{4}:\\d{2}:\\d{2}:\\d{2})', 1), ''), '%d/%b/%Y:%H:%M:%S')) AS ts_read FROM $log_lines""")
def _(t):
    return t.log_lines.select("line_id", tx.extract_ts("line").alias("ts_read"))


UPSTREAM_SQL = lambda e: case([(f"contains(upper({e}), '{s}')", f"'{s}'") for s in fv.UPSTREAM_SYSTEMS], "NULL")


_MENTIONED_SQL = ", ".join(f"CASE WHEN {any_in('lower(resume)', a)} THEN {q(s)} END" for s, a in fv.SYSTEM_ALIASES.items())


@query("t11_detect_systems", f"SELECT ticket_id, {UPSTREAM_SQL('resume')} AS upstream, concat_ws(',', {_MENTIONED_SQL}) AS systems FROM $tickets")
def _(t):
    return t.tickets.select("ticket_id", tx.upstream_system("resume").alias("upstream"), F.array_join(tx.systems_mentioned("resume"), ",").alias("systems"))


_EXC_SQL = f"coalesce(nullif(regexp_extract(line, '(?i)[\\w.]+\\.exception\\.(?:[\\w.]*\\.)?(\\w+(?:Exception|Error))', 1), ''), {case([(f'contains(line, {q(c)})', q(c)) for c in fv.EXCEPTION_SHORT], 'NULL')})"
MSG_SQL = lambda e: case([(f"regexp_matches(lower({e}), {q(p)})", q(c)) for p, c in fv.MESSAGE_RULES], "NULL")


@query("t17_exception_code", f"SELECT line_id, x AS exception_class, coalesce({table_map(fv.EXCEPTION_SHORT)}[x], x, {MSG_SQL('line')}) AS code FROM (SELECT *, {_EXC_SQL} AS x FROM $log_lines)")
def _(t):
    return t.log_lines.select("line_id", tx.exception_class("line").alias("exception_class"), tx.exception_code("line").alias("code"))


@query("t18_to_template", f"SELECT line_id, trim(regexp_replace({replace_all('line', fv.TEMPLATE_VARIABLES)}, '\\s+', ' ', 'g')) AS template FROM $log_lines")
def _(t):
    return t.log_lines.select("line_id", tx.to_template("line").alias("template"))


_G = lambda p, g=1: f"nullif(regexp_extract(line, {q(p)}, {g}), '')"
_LAST = lambda e, s: f"(string_split({e}, '{s}'))[-1]"


@query("t19_parse_trace", f"""WITH k AS (SELECT line_id, line, {_LAST(_G(r'(java[.]\w+[.]\w+Exception|org[.]\w+[.]\w+Exception|[A-Z]\w*Exception)'), '.')} AS jt, {_G(r'Exception[:\s]+(.+?)(?:\n|$)')} AS jm, {_LAST(_G(r'at\s+([\w.]+)\.([\w$]+)\('), '.')} AS jmod, {_G(r'at\s+([\w.]+)\.([\w$]+)\(', 2)} AS jmeth,
 len(list_distinct(list_transform(regexp_extract_all(line, 'at\\s+([\\w.]+)\\.\\w+\\(', 1), lambda c: (string_split(c, '.'))[-1]))) AS jn, {_G(r'(\w+Error|\w+Exception|Traceback).*?:\s*(.+?)(?:\n|$)')} AS pt, {_G(r'(?i)ORA-(\d+)')} AS ora, upper({_G(r'(?i)\b(from|into|update|table)\s+(\w+)', 2)}) AS omod, {_G(r'\b(\d{4})\b')} AS net, upper({_G(r'(?i)\b(DSLAM|NE|BAS|ROUTEUR|VLAN|ND|NRO|CARTE|PORT)\b')}) AS nmod FROM $log_lines),
r AS (SELECT *, jn + CASE WHEN jt IS NOT NULL THEN 5 ELSE 0 END AS rj, CASE WHEN pt IS NOT NULL THEN 5 ELSE 0 END AS rp, CASE WHEN ora IS NOT NULL THEN 5 ELSE 0 END AS ro, CASE WHEN net IS NOT NULL THEN 5 ELSE 0 END AS rn FROM k),
s AS (SELECT *, CASE WHEN rj >= rp AND rj >= ro AND rj >= rn THEN 'java_spring' WHEN rp >= ro AND rp >= rn THEN 'python' WHEN ro >= rn THEN 'oracle' ELSE 'network' END AS strategy FROM r),
f AS (SELECT line_id, strategy, CASE strategy WHEN 'java_spring' THEN jt WHEN 'python' THEN pt WHEN 'oracle' THEN 'ORA-' || ora ELSE 'ERR_' || net END AS error_type, CASE strategy WHEN 'java_spring' THEN jmod WHEN 'oracle' THEN omod WHEN 'network' THEN nmod END AS module, CASE strategy WHEN 'java_spring' THEN jmeth END AS method, line_id % 5 AS app FROM s)
SELECT line_id, strategy, error_type, module, method, md5(lower(concat(app, '|', coalesce(error_type, ''), '|', coalesce(module, ''), '|', coalesce(method, '')))) AS signature_hash FROM f""")
def _(t):
    df = t.log_lines.select("line_id", "line", (C("line_id") % 5).alias("app"))
    return ex.parse_trace(df, "line", "app").select("line_id", "strategy", "error_type", "module", "method", "signature_hash")


_LOGWORDS = f"list_filter(regexp_extract_all(line, '[\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_full_match(w, '[a-zA-Z_][a-zA-Z0-9_]{{2,}}') AND lower(w) NOT IN ({items(fv.TRACE_STOP_WORDS)}))"


@query("t19_trace_keywords", f"SELECT line_id, array_to_string(list_filter({_LOGWORDS}, lambda w, i: list_position(list_transform({_LOGWORDS}, lambda v: lower(v)), lower(w)) = i)[1:20], ',') AS keywords FROM $log_lines")
def _(t):
    df = t.log_lines.select("line_id", "line", L("a").alias("app"))
    return ex.parse_trace(df, "line", "app").select("line_id", F.array_join("log_keywords", ",").alias("keywords"))


_PII_TEXT = "concat(resume, ' ', sig, ' tel 0612345678 ip 10.1.', user_id % 200, '.7 CMD-', 10000 + ticket_id, ' CMD-', 10000 + ticket_id, ' ND', 100000 + user_id)"
_PII_STEPS = ", ".join(f"s{i + 1} AS (SELECT *, regexp_replace(t{i}, {q(p)}, '[X]', 'g') AS t{i + 1}, len(list_distinct(regexp_extract_all(t{i}, {q(p)}))) AS n_{pre.lower()} FROM s{i})" for i, (pre, p) in enumerate(fv.PII_PATTERNS))
_PII_ROWS = " UNION ALL ".join(f"SELECT ticket_id, '{pre}' AS prefix, n_{pre.lower()}::BIGINT AS n FROM s10 WHERE n_{pre.lower()} > 0" for pre, _ in fv.PII_PATTERNS)


@query("t20_anonymize_counts", f"WITH s0 AS (SELECT ticket_id, {_PII_TEXT} AS t0 FROM $tickets), {_PII_STEPS} {_PII_ROWS}")
def _(t):
    df = t.tickets.selectExpr("ticket_id", f"{_PII_TEXT} AS body")
    _, mapping = ex.anonymize(df, "ticket_id", "body")
    return mapping.groupBy("ticket_id", F.regexp_extract("token", r"^\[([A-Z0-9]+)_", 1).alias("prefix")).agg(F.count("*").alias("n"))


@query("t20_restore_roundtrip", f"SELECT ticket_id, {_PII_TEXT} AS body FROM $tickets")
def _(t):
    df = t.tickets.selectExpr("ticket_id", f"{_PII_TEXT} AS body")
    rows, mapping = ex.anonymize(df, "ticket_id", "body")
    return ex.restore(rows, mapping, "ticket_id", "body")


# ---------------------------------------------------------------- policy, lines, snippets
_ANSWER = "concat(text, CASE turn % 5 WHEN 0 THEN ' DELETE FROM t_ports' WHEN 1 THEN ' sudo reboot' WHEN 2 THEN ' use [NUM_ID] here' WHEN 3 THEN ' il me semble que non' ELSE '' END)"


@query("t21_scan_policy", "WITH k AS (SELECT conv_id, turn, " + _ANSWER + " AS a FROM conversations) " + " UNION ALL ".join(f"SELECT conv_id, turn, '{k}' AS kind, regexp_replace(regexp_extract(a, {q(p)}), '^\\s+|\\s+$', '', 'g') AS value FROM k WHERE regexp_matches(a, {q(p)})" for k, p in fv.POLICY_RULES))
def _(t):
    df = t.conversations.selectExpr("conv_id", "turn", f"{_ANSWER} AS a")
    return ex.scan_policy(df, "a").drop("a")


_FILLER = "concat(text, chr(10), CASE turn % 3 WHEN 0 THEN 'Cordialement, N3' WHEN 1 THEN '- feel free to ask' ELSE 'fin' END, chr(10), chr(10), chr(10), 'suite')"


@query("t22_drop_lines", f"""SELECT conv_id, turn, regexp_replace(regexp_replace(array_to_string(list_filter(string_split(a, chr(10)), lambda s: NOT ({' OR '.join('regexp_matches(s, ' + q(p) + ')' for p in fv.FILLER_LINES)})), chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g') AS cleaned FROM (SELECT conv_id, turn, {_FILLER} AS a FROM conversations)""")
def _(t):
    return t.conversations.selectExpr("conv_id", "turn", f"{_FILLER} AS a").select("conv_id", "turn", tx.drop_lines("a").alias("cleaned"))


@query("t23_snippet", """WITH k AS (SELECT doc_id, text, strpos(lower(text), 'that') - 1 AS p FROM documents), b AS (SELECT *, greatest(0, p - 40) AS s, least(length(text), p + 80) AS e FROM k)
SELECT doc_id, CASE WHEN p < 0 THEN left(text, 120) ELSE concat(CASE WHEN s > 0 THEN '…' ELSE '' END, regexp_replace(substr(text, s + 1, e - s), '^\\s+|\\s+$', '', 'g'), CASE WHEN e < length(text) THEN '…' ELSE '' END) END AS snippet FROM b""")
def _(t):
    return t.documents.select("doc_id", tx.snippet("text", "that", 120).alias("snippet"))


@query("t24_stable_id", "SELECT doc_id, concat('LOG-', upper(left(md5(concat(source, lang)), 12))) AS id FROM documents")
def _(t):
    return t.documents.select("doc_id", tx.stable_id("LOG-", [C("source"), C("lang")], 12).alias("id"))


# ---------------------------------------------------------------- intents and tags
INTENTS = {
    "order_blocked": ["avp", "nro", "olt", "bloqué", "blocage", "occupé"], "diagnostic_request": ["erreur", "error", "1300", "4002", "ora-", "impossible", "problème"],
    "procedure_lookup": ["procédure", "comment faire", "reprise"], "root_cause_exploration": ["pourquoi", "cause", "depuis"],
    "delete_equipment": ["suppression", "supprimer", "purge"], "update_configuration": ["configuration", "modifier", "mutation", "affectation"],
}
INTENT_ORDER = ["order_blocked", "procedure_lookup", "root_cause_exploration", "diagnostic_request"]
_IC = {i: count_in("lower(resume)", p) for i, p in INTENTS.items()}
_REST = [i for i in INTENTS if i not in INTENT_ORDER]
_BEST = f"greatest({', '.join(_IC[i] for i in _REST)})"
_INTENT_RULES = [(f"{_IC[i]} > 0", i, _IC[i]) for i in INTENT_ORDER] + [(f"{_BEST} > 0 AND {_IC[i]} = {_BEST}", i, _IC[i]) for i in _REST]


@query("t25_classify_intent", f"SELECT ticket_id, {case([(c, q(i)) for c, i, _ in _INTENT_RULES], q('unknown'))} AS intent, round({case([(c, f'least(0.40 + 0.15 * {n}, 0.95)') for c, _, n in _INTENT_RULES], '0.3')}, 6) AS confidence FROM $tickets")
def _(t):
    r = t.tickets.select("ticket_id", tx.classify_intent("resume", INTENTS, INTENT_ORDER).alias("r"))
    return r.select("ticket_id", "r.intent", F.round("r.confidence", 6).alias("confidence"))


PROFILES = {
    "REPLAY_ORDER": [(["rejouer", "relancer", "rejeu"], 1.0), (["de nouveau", "à nouveau"], 0.5)], "DELETE_RESOURCE": [(["supprimer", "suppression", "retirer"], 1.0), (["nd supprimé"], 1.2)],
    "ORDER_BLOCKED": [(["bloqué", "blocage", "en attente"], 1.0), (["avp", "avp 1300"], 1.3), (["1300", "erreur 1300"], 0.8)], "DATA_INCONSISTENCY": [(["incohérence", "données incorrectes"], 1.0)],
    "DUPLICATE_RESOURCE": [(["doublon", "duplicate"], 1.0)], "DIAGNOSTIC": [(["erreur", "error", "b4002", "problème"], 1.0), (["42c", "9903"], 0.9)],
}
PROFILE_PRIORITY = {"DUPLICATE_RESOURCE": 95, "ORDER_BLOCKED": 90, "REPLAY_ORDER": 85, "DATA_INCONSISTENCY": 83, "DELETE_RESOURCE": 80, "DIAGNOSTIC": 10}
_PS = " UNION ALL ".join(f"SELECT ticket_id, '{i}' AS intent, {PROFILE_PRIORITY[i]} AS p, ({' + '.join(f'{w} * {count_in("lower(resume)", ph)}' for ph, w in g)})::DOUBLE AS s FROM k" for i, g in PROFILES.items())


@query("t26_weighted_intent", f"WITH k AS $tickets, s AS ({_PS}), b AS (SELECT ticket_id, max_by(intent, {{'p': p, 's': s}}) AS intent, max_by(s, {{'p': p, 's': s}}) AS s FROM s WHERE s > 0 GROUP BY 1) SELECT k.ticket_id, coalesce(b.intent, 'UNKNOWN') AS intent, CASE WHEN b.intent IS NULL THEN 0.2 ELSE round(least(0.40 + s * 0.12, 0.97), 3) END AS confidence FROM k LEFT JOIN b USING (ticket_id)")
def _(t):
    return t.tickets.select("ticket_id", tx.classify_intent_weighted("resume", PROFILES, PROFILE_PRIORITY).alias("r")).select("ticket_id", "r.*")


ROUTES = [(r"(?i)\b(dslam|vlan)\b", "runtime_state", 0.6), (r"(?i)suppression", "workflow", 0.85), (r"(?i)\berr(eur)?\b", "exception_lookup", 0.8), (r"(?i)timeout|deadlock", "transaction", 0.75), (r"(?i)planning", "ihm", 0.3), (r"(?i)script", "workflow", 0.5), (r"(?i)données", "schema", 0.55)]
_CATS = list(dict.fromkeys(c for _, c, _ in ROUTES))
_RW = " UNION ALL ".join(f"SELECT ticket_id, {i} AS i, '{c}' AS c, greatest({', '.join(f'CASE WHEN regexp_matches(resume, {q(p)}) THEN {w} ELSE 0 END' for p, k2, w in ROUTES if k2 == c)}, 0)::DOUBLE AS w FROM k" for i, c in enumerate(_CATS))


@query("t27_route_multilabel", f"""WITH k AS $tickets, r AS (SELECT * FROM ({_RW}) WHERE w > 0), b AS (SELECT ticket_id, first(c ORDER BY w DESC, i) AS c, max(w) AS w, array_to_string(list(c ORDER BY w DESC, i) FILTER (w >= 0.55), ',') AS labels FROM r GROUP BY 1)
SELECT k.ticket_id, CASE WHEN b.w IS NULL OR b.w < 0.40 THEN 'runtime_diagnostic' ELSE b.c END AS primary_label, CASE WHEN b.w IS NULL THEN 0.0 WHEN b.w < 0.40 THEN 0.3 ELSE b.w END::DOUBLE AS confidence, CASE WHEN b.w IS NULL THEN '' WHEN coalesce(labels, '') <> '' THEN labels WHEN b.w < 0.40 THEN 'runtime_diagnostic' ELSE b.c END AS labels FROM k LEFT JOIN b USING (ticket_id)""")
def _(t):
    r = t.tickets.select("ticket_id", tx.route_multilabel("resume", ROUTES).alias("r"))
    return r.select("ticket_id", C("r.primary").alias("primary_label"), "r.confidence", F.array_join("r.labels", ",").alias("labels"))


QUESTION_RULES = [
    {"category": "deletion_blocked", "urgency": "high", "weight": 1.5, "patterns": [r"(?i)suppression", r"(?i)impossible"]}, {"category": "vlan_issue", "urgency": "normal", "weight": 1.2, "patterns": [r"(?i)vlan", r"(?i)compteur", r"(?i)purge"]},
    {"category": "workflow_stuck", "urgency": "critical", "weight": 1.3, "patterns": [r"(?i)bloqué", r"(?i)script", r"(?i)deadlock"]}, {"category": "access", "urgency": "low", "weight": 1.0, "patterns": [r"(?i)accès", r"(?i)connexion|connection"]},
]
_QR = " UNION ALL ".join(f"SELECT ticket_id, {i} AS i, '{r['category']}' AS c, '{r['urgency']}' AS u, least(0.5 + 0.15 * n, 0.95) * {r['weight']} AS w FROM (SELECT ticket_id, {count_re('resume', r['patterns'])} AS n FROM k) WHERE n > 0" for i, r in enumerate(QUESTION_RULES))


@query("t28_route_question", f"""WITH k AS $tickets, r AS ({_QR}), b AS (SELECT ticket_id, list(c ORDER BY w DESC, i) AS cs, first(u ORDER BY w DESC, i) AS u, max(w) AS w FROM r GROUP BY 1)
SELECT k.ticket_id, coalesce(cs[1], 'causal_escalation') AS category, CASE WHEN w IS NULL THEN 0.2 ELSE round(least(w / 2, 0.95), 6) END AS confidence, coalesce(u, 'normal') AS urgency, coalesce(array_to_string(cs[2:4], ','), '') AS secondary FROM k LEFT JOIN b USING (ticket_id)""")
def _(t):
    r = t.tickets.select("ticket_id", tx.route_question("resume", QUESTION_RULES).alias("r"))
    return r.select("ticket_id", "r.category", F.round("r.confidence", 6).alias("confidence"), "r.urgency", F.coalesce(F.array_join("r.secondary", ","), L("")).alias("secondary"))


TAXONOMY = {"provisioning.vlan": ["vlan", "compteur", "purge"], "data.inconsistency": ["incohérence", "doublon", "accès"], "system.timeout": ["timeout", "deadlock", "erreur"], "ops.deletion": ["suppression", "vlan", "impossible"], "log_investigation": ["erreur interne"]}
TAX_PRIORITY = ["log_investigation"]
_TO = [*TAX_PRIORITY, *[k for k in TAXONOMY if k not in TAX_PRIORITY]]
_TT = " UNION ALL ".join(f"SELECT ticket_id, {i} AS i, '{k}' AS t, {count_in('lower(resume)', TAXONOMY[k])} AS n FROM k" for i, k in enumerate(_TO))


@query("t29_tag_incident_type", f"WITH k AS $tickets, s AS (SELECT * FROM ({_TT}) WHERE n > 0), b AS (SELECT ticket_id, first(t ORDER BY n DESC, i) AS t FROM s GROUP BY 1) SELECT k.ticket_id, coalesce(t, 'unknown.insufficient_information') AS incident_type FROM k LEFT JOIN b USING (ticket_id)")
def _(t):
    return t.tickets.select("ticket_id", tx.tag_incident_type("resume", TAXONOMY, TAX_PRIORITY).alias("incident_type"))


@query("t30_ticket_scores", f"""WITH k AS (SELECT *, {CATEGORY_SQL} AS category, len(list_distinct({union_found('resume', fv.ERROR_CODE_PATTERNS['text'])})) > 0 AS hc, {any_in('lower(resume)', sum(fv.SYSTEM_ALIASES.values(), []))} AS hs FROM $tickets)
SELECT ticket_id, round(least(0.6 * 0.40 + least((user_id % 6) * 0.05, 0.20) + CASE WHEN hc THEN 0.15 ELSE 0 END + CASE WHEN category <> 'Autre' THEN 0.20 ELSE 0 END + CASE WHEN hs THEN 0.05 ELSE 0 END, 0.97), 3) AS confidence,
 round(least(0.25 + CASE WHEN hc THEN 0.05 ELSE 0 END + CASE WHEN category <> 'Autre' THEN 0.05 ELSE 0 END + CASE WHEN length(resume) > 50 THEN 0.05 ELSE 0 END, 0.40), 3) AS trust,
 round(least(CASE WHEN contains(resume, '0312345678') THEN 0.30 ELSE 0 END + CASE WHEN hc THEN 0.30 ELSE 0 END + CASE WHEN hs THEN 0.20 ELSE 0 END + CASE WHEN contains(resume, 'suppression') THEN 0.20 ELSE 0 END, 1.0), 3) AS completeness FROM k""")
def _(t):
    df = t.tickets.withColumns({"category": tx.categorize("resume"), "hc": F.size(tx.error_codes("resume", "text")) > 0, "hs": F.size(tx.systems_mentioned("resume")) > 0})
    known = C("category") != "Autre"
    return df.select("ticket_id", sc.ticket_confidence(L(0.6), (C("user_id") % 6), C("hc"), known, C("hs")).alias("confidence"), sc.ticket_trust(C("hc"), known, F.length("resume") > 50).alias("trust"),
                     sc.completeness(F.contains("resume", L("0312345678")), C("hc"), C("hs"), F.contains("resume", L("suppression"))).alias("completeness"))


LABEL_MAP = [("DONNEES", "DATA", "DATA_INCONSISTENCY"), ("RESEAU", "DATA", "NETWORK_CONFIGURATION"), ("SCRIPT", "DATA", "DATA_CORRECTION_SCRIPT"), ("HABILITATIONS", "ACCESS", "ACCESS_RIGHTS")]


@query("t31_map_labels", "SELECT ticket_id, m.a AS level_1, m.b AS level_2, m.s AS mapping_source FROM (SELECT ticket_id, " + case(
    [(f"upper(trim(cause)) = '{k}'", f"{{'a': '{a}', 'b': '{b}', 's': 'direct'}}") for k, a, b in LABEL_MAP] + [(f"contains('{k}', upper(trim(cause))) OR contains(upper(trim(cause)), '{k}')", f"{{'a': '{a}', 'b': '{b}', 's': 'fuzzy'}}") for k, a, b in LABEL_MAP],
    "{'a': 'UNKNOWN', 'b': 'UNDETERMINED', 's': 'default'}") + " AS m FROM $tickets)")
def _(t):
    return ex.map_labels(t.tickets.select("ticket_id", "cause"), "cause", LABEL_MAP).drop("cause")


_L1 = list(dict.fromkeys(s[1] for s in fv.KEYWORD_SIGNALS))
_KW = lambda rows: " + ".join(f"CASE WHEN contains(lower(resume), {q(k)}) THEN {w} ELSE 0 END" for k, _, _, w in rows)
_KB = " UNION ALL ".join(f"SELECT ticket_id, '{l}' AS l1, ({_KW([s for s in fv.KEYWORD_SIGNALS if s[1] == l])})::DOUBLE AS w FROM k" for l in _L1)


@query("t32_keyword_boost", f"WITH k AS $tickets, p AS ({_KB}), s AS (SELECT *, sum(w) OVER (PARTITION BY ticket_id) AS total FROM p) SELECT ticket_id, l1, round(w / total, 6) AS share, round(least(total, 1.0), 6) AS boost FROM s WHERE w > 0")
def _(t):
    r = t.tickets.select("ticket_id", sc.keyword_boost(C("resume")).alias("r"))
    return r.select("ticket_id", F.round("r.boost", 6).alias("boost"), F.explode("r.shares").alias("s")).select("ticket_id", "s.l1", F.round("s.share", 6).alias("share"), "boost")


@query("t32_keyword_boost_l2", "WITH k AS $tickets, p AS (" + " UNION ALL ".join(f"SELECT ticket_id, '{l}' AS l2, ({_KW([s for s in fv.KEYWORD_SIGNALS if s[1] == 'DATA' and s[2] == l])})::DOUBLE AS w FROM k" for l in dict.fromkeys(s[2] for s in fv.KEYWORD_SIGNALS if s[1] == "DATA")) + "), s AS (SELECT *, sum(w) OVER (PARTITION BY ticket_id) AS total FROM p) SELECT ticket_id, l2, round(w / total, 6) AS share FROM s WHERE w > 0")
def _(t):
    r = t.tickets.select("ticket_id", sc.keyword_boost_l2(C("resume"), "DATA").alias("r")).select("ticket_id", F.explode("r.shares").alias("s"))
    return r.select("ticket_id", C("s.l1").alias("l2"), F.round("s.share", 6).alias("share"))


# ---------------------------------------------------------------- scores
DOC_ACTIONS, DOC_TECH, DOC_VAGUE = ["the", "of", "la", "de", "und", "con", "retition", "erar", "thou", "ión", "that", "von"], ["tion", "ment", "ung", "ado", "thth", "errea", "heit", "quea"], ["it", "en", "is", "pas", "die", "al."]
_NW = "len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> ''))"
_VG = [f"(^|[^\\p{{L}}\\p{{N}}_]){p}" + ("([^\\p{L}\\p{N}_]|$)" if p[-1].isalnum() else "") for p in DOC_VAGUE]
SCORE_SQL = f"""(CASE WHEN nw >= 300 THEN 20 WHEN nw >= 150 THEN 14 WHEN nw >= 80 THEN 8 WHEN nw >= 30 THEN 4 ELSE 0 END + least(doc_id % 6, 4) * 5 + least({count_in('lower(text)', DOC_ACTIONS)} * 2, 20) + least((doc_id % 4) * 5, 10) + least({count_in('lower(text)', DOC_TECH)} * 2, 15)
 + greatest(0, 15 - floor(least({count_re('lower(text)', _VG)} / greatest(nw / 50, 1.0), 1.0) * 15)))::INTEGER"""
DOCS_SCORED_SQL = f"(SELECT *, {SCORE_SQL} AS score FROM (SELECT *, {_NW} AS nw FROM documents))"


def scored_documents(t):
    n = F.size(tx.words_of(C("text")))
    df = t.documents.withColumn("nw", n)
    score = sc.document_score(C("text"), C("nw"), C("doc_id") % 6, C("doc_id") % 4, DOC_ACTIONS, DOC_TECH, DOC_VAGUE)
    # As a row of its own the score is worked out once, not wherever a filter or a label asks for it.
    return df.withColumn("score", F.explode_outer(F.array(score)))


@query("t33_document_score", f"SELECT doc_id, score, CASE WHEN score >= 80 THEN 'canonique' WHEN score >= 60 THEN 'bonne' WHEN score >= 30 THEN 'partielle' ELSE 'inutilisable' END AS label, CASE WHEN score >= 80 THEN 'high' WHEN score >= 60 THEN 'medium' WHEN score >= 30 THEN 'low' ELSE 'none' END AS trust FROM {DOCS_SCORED_SQL}")
def _(t):
    return scored_documents(t).select("doc_id", "score", sc.quality_label(C("score")).alias("label"), sc.quality_trust(C("score")).alias("trust"))


_SRC = ["human_validated_fr", "fr_unvalidated", "jira_resolved", "cluster", "single_ticket", "other"]
_SRC_W = "CASE doc_id % 6 WHEN 0 THEN 1.0 WHEN 1 THEN 0.75 WHEN 2 THEN 0.70 WHEN 3 THEN CASE WHEN doc_id % 40 >= 20 THEN 0.65 ELSE 0.50 END WHEN 4 THEN 0.30 ELSE 0.30 END::DOUBLE"


@query("t34_document_trust", f"""WITH k AS (SELECT doc_id, least(floor((0.40 * {_SRC_W} + 0.25 * CASE WHEN doc_id % 101 > 0 THEN greatest(((doc_id % 2) + (doc_id % 3 > 0)::INTEGER + (doc_id % 5 > 0)::INTEGER) / 3.0::DOUBLE, doc_id % 101 / 100) ELSE ((doc_id % 2) + (doc_id % 3 > 0)::INTEGER + (doc_id % 5 > 0)::INTEGER) / 3.0::DOUBLE END + 0.25 * CASE WHEN doc_id % 7 = 0 THEN 1.0 ELSE 0.0 END::DOUBLE + 0.10 * exp(-0.05 * (doc_id % 37))) * 100), 100)::INTEGER AS trust FROM documents)
SELECT doc_id, trust, CASE WHEN trust >= 70 THEN 'strong' WHEN trust >= 40 THEN 'moderate' WHEN trust > 0 THEN 'weak' ELSE 'insufficient' END AS label FROM k""")
def _(t):
    src = tx.first_match([(C("doc_id") % 6 == i, L(n)) for i, n in enumerate(_SRC)], L("other"))
    parts = [C("doc_id") % 2 == 1, C("doc_id") % 3 > 0, C("doc_id") % 5 > 0]
    v = sc.document_trust(src, C("doc_id") % 101, C("doc_id") % 7 == 0, parts, C("doc_id") % 40, C("doc_id") % 37)
    return t.documents.select("doc_id", v.alias("trust")).withColumn("label", sc.trust_label(C("trust")))


@query("t34_procedure_confidence", """SELECT doc_id, round(v, 6) AS trust, CASE WHEN v >= 0.80 THEN 'high' WHEN v >= 0.60 THEN 'medium' WHEN v >= 0.40 THEN 'low' ELSE 'very_low' END AS level FROM (SELECT doc_id, 0.50::DOUBLE * least(doc_id % 101 / 100, 1.0) + 0.30::DOUBLE * ((doc_id % 2) + (doc_id % 3 > 0)::INTEGER + (doc_id % 5 > 0)::INTEGER) / 3.0 + 0.20::DOUBLE AS v FROM documents)""")
def _(t):
    v, level = sc.procedure_confidence(C("doc_id") % 101, [C("doc_id") % 2 == 1, C("doc_id") % 3 > 0, C("doc_id") % 5 > 0])
    return t.documents.select("doc_id", F.round(v, 6).alias("trust"), level.alias("level"))


@query("t35_trust_points", """WITH k AS (SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 40 WHEN 1 THEN 25 ELSE 10 END + CASE WHEN m >= 0.9 THEN 20 WHEN m >= 0.75 THEN 12 WHEN m >= 0.6 THEN 6 ELSE 0 END + CASE WHEN u > 50 AND s > 0 AND s / u > 0.7 THEN 10 ELSE 0 END AS canonical,
 least(CASE WHEN o_orderkey % 2 = 0 THEN 40 ELSE 15 END + CASE WHEN u >= 50 THEN 20 WHEN u >= 10 THEN 10 WHEN u >= 3 THEN 5 ELSE 0 END + CASE WHEN o_orderkey % 5 > 0 THEN 20 ELSE 0 END + CASE WHEN o_orderkey % 7 > 2 THEN 20 ELSE 0 END + CASE WHEN m >= 0.75 THEN 10 ELSE 0 END, 100) AS signature,
 CASE WHEN u >= 20 THEN 15 WHEN u >= 5 THEN 8 ELSE 3 END + CASE WHEN o_orderstatus = 'F' THEN 10 ELSE 0 END + least((o_orderkey % 8) * 2, 10) AS ticket FROM (SELECT *, o_orderkey % 101 / 100 AS m, o_orderkey % 90 AS u, o_orderkey % 83 AS s FROM orders))
SELECT id, canonical, signature::INTEGER AS signature, ticket::INTEGER AS ticket, least(100, greatest(canonical, signature, ticket) + floor(canonical * 0.2) + floor(signature * 0.2) + floor(ticket * 0.2) - floor(greatest(canonical, signature, ticket) * 0.2))::INTEGER AS combined FROM k""")
def _(t):
    df = t.orders.withColumns({"m": C("o_orderkey") % 101 / 100, "u": C("o_orderkey") % 90, "s": C("o_orderkey") % 83})
    level = F.when(C("o_orderkey") % 3 == 0, "high").when(C("o_orderkey") % 3 == 1, "medium").otherwise("low")
    df = df.select(C("o_orderkey").alias("id"), sc.canonical_points(level, C("m"), C("u"), C("s")).cast("int").alias("canonical"),
                   sc.signature_points(C("o_orderkey") % 2 == 0, C("u"), C("o_orderkey") % 5 > 0, C("o_orderkey") % 7 > 2, C("m")).cast("int").alias("signature"),
                   sc.ticket_points(C("u"), C("o_orderstatus") == "F", (C("o_orderkey") % 8).cast("int")).cast("int").alias("ticket"))
    return df.withColumn("combined", sc.combined_points(F.array("canonical", "signature", "ticket")))


@query("t36_pattern_trust", """SELECT p_partkey, round(least(0.35 * CASE WHEN p_partkey % 2 = 0 THEN 0.78 ELSE 0.45 END::DOUBLE + 0.25 * least(ln(1 + p_size * 5) / ln(201.0), 1.0) + 0.30 * least(CASE WHEN p_partkey % 2 = 0 THEN 0.70 ELSE 0.0 END::DOUBLE + CASE WHEN p_partkey % 4 > 0 THEN least((p_partkey % 4) * 0.15::DOUBLE, 0.30::DOUBLE) ELSE 0 END, 1.0::DOUBLE) + 0.10 * greatest(0.0::DOUBLE, 1.0 - p_partkey % 500 / 365), 1.0), 4) AS pattern,
 round(least(0.40 * (p_size / 60) + 0.25 * least(ln(1 + p_partkey % 300) / ln(201.0), 1.0) + 0.25 * CASE WHEN p_partkey % 4 > 0 THEN least(ln(1 + p_partkey % 4) / ln(11.0) * 0.8 + ln(1 + p_size) / ln(201.0) * 0.2, 1.0) ELSE 0 END + 0.10 * CASE WHEN p_partkey % 2 = 0 THEN 1.0 ELSE 0.0 END, 1.0), 4) AS procedure_trust FROM part""")
def _(t):
    even = C("p_partkey") % 2 == 0
    return t.part.select("p_partkey", sc.pattern_trust(C("p_size") * 5, even, C("p_partkey") % 4, C("p_partkey") % 500).alias("pattern"),
                         sc.procedure_trust(C("p_size") / 60, C("p_partkey") % 300, C("p_partkey") % 4, even, C("p_size")).alias("procedure_trust"))


@query("t37_durations", """SELECT l_orderkey, l_linenumber, l_partkey, round((epoch_us(l_shipdate) - epoch_us(o_orderdate)) / 8.64e10, 6) AS mttr_days, o_orderdate::DATE AS day, strftime(o_orderdate, '%Y-%m') AS month, date_trunc('week', o_orderdate)::DATE AS week_start FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def _(t):
    df = t.lineitem.join(t.orders, C("l_orderkey") == C("o_orderkey"))
    return wi.with_durations(df, "o_orderdate", "l_shipdate").select("l_orderkey", "l_linenumber", "l_partkey", "mttr_days", "day", "month", "week_start")


@query("t38_flatten_corrections", "SELECT event_id, (props->>'$.k')::BIGINT AS k, coalesce((props->>'$.corrected')::BIGINT, (props->>'$.k')::BIGINT) AS final FROM events")
def _(t):
    df = t.events.select("event_id", "props")
    return ex.flatten_json(df, "props", "k BIGINT, corrected BIGINT", {"k": ["k"], "final": ["corrected", "k"]}).drop("props")


_TS = lambda e: f"list_distinct(list_filter(regexp_split_to_array(lower({e}), '\\s+'), lambda w: w <> ''))"


@query("t39_token_similarity", f"""WITH k AS (SELECT conv_id, turn, {_TS('text')} AS a, {_TS("coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), '')")} AS b FROM conversations)
SELECT conv_id, turn, round(coalesce(len(list_intersect(a, b)) / nullif(len(list_distinct(list_concat(a, b))), 0), 0), 6) AS jaccard, round(CASE WHEN len(a) > 0 AND len(b) > 0 THEN len(list_intersect(a, b)) / greatest(len(a), len(b)) ELSE 0 END, 6) AS overlap FROM k""")
def _(t):
    from ticketweave.operators.ordered import previous_values
    c = t.conversations
    prev = c.select("conv_id", (C("turn") + 1).alias("turn"), C("text").alias("before"))
    df = c.join(prev, ["conv_id", "turn"], "left").withColumns({"a": tx.token_set("text"), "b": tx.token_set(F.coalesce("before", L("")))})
    return df.select("conv_id", "turn", F.round(tx.jaccard(C("a"), C("b")), 6).alias("jaccard"), F.round(tx.overlap_max(C("a"), C("b")), 6).alias("overlap"))


@query("t40_search_text", """SELECT ticket_id, concat_ws(' ', 'order blocked', CASE WHEN user_id % 2 = 0 THEN concat('erreur ', user_id) END, CASE WHEN user_id % 3 = 0 THEN concat('ND ', event_type) END, nullif(application, ''), array_to_string(list_filter(regexp_split_to_array(resume, '\\s+'), lambda w: w <> '')[1:20], ' ')) AS primary_text,
 concat_ws(' ', 'order blocked', CASE WHEN user_id % 2 = 0 THEN concat('code ', user_id) END, nullif(application, '')) AS fallback_text, concat_ws(' | ', concat('Titre: ', resume), CASE WHEN cause <> '' THEN concat('Causes: ', cause) END, CASE WHEN application <> '' THEN concat('Application: ', application) END) AS record_text FROM $tickets""")
def _(t):
    code = F.when(C("user_id") % 2 == 0, C("user_id").cast("string"))
    nd = F.when(C("user_id") % 3 == 0, C("event_type"))
    p, f = ex.query_texts(L("ORDER_BLOCKED"), code, {"ND": nd}, F.nullif(C("application"), L("")), C("resume"))
    return t.tickets.select("ticket_id", p.alias("primary_text"), f.alias("fallback_text"), ex.search_text([("Titre: ", C("resume")), ("Causes: ", C("cause")), ("Application: ", C("application"))]).alias("record_text"))


OVERRIDES = [(r"\bthe\b", "summarize"), (r"ction", "schema"), (r"quea", "procedure_lookup")]
TRANSITIONS = [(r"thth", "closing"), (r"retition", "investigation"), (r"eux", "resolution")]


@query("t41_conversation_signals", f"""WITH f AS (SELECT conv_id, min(turn) AS first FROM conversations WHERE role = 'assistant' GROUP BY 1), k AS (SELECT c.*, lower(text) AS l, first FROM conversations c LEFT JOIN f USING (conv_id)),
p AS (SELECT *, {case([(f'regexp_matches(l, {q(a)})', q(b)) for a, b in OVERRIDES], 'NULL')} AS intent_override, {case([(f'regexp_matches(l, {q(a)})', q(b)) for a, b in TRANSITIONS], 'NULL')} AS phase FROM k)
SELECT conv_id, turn, intent_override, phase, CASE WHEN regexp_matches(l, 'erro') OR phase = 'closing' THEN 'depositor' WHEN regexp_matches(l, 'unge') THEN 'colleague' ELSE 'n3_engineer' END AS audience, coalesce(first < turn, false) AND (length(trim(l)) < 120 OR contains(l, 'onth') OR contains(l, 'eau')) AS is_followup FROM p""")
def _(t):
    return ex.conversation_signals(t.conversations, "conv_id", "turn", "role", "text", OVERRIDES, TRANSITIONS, "erro", "unge", ["onth", "eau"]).drop("role", "text")


_CW, _EW = r"(?i)(thand|eaux|hein|cióna|verein)", r"(?i)\b(the|la|die|de)\b"


@query("t42_mine_constraints", f"""WITH k AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents)
SELECT doc_id, line_no::INTEGER AS line_no, concat('SFD-', upper(left(md5(line), 8))) AS rule_id, left(trim(line), 200) AS description, array_to_string(list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(line, '[\\p{{L}}\\p{{N}}_]+'), lambda x: upper(x)), lambda x: x IN ('THE', 'LA', 'DIE', 'DE')))), ',') AS entities FROM k WHERE regexp_matches(line, {q(_CW)}) AND length(trim(line)) > 15""")
def _(t):
    return ex.mine_constraints(t.documents.select("doc_id", "text"), "text", _CW, _EW).withColumn("entities", F.array_join("entities", ","))


_OPT = "concat('POST then GET /api/v1/items', CASE WHEN page_id % 3 = 0 THEN ' DELETE' ELSE '' END, ' ', html)"


@query("t42_mine_operations", f"""WITH k AS (SELECT page_id, {_OPT} AS b FROM pages), s AS (SELECT page_id, string_split(regexp_replace(b, '\\b(GET|POST|PUT|DELETE|PATCH)\\b', chr(1) || '\\1', 'g'), chr(1)) AS parts FROM k), e AS (SELECT page_id, parts, unnest(generate_series(2, len(parts))) AS i FROM s)
SELECT * FROM (SELECT page_id, (i - 1)::INTEGER AS op_no, regexp_extract(parts[i], '^\\b(GET|POST|PUT|DELETE|PATCH)\\b', 1) AS method, regexp_extract(left(array_to_string(parts[i:], ''), 200), '(/[a-zA-Z0-9/_\\-\\{{\\}}]{{5,80}})', 1) AS path FROM e) WHERE path <> ''""")
def _(t):
    return ex.mine_operations(t.pages.selectExpr("page_id", f"{_OPT} AS b"), "b")


_MK = {k: count_re("a", v) for k, v in fv.ANSWER_MARKERS.items()}
_QA = "concat(a.text, CASE a.turn % 4 WHEN 1 THEN ' SELECT x FROM t_ports WHERE id = 1 et t_foo' WHEN 3 THEN ' cause racine : step 2: check. Solution : relancer le service t_bar' ELSE '' END)"
_W5 = lambda e: f"list_distinct(regexp_extract_all(lower({e}), '[\\p{{L}}\\p{{N}}_]{{5,}}'))"


@query("t43_answer_score", f"""WITH k AS (SELECT a.conv_id, a.turn, {_QA} AS a, coalesce(q.text, '') AS q FROM conversations a LEFT JOIN conversations q ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 WHERE a.role = 'assistant'),
n AS (SELECT *, length(regexp_replace(a, '^\\s+|\\s+$', '', 'g')) AS len, len(list_filter(list_distinct(regexp_extract_all(a, '\\bt_[a-z_]{{3,40}}\\b')), lambda x: x <> 't_ports')) AS fake, len(list_filter(regexp_extract_all(a, 'FROM\\s+(t_\\w+)', 1), lambda x: x = 't_ports')) AS known, {_W5('q')} AS qw, {_W5('a')} AS aw FROM k),
p AS (SELECT *, least({_MK['evidence']} * 4 + least(known * 3, 10), 25) AS evidence, greatest(0, 25 - ({_MK['red_flag']} * 5 + fake * 4)) AS risk, CASE WHEN turn % 3 = 0 AND {_MK['rca']} = 0 THEN 0 ELSE least({_MK['rca']} * 5, 20) END AS depth, least({_MK['operational']} * 4, 20) AS value, CASE WHEN len < 100 THEN 2 WHEN len < 300 THEN 5 WHEN len < 800 THEN 8 ELSE 10 END AS base FROM n),
c AS (SELECT *, CASE WHEN len(qw) > 0 AND len(list_intersect(qw, aw)) / len(qw) < 0.2 THEN greatest(0, base - 4) ELSE base END AS completeness FROM p)
SELECT conv_id, turn, evidence::INTEGER AS evidence, risk::INTEGER AS risk, depth::INTEGER AS depth, value::INTEGER AS value, completeness::INTEGER AS completeness, (evidence + risk + depth + value + completeness)::INTEGER AS total FROM c""")
def _(t):
    c = t.conversations
    asked = c.select("conv_id", (C("turn") + 1).alias("turn"), C("text").alias("q"))
    extra = F.when(C("turn") % 4 == 1, " SELECT x FROM t_ports WHERE id = 1 et t_foo").when(C("turn") % 4 == 3, " cause racine : step 2: check. Solution : relancer le service t_bar").otherwise("")
    df = c.filter("role = 'assistant'").withColumn("a", F.concat("text", extra)).join(asked, ["conv_id", "turn"], "left")
    names = F.array_distinct(F.regexp_extract_all("a", L(r"\bt_[a-z_]{3,40}\b"), L(0)))
    fake, known = F.size(F.filter(names, lambda x: x != "t_ports")), F.size(F.filter(F.regexp_extract_all("a", L(r"FROM\s+(t_\w+)"), L(1)), lambda x: x == "t_ports"))
    s = sc.answer_score(C("a"), C("q"), fake, known, C("turn") % 3 == 0)
    return df.select("conv_id", "turn", s.alias("s")).select("conv_id", "turn", *[C(f"s.{x}").cast("int").alias(x) for x in ("evidence", "risk", "depth", "value", "completeness", "total")])


@query("t44_review_priority", f"""SELECT ticket_id, CASE WHEN v >= 0.80 THEN NULL WHEN (kind IN ({items(fv.CRITICAL_INCIDENT_TYPES)}) AND v < 0.70) OR v < 0.40 THEN 9 WHEN v < 0.60 THEN 7 ELSE 4 END::INTEGER AS priority FROM (SELECT ticket_id, value / 100 AS v, CASE user_id % 4 WHEN 0 THEN 'backend_error.api_error' ELSE 'other' END AS kind FROM $tickets)""")
def _(t):
    kind = F.when(C("user_id") % 4 == 0, "backend_error.api_error").otherwise("other")
    return t.tickets.select("ticket_id", sc.review_priority(C("value") / 100, kind).alias("priority"))


# ---------------------------------------------------------------- sources that are relational
@query("s02_canonicalize_columns", "SELECT ticket_id::VARCHAR AS ticket, resume AS inc_resume, solution AS inc_solution, cause AS inc_cause, application, status AS inc_statut FROM $tickets")
def _(t):
    raw = t.tickets.select(C("ticket_id").cast("string").alias("Numero"), C("resume").alias("Titre court"), C("solution").alias("Resolution"), C("cause").alias("Motif"), C("application").alias("Systeme"), C("status").alias("State"))
    return readers.canonicalize_columns(raw)


@query("s06_flatten_issues", """SELECT concat('jira_K-', event_id) AS id, concat('K-', event_id) AS issue_key, event_type AS summary, CASE WHEN user_id % 3 = 0 THEN NULL ELSE concat('u', user_id) END AS assignee, concat('l', user_id % 4) AS labels, concat('c', user_id % 2) AS components FROM events""")
def _(t):
    user = C("user_id")
    payload = F.to_json(F.struct(F.concat(L("K-"), C("event_id").cast("string")).alias("key"), F.struct(
        C("event_type").alias("summary"), F.when(user % 3 != 0, F.struct(F.concat(L("u"), user.cast("string")).alias("displayName"))).alias("assignee"),
        F.array(F.concat(L("l"), (user % 4).cast("string"))).alias("labels"), F.array(F.struct(F.concat(L("c"), (user % 2).cast("string")).alias("name"))).alias("components")).alias("fields")))
    flat = readers.flatten_issues(t.events.select(payload.alias("payload")), "payload")
    return flat.select("id", "issue_key", "summary", "assignee", F.array_join("labels", ",").alias("labels"), F.array_join("components", ",").alias("components"))


LANGS = {".py": "python", ".java": "java", ".sql": "sql"}
_PATH = "concat(CASE page_id % 5 WHEN 0 THEN 'node_modules/' ELSE 'src/' END, 'f', page_id, CASE page_id % 4 WHEN 0 THEN '.py' WHEN 1 THEN '.JAVA' WHEN 2 THEN '.sql' ELSE '.txt' END)"


@query("s12_scan_artifacts", f"""SELECT path, extension, CASE extension WHEN '.py' THEN 'python' WHEN '.java' THEN 'java' ELSE 'sql' END AS language, strlen(html)::INTEGER AS size_bytes, len(string_split(html, chr(10)))::INTEGER AS n_lines FROM (SELECT *, lower(regexp_extract(path, '(\\.[A-Za-z0-9]+)$', 1)) AS extension FROM (SELECT *, {_PATH} AS path FROM pages)) WHERE extension IN ('.py', '.java', '.sql') AND NOT contains(path, 'node_modules/')""")
def _(t):
    return ex.artifact_rows(t.pages.selectExpr(f"{_PATH} AS path", "html"), "path", "html", LANGS, ["node_modules"])


FACTS = {"title": r"<title>([^<]*)</title>", "link": r'href="(/[^"]+)"', "track": r"track\((\d+)\)"}


@query("g13_code_facts", "SELECT page_id, kind, fact_no::INTEGER AS fact_no, fact FROM (" + " UNION ALL ".join(f"SELECT page_id, '{k}' AS kind, generate_subscripts(regexp_extract_all(html, {q(p)}, 1), 1) - 1 AS fact_no, unnest(regexp_extract_all(html, {q(p)}, 1)) AS fact FROM pages" for k, p in FACTS.items()) + ")")
def _(t):
    return ex.extract_code_facts(t.pages, "page_id", "html", FACTS)
