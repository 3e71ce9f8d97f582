"""Rule queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ticketweave.functions import text as tx
from ticketweave.operators import rules as ru
from ticketweave.plans.registry import query
from ticketweave.plans.sqlkit import any_in, case, q

C, L = F.col, F.lit
S = lambda c: c.cast("string")

RULES = [("R1", "O", "o_totalprice > 300000", True), ("R2", "O", "o_orderpriority = '1-URGENT'", True), ("R3", "F", "o_orderkey % 7 = 0", True), ("W1", "O", "o_custkey % 5 = 0", False), ("W2", "F", "o_totalprice < 50000", False)]


@query("b01_evaluate_rules", "SELECT o_orderkey, o_orderstatus, concat_ws(',', " + ", ".join(f"CASE WHEN o_orderstatus = '{i}' AND ({p}) THEN '{r}' END" for r, i, p, b in RULES if b) + ") AS fired, concat_ws(',', " + ", ".join(f"CASE WHEN o_orderstatus = '{i}' AND ({p}) THEN '{r}' END" for r, i, p, b in RULES if not b) + ") AS warnings, " + " OR ".join(f"(o_orderstatus = '{i}' AND ({p}))" for r, i, p, b in RULES if b) + " AS blocked FROM orders")
def _(t):
    out = ru.evaluate_rules(t.orders, "o_orderkey", "o_orderstatus", RULES)
    return out.withColumns({"fired": F.array_join("fired", ","), "warnings": F.array_join("warnings", ",")})


_EQ = "(SELECT c_custkey AS id, CASE c_custkey % 7 WHEN 0 THEN 'A' WHEN 1 THEN 'P' WHEN 2 THEN 'F' WHEN 3 THEN 'C' WHEN 4 THEN 'S' WHEN 5 THEN ' a ' ELSE 'Z' END AS st, c_custkey % 3 AS services, c_custkey % 2 AS links, c_custkey % 4 AS cards, c_custkey % 5 <> 0 AS ack, CASE WHEN c_custkey % 6 = 0 THEN 'A' END AS other, CASE WHEN c_custkey % 8 < 3 THEN NULL WHEN c_custkey % 8 < 6 THEN 'S' ELSE 'F' END AS target, concat('log ', CASE c_custkey % 9 WHEN 0 THEN 'DLQ full' WHEN 1 THEN 'Timed out' WHEN 2 THEN 'rolled back' ELSE '' END) AS log FROM customer)"


def equipment(t):
    k = C("c_custkey")
    return t.customer.select(k.alias("id"), tx.first_match([(k % 7 == i, L(v)) for i, v in enumerate(["A", "P", "F", "C", "S", " a "])], L("Z")).alias("st"), (k % 3).alias("services"), (k % 2).alias("links"), (k % 4).alias("cards"), (k % 5 != 0).alias("ack"),
                             F.when(k % 6 == 0, "A").alias("other"), F.when((k % 8 >= 3) & (k % 8 < 6), "S").when(k % 8 >= 6, "F").alias("target"),
                             F.concat(L("log "), F.when(k % 9 == 0, "DLQ full").when(k % 9 == 1, "Timed out").when(k % 9 == 2, "rolled back").otherwise("")).alias("log"))


@query("b02_diagnose_state", f"""WITH k AS (SELECT *, upper(trim(st)) AS s FROM {_EQ}) SELECT id, CASE WHEN s = 'A' AND services = 0 AND links = 0 AND cards = 0 THEN 'ORPHAN' WHEN s IN ('A','P','F','C','S') THEN s ELSE 'INCONSISTENT' END AS state, s IN ('A','P','F','C','S') AS is_valid, s = 'P' AS is_transient, s = 'A' AND services = 0 AND links = 0 AND cards = 0 AS is_orphan,
 (s IN ('A','P') AND NOT ack) OR (other IS NOT NULL AND other <> s) AS is_inconsistent, CASE WHEN target IS NULL THEN true ELSE ((s = 'P' AND target IN ('A','F','S')) OR (s = 'A' AND target IN ('F','C','S','P')) OR (s = 'F' AND target IN ('A','S')) OR (s = 'C' AND target = 'S')) AND NOT (target = 'S' AND s = 'P') END AS transition_allowed FROM k""")
def _(t):
    return ru.diagnose_state(equipment(t), "id", "st", "services", "links", "cards", "ack", "other", "target")


@query("b03_sync_anomalies", f"""WITH k AS (SELECT *, upper(st) AS s, lower(log) AS l FROM {_EQ}) SELECT id, 'SYNC_DB_MQ' AS anomaly, 'CRITICAL' AS severity, 0.92::DOUBLE AS confidence FROM k WHERE s IN ('A','ACTIF','ACTIVE') AND NOT ack UNION ALL SELECT id, 'SYNC_DB_ORCH', 'HIGH', 0.85 FROM k WHERE s <> other UNION ALL SELECT id, 'SYNC_DB_42C', 'HIGH', 0.85 FROM k WHERE s <> target
 UNION ALL SELECT id, 'SYNC_DLQ', 'CRITICAL', 0.85 FROM k WHERE contains(l, 'dlq') UNION ALL SELECT id, 'SYNC_TIMEOUT', 'HIGH', 0.85 FROM k WHERE contains(l, 'timed out') UNION ALL SELECT id, 'SYNC_ROLLBACK', 'HIGH', 0.85 FROM k WHERE contains(l, 'rolled back') UNION ALL SELECT id, 'SYNC_ORPHAN', 'MEDIUM', 0.85 FROM k WHERE s IN ('A','ACTIF') AND services = 0 AND links = 0""")
def _(t):
    return ru.sync_anomalies(equipment(t), "id", "st", "ack", "other", "target", "log", "services", "links")


_RC = {"equipment_has_residual_data": 0.92, "tp_blocked_status_1": 0.95, "port_shared_between_links": 0.85, "vlan_residual_resources": 0.55}
_RQ = ["check_residual_references", "check_active_services", "get_blocked_tps", "check_shared_port_links", "unknown_check"]


@query("b04_resolution_candidates", f"""WITH e AS (SELECT l_orderkey AS id, {case([(f'l_linenumber % 5 = {i}', q(n)) for i, n in enumerate(_RQ)], 'NULL')} AS qn FROM lineitem), f AS (SELECT id, CASE qn WHEN 'check_residual_references' THEN 'equipment_has_residual_data' WHEN 'check_active_services' THEN 'equipment_has_residual_data' WHEN 'get_blocked_tps' THEN 'tp_blocked_status_1' WHEN 'check_shared_port_links' THEN 'port_shared_between_links' END AS rc, CASE qn WHEN 'check_residual_references' THEN 0.94 WHEN 'check_active_services' THEN 0.93 WHEN 'get_blocked_tps' THEN 0.95 ELSE 0.85 END::DOUBLE AS conf, 'live_db' AS src FROM e),
g AS (SELECT * FROM f WHERE rc IS NOT NULL), x AS (SELECT DISTINCT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'equipment_has_residual_data' ELSE 'vlan_residual_resources' END AS rc, CASE WHEN o_orderkey % 2 = 0 THEN 0.82 ELSE 0.45 END::DOUBLE AS conf, 'intent_fallback' AS src FROM orders WHERE o_orderkey % 3 = 0),
u AS (SELECT * FROM g UNION ALL SELECT * FROM x WHERE conf >= 0.5 AND NOT EXISTS (SELECT 1 FROM g WHERE g.id = x.id AND g.rc = x.rc)), b AS (SELECT id, rc, first(struct_pack(c := round(conf, 6), s := src) ORDER BY conf DESC, src DESC) AS b FROM u GROUP BY 1, 2) SELECT id, rc AS root_cause, b.c AS confidence, b.s AS source, row_number() OVER (PARTITION BY id ORDER BY b.c DESC, b.s DESC, rc DESC)::INTEGER AS rank FROM b""")
def _(t):
    ev = t.lineitem.select(C("l_orderkey").alias("id"), tx.first_match([(C("l_linenumber") % 5 == i, L(n)) for i, n in enumerate(_RQ)], L(None).cast("string")).alias("qn"), L(True).alias("raised"))
    inc = t.orders.select(C("o_orderkey").alias("id"), F.when(C("o_orderkey") % 2 == 0, "delete_equipment").otherwise("delete_vlan").alias("intent"), (C("o_orderkey") % 3 == 0).alias("fresh"))
    return ru.resolution_candidates(ev, "id", "qn", "raised", _RC, inc)


@query("b05_fresh_only", "SELECT event_id, ts FROM events WHERE ts <= TIMESTAMP '2024-01-15 12:00:00' AND ts >= TIMESTAMP '2024-01-15 11:00:00'")
def _(t):
    return ru.fresh_only(t.events.select("event_id", "ts"), "ts", L("2024-01-15 12:00:00").cast("timestamp"))


@query("b06_tag_stale", "SELECT event_id, CASE WHEN ts > TIMESTAMP '2024-01-25' THEN 'future_timestamp' WHEN epoch_us(TIMESTAMP '2024-01-25') - epoch_us(ts) > 48 * 3600000000 THEN 'stale' ELSE '' END AS tags, CASE WHEN ts <= TIMESTAMP '2024-01-25' AND epoch_us(TIMESTAMP '2024-01-25') - epoch_us(ts) > 48 * 3600000000 AND event_type = 'error' THEN 'info' ELSE event_type END AS severity FROM events")
def _(t):
    df = t.events.select("event_id", "ts", C("event_type").alias("severity"), F.array().cast("array<string>").alias("tags"))
    return ru.tag_stale(df, "ts", "severity", "tags", L("2024-01-25").cast("timestamp")).select("event_id", F.array_join("tags", ",").alias("tags"), "severity")


KEYWORDS = [("VLAN mismatch", r"\b(vlan|tag|trunk)\b"), ("Latency", r"\b(timeout|latence|delay)\b"), ("Crash", r"\b(exception|crash|deadlock)\b"), ("Provisioning", r"\b(affectation|mutation|activ)\b")]
_SB = case([(f"src = '{s}'", str(v)) for s, v in ru.SOURCE_BASE.items()], "0.5")
_SRC = ["user", "kb", "jira", "log"]
_HY = " UNION ALL ".join(f"SELECT id, src, '{l}' AS label, len(regexp_extract_all(lower(txt), {q(p)})) AS n FROM k WHERE regexp_matches(lower(txt), {q(p)})" for l, p in KEYWORDS)


@query("b08_correlate_sources", f"""WITH k AS (SELECT user_id AS id, {case([(f'ticket_id % 4 = {i}', q(s)) for i, s in enumerate(_SRC)], 'NULL')} AS src, resume AS txt FROM $tickets), t AS (SELECT id, count(DISTINCT nullif(src, 'user')) AS total FROM k GROUP BY 1), h AS ({_HY}),
g AS (SELECT id, label, count(DISTINCT nullif(src, 'user')) AS agree, max({_SB})::DOUBLE AS b, sum(n) AS n FROM h GROUP BY 1, 2), s AS (SELECT g.id, label, round(least(b + least(0.1 * n, 0.2), 1.0), 6) AS confidence, CASE WHEN total > 0 THEN round(agree / total, 6) ELSE 0 END AS agreement FROM g JOIN t USING (id))
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY agreement DESC, confidence DESC, label)::INTEGER AS rank FROM s) WHERE rank <= 4""")
def _(t):
    df = t.tickets.select(C("user_id").alias("id"), tx.first_match([(C("ticket_id") % 4 == i, L(s)) for i, s in enumerate(_SRC)], L(None).cast("string")).alias("src"), C("resume").alias("txt"))
    return ru.correlate_sources(df, "id", "src", "txt", KEYWORDS)


@query("b08_recurring_components", "SELECT component, count(*) AS n, round(least(0.4 + 0.1 * count(*), 0.85), 4) AS confidence FROM (SELECT unnest(regexp_extract_all(upper(resume), '(SEBA|IPON|ARTEMIS|ADELIA|OP49[A-Z0-9]+)')) AS component FROM $tickets) GROUP BY 1 HAVING count(*) >= 2")
def _(t):
    return ru.recurring_components(t.tickets, "resume", "(SEBA|IPON|ARTEMIS|ADELIA|OP49[A-Z0-9]+)")


HYPS = [("H1", ["vlan", "suppression", "compteur"], ["SEBA"]), ("H2", ["timeout", "deadlock", "script"], ["IPON", "ADELIA"]), ("H3", ["erreur", "1300"], []), ("H4", ["zzz"], ["PORTAIL"])]
_SW = case([(f"src = '{s}'", str(v)) for s, v in ru.SOURCE_WEIGHT.items()], "1.0")
_HS = ["query", "fr", "log", "incident"]
_HR = " UNION ALL ".join(f"SELECT id, src, {_SW}::DOUBLE AS w, '{h}' AS hypothesis_id, {len(ps)} AS np, list_filter([{', '.join(f'CASE WHEN regexp_matches(lower(txt), {q(p)}) THEN {i} END' for i, p in enumerate(ps))}], lambda x: x IS NOT NULL) AS f, CASE WHEN upper(ent) IN ({', '.join(q(e) for e in es) or 'NULL'}) THEN upper(ent) END AS e FROM k" for h, ps, es in HYPS)


@query("b09_score_hypotheses", f"""WITH k AS (SELECT user_id AS id, {case([(f'ticket_id % 4 = {i}', q(s)) for i, s in enumerate(_HS)], 'NULL')} AS src, resume AS txt, application AS ent FROM $tickets), r AS ({_HR}), a AS (SELECT id, hypothesis_id, any_value(np) AS np, len(list_distinct(flatten(list(f)))) AS nf, count_if(len(f) > 0 AND src <> 'query')::BIGINT AS n_evidence, count(DISTINCT e) AS ne, max(len(f) / np * w) FILTER (len(f) > 0 AND src <> 'query') AS best FROM r WHERE len(f) > 0 OR e IS NOT NULL GROUP BY 1, 2),
d AS (SELECT unnest(['H1', 'H3']) AS hypothesis_id, unnest([-0.1, -0.3]) AS delta)
SELECT id, a.hypothesis_id, round(greatest(0.0, CASE WHEN n_evidence > 0 THEN least(1.0, nf / np + 0.1 * ne + 0.05 * n_evidence) ELSE least(0.7, nf / np + 0.1 * ne) END + coalesce(delta, 0)), 6) AS confidence, n_evidence, round(best, 6) AS best_evidence FROM a LEFT JOIN d USING (hypothesis_id) WHERE nf / np >= 0.05""")
def _(t):
    df = t.tickets.select(C("user_id").alias("id"), tx.first_match([(C("ticket_id") % 4 == i, L(s)) for i, s in enumerate(_HS)], L(None).cast("string")).alias("src"), C("resume").alias("txt"), C("application").alias("ent"))
    supp = t.spark.createDataFrame([("H1", -0.1), ("H3", -0.3)], "hypothesis_id string, delta double")
    return ru.score_hypotheses(df, "id", "src", "txt", HYPS, "ent", supp)


_KINDS = ["live_db", "live_log", "code", "incident"]
_KW = "CASE kind WHEN 'live_db' THEN 100 WHEN 'live_log' THEN 90 WHEN 'code' THEN 80 WHEN 'incident' THEN 50 ELSE 0 END"


@query("b10_weigh_evidence", f"""WITH k AS (SELECT user_id, event_id, {case([(f'event_id % 5 = {i}', q(s)) for i, s in enumerate(_KINDS)], q('other'))} AS kind, value / 200 AS conf FROM events), r AS (SELECT *, {_KW} AS w, row_number() OVER (PARTITION BY user_id ORDER BY {_KW} DESC, conf DESC, event_id) AS rn, max(conf) OVER (PARTITION BY user_id) AS mc, count(*) OVER (PARTITION BY user_id) AS n FROM k)
SELECT user_id, mc AS highest_confidence, w AS top_weight, kind AS top_kind, event_id AS top_id, n AS n_evidence FROM r WHERE rn = 1""")
def _(t):
    df = t.events.select("user_id", "event_id", tx.first_match([(C("event_id") % 5 == i, L(s)) for i, s in enumerate(_KINDS)], L("other")).alias("kind"), (C("value") / 200).alias("conf"))
    return ru.weigh_evidence(df, "user_id", "kind", "conf", "event_id")


SECTIONS = {"diagnostic": ["the", "la "], "evidence": ["tion", "ment", "ung"]}
GENERIC = [r"thth", r"eaux"]
_FAIL = f"""list_sort(list_filter([CASE WHEN NOT {any_in('l', SECTIONS['diagnostic'])} OR NOT {any_in('l', SECTIONS['evidence'])} THEN 'FORENSIC_ERROR' END, CASE WHEN contains(l, 'cióna') THEN 'HALLUCINATION' END, CASE WHEN contains(l, 'delete from') THEN 'SQL_MUTATION' END, CASE WHEN regexp_matches(l, 'thth') OR regexp_matches(l, 'eaux') THEN 'GENERIC_RESPONSE' END,
 CASE WHEN NOT (contains(l, 'ere') OR contains(l, 'on')) THEN 'MISSING_EVIDENCE' END, CASE WHEN NOT contains(l, 'r') THEN 'MISSING_CODE_REFERENCE' END], lambda x: x IS NOT NULL))"""
_ANS = "(SELECT concat(conv_id, '-', turn) AS id, lower(concat(text, CASE WHEN turn % 5 = 1 THEN ' DELETE FROM t_x' ELSE '' END)) AS l FROM conversations WHERE role = 'assistant')"


def answers(t):
    return t.conversations.filter("role = 'assistant'").select(F.concat_ws("-", S(C("conv_id")), S(C("turn"))).alias("id"), F.concat("text", F.when(C("turn") % 5 == 1, " DELETE FROM t_x").otherwise("")).alias("a"))


@query("b11_contract_failures", f"SELECT id, array_to_string({_FAIL}, ',') AS failures, len({_FAIL}) = 0 AS passed FROM {_ANS}")
def _(t):
    out = ru.contract_failures(answers(t), "id", "a", SECTIONS, ["ere", "on"], ["cióna", "DELETE FROM"], GENERIC, "R")
    return out.withColumn("failures", F.array_join("failures", ","))


@query("b11_contract_pass_rate", f"SELECT count(*) AS n, count_if(len({_FAIL}) = 0)::BIGINT AS n_passed, round(count_if(len({_FAIL}) = 0) / count(*) * 100, 2) AS pass_rate FROM {_ANS}")
def _(t):
    return ru.contract_pass_rate(ru.contract_failures(answers(t), "id", "a", SECTIONS, ["ere", "on"], ["cióna", "DELETE FROM"], GENERIC, "R"))


def check_suite() -> ru.CheckSuite:
    """Health checks over the inventory stand-ins."""
    suite = ru.CheckSuite()
    suite.add("blocked_plans", lambda t: t.orders.filter("o_orderstatus = 'P'"), ["plan"])
    suite.add("orphan_parents", lambda t: t.customer.join(t.orders.select(C("o_custkey").alias("c_custkey")), "c_custkey", "left_anti"), ["orphan", "customer"], 200)
    suite.add("shared_links", lambda t: ru.shared_links(t.lineitem, "l_partkey", "l_suppkey"), ["link"], 100)
    suite.add("impossible_rows", lambda t: t.lineitem.filter("l_quantity < 0"), ["sanity"])
    suite.plan("delete_equipment", ["blocked_plans", "orphan_parents", "shared_links", "impossible_rows"])
    return suite


_CK = lambda name, sql, cap, tags: f"SELECT '{name}' AS query_name, least(count(*), {cap})::BIGINT AS row_count, count(*) >= {cap} AS truncated, CASE WHEN count(*) > 0 THEN 0.97 ELSE 0.5 END::DOUBLE AS confidence, CASE WHEN count(*) = 0 THEN 'Insufficient evidence' END AS error, '{tags}' AS tags FROM ({sql})"


@query("b12_check_suite", " UNION ALL ".join([_CK("blocked_plans", "SELECT * FROM orders WHERE o_orderstatus = 'P'", 50, "plan"), _CK("orphan_parents", "SELECT * FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)", 200, "orphan,customer"),
                                             _CK("shared_links", "SELECT l_partkey FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) > 1", 100, "link"), _CK("impossible_rows", "SELECT * FROM lineitem WHERE l_quantity < 0", 50, "sanity")]))
def _(t):
    return check_suite().run(t, "delete_equipment")


@query("b13_shared_links", "SELECT l_partkey, count(DISTINCT l_suppkey) AS n_links FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) > 1")
def _(t):
    return ru.shared_links(t.lineitem, "l_partkey", "l_suppkey")


@query("b14_blocked_items", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus IN ('P', 'O') AND o_orderpriority LIKE '%URG%'")
def _(t):
    return ru.blocked_items(t.orders, "o_orderstatus", ["P", "O"], "o_orderpriority", "%URG%").select("o_orderkey", "o_orderpriority")


@query("b15_validate_answers", """WITH v AS (SELECT o_custkey AS id, CASE o_orderpriority WHEN '1-URGENT' THEN 'block' WHEN '2-HIGH' THEN 'warning' ELSE 'info' END AS sev FROM orders), a AS (SELECT id, count_if(sev='block')::BIGINT AS nb, count_if(sev='warning')::BIGINT AS nw, count_if(sev='info')::BIGINT AS ni FROM v GROUP BY 1),
k AS (SELECT c_custkey AS id, coalesce(nb, 0) AS nb, coalesce(nw, 0) AS nw, coalesce(ni, 0) AS ni, c_custkey % 6 AS ev, c_custkey % 100 / 100 AS hc, c_custkey % 10 / 10 AS cc FROM customer LEFT JOIN a ON a.id = c_custkey), t AS (SELECT *, CASE WHEN nb > 0 THEN 'LOW' WHEN nw > 0 OR ev = 0 THEN 'MEDIUM' WHEN hc > 0.9 AND ev < 3 THEN 'MEDIUM' ELSE 'HIGH' END AS tier FROM k)
SELECT id, tier, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, ((1.0::DOUBLE - 0.35::DOUBLE * nb - 0.15::DOUBLE * nw - 0.05::DOUBLE * ni + least(ev * 0.05::DOUBLE, 0.20::DOUBLE)) * 0.90::DOUBLE + hc * 0.10::DOUBLE) * 0.95::DOUBLE + cc * 0.05::DOUBLE)), 3) AS score, nb AS n_block, nw AS n_warning, ni AS n_info, tier <> 'HIGH' AS needs_review FROM t""")
def _(t):
    v = t.orders.select(C("o_custkey").alias("id"), F.when(C("o_orderpriority") == "1-URGENT", "block").when(C("o_orderpriority") == "2-HIGH", "warning").otherwise("info").alias("sev"))
    k = C("c_custkey")
    a = t.customer.select(k.alias("id"), (k % 6).alias("ev"), (k % 100 / 100).alias("hc"), (k % 10 / 10).alias("cc"))
    return ru.validate_answers(v, a, "id", "sev", "ev", "hc", "cc")


@query("b16_validate_records", "SELECT p_partkey, trim(p_name) AS p_name, concat_ws(',', CASE WHEN NOT p_size >= 5 THEN 'TOO_SMALL' END, CASE WHEN NOT regexp_matches(p_brand, '^Brand#1[0-9]$') THEN 'BAD_BRAND' END) AS failures, p_size >= 5 AND regexp_matches(p_brand, '^Brand#1[0-9]$') AS is_valid FROM part")
def _(t):
    rules = [("TOO_SMALL", "p_size >= 5"), ("BAD_BRAND", "p_brand rlike '^Brand#1[0-9]$'"), ("NO_NAME", "length(p_name) > 0")]
    out = ru.validate_records(t.part.withColumn("p_name", F.concat(L(" "), "p_name")), "p_partkey", rules, {"p_name": "trim(p_name)"})
    return out.select("p_partkey", "p_name", F.array_join("failures", ",").alias("failures"), "is_valid")
