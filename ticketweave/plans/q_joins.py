"""Join queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ticketweave.functions import text as tx
from ticketweave.operators import joins as jn
from ticketweave.operators.matching import similar_pairs
from ticketweave.plans.registry import query

C, L = F.col, F.lit
S = lambda c: c.cast("string")

CLUSTERS_SQL = """(SELECT s_suppkey AS cluster_id, concat('t', s_nationkey % 6, '.x') AS incident_type, concat('app', s_suppkey % 4) AS application, [concat('E', s_suppkey % 9), concat('E', s_suppkey % 4)] AS codes, concat('hot ', CASE WHEN s_suppkey % 3 = 0 THEN 'errring' ELSE 'plain' END, ' text') AS terms FROM supplier)"""
RECORDS_SQL = """(SELECT p_partkey AS record_id, CASE WHEN p_size % 5 = 0 THEN 'errRing' WHEN p_size % 5 = 1 THEN '' ELSE concat('x', p_size) END AS exception, CASE WHEN p_size % 7 = 0 THEN '' ELSE concat('t', p_size % 7, '.', CASE WHEN p_size % 2 = 0 THEN 'x' ELSE 'y' END) END AS incident_type, concat('app', p_partkey % 6) AS application, [concat('e', p_size % 12)] AS codes, p_partkey % 11 = 0 AS validated FROM part)"""


def clusters(t):
    k, n = C("s_suppkey"), C("s_nationkey")
    return t.supplier.select(k.alias("cluster_id"), F.concat(L("t"), S(n % 6), L(".x")).alias("incident_type"), F.concat(L("app"), S(k % 4)).alias("application"), F.array(F.concat(L("E"), S(k % 9)), F.concat(L("E"), S(k % 4))).alias("codes"),
                             F.concat(L("hot "), F.when(k % 3 == 0, "errring").otherwise("plain"), L(" text")).alias("terms"))


def records(t):
    k, z = C("p_partkey"), C("p_size")
    return t.part.select(k.alias("record_id"), F.when(z % 5 == 0, "errRing").when(z % 5 == 1, "").otherwise(F.concat(L("x"), S(z))).alias("exception"),
                         F.when(z % 7 == 0, "").otherwise(F.concat(L("t"), S(z % 7), L("."), F.when(z % 2 == 0, "x").otherwise("y"))).alias("incident_type"), F.concat(L("app"), S(k % 6)).alias("application"),
                         F.array(F.concat(L("e"), S(z % 12))).alias("codes"), (k % 11 == 0).alias("validated"))


@query("j01_link_clusters", f"SELECT DISTINCT c.cluster_id, r.record_id FROM {CLUSTERS_SQL} c JOIN {RECORDS_SQL} r ON (c.incident_type <> '' AND c.incident_type = r.incident_type) OR len(list_intersect(c.codes, list_transform(r.codes, lambda x: upper(x)))) > 0")
def _(t):
    return jn.link_clusters(clusters(t), records(t), "cluster_id", "record_id", "incident_type", "codes")


@query("j02_match_log_records", f"""WITH s AS (SELECT c.cluster_id, r.record_id, CASE WHEN r.exception <> '' AND contains(lower(c.terms), lower(r.exception)) THEN 10 ELSE 0 END + CASE WHEN r.incident_type <> '' AND split_part(r.incident_type, '.', 1) = split_part(c.incident_type, '.', 1) THEN 6 ELSE 0 END + CASE WHEN r.application = c.application THEN 3 ELSE 0 END
 + CASE WHEN len(list_intersect(list_transform(c.codes, lambda x: lower(x)), r.codes)) > 0 THEN 4 ELSE 0 END + CASE WHEN r.validated THEN 2 ELSE 0 END AS score FROM {CLUSTERS_SQL} c, {RECORDS_SQL} r)
SELECT cluster_id, record_id, score::BIGINT AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY score DESC, record_id)::INTEGER AS rank FROM s WHERE score > 0) WHERE rank <= 3""")
def _(t):
    return jn.match_log_records(clusters(t), records(t), 3)


_CAT_SQL = "(SELECT concat('x', s_suppkey) AS exception, 'high' AS severity, 'provisioning_failure' AS incident_type, CASE WHEN s_suppkey % 2 = 0 THEN '' ELSE s_name END AS probable_root_cause FROM supplier)"


def catalog(t):
    return t.supplier.select(F.concat(L("x"), S(C("s_suppkey"))).alias("exception"), L("high").alias("severity"), L("provisioning_failure").alias("incident_type"), F.when(C("s_suppkey") % 2 == 0, "").otherwise(C("s_name")).alias("probable_root_cause"))


_TPL = "CASE p_size % 3 WHEN 0 THEN 'port closed now' WHEN 1 THEN 'connection lost' ELSE p_name END"


@query("j03_enrich_from_catalog", f"""SELECT r.p_partkey, c.exception IS NOT NULL AS in_catalog, coalesce(severity, 'medium') AS severity, coalesce(incident_type, 'unknown') AS incident_type, coalesce(nullif(probable_root_cause, ''), CASE p_size % 3 WHEN 0 THEN 'Équipement ou service fermé/indisponible pour la production' WHEN 1 THEN 'Échec de connexion vers un service ou équipement' ELSE 'Erreur applicative détectée — analyse des logs nécessaire' END) AS probable_root_cause,
 round(least(0.35 * CASE WHEN c.exception IS NOT NULL THEN 0.78 ELSE 0.45 END::DOUBLE + 0.25 * least(ln(1 + p_size) / ln(201.0), 1.0) + 0.30 * CASE WHEN c.exception IS NOT NULL THEN 0.70 ELSE 0 END::DOUBLE + 0.10 * greatest(0.0::DOUBLE, 1.0 - p_partkey % 400 / 365), 1.0), 4) AS trust_score FROM part r LEFT JOIN {_CAT_SQL} c ON c.exception = concat('x', p_size)""")
def _(t):
    recs = t.part.withColumn("exception", F.concat(L("x"), S(C("p_size")))).selectExpr("p_partkey", "p_size", "exception", f"{_TPL} AS template")
    return jn.enrich_from_catalog(recs, catalog(t), "exception", "template", "p_size", C("p_partkey") % 400).select("p_partkey", "in_catalog", "severity", "incident_type", "probable_root_cause", "trust_score")


@query("j04_uncovered_catalog", f"SELECT exception, concat('<CATALOG> ', exception, ' — aucun log disponible') AS error_pattern, 0::BIGINT AS frequency, 0.65::DOUBLE AS trust_score, 'catalog_only' AS source_type FROM {_CAT_SQL} WHERE exception NOT IN (SELECT concat('x', p_size) FROM part)")
def _(t):
    recs = t.part.select(F.concat(L("x"), S(C("p_size"))).alias("exception"))
    return jn.uncovered_catalog(catalog(t).select("exception"), recs, "exception")


_NAMES_SQL = "(SELECT DISTINCT lower(w) AS name, CASE WHEN length(w) % 2 = 0 THEN 'table' ELSE 'fiche' END AS kind FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z]{9,}')) AS w FROM benchmark))"


def names(t):
    w = t.benchmark.select(F.explode(F.regexp_extract_all("text", L("[A-Za-z]{9,}"), L(0))).alias("w"))
    return w.select(F.lower("w").alias("name"), F.when(F.length("w") % 2 == 0, "table").otherwise("fiche").alias("kind")).distinct()


@query("j05_mention_edges", f"SELECT d.doc_id, n.name AS target, CASE WHEN d.lang = 'en' AND n.kind = 'table' THEN 'READS' WHEN d.lang = 'fr' AND n.kind = 'fiche' THEN 'CITES' ELSE 'RELATED_TO' END AS rel_type FROM documents d JOIN {_NAMES_SQL} n ON contains(lower(d.text), n.name)")
def _(t):
    return jn.mention_edges(t.documents, "doc_id", "text", "lang", names(t), "name", "kind", {("en", "table"): "READS", ("fr", "fiche"): "CITES"}).withColumnRenamed("name", "target")


@query("j06_unknown_references", "WITH k AS (SELECT DISTINCT conv_id, turn, unnest(regexp_extract_all(text, '[A-Z][a-z]{7,}')) AS name FROM conversations), known AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Z][a-z]{7,}')) AS name FROM documents) SELECT concat(conv_id, '-', turn) AS id, name, CASE WHEN lower(name) = 'thshonwh' THEN 'use t_ports' END AS correction FROM k WHERE name NOT IN (SELECT name FROM known)")
def _(t):
    df = t.conversations.select(F.concat_ws("-", S(C("conv_id")), S(C("turn"))).alias("id"), "text")
    known = t.documents.select(F.explode(F.regexp_extract_all("text", L("[A-Z][a-z]{7,}"), L(0))).alias("name"))
    return jn.unknown_references(df, "id", "text", "[A-Z][a-z]{7,}", known, "name", {"thshonwh": "use t_ports"})


@query("j07_reconcile", """WITH a AS (SELECT CASE WHEN c_custkey % 10 = 0 THEN -c_custkey ELSE c_custkey END AS k, c_name AS name, c_mktsegment AS status, c_nationkey AS description FROM customer), b AS (SELECT CASE WHEN c_custkey % 9 = 0 THEN -c_custkey - 1000000000 ELSE c_custkey END AS k, CASE WHEN c_custkey % 7 = 0 THEN upper(c_name) ELSE c_name END AS name, CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_mktsegment END AS status, CASE WHEN c_custkey % 13 = 0 THEN c_nationkey + 1 ELSE c_nationkey END AS description FROM customer),
j AS (SELECT coalesce(a.k, b.k) AS k, a.k AS ak, b.k AS bk, a.name AS n1, b.name AS n2, a.status AS s1, b.status AS s2, a.description::VARCHAR AS d1, b.description::VARCHAR AS d2 FROM a FULL JOIN b ON a.k = b.k)
SELECT k, 'name' AS field, n1 AS a_value, n2 AS b_value, 'low' AS severity FROM j WHERE ak IS NOT NULL AND bk IS NOT NULL AND n1 IS DISTINCT FROM n2 UNION ALL SELECT k, 'status', s1, s2, 'critical' FROM j WHERE ak IS NOT NULL AND bk IS NOT NULL AND s1 IS DISTINCT FROM s2
UNION ALL SELECT k, 'description', d1, d2, 'high' FROM j WHERE ak IS NOT NULL AND bk IS NOT NULL AND d1 IS DISTINCT FROM d2 UNION ALL SELECT k, 'missing_in_b', NULL, NULL, 'critical' FROM j WHERE bk IS NULL UNION ALL SELECT k, 'missing_in_a', NULL, NULL, 'critical' FROM j WHERE ak IS NULL""")
def _(t):
    k = C("c_custkey")
    a = t.customer.select(F.when(k % 10 == 0, -k).otherwise(k).alias("k"), C("c_name").alias("name"), C("c_mktsegment").alias("status"), C("c_nationkey").alias("description"))
    b = t.customer.select(F.when(k % 9 == 0, -k - 1000000000).otherwise(k).alias("k"), F.when(k % 7 == 0, F.upper("c_name")).otherwise(C("c_name")).alias("name"), F.when(k % 11 != 0, C("c_mktsegment")).alias("status"), F.when(k % 13 == 0, C("c_nationkey") + 1).otherwise(C("c_nationkey")).alias("description"))
    return jn.reconcile(a, b, "k", ["name", "status", "description"])


@query("j08_match_signatures", """WITH s AS (SELECT s_suppkey AS sig_id, s_suppkey % 3 AS app, concat('h', s_suppkey) AS signature_hash, concat('t', s_nationkey) AS error_type, concat('m', s_suppkey % 5) AS module, s_acctbal AS frequency FROM supplier WHERE s_suppkey % 8 > 0), e AS (SELECT event_id, user_id % 3 AS app, concat('h', event_id % 900) AS signature_hash, concat('t', user_id % 60) AS error_type, concat('m', user_id % 8) AS module FROM events),
x AS (SELECT event_id, sig_id, 1 AS rank, 'hash' AS level FROM e JOIN s USING (app, signature_hash)), r1 AS (SELECT * FROM e WHERE event_id NOT IN (SELECT event_id FROM x)),
y AS (SELECT event_id, sig_id, rank, 'type' AS level FROM r1 JOIN (SELECT *, row_number() OVER (PARTITION BY app, error_type ORDER BY frequency DESC, sig_id) AS rank FROM s) b USING (app, error_type) WHERE rank <= 5), r2 AS (SELECT * FROM r1 WHERE event_id NOT IN (SELECT event_id FROM y)),
z AS (SELECT event_id, sig_id, rank, 'module' AS level FROM r2 JOIN (SELECT *, row_number() OVER (PARTITION BY app, module ORDER BY frequency DESC, sig_id) AS rank FROM s) b USING (app, module) WHERE rank <= 3) SELECT event_id, sig_id, rank::INTEGER AS rank, level FROM x UNION ALL SELECT event_id, sig_id, rank::INTEGER, level FROM y UNION ALL SELECT event_id, sig_id, rank::INTEGER, level FROM z""")
def _(t):
    k = C("s_suppkey")
    sig = t.supplier.select(k.alias("sig_id"), (k % 3).alias("app"), F.concat(L("h"), S(k)).alias("signature_hash"), F.concat(L("t"), S(C("s_nationkey"))).alias("error_type"), F.concat(L("m"), S(k % 5)).alias("module"), C("s_acctbal").alias("frequency"), (k % 8 > 0).alias("is_active"))
    u = C("user_id")
    ev = t.events.select("event_id", (u % 3).alias("app"), F.concat(L("h"), S(C("event_id") % 900)).alias("signature_hash"), F.concat(L("t"), S(u % 60)).alias("error_type"), F.concat(L("m"), S(u % 8)).alias("module"))
    return jn.match_signatures(ev, sig, "event_id")


@query("j09_active_children", "SELECT c_custkey, o_orderkey, l_returnflag FROM customer JOIN orders ON c_custkey = o_custkey LEFT JOIN lineitem l ON l_orderkey = o_orderkey WHERE l_returnflag IS NULL OR l_returnflag NOT IN ('A', 'R')")
def _(t):
    child = t.orders.select(C("o_custkey").alias("c_custkey"), "o_orderkey")
    ver = t.lineitem.select(C("l_orderkey").alias("o_orderkey"), "l_returnflag")
    return jn.active_children(t.customer, child, ver, "c_custkey", "o_orderkey", "l_returnflag", ["A", "R"]).select("c_custkey", "o_orderkey", "l_returnflag")


@query("j10_hierarchy_join", "SELECT r_name, n_name, s_suppkey, concat(s_name, CASE WHEN s_suppkey % 3 = 0 THEN ' €' ELSE ' é' END) AS remark FROM region JOIN nation ON r_regionkey = n_regionkey JOIN supplier ON s_nationkey = n_nationkey WHERE s_suppkey % 3 = 0")
def _(t):
    n = t.nation.withColumnRenamed("n_regionkey", "r_regionkey")
    s = t.supplier.withColumnRenamed("s_nationkey", "n_nationkey").withColumn("remark", F.concat("s_name", F.when(C("s_suppkey") % 3 == 0, " €").otherwise(" é")))
    return jn.hierarchy_join([(t.region, ""), (n, "r_regionkey"), (s, "n_nationkey")], "remark").select("r_name", "n_name", "s_suppkey", "remark")


@query("j11_latest_by_key", "SELECT * FROM (SELECT o_custkey, o_orderkey, o_orderdate, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey)::INTEGER AS rank FROM orders WHERE o_orderstatus <> 'P') WHERE rank <= 3")
def _(t):
    return jn.latest_by_key(t.orders.filter("o_orderstatus <> 'P'").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], "o_orderdate", "o_orderkey", 3)


@query("j12_latest_version", "WITH v AS (SELECT l_orderkey, max({'v': l_linenumber, 's': l_shipdate, 'p': l_partkey}) AS m FROM lineitem GROUP BY 1) SELECT o_orderkey, m.v AS version, m.s AS shipped, m.p AS part FROM orders LEFT JOIN v ON l_orderkey = o_orderkey")
def _(t):
    ver = t.lineitem.select(C("l_orderkey").alias("o_orderkey"), C("l_linenumber").alias("version"), C("l_shipdate").alias("shipped"), C("l_partkey").alias("part"), F.struct("l_shipdate", "l_partkey").alias("tie"))
    return jn.with_latest_version(t.orders.select("o_orderkey"), ver, "o_orderkey", "version", ["shipped", "part"], "tie")


_PROC_SQL = "(SELECT p_partkey AS proc_id, p_name AS title, [concat('E', p_size % 40, 'x'), concat('z', p_size)] AS codes, [concat(split_part(p_name, ' ', 1), ' ', split_part(p_name, ' ', 2)), 'never'] AS symptoms, concat(p_type, '_', split_part(p_name, ' ', 2)) AS category, CASE p_size % 3 WHEN 0 THEN 'LOW' ELSE 'HIGH' END AS trust FROM part)"
_Q_SQL = "(SELECT event_id AS qid, concat('code e', user_id, 'X ', CASE user_id % 4 WHEN 0 THEN 'small economy' WHEN 1 THEN 'red thing' WHEN 2 THEN 'nothing' ELSE 'z7 large' END) AS text FROM events)"


def procs(t):
    z = C("p_size")
    return t.part.select(C("p_partkey").alias("proc_id"), C("p_name").alias("title"), F.array(F.concat(L("E"), S(z % 40), L("x")), F.concat(L("z"), S(z))).alias("codes"), F.array(F.concat_ws(" ", F.split_part("p_name", L(" "), L(1)), F.split_part("p_name", L(" "), L(2))), L("never")).alias("symptoms"),
                                                      F.concat_ws("_", "p_type", F.split_part("p_name", L(" "), L(2))).alias("category"), F.when(z % 3 == 0, "LOW").otherwise("HIGH").alias("trust"))


def questions(t):
    u = C("user_id")
    tail = F.when(u % 4 == 0, "small economy").when(u % 4 == 1, "red thing").when(u % 4 == 2, "nothing").otherwise("z7 large")
    return t.events.select(C("event_id").alias("qid"), F.concat(L("code e"), S(u), L("X "), tail).alias("text"))


@query("j13_match_procedures", f"""WITH c AS (SELECT qid, proc_id, least(len(list_filter(codes, lambda x: contains(lower(text), lower(x)))) / len(codes), 1.0) AS score, 'error_code' AS matched_by FROM {_Q_SQL}, {_PROC_SQL} WHERE len(list_filter(codes, lambda x: contains(lower(text), lower(x)))) > 0)
SELECT * FROM c UNION ALL SELECT qid, proc_id, len(list_filter(symptoms, lambda x: contains(lower(text), lower(x)))) / len(symptoms), 'symptom' FROM {_Q_SQL}, {_PROC_SQL} WHERE qid NOT IN (SELECT qid FROM c) AND len(list_filter(symptoms, lambda x: contains(lower(text), lower(x)))) > 0""")
def _(t):
    return jn.match_procedures(questions(t), "qid", "text", procs(t), "proc_id", "codes", "symptoms")


@query("j13_match_procedures_weak", f"""SELECT qid, proc_id, round(least(s, 1.0), 6) AS score FROM (SELECT qid, proc_id, CASE WHEN len(list_filter(codes, lambda x: contains(lower(text), lower(x)))) > 0 THEN 0.5 ELSE 0 END + 0.3 * len(list_filter(symptoms, lambda x: contains(lower(text), lower(x)))) / len(symptoms) + CASE WHEN contains(lower(text), lower(title)) THEN 0.2 ELSE 0 END AS s FROM {_Q_SQL}, {_PROC_SQL}) WHERE s > 0""")
def _(t):
    return jn.match_procedures_weak(questions(t), "qid", "text", procs(t), "proc_id", "codes", "symptoms", "title")


@query("j14_enrich_procedures", f"""WITH c AS (SELECT concat('Cat_', lower(p_type)) AS cat, concat('z', min(p_size)) AS code, count(*) AS n, round(count(*) / 20, 2) AS pct FROM part GROUP BY 1 UNION ALL SELECT 'ring', 'none', 12, 1.5), m AS (SELECT p.proc_id, c.* FROM {_PROC_SQL} p, c WHERE list_contains(p.codes, c.code) OR len(list_filter(string_split(p.category, '_'), lambda x: contains(lower(c.cat), lower(x)) OR contains(lower(x), lower(c.cat)))) > 0),
b AS (SELECT proc_id, max({{'n': n, 'c': cat, 'p': pct}}) AS b FROM m GROUP BY 1) SELECT p.proc_id, b.c AS cluster_category, b.n AS ticket_count, b.p AS percentage, CASE WHEN b.n >= 20 AND trust = 'LOW' THEN 'MEDIUM' ELSE trust END AS new_trust FROM {_PROC_SQL} p LEFT JOIN b USING (proc_id)""")
def _(t):
    c = t.part.groupBy(F.concat(L("Cat_"), F.lower("p_type")).alias("cluster_category")).agg(F.concat(L("z"), S(F.min("p_size"))).alias("dominant_error_code"), F.count("*").alias("ticket_count"), F.round(F.count("*") / 20, 2).alias("percentage"))
    extra = t.spark.createDataFrame([("ring", "none", 12, 1.5)], "cluster_category string, dominant_error_code string, ticket_count long, percentage double")
    return jn.enrich_procedures(procs(t), c.unionByName(extra), "proc_id", "category", "codes", "trust").select("proc_id", "cluster_category", "ticket_count", "percentage", "new_trust")


FOLLOW = [("view", "click", 30000), ("click", "purchase", 86400), ("signup", "view", 20)]
_FU = " UNION ALL ".join(f"SELECT a.event_id, a.user_id, a.ts, '{e}' AS expected_event, '{s}' AS after_event, {m} AS max_seconds, '{'error' if m <= 30 else 'warning'}' AS severity FROM events a WHERE a.event_type = '{s}' AND NOT EXISTS (SELECT 1 FROM events b WHERE b.user_id = a.user_id AND b.event_type = '{e}' AND b.ts BETWEEN a.ts AND a.ts + INTERVAL {m} SECOND)" for s, e, m in FOLLOW)


@query("j15_missing_followups", _FU)
def _(t):
    return jn.missing_followups(t.events, FOLLOW, "user_id", "event_type", "ts", "event_id")


@query("j15_followups_anywhere", "SELECT 'refund' AS expected_event, 'purchase' AS after_event, 30 AS max_seconds, 'error' AS severity FROM events WHERE event_type = 'purchase' HAVING count(*) > 0")
def _(t):
    return jn.missing_followups(t.events, [("purchase", "refund", 30), ("view", "click", 60), ("none", "click", 60)], "user_id", "event_type", "ts", "event_id", strict=False)


@query("j16_asof_trigger", """WITH s AS (SELECT * FROM events WHERE event_type = 'error'), r AS (SELECT * FROM events WHERE event_type IN ('click', 'purchase')), j AS (SELECT s.event_id, s.user_id, s.ts, r.event_id AS tid, r.ts AS tts, r.event_type AS tk, row_number() OVER (PARTITION BY s.event_id ORDER BY r.ts DESC, r.event_id DESC) AS rn FROM s LEFT JOIN r ON r.user_id = s.user_id AND r.ts <= s.ts)
SELECT event_id, user_id, ts, tid AS trigger_id, tts AS trigger_ts, tk AS trigger_kind FROM j WHERE rn = 1""")
def _(t):
    return jn.asof_trigger(t.events, C("event_type") == "error", C("event_type").isin("click", "purchase"), "user_id", "ts", "event_id", "event_type")


@query("j17_dedupe_similar")
def _(t):
    df = t.tickets.select("ticket_id", F.date_trunc("hour", "created_at").alias("hour"), F.concat_ws(" ", "resume", "solution", "status").alias("msg"))
    return jn.dedupe_similar(df, "ticket_id", "hour", "msg").select("ticket_id")


_ST = "(SELECT item_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: w <> '')) AS t FROM benchmark)"


@query("j17_similar_pairs", f"WITH d AS (SELECT doc_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: w <> '')) AS t FROM documents), p AS (SELECT a.doc_id AS a, b.doc_id AS b, len(list_intersect(a.t, b.t)) / greatest(len(a.t), len(b.t)) AS s FROM d a JOIN d b ON a.doc_id < b.doc_id AND len(a.t) >= 0.8 * len(b.t) AND len(b.t) >= 0.8 * len(a.t)) SELECT a, b, round(s, 6) AS score FROM p WHERE s >= 0.8")
def _(t):
    d = t.documents.select("doc_id", tx.token_set("text").alias("t"))
    p = similar_pairs(d, d, "doc_id", "doc_id", "t", 0.8, "overlap").filter("l < r")
    return p.select(C("l").alias("a"), C("r").alias("b"), F.round("score", 6).alias("score"))


@query("j18_drop_contradictions", "WITH t AS (SELECT ticket_id, concat(resume, ' #', ticket_id // 3) AS resume, event_type FROM $tickets) SELECT ticket_id, resume, event_type FROM t WHERE resume NOT IN (SELECT resume FROM t GROUP BY 1 HAVING count(DISTINCT event_type) > 1)")
def _(t):
    return jn.drop_contradictions(t.tickets.select("ticket_id", F.concat("resume", L(" #"), S(F.floor(C("ticket_id") / 3))).alias("resume"), "event_type"), "resume", "event_type")


@query("j19_graph_issues", """WITH n AS (SELECT CASE WHEN c_custkey % 20 = 3 THEN -c_custkey ELSE c_custkey END AS id, CASE WHEN c_custkey % 50 = 0 THEN 'dup' ELSE c_name END AS name FROM customer), e AS (SELECT o_custkey AS src, o_custkey + 7 AS dst FROM orders), c AS (SELECT concat('R', p_partkey) AS rule_id, CASE WHEN p_partkey % 3 = 0 THEN 'DUP' ELSE p_name END AS entity FROM part)
SELECT DISTINCT 'missing_source' AS issue, 'warning' AS severity, src::VARCHAR AS subject FROM e WHERE src NOT IN (SELECT id FROM n) UNION ALL SELECT DISTINCT 'missing_target', 'info', dst::VARCHAR FROM e WHERE dst NOT IN (SELECT id FROM n) UNION ALL SELECT 'duplicate_name', 'warning', upper(name) FROM n GROUP BY 3 HAVING count(*) > 1
UNION ALL SELECT DISTINCT 'constraint_entity_missing', 'info', concat(rule_id, ':', entity) FROM c WHERE upper(entity) NOT IN (SELECT upper(name) FROM n)""")
def _(t):
    n = t.customer.select(F.when(C("c_custkey") % 20 == 3, -C("c_custkey")).otherwise(C("c_custkey")).alias("id"), F.when(C("c_custkey") % 50 == 0, "dup").otherwise(C("c_name")).alias("name"))
    e = t.orders.select(C("o_custkey").alias("src"), (C("o_custkey") + 7).alias("dst"))
    c = t.part.select(F.concat(L("R"), S(C("p_partkey"))).alias("rule_id"), F.when(C("p_partkey") % 3 == 0, "DUP").otherwise(C("p_name")).alias("entity"))
    return jn.graph_issues(n, e, "id", "name", "src", "dst", c)


_CASES_SQL = "(SELECT item_id AS case_id, CASE item_id % 3 WHEN 0 THEN 'delete_vlan' WHEN 1 THEN 'fix_port' ELSE 'that_other' END AS intent, text AS examples, item_id % 30 AS frequency FROM benchmark)"
_QQ_SQL = "(SELECT concat(conv_id, '-', turn) AS qid, text, CASE conv_id % 2 WHEN 0 THEN 'fix_port' ELSE 'none' END AS intent, CASE conv_id % 5 WHEN 0 THEN 'Erth' ELSE '' END AS entity FROM conversations)"
_W4 = lambda e: f"list_distinct(regexp_extract_all(lower({e}), '[\\p{{L}}\\p{{N}}_]{{4,}}'))"


@query("j20_score_cases", f"""WITH s AS (SELECT qid, case_id, CASE WHEN q.intent = c.intent THEN 2.0 ELSE 0 END + 0.3 * len(list_intersect({_W4('q.text')}, {_W4('c.examples')})) + CASE WHEN entity <> '' AND contains(lower(concat(examples, ' ', c.intent)), lower(entity)) THEN 1.0 ELSE 0 END + 0.5 * len(list_filter(string_split(replace(c.intent, '_', ' '), ' '), lambda w: contains(lower(q.text), w))) AS p, least(frequency * 0.05, 1.0) AS f FROM {_QQ_SQL} q, {_CASES_SQL} c)
SELECT qid, case_id, round(p + f, 4) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(p + f, 4) DESC, case_id)::INTEGER AS rank FROM s WHERE p > 0 AND p + f > 0.5) WHERE rank <= 3""")
def _(t):
    cases = t.benchmark.select(C("item_id").alias("case_id"), F.when(C("item_id") % 3 == 0, "delete_vlan").when(C("item_id") % 3 == 1, "fix_port").otherwise("that_other").alias("intent"), C("text").alias("examples"), (C("item_id") % 30).alias("frequency"))
    q = t.conversations.select(F.concat_ws("-", S(C("conv_id")), S(C("turn"))).alias("qid"), "text", F.when(C("conv_id") % 2 == 0, "fix_port").otherwise("none").alias("intent"), F.when(C("conv_id") % 5 == 0, "Erth").otherwise("").alias("entity"))
    return jn.score_cases(q, cases, "qid", "case_id")


_SIG_SQL = "(SELECT item_id AS sheet_id, 1 AS group_id, lower(w) AS phrase, 0.35 AS weight FROM (SELECT item_id, unnest(regexp_extract_all(text, '[A-Za-z]{7,}')) AS w FROM benchmark) UNION ALL SELECT item_id, 2, lower(w), 0.06 FROM (SELECT item_id, unnest(regexp_extract_all(text, '[A-Z][a-z]{3,}')) AS w FROM benchmark))"


@query("j21_score_sheets", f"""WITH h AS (SELECT doc_id, sheet_id, group_id, max(weight) AS w FROM documents d JOIN {_SIG_SQL} s ON contains(lower(d.text), s.phrase) GROUP BY 1, 2, 3), t AS (SELECT doc_id, sheet_id, round(sum(w), 6) AS score FROM h GROUP BY 1, 2)
SELECT doc_id, sheet_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, sheet_id)::INTEGER AS rank FROM t WHERE score > 0.08) WHERE rank <= 3""")
def _(t):
    w = lambda p, g, x: t.benchmark.select(C("item_id").alias("sheet_id"), L(g).alias("group_id"), F.explode(F.regexp_extract_all("text", L(p), L(0))).alias("phrase"), L(x).alias("weight"))
    return jn.score_sheets(t.documents, "doc_id", "text", w("[A-Za-z]{7,}", 1, 0.35).unionByName(w("[A-Z][a-z]{3,}", 2, 0.06)))


PATTERNS = [("P1", r"(?i)thth"), ("P2", r"(?i)eaux"), ("P3", r"[0-9]{4}"), ("P4", r"(?i)\bthe\b"), ("P5", r"\|"), ("P6", r"(?i)tion"), ("P7", r"(?i)re")]
_PL = ", ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN '{i}' END" for i, p in PATTERNS)


@query("j22_match_patterns", f"WITH k AS (SELECT doc_id, list_filter([{_PL}], lambda x: x IS NOT NULL)[1:5] AS l FROM documents) SELECT doc_id, unnest(l) AS pattern_id, (generate_subscripts(l, 1) - 1)::INTEGER AS position FROM k")
def _(t):
    return jn.match_patterns(t.documents.select("doc_id", "text"), "text", PATTERNS).drop("text")


@query("j23_diagnose", """WITH p AS (SELECT p_partkey AS procedure_id, concat('x', p_size) AS exception, concat('t', p_partkey % 9) AS incident_type, p_size / 60 AS trust FROM part), t AS (SELECT event_id AS tid, CASE user_id % 4 WHEN 0 THEN [concat('x', user_id % 70)] ELSE [] END AS excs, CASE user_id % 3 WHEN 0 THEN ['1300'] ELSE [] END AS codes, concat('t', user_id % 15) AS incident_type, CASE user_id % 2 WHEN 0 THEN 'SEBA' ELSE '' END AS application FROM events),
s AS (SELECT event_id AS tid, (user_id * 7) % 20011 AS procedure_id FROM events), px AS (SELECT exception, min({'i': procedure_id, 't': trust}) AS m FROM p GROUP BY 1), pt AS (SELECT incident_type, min({'i': procedure_id, 't': trust}) AS m FROM p GROUP BY 1),
l AS (SELECT tid, 1 AS lvl, m.i AS pid, m.t AS base, 'exception' AS how FROM t JOIN px ON px.exception = t.excs[1] UNION ALL SELECT tid, 2, p.procedure_id, p.trust, 'search' FROM s JOIN p USING (procedure_id) UNION ALL SELECT tid, 3, m.i, m.t, 'incident_type' FROM t JOIN pt USING (incident_type) UNION ALL SELECT tid, 4, m.i, m.t * 0.85, 'error_code' FROM t JOIN pt ON len(t.codes) > 0 AND pt.incident_type = 't5'),
b AS (SELECT tid, first(struct_pack(pid := pid, base := base, how := how) ORDER BY lvl) AS b FROM l GROUP BY 1)
SELECT tid, b.pid AS procedure_id, b.how AS matched_by, CASE WHEN b.pid IS NULL THEN 0.0 ELSE round(least(greatest(b.base + CASE WHEN application <> '' THEN 0.05 ELSE 0 END + CASE WHEN len(excs) > 0 THEN 0.05 ELSE 0 END - CASE WHEN len(excs) = 0 AND len(codes) = 0 THEN 0.05 ELSE 0 END, 0.0), 1.0), 4) END AS trust_score FROM t LEFT JOIN b USING (tid)""")
def _(t):
    u = C("user_id")
    none = F.array().cast("array<string>")
    tk = t.events.select(C("event_id").alias("tid"), F.when(u % 4 == 0, F.array(F.concat(L("x"), S(u % 70)))).otherwise(none).alias("exceptions"), F.when(u % 3 == 0, F.array(L("1300"))).otherwise(none).alias("codes"), F.concat(L("t"), S(u % 15)).alias("incident_type"), F.when(u % 2 == 0, "SEBA").otherwise("").alias("application"))
    pr = t.part.select(C("p_partkey").alias("procedure_id"), F.concat(L("x"), S(C("p_size"))).alias("exception"), F.concat(L("t"), S(C("p_partkey") % 9)).alias("incident_type"), (C("p_size") / 60).alias("trust_score"))
    se = t.events.select(C("event_id").alias("tid"), ((u * 7) % 20011).alias("procedure_id"), L(1.0).alias("score"))
    return jn.diagnose(tk, pr, se, {"1300": "t5"}, "tid")
