"""Set queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ticketweave.operators import setops as so
from ticketweave.plans.registry import query

C, L = F.col, F.lit

TIMELINE = """WITH a AS (SELECT ts, concat_ws('  ', CASE WHEN event_type = 'error' THEN 'TimeoutException' END, CASE WHEN user_id % 3 = 0 THEN concat('code=', user_id) END, concat('message ', event_id)) AS event, 'log' AS source, CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END AS level,
 CASE WHEN user_id % 7 = 0 THEN 'Caused by: JMSException' END AS details FROM events WHERE value >= 100),
b AS (SELECT NULL::TIMESTAMP, CASE WHEN n = 0 THEN concat('DB [', q, '] : aucune donnée résiduelle trouvée') ELSE concat('DB [', q, '] : ', n, ' enregistrement(s) résiduel(s)', CASE WHEN n >= 50 THEN ' (tronqué)' ELSE '' END) END, 'db', CASE WHEN n > 0 THEN 'WARN' ELSE 'INFO' END, NULL FROM (SELECT concat('q', s_suppkey) AS q, s_suppkey % 60 AS n FROM supplier)),
c AS (SELECT NULL::TIMESTAMP, concat('SSH [', p_name, '] @ ', p_brand, ' : ', CASE WHEN p_size > 25 THEN 'OK' ELSE 'ERREUR' END), 'ssh', CASE WHEN p_size > 25 THEN 'INFO' ELSE 'ERROR' END, CASE WHEN p_size > 25 THEN p_type END FROM part),
d AS (SELECT NULL::TIMESTAMP, concat('[FR] Étape ', i, ': ', left(x, 120)), 'fr', 'INFO', NULL FROM (SELECT unnest(range(1, 3)) AS i, unnest(['ouvrir ' || item_id, 'fermer ' || item_id]) AS x FROM benchmark WHERE item_id % 2 = 0)),
e AS (SELECT NULL::TIMESTAMP, concat('[FR] T', item_id), 'fr', 'INFO', left(text, 300) FROM benchmark WHERE item_id % 2 = 1)
SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c UNION ALL SELECT * FROM d UNION ALL SELECT * FROM e"""


@query("u01_timeline", TIMELINE)
def _(t):
    logs = t.events.select("ts", F.when(C("event_type") == "error", "ERROR").otherwise("DEBUG").alias("level"), F.when(C("event_type") == "error", "TimeoutException").otherwise("").alias("exception"),
                           F.when(C("user_id") % 3 == 0, C("user_id").cast("string")).alias("error_code"), L(None).cast("string").alias("equipment"), F.concat(L("message "), C("event_id").cast("string")).alias("message"),
                           F.when(C("user_id") % 7 == 0, "JMSException").alias("caused_by"), C("value").alias("score"))
    checks = t.supplier.select(F.concat(L("q"), C("s_suppkey").cast("string")).alias("query_name"), (C("s_suppkey") % 60).alias("row_count"), (C("s_suppkey") % 60 >= 50).alias("truncated"))
    commands = t.part.select(C("p_name").alias("command"), C("p_brand").alias("host"), (C("p_size") > 25).alias("success"), C("p_type").alias("output"))
    key = C("item_id").cast("string")
    steps = t.benchmark.select(F.concat(L("T"), key).alias("title"), F.when(C("item_id") % 2 == 0, F.concat(L("1. ouvrir "), key, L("\n2) fermer "), key)).otherwise(C("text")).alias("content"))
    return so.build_timeline(logs, checks, commands, steps, 100.0)


@query("u02_residual_counts", "SELECT l_suppkey AS entity, 'lineitem' AS source, count(*) AS n FROM lineitem WHERE l_suppkey IN (1, 2, 3) GROUP BY 1 UNION ALL SELECT s_suppkey, 'supplier', count(*) FROM supplier WHERE s_suppkey IN (1, 2, 3) GROUP BY 1 UNION ALL SELECT p_partkey, 'part', count(*) FROM part WHERE p_partkey IN (1, 2, 3) GROUP BY 1")
def _(t):
    return so.residual_counts({"lineitem": (t.lineitem, "l_suppkey"), "supplier": (t.supplier, "s_suppkey"), "part": (t.part, "p_partkey")}, [1, 2, 3])


@query("u03_merge_ranked", """WITH u AS (SELECT 0 AS source_rank, p_name AS title, p_size::DOUBLE AS score, p_partkey AS id FROM part UNION ALL SELECT 1, CASE WHEN p_size % 2 = 0 THEN upper(p_name) ELSE concat(p_name, ' ', p_size) END, p_retailprice, p_partkey FROM part)
SELECT source_rank, title, score, id FROM (SELECT *, row_number() OVER (PARTITION BY lower(title) ORDER BY source_rank, score DESC, id) rn FROM u) WHERE rn = 1""")
def _(t):
    a = t.part.select(C("p_name").alias("title"), C("p_size").cast("double").alias("score"), C("p_partkey").alias("id"))
    b = t.part.select(F.when(C("p_size") % 2 == 0, F.upper("p_name")).otherwise(F.concat_ws(" ", "p_name", "p_size")).alias("title"), C("p_retailprice").alias("score"), C("p_partkey").alias("id"))
    return so.merge_ranked([a, b], [], "title", "score", "id").select("source_rank", "title", "score", "id")


@query("u04_dedupe_candidates", """WITH k AS (SELECT p_partkey, p_type, concat_ws(',', least(concat('c', p_size % 5), concat('c', p_size % 3)), greatest(concat('c', p_size % 5), concat('c', p_size % 3))) AS code_key, CASE p_partkey % 7 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' ELSE 'LOW' END AS trust FROM part)
SELECT p_type, code_key, min(p_partkey) AS p_partkey, CASE max(CASE trust WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 1 END) WHEN 3 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' ELSE 'LOW' END AS trust, count(*) AS n_merged FROM k GROUP BY 1, 2""")
def _(t):
    code = lambda m: F.concat(L("c"), (C("p_size") % m).cast("string"))
    df = t.part.select("p_partkey", "p_type", F.array(code(5), code(3)).alias("codes"), F.when(C("p_partkey") % 7 == 0, "HIGH").when(C("p_partkey") % 7 == 1, "MEDIUM").otherwise("LOW").alias("trust"))
    return so.dedupe_candidates(df, "p_type", "codes", "trust", "p_partkey")


@query("u05_merge_edges", """WITH d AS (SELECT DISTINCT l_suppkey AS src, l_returnflag AS rel, l_partkey % 50 AS dst, l_linestatus AS source FROM lineitem) SELECT src, rel, dst, array_to_string(list(source ORDER BY source), ' + ') AS sources, CASE WHEN count(*) > 1 THEN 'high' ELSE 'medium' END AS confidence FROM d GROUP BY 1, 2, 3""")
def _(t):
    df = t.lineitem.select(C("l_suppkey").alias("src"), C("l_returnflag").alias("rel"), (C("l_partkey") % 50).alias("dst"), C("l_linestatus").alias("source"), L("medium").alias("confidence"))
    return so.merge_edges(df, "src", "rel", "dst", "source", "confidence")


@query("u06_new_only", "WITH s AS (SELECT CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey ELSE -o_orderkey END AS k FROM orders), b AS (SELECT CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey ELSE o_orderkey + 1000000000 END AS k FROM orders) SELECT k AS o_orderkey, 'store' AS origin FROM s UNION ALL SELECT k, 'batch' FROM b WHERE k NOT IN (SELECT k FROM s)")
def _(t):
    k = C("o_orderkey")
    store = t.orders.select(F.when(k % 3 == 0, k).otherwise(-k).alias("o_orderkey"), L("store").alias("origin"))
    batch = t.orders.select(F.when(k % 2 == 0, k).otherwise(k + 1000000000).alias("o_orderkey"), L("batch").alias("origin"))
    return so.new_only(batch.unionByName(batch), store, "o_orderkey")


@query("u07_merge_corrections", "WITH c AS (SELECT concat(resume, ' #', ticket_id // 3) AS text, event_type AS label FROM $tickets) SELECT md5(text) AS h, lang AS label FROM documents UNION ALL SELECT md5(text), label FROM c WHERE text NOT IN (SELECT text FROM c GROUP BY 1 HAVING count(DISTINCT label) > 1)")
def _(t):
    train = t.documents.select("text", C("lang").alias("label"))
    corr = t.tickets.select(F.concat("resume", L(" #"), F.floor(C("ticket_id") / 3).cast("string")).alias("text"), C("event_type").alias("label"))
    return so.merge_corrections(train, corr, "text", "label").select(F.md5(C("text").cast("binary")).alias("h"), "label")


@query("u08_dedupe_provenance", "SELECT source, lang, doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) rn FROM documents) WHERE rn = 1")
def _(t):
    return so.dedupe_provenance(t.documents.select("source", "lang", "doc_id", "n_chars"), "source", "lang", "n_chars", "doc_id")


@query("u09_key_difference", "WITH a AS (SELECT DISTINCT regexp_extract(c_name, '(\\d+)$', 1)::BIGINT::VARCHAR AS k FROM customer), b AS (SELECT DISTINCT (o_custkey + 5)::VARCHAR AS k FROM orders) SELECT k, 'only_a' AS side FROM a WHERE k NOT IN (SELECT k FROM b) UNION ALL SELECT k, 'only_b' FROM b WHERE k NOT IN (SELECT k FROM a)")
def _(t):
    return so.key_difference(t.customer, t.orders, F.regexp_extract("c_name", r"(\d+)$", 1).cast("long").cast("string"), (C("o_custkey") + 5).cast("string"))
