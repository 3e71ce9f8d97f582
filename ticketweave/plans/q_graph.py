"""Graph queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ticketweave.operators import graph as gr
from ticketweave.plans.q_rollups import CODES_SQL, tickets
from ticketweave.plans.registry import query

C, L = F.col, F.lit
S = lambda c: c.cast("string")

_TK = f"(SELECT ticket_id, application, cause AS incident_type, {CODES_SQL} AS codes, user_id AS cluster_id FROM $tickets)"
_CL = "(SELECT DISTINCT user_id AS cluster_id, concat('app', user_id % 3) AS application, concat('t', user_id % 4) AS incident_type FROM events)"
_PR = "(SELECT p_partkey AS procedure_id, concat('app', p_size % 4) AS application, p_type AS incident_type, [concat('e', p_size % 6)] AS codes FROM part)"
GRAPH_SQL = f"""(SELECT DISTINCT * FROM (SELECT concat('TKT:', ticket_id) AS src, concat('APP:', application) AS dst, 'AFFECTS' AS rel_type FROM {_TK} WHERE application <> '' UNION ALL SELECT concat('TKT:', ticket_id), concat('TYPE:', incident_type), 'IS_TYPE' FROM {_TK} WHERE incident_type <> '' UNION ALL SELECT concat('TKT:', ticket_id), concat('CLU:', cluster_id), 'BELONGS_TO' FROM {_TK}
 UNION ALL SELECT concat('CLU:', cluster_id), concat('APP:', application), 'CONCERNS' FROM {_CL} UNION ALL SELECT concat('CLU:', cluster_id), concat('TYPE:', incident_type), 'HAS_TYPE' FROM {_CL} UNION ALL SELECT concat('PROC:', procedure_id), concat('APP:', application), 'APPLIES_TO' FROM {_PR} UNION ALL SELECT concat('PROC:', procedure_id), concat('TYPE:', incident_type), 'RESOLVES' FROM {_PR}
 UNION ALL SELECT concat('TKT:', ticket_id), concat('ERR:', upper(unnest(codes))), 'HAS_CODE' FROM {_TK} UNION ALL SELECT concat('PROC:', procedure_id), concat('ERR:', upper(unnest(codes))), 'HANDLES_CODE' FROM {_PR} UNION ALL SELECT concat('TKT:', ticket_id), concat('SYS:', 'S', ticket_id % 3), 'MENTIONS' FROM {_TK}))"""


def graph(t):
    tk = tickets(t).select("ticket_id", "application", C("cause").alias("incident_type"), "codes", F.array(F.concat(L("s"), S(C("ticket_id") % 3))).alias("systems"), C("user_id").alias("cluster_id"))
    k = C("user_id")
    cl = t.events.select(k.alias("cluster_id"), F.concat(L("app"), S(k % 3)).alias("application"), F.concat(L("t"), S(k % 4)).alias("incident_type")).distinct()
    z = C("p_size")
    pr = t.part.select(C("p_partkey").alias("procedure_id"), F.concat(L("app"), S(z % 4)).alias("application"), C("p_type").alias("incident_type"), F.array(F.concat(L("e"), S(z % 6))).alias("codes"))
    return gr.build_graph(tk, cl, pr)


_KIND = "CASE split_part(id, ':', 1) WHEN 'TKT' THEN 'Ticket' WHEN 'CLU' THEN 'Cluster' WHEN 'PROC' THEN 'Procedure' WHEN 'APP' THEN 'Application' WHEN 'TYPE' THEN 'IncidentType' WHEN 'ERR' THEN 'ErrorCode' ELSE 'System' END"
NODES_SQL = f"(SELECT id, {_KIND} AS node_type FROM (SELECT src AS id FROM {GRAPH_SQL} UNION SELECT dst FROM {GRAPH_SQL}))"


@query("g01_graph_edges", f"SELECT * FROM {GRAPH_SQL}")
def _(t):
    return graph(t)[1]


@query("g01_graph_nodes", f"SELECT * FROM {NODES_SQL}")
def _(t):
    return graph(t)[0]


@query("g02_schema_graph", "SELECT DISTINCT * FROM (SELECT concat('N', n_nationkey) AS source, 'FK' AS type, concat('R', n_regionkey) AS target FROM nation UNION ALL SELECT concat('S', s_suppkey), 'FK', concat('N', s_nationkey) FROM supplier UNION ALL SELECT concat('N', s_nationkey), 'HAS', concat('S', s_suppkey % 10) FROM supplier)")
def _(t):
    fk = t.nation.select(F.concat(L("N"), S(C("n_nationkey"))).alias("source"), L("FK").alias("type"), F.concat(L("R"), S(C("n_regionkey"))).alias("target")).unionByName(
        t.supplier.select(F.concat(L("S"), S(C("s_suppkey"))).alias("source"), L("FK").alias("type"), F.concat(L("N"), S(C("s_nationkey"))).alias("target")))
    rel = t.supplier.select(F.concat(L("N"), S(C("s_nationkey"))).alias("source"), L("HAS").alias("type"), F.concat(L("S"), S(C("s_suppkey") % 10)).alias("target"))
    return gr.schema_graph(fk, rel)


@query("g02_graph_density", f"SELECT (SELECT count(*) FROM {NODES_SQL}) AS nodes, count(*) AS edges, round(count(*) / ((SELECT count(*) FROM {NODES_SQL}) * ((SELECT count(*) FROM {NODES_SQL}) - 1)), 4) AS density FROM {GRAPH_SQL}")
def _(t):
    return gr.graph_density(*graph(t))


@query("g03_neighbors", f"WITH e AS {GRAPH_SQL} SELECT src AS id, dst AS neighbor, rel_type, 'out' AS direction FROM e WHERE src IN ('CLU:3', 'APP:SEBA', 'ERR:1300') UNION ALL SELECT dst, src, rel_type, 'in' FROM e WHERE dst IN ('CLU:3', 'APP:SEBA', 'ERR:1300')")
def _(t):
    ids = t.spark.createDataFrame([("CLU:3",), ("APP:SEBA",), ("ERR:1300",)], "id string")
    return gr.neighbors(graph(t)[1], ids, "id", "both")


@query("g04_relations_by_type", f"SELECT src, rel_type, dst FROM {GRAPH_SQL} WHERE src LIKE 'PROC:%' AND dst LIKE 'ERR:%'")
def _(t):
    return gr.relations_by_type(*graph(t), "Procedure", "ErrorCode")


_GE = "(SELECT DISTINCT l_suppkey AS src, 1000000000 + l_partkey AS dst FROM lineitem)"


def bipartite(t):
    return t.lineitem.select(C("l_suppkey").alias("src"), (1000000000 + C("l_partkey")).alias("dst")).distinct()


@query("g05_k_hop", f"""WITH e AS (SELECT * FROM {_GE} UNION SELECT dst, src FROM {_GE}), h0 AS (SELECT unnest([1, 2, 3])::BIGINT AS start, unnest([1, 2, 3])::BIGINT AS node), h1 AS (SELECT DISTINCT start, dst AS node FROM h0 JOIN e ON node = src EXCEPT SELECT * FROM h0), s1 AS (SELECT * FROM h0 UNION SELECT * FROM h1), h2 AS (SELECT DISTINCT start, dst AS node FROM h1 JOIN e ON node = src EXCEPT SELECT * FROM s1)
SELECT *, 1 AS distance FROM h1 UNION ALL SELECT *, 2 FROM h2""")
def _(t):
    return gr.k_hop(bipartite(t), t.supplier.filter("s_suppkey in (1, 2, 3)"), "s_suppkey", 2)


# Every user is a node; edges lead a little forward, every seventh event back.
_CAUSAL = "(SELECT DISTINCT user_id AS src, CASE WHEN event_id % 7 = 0 THEN abs(user_id - 3) ELSE user_id + event_id % 4 + 1 END AS dst, 0.5::DOUBLE + (user_id % 5) * 0.1::DOUBLE AS weight FROM events)"


def causal(t):
    u = C("user_id")
    return t.events.select(u.alias("src"), F.when(C("event_id") % 7 == 0, F.abs(u - 3)).otherwise(u + C("event_id") % 4 + 1).alias("dst"), (0.5 + (u % 5) * 0.1).alias("weight")).distinct()


@query("g06_paths_from", f"""WITH RECURSIVE e AS (SELECT DISTINCT src, dst FROM {_CAUSAL}), p AS (SELECT 1::BIGINT AS start, 1::BIGINT AS node, [1::BIGINT] AS path, 0 AS depth UNION ALL SELECT start, dst, list_append(path, dst), depth + 1 FROM p JOIN e ON node = src WHERE depth < 3 AND NOT list_contains(path, dst)) SELECT start, node, array_to_string(path, '>') AS path, depth FROM p""")
def _(t):
    return gr.paths_from(causal(t), t.supplier.filter("s_suppkey = 1"), "s_suppkey", 3).withColumn("path", F.array_join(F.transform("path", S), ">"))


@query("g07_graph_stats", f"SELECT 'node_type' AS metric, node_type AS value, count(*) AS n FROM {NODES_SQL} GROUP BY 2 UNION ALL SELECT 'rel_type', rel_type, count(*) FROM {GRAPH_SQL} GROUP BY 2 UNION ALL SELECT 'total', 'nodes', count(*) FROM {NODES_SQL} UNION ALL SELECT 'total', 'edges', count(*) FROM {GRAPH_SQL}")
def _(t):
    return gr.graph_stats(*graph(t))


@query("g08_root_causes", f"""WITH RECURSIVE e AS (SELECT dst AS a, src AS b, weight FROM {_CAUSAL}), hot AS (SELECT DISTINCT user_id AS node FROM events WHERE user_id % 5 = 4), p AS (SELECT s AS origin, s AS node, 1.0::DOUBLE AS prob, [s] AS path, 0 AS hops FROM (SELECT DISTINCT user_id AS s FROM events WHERE user_id % 20 = 0)
 UNION ALL SELECT origin, b, prob * weight, list_append(path, b), hops + 1 FROM p JOIN e ON node = a WHERE hops < 5 AND NOT list_contains(path, b) AND (hops = 0 OR node NOT IN (SELECT node FROM hot))),
m AS (SELECT origin, node, max(prob) AS pr, first(hops ORDER BY prob DESC, hops) AS hops FROM p WHERE hops > 0 AND node IN (SELECT node FROM hot) GROUP BY 1, 2), s AS (SELECT origin AS symptom, node AS cause, round(least(pr, 0.99), 6) AS confidence, hops FROM m)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symptom ORDER BY confidence DESC, cause)::INTEGER AS rank FROM s) WHERE rank <= 5""")
def _(t):
    users = t.events.select(C("user_id").alias("node")).distinct()
    sym, hot = users.filter("node % 20 = 0"), users.filter("node % 5 = 4")
    return gr.root_causes(causal(t), sym, hot)


@query("g09_activate_nodes", "SELECT DISTINCT user_id, node FROM (SELECT user_id, CASE WHEN event_type = 'error' THEN 'mq_ack_missing' WHEN event_type = 'signup' THEN 'eqpt_closed' END AS node FROM events UNION ALL SELECT user_id, 'dlq_accumulation' FROM events WHERE event_type = 'click' AND contains(props, '7') UNION ALL SELECT user_id, 'rollback' FROM events WHERE event_type = 'click' AND contains(props, '13')) WHERE node IS NOT NULL")
def _(t):
    ev = t.events.select("user_id", F.when(C("event_type") == "click", "log").otherwise("rule").alias("kind"), F.when(C("event_type") == "click", C("props")).otherwise(C("event_type")).alias("value"))
    return gr.activate_nodes(ev, "user_id", "kind", "value", [("rule", "error", "mq_ack_missing"), ("rule", "signup", "eqpt_closed")], [(["7"], "dlq_accumulation"), (["13"], "rollback")])


@query("g10_causal_chain", f"""WITH e AS (SELECT src, dst, max(weight) AS w FROM {_CAUSAL} GROUP BY 1, 2), d0 AS (SELECT unnest([1, 2])::BIGINT AS seed, unnest([1, 2])::BIGINT AS node, 0 AS depth, NULL::DOUBLE AS w), d1 AS (SELECT seed, dst AS node, 1 AS depth, max(e.w) AS w FROM d0 JOIN e ON node = src GROUP BY 1, 2 HAVING dst <> seed), s1 AS (SELECT * FROM d0 UNION ALL SELECT * FROM d1),
d2 AS (SELECT d1.seed, dst AS node, 2 AS depth, max(e.w) AS w FROM d1 JOIN e ON node = src WHERE NOT EXISTS (SELECT 1 FROM s1 WHERE s1.seed = d1.seed AND s1.node = dst) GROUP BY 1, 2), r AS (SELECT *, CASE node % 3 WHEN 0 THEN 'cause' WHEN 1 THEN 'action' ELSE 'symptom' END AS kind, node % 4 AS visits FROM (SELECT * FROM s1 UNION ALL SELECT * FROM d2))
SELECT seed, last(node ORDER BY depth, node) FILTER (kind = 'cause') AS deepest_cause, count(*) AS n_nodes, array_to_string(list(node ORDER BY depth, node) FILTER (kind = 'action')[1:6], ',') AS actions, round(least(1.0, least(1.0, exp(avg(ln(greatest(w, 0.01))))) + ln(1 + sum(visits)) * 0.15), 6) AS confidence FROM r GROUP BY 1""")
def _(t):
    e = causal(t).withColumn("rel_type", L("CAUSES"))
    k = C("id")
    ids = e.select(C("src").alias("id")).union(e.select("dst")).distinct()
    n = ids.select("id", F.when(k % 3 == 0, "cause").when(k % 3 == 1, "action").otherwise("symptom").alias("node_type"), (k % 4).alias("visit_count"))
    seeds = t.supplier.filter("s_suppkey in (1, 2)").select(C("s_suppkey").alias("id"))
    out = gr.causal_chain(n, e, seeds, max_depth=2)
    return out.withColumn("actions", F.array_join(F.transform("actions", S), ","))


@query("g11_adjust_weights", f"SELECT src, dst, weight, round(CASE WHEN src % 5 = 0 THEN greatest(0.05, least(1.0, weight - 0.06)) ELSE weight END, 6) AS new_weight FROM {_CAUSAL}")
def _(t):
    e = causal(t)
    return gr.adjust_weights(e, e.filter("src % 5 = 0"), -0.6)


@query("g12_code_lookup", "WITH n AS (SELECT doc_id, list_distinct(list_transform(regexp_extract_all(text, '[A-Za-z]{9,}'), lambda x: lower(x))) AS m FROM documents), w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z]{9,}')) AS term FROM benchmark) SELECT term, doc_id FROM w JOIN n ON list_contains(m, lower(term))")
def _(t):
    n = t.documents.select("doc_id", F.regexp_extract_all("text", L("[A-Za-z]{9,}"), L(0)).alias("m"))
    w = t.benchmark.select(F.explode(F.regexp_extract_all("text", L("[A-Za-z]{9,}"), L(0))).alias("term"))
    return gr.code_lookup(n, w, "doc_id", "m", "term")


@query("g14_subgraph", f"WITH k AS (SELECT id FROM {NODES_SQL} ORDER BY id LIMIT 30) SELECT src, dst, rel_type FROM {GRAPH_SQL} WHERE src IN (SELECT id FROM k)")
def _(t):
    return gr.subgraph(*graph(t), 30)[1]
