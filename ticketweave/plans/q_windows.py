"""Window and queue queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ticketweave.operators import windows as wi
from ticketweave.plans.q_rollups import _TASKS_SQL, tasks
from ticketweave.plans.registry import query
from ticketweave.plans.sqlkit import any_in, case

C, L = F.col, F.lit


@query("w01_pareto", "WITH c AS (SELECT coalesce(nullif(trim(application), ''), 'Non classé') AS label, count(*) AS n FROM $tickets GROUP BY 1) SELECT label, n, round(n / sum(n) OVER () * 100, 2) AS pct, round(sum(n) OVER (ORDER BY n DESC, label) / sum(n) OVER () * 100, 2) AS cumulative_pct FROM c")
def _(t):
    return wi.pareto(t.tickets, "application")


@query("w01_pareto_customers", "WITH c AS (SELECT o_custkey::VARCHAR AS label, count(*) AS n FROM orders GROUP BY 1) SELECT label, n, round(n / sum(n) OVER () * 100, 2) AS pct, round(sum(n) OVER (ORDER BY n DESC, label) / sum(n) OVER () * 100, 2) AS cumulative_pct FROM c")
def _(t):
    return wi.pareto(t.orders, "o_custkey")


@query("w02_volume_anomalies", "WITH d AS (SELECT o_orderdate::DATE AS day, count(*) AS volume FROM orders GROUP BY 1), s AS (SELECT avg(volume) AS m, CASE WHEN coalesce(stddev_samp(volume), 0) = 0 THEN 1 ELSE stddev_samp(volume) END AS s, count(*) AS k FROM d) SELECT day, volume, round((volume - m) / m * 100, 1) AS delta_pct, CASE WHEN volume > m THEN 'spike' ELSE 'drop' END AS direction FROM d, s WHERE k >= 3 AND abs((volume - m) / s) >= 1.8")
def _(t):
    return wi.volume_anomalies(t.orders, "o_orderdate")


@query("w03_score_drift", """WITH d AS (SELECT ts::DATE AS day, round(avg(value), 4) AS today_avg FROM events GROUP BY 1), b AS (SELECT *, round(coalesce(avg(today_avg) OVER (ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING), today_avg), 4) AS baseline_avg FROM d)
SELECT *, CASE WHEN baseline_avg > 0 THEN round((baseline_avg - today_avg) / baseline_avg, 4) ELSE 0.0 END AS delta_pct, CASE WHEN baseline_avg > 0 THEN round((baseline_avg - today_avg) / baseline_avg, 4) ELSE 0.0 END > 0.15 AS drift_detected FROM b""")
def _(t):
    return wi.score_drift(t.events.groupBy(F.to_date("ts").alias("day")).agg(F.avg("value").alias("v")), "day", "v")


@query("w04_retry_loops", """SELECT user_id, event_type, count(*) AS occurrences, min(ts) AS first_seen, max(ts) AS last_seen, CASE WHEN count(ts) >= 2 THEN round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 / (count(ts) - 1), 3) END AS interval_seconds FROM events WHERE event_type <> 'view' GROUP BY 1, 2 HAVING count(*) >= CASE WHEN event_type = 'error' THEN 5 ELSE 8 END""")
def _(t):
    return wi.retry_loops(t.events, "user_id", "event_type", "ts", fast=["error"], benign=["view"])


@query("w05_root_event", """WITH k AS (SELECT user_id, ts, event_id, CASE WHEN event_type = 'error' AND value > 60 THEN 0 WHEN event_type = 'error' THEN 1 END AS tier, ts < TIMESTAMP '2024-01-10' AS stale FROM events), f AS (SELECT user_id, bool_or(NOT stale) AS fresh FROM k GROUP BY 1),
r AS (SELECT k.*, row_number() OVER (PARTITION BY k.user_id ORDER BY tier, ts, event_id) AS rn FROM k JOIN f USING (user_id) WHERE tier IS NOT NULL AND (NOT fresh OR NOT stale)) SELECT user_id, event_id AS root_id, ts AS root_ts, CASE WHEN tier = 0 THEN 'critical' ELSE 'error' END AS tier FROM r WHERE rn = 1""")
def _(t):
    err = C("event_type") == "error"
    return wi.root_event(t.events, "user_id", "ts", "event_id", err & (C("value") > 60), err, C("ts") < L("2024-01-10").cast("timestamp"))


@query("w06_last_messages", "SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) rn FROM conversations) WHERE rn <= 3 AND role IN ('user','assistant') AND length(text) > 0")
def _(t):
    return wi.last_messages(t.conversations, "conv_id", "turn", "role", "text", 3)


@query("w07_carry_entity", "WITH k AS (SELECT conv_id, turn, nullif(regexp_extract(lower(text), '(retition|eaux|ciónar|verein)'), '') AS entity FROM conversations) SELECT conv_id, turn, entity, last_value(entity IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS known_entity FROM k")
def _(t):
    df = t.conversations.select("conv_id", "turn", F.nullif(F.regexp_extract(F.lower("text"), "(retition|eaux|ciónar|verein)", 1), L("")).alias("entity"))
    return wi.carry_entity(df, "conv_id", "turn", "entity", chunk=2)


FSM = {"signup": ["click", "view"], "view": ["click", "purchase", "view"], "click": ["purchase", "error"], "error": ["view"], "purchase": []}
_ALLOWED = " OR ".join(f"(p = '{a}' AND event_type IN ({', '.join(chr(39) + b + chr(39) for b in bs)}))" for a, bs in FSM.items() if bs)


@query("w08_check_transitions", f"WITH k AS (SELECT user_id, event_id, ts, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) SELECT user_id, event_id, ts, p AS from_state, event_type AS to_state, ({_ALLOWED}) AS is_valid FROM k WHERE p IS NOT NULL")
def _(t):
    return wi.check_transitions(t.events, "user_id", "ts", "event_id", "event_type", FSM)


@query("w09_stuck_states", "WITH k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) rn FROM events) SELECT user_id, event_type AS state, ts AS since, CASE event_type " + " ".join(f"WHEN '{a}' THEN '{'|'.join(b)}'" for a, b in FSM.items() if b) + " END AS allowed_next FROM k WHERE rn = 1 AND event_type <> 'purchase'")
def _(t):
    return wi.stuck_states(t.events, "user_id", "ts", "event_id", "event_type", FSM)


SECTIONS = {"context": ["the"], "causes": ["eau", "ung"], "checks": ["ción", "re"]}
_OPEN = case([(any_in("lower(line)", w), f"'{s}'") for s, w in SECTIONS.items()], "NULL")


@query("w10_sectionize", f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents), o AS (SELECT *, CASE WHEN i % 5 = 0 OR length(line) < 80 THEN {_OPEN} END AS o FROM l),
f AS (SELECT doc_id, i, line, last_value(o IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS section FROM o), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, section ORDER BY i)::INTEGER AS line_rank FROM f WHERE section IS NOT NULL AND length(line) > 10)
SELECT doc_id, i::INTEGER AS para_idx, section, line_rank FROM r WHERE line_rank <= 20""")
def _(t):
    paras = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("para_idx", "line")).withColumn("is_heading", C("para_idx") % 5 == 0)
    return wi.sectionize(paras, "doc_id", "para_idx", "line", "is_heading", SECTIONS, chunk=8).select("doc_id", "para_idx", "section", "line_rank")


@query("w11_rank_candidates", """WITH b AS (SELECT user_id, event_type AS cause, first(struct_pack(v := value, s := concat('s', event_id % 7)) ORDER BY value DESC, concat('s', event_id % 7) DESC) AS b FROM events GROUP BY 1, 2)
SELECT user_id, cause, b.v AS value, b.s AS src, row_number() OVER (PARTITION BY user_id ORDER BY b.v DESC, b.s DESC, cause DESC)::INTEGER AS rank FROM b""")
def _(t):
    df = t.events.select("user_id", C("event_type").alias("cause"), "value", F.concat(L("s"), (C("event_id") % 7).cast("string")).alias("src"))
    return wi.rank_candidates(df, ["user_id"], "cause", "value", "src")


@query("w13_ticket_batches", """WITH r AS (SELECT user_id, ticket_id, resume, row_number() OVER (PARTITION BY user_id ORDER BY ticket_id) rn, count(*) OVER (PARTITION BY user_id) AS ticket_count FROM $tickets)
SELECT user_id, concat('BATCH_', min(ticket_id), '_x', count(*)) AS chunk_id, concat('Exemples de tickets similaires (', user_id, '):', chr(10), array_to_string(list(concat('[', ticket_id, '] ', resume) ORDER BY rn), chr(10) || '---' || chr(10))) AS content, any_value(ticket_count) AS ticket_count FROM r WHERE rn <= 8 GROUP BY user_id""")
def _(t):
    return wi.ticket_batches(t.tickets, "user_id", "ticket_id", "resume")


@query("k01_pending_queue", f"SELECT task_id, task_type, priority, CASE WHEN priority >= 9 THEN 'high' WHEN priority >= 6 THEN 'medium' ELSE 'low' END AS priority_label FROM {_TASKS_SQL} WHERE status = 'pending' ORDER BY priority DESC, created_at, task_id LIMIT 25 OFFSET 5")
def _(t):
    return wi.pending_queue(tasks(t), 25, "status", "priority", "created_at", "task_id", offset=5).select("task_id", "task_type", "priority", "priority_label")


@query("k02_review_queue", """SELECT event_id, reason, CASE reason WHEN 'MEDIUM_CONFIDENCE' THEN 2 WHEN 'OTHER' THEN 3 ELSE 1 END AS priority, round(value / 100, 3) AS confidence_3 FROM (SELECT *, CASE event_type WHEN 'error' THEN 'UNKNOWN' WHEN 'click' THEN 'MEDIUM_CONFIDENCE' ELSE 'OTHER' END AS reason FROM events) ORDER BY priority, confidence_3, event_id LIMIT 50""")
def _(t):
    df = t.events.withColumn("reason", F.when(C("event_type") == "error", "UNKNOWN").when(C("event_type") == "click", "MEDIUM_CONFIDENCE").otherwise("OTHER")).withColumn("conf", C("value") / 100)
    return wi.review_queue(df, 50, "reason", "conf", "event_id").select("event_id", "reason", "priority", "confidence_3")


@query("k03_list_clusters", "SELECT l_suppkey, count(*) AS size FROM lineitem GROUP BY 1 HAVING count(*) >= 5 ORDER BY size DESC, l_suppkey LIMIT 20")
def _(t):
    return wi.list_clusters(t.lineitem.groupBy("l_suppkey").agg(F.count("*").alias("size")), "size", 5, "l_suppkey", 20)


@query("k04_topk", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 1000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def _(t):
    return wi.topk(t.orders.select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey", 10, 1000)


@query("k05_listing", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 40")
def _(t):
    return wi.listing(t.orders, {"o_orderstatus": "F", "o_orderpriority": None}, [F.desc("o_orderdate"), F.asc("o_orderkey")], 40, 20).select("o_orderkey", "o_orderdate")
