"""Rollup queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ticketweave import fixed_values as fv
from ticketweave.functions import text as tx
from ticketweave.operators import ordered, rollups as ro, windows as wi
from ticketweave.plans.registry import query

C, L = F.col, F.lit


def sql_list(values) -> str:
    return ", ".join("'" + str(v).replace("'", "''") + "'" for v in values)


def _events_as_log(t):
    """Events as structured log events: the type is the level, errors carry a code."""
    return t.events.select(
        "event_id", "ts", C("event_type").alias("level"),
        F.when(C("event_type") == "error", F.concat(L("E"), (C("user_id") % 9).cast("string"))).alias("error_code"),
        F.concat(L("svc"), (C("user_id") % 7).cast("string")).alias("service"), F.concat(L("/u/"), C("user_id").cast("string")).alias("endpoint"),
        F.when(C("user_id") % 3 == 0, L("SEBA")).alias("upstream_system"), F.when(C("value") > 50, "slow").otherwise("").alias("incident_type"),
        F.concat(L("k="), F.get_json_object("props", "$.k")).alias("message"))


_LOG_SQL = """(SELECT event_id, ts, event_type AS level, CASE WHEN event_type='error' THEN concat('E', user_id % 9) END AS error_code,
  concat('svc', user_id % 7) AS service, concat('/u/', user_id) AS endpoint, CASE WHEN user_id % 3 = 0 THEN 'SEBA' END AS upstream_system,
  CASE WHEN value > 50 THEN 'slow' ELSE '' END AS incident_type, concat('k=', json_extract_string(props, '$.k')) AS message FROM events)"""

_ACTION = lambda n: f"CASE WHEN {n} >= 20 THEN {{0}} WHEN {n} >= 5 THEN {{1}} ELSE {{2}} END"

A01 = f"""WITH e AS (SELECT *, coalesce(error_code, level) AS pattern FROM {_LOG_SQL}),
s AS (SELECT pattern, array_to_string(list(m ORDER BY m), '|') AS samples FROM (SELECT pattern, m, row_number() OVER (PARTITION BY pattern ORDER BY m) rn FROM (SELECT DISTINCT pattern, left(message,200) m FROM e)) WHERE rn <= 3 GROUP BY 1),
g AS (SELECT pattern, count(*) AS n, count(DISTINCT nullif(service,'')) AS n_services, count(DISTINCT nullif(endpoint,'')) AS n_endpoints, count(DISTINCT nullif(upstream_system,'')) AS n_upstreams,
 count(DISTINCT nullif(incident_type,'')) AS n_incident_types, min(ts) AS first_seen, max(ts) AS last_seen FROM e GROUP BY 1)
SELECT g.*, s.samples, {_ACTION('n').format('0.60::DOUBLE', '0.50::DOUBLE', '0.35::DOUBLE')} AS trust_score,
 {_ACTION('n').format(*["'" + a[2] + "'" for a in fv.PATTERN_ACTIONS])} AS recommended_action FROM g JOIN s USING (pattern)"""


@query("a01_error_patterns", A01)
def _(t):
    return ro.error_patterns(_events_as_log(t)).withColumn("samples", F.array_join("samples", "|"))


@query("flagship_error_pareto", f"""WITH a AS ({A01}), w AS (SELECT *, sum(n) OVER () AS tot, sum(n) OVER (ORDER BY n DESC, pattern) AS cum FROM a)
SELECT pattern, n, n_services, first_seen, last_seen, trust_score, round(n / tot * 100, 2) AS pct, round(cum / tot * 100, 2) AS cumulative_pct FROM w""")
def _(t):
    rows = ro.error_patterns(_events_as_log(t))
    shares = wi.pareto(rows, "pattern", weight="n").withColumnRenamed("label", "pattern").drop("n")
    return rows.select("pattern", "n", "n_services", "first_seen", "last_seen", "trust_score").join(shares, "pattern")


@query("a01_pattern_members", f"""SELECT DISTINCT pattern, kind, member FROM (SELECT coalesce(error_code, level) AS pattern, unnest(['service','endpoint','upstream_system']) AS kind, unnest([service, endpoint, upstream_system]) AS member FROM {_LOG_SQL}) WHERE member <> ''""")
def _(t):
    return ro.pattern_members(_events_as_log(t).withColumn("pattern", F.coalesce("error_code", "level")), "pattern", ["service", "endpoint", "upstream_system"])


_TEMPLATE_SQL = "line"
for _p, _r in fv.TEMPLATE_VARIABLES:
    _TEMPLATE_SQL = f"regexp_replace({_TEMPLATE_SQL}, '{_p}', '{_r}', 'g')"
TEMPLATE_SQL = f"trim(regexp_replace({_TEMPLATE_SQL}, '\\s+', ' ', 'g'))"


@query("a02_mine_templates", f"""WITH e AS (SELECT {TEMPLATE_SQL} AS template, coalesce(nullif(regexp_extract(line, '(\\w+Exception)', 1), ''), '') AS exception, line, ts, file_name FROM $log_lines),
g AS (SELECT exception, template, count(*) AS frequency, min(ts) AS first_seen, max(ts) AS last_seen, count(DISTINCT file_name) AS n_file_name FROM e GROUP BY 1, 2 HAVING count(*) >= 2),
s AS (SELECT exception, template, array_to_string(list(m ORDER BY m), '|') AS messages_sample FROM (SELECT exception, template, m, row_number() OVER (PARTITION BY exception, template ORDER BY m) rn FROM (SELECT DISTINCT exception, template, left(line,200) m FROM e)) WHERE rn <= 5 GROUP BY 1, 2)
SELECT g.*, s.messages_sample, concat('LOG-', upper(left(md5(concat(exception, template)), 12))) AS record_id FROM g JOIN s USING (exception, template)""")
def _(t):
    df = t.log_lines.withColumn("template", tx.to_template("line")).withColumn("exc", F.nullif(F.regexp_extract("line", r"(\w+Exception)", 1), L("")))
    return ro.mine_templates(df, "template", "exc", "line", "ts", ["file_name"]).withColumn("messages_sample", F.array_join("messages_sample", "|"))


# ---------------------------------------------------------------- tickets
CATEGORY_SQL = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(resume), '{w}')" for w in ws) + f" THEN '{n}'" for n, ws in fv.TICKET_CATEGORIES) + " ELSE 'Autre' END"
_KNOWN = "list_filter([" + ", ".join(f"CASE WHEN contains(resume, '{k}') THEN '{k}' END" for k in fv.KNOWN_TICKET_CODES) + "], lambda x: x IS NOT NULL)"
_FOUND = ", ".join(f"regexp_extract_all(resume, '{p}', {g})" for p, g in fv.ERROR_CODE_PATTERNS["ticket"])
CODES_SQL = f"list_sort(list_distinct(flatten([{_KNOWN}, {_FOUND}])))"
TICKET_SQL = f"(SELECT *, {CATEGORY_SQL} AS category, {CODES_SQL} AS codes FROM $tickets)"


def tickets(t):
    return t.tickets.withColumn("category", tx.categorize("resume")).withColumn("codes", tx.error_codes("resume", "ticket"))


@query("a03_ticket_distributions", f"""WITH k AS {TICKET_SQL}
SELECT 'category' AS dimension, category AS value, count(*) AS n FROM k GROUP BY 2 UNION ALL SELECT 'status', status, count(*) FROM k GROUP BY 2 UNION ALL SELECT 'priority', priority, count(*) FROM k GROUP BY 2
UNION ALL SELECT 'error_code', c, n FROM (SELECT c, count(*) n FROM (SELECT unnest(codes) c FROM k) GROUP BY 1 ORDER BY n DESC, c LIMIT 20)""")
def _(t):
    return ro.ticket_distributions(tickets(t), ["category", "status", "priority"], "codes")


@query("a04_cluster_candidates", f"""WITH k AS {TICKET_SQL}, b AS (SELECT category, count(*) AS ticket_count FROM k WHERE category <> 'Autre' GROUP BY 1 HAVING count(*) >= 3),
d AS (SELECT category, c AS dominant_error_code FROM (SELECT category, c, row_number() OVER (PARTITION BY category ORDER BY n DESC, c) rn FROM (SELECT category, c, count(*) n FROM (SELECT category, unnest(codes) c FROM k) GROUP BY 1, 2)) WHERE rn = 1),
s AS (SELECT category, array_to_string(list(resume ORDER BY resume), '|') AS samples FROM (SELECT category, resume, row_number() OVER (PARTITION BY category ORDER BY resume) rn FROM (SELECT DISTINCT category, resume FROM k)) WHERE rn <= 3 GROUP BY 1)
SELECT category, ticket_count, dominant_error_code, samples, round(ticket_count / (SELECT count(*) FROM k) * 100, 1) AS percentage, ticket_count >= 10 AS canonical_candidate FROM b LEFT JOIN d USING (category) LEFT JOIN s USING (category)""")
def _(t):
    return ro.cluster_candidates(tickets(t), "category", "codes", "resume").withColumn("samples", F.array_join("samples", "|"))


_RESOLVED = " OR ".join(f"contains(lower(status), '{w}')" for w in fv.RESOLVED_STATUS_WORDS)


@query("a05_resolution_rate", f"SELECT count(*) AS total, count_if({_RESOLVED})::BIGINT AS resolved, round(count_if({_RESOLVED}) / count(*) * 100, 1) AS resolution_rate FROM $tickets")
def _(t):
    return ro.resolution_rate(t.tickets, "status")


@query("a06_ticket_summary", f"""WITH k AS (SELECT *, value / 100 AS confidence, solution = '' AS review, CASE WHEN user_id % 2 = 0 THEN 'fr' ELSE 'en' END AS lang FROM {TICKET_SQL})
SELECT 'total' AS metric, 'total_tickets' AS value, count(*)::DOUBLE AS n FROM k UNION ALL SELECT 'total', 'needs_human_review', count_if(review)::DOUBLE FROM k
UNION ALL SELECT 'total', 'avg_confidence', round(avg(confidence), 3) FROM k UNION ALL SELECT 'total', 'tickets_with_error_codes', count_if(len(codes) > 0)::DOUBLE FROM k
UNION ALL SELECT * FROM (SELECT 'event_type', event_type, count(*)::DOUBLE c FROM k GROUP BY 2 ORDER BY c DESC, 2 LIMIT 15) UNION ALL SELECT * FROM (SELECT 'category', category, count(*)::DOUBLE c FROM k GROUP BY 2 ORDER BY c DESC, 2 LIMIT 15)
UNION ALL SELECT 'lang', lang, count(*)::DOUBLE FROM k GROUP BY 2""")
def _(t):
    df = tickets(t).withColumns({"confidence": C("value") / 100, "review": C("solution") == "", "lang": F.when(C("user_id") % 2 == 0, "fr").otherwise("en")})
    return ro.ticket_summary(df, "event_type", "category", "lang", "confidence", "codes", "review")


@query("a07_top_keywords", f"""SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '{fv.KEYWORD_PATTERN}')) AS word FROM documents) WHERE word NOT IN ({sql_list(fv.KEYWORD_STOP_WORDS)}) GROUP BY 1 ORDER BY n DESC, word LIMIT 50""")
def _(t):
    return ro.top_keywords(t.documents, "text", 50)


_SHIP = "(SELECT l.*, o.o_orderpriority, o.o_orderdate, (epoch_us(l_shipdate) - epoch_us(o_orderdate)) / 8.64e10 AS days FROM lineitem l JOIN orders o ON l_orderkey = o_orderkey)"


def shipped(t):
    return t.lineitem.join(t.orders, C("l_orderkey") == C("o_orderkey")).withColumn("days", (F.unix_micros("l_shipdate") - F.unix_micros("o_orderdate")) / 8.64e10)


@query("a08_dataset_stats", f"""WITH k AS {_SHIP} SELECT 'volume' AS metric, '' AS value, count(*)::DOUBLE AS stat FROM k UNION ALL SELECT 'mttr_median', '', median(days) FROM k
UNION ALL SELECT * FROM (SELECT 'o_orderpriority', o_orderpriority, count(*)::DOUBLE c FROM k GROUP BY 2 ORDER BY c DESC, 2 LIMIT 5) UNION ALL SELECT * FROM (SELECT 'l_returnflag', l_returnflag, count(*)::DOUBLE c FROM k GROUP BY 2 ORDER BY c DESC, 2 LIMIT 5)""")
def _(t):
    return ro.dataset_stats(shipped(t), "days", ["o_orderpriority", "l_returnflag"])


@query("a08_exact_quantile", "SELECT round(quantile_cont(l_extendedprice, 0.37), 6) AS q FROM lineitem")
def _(t):
    return ordered.exact_quantile(t.lineitem, "l_extendedprice", 0.37).select(F.round("quantile", 6).alias("q"))


@query("a09_timeseries", "SELECT ts::DATE AS day, event_type, count(*) AS volume FROM events GROUP BY 1, 2")
def _(t):
    return ro.timeseries(t.events, "ts", ["event_type"])


@query("a10_top_values", "SELECT application AS value, count(*) AS n, (SELECT count(*) FROM events) AS total FROM $tickets WHERE trim(application) <> '' GROUP BY 1 ORDER BY n DESC, 1 LIMIT 3")
def _(t):
    return ro.top_values(t.tickets, "application", 3)


@query("a11_kpi_summary", f"""WITH k AS {TICKET_SQL}, v AS (SELECT count(*) n FROM k)
SELECT 'volume' AS metric, '' AS value, count(*)::DOUBLE AS stat, NULL::DOUBLE AS pct FROM k UNION ALL SELECT 'first_day', '', date_diff('day', DATE '1970-01-01', min(created_at)::DATE)::DOUBLE, NULL FROM k
UNION ALL SELECT 'last_day', '', date_diff('day', DATE '1970-01-01', max(created_at)::DATE)::DOUBLE, NULL FROM k UNION ALL SELECT 'mttr_median', '', median(value), NULL FROM k
UNION ALL SELECT * FROM (SELECT 'top_cause', cause, count(*)::DOUBLE c, round(count(*) / (SELECT n FROM v) * 100, 1) FROM k WHERE cause <> '' GROUP BY 2 ORDER BY c DESC, 2 LIMIT 10)
UNION ALL SELECT * FROM (SELECT 'top_category', category, count(*)::DOUBLE c, round(count(*) / (SELECT n FROM v) * 100, 1) FROM k WHERE category <> '' GROUP BY 2 ORDER BY c DESC, 2 LIMIT 10)
UNION ALL SELECT * FROM (SELECT 'top_code', x, count(*)::DOUBLE c, NULL::DOUBLE FROM (SELECT unnest(codes) x FROM k) GROUP BY 2 ORDER BY c DESC, 2 LIMIT 10)""")
def _(t):
    return ro.kpi_summary(tickets(t), "created_at", "value", "cause", "category", "codes")


@query("a12_weekly_volume", "SELECT date_trunc('week', ts)::DATE AS week, count(*) AS volume FROM events GROUP BY 1")
def _(t):
    return ro.weekly_volume(t.events, "ts")


@query("a13_correction_stats", """WITH k AS (SELECT *, CASE user_id % 3 WHEN 0 THEN 'reinforce' ELSE 'suppress' END AS kind FROM events)
SELECT 'total' AS metric, '' AS value, count(*) AS n FROM k UNION ALL SELECT 'by_label', event_type, count(*) FROM k GROUP BY 2 UNION ALL SELECT 'by_type', kind, count(*) FROM k GROUP BY 2
UNION ALL SELECT 'recent', event_id::VARCHAR, 1 FROM (SELECT event_id FROM k ORDER BY ts DESC, event_id DESC LIMIT 10)""")
def _(t):
    df = t.events.withColumn("kind", F.when(C("user_id") % 3 == 0, "reinforce").otherwise("suppress"))
    return ro.correction_stats(df, "event_type", "kind", "ts", "event_id")


_TASKS_SQL = """(SELECT o_orderkey AS task_id, o_orderpriority AS task_type, CASE o_orderstatus WHEN 'F' THEN 'validated' WHEN 'O' THEN 'pending' ELSE 'rejected' END AS status,
 o_orderdate AS created_at, o_orderdate AS validated_at, (o_orderkey % 10 + 1)::INTEGER AS priority, o_totalprice FROM orders)"""


def tasks(t):
    return t.orders.select(C("o_orderkey").alias("task_id"), C("o_orderpriority").alias("task_type"),
                           F.when(C("o_orderstatus") == "F", "validated").when(C("o_orderstatus") == "O", "pending").otherwise("rejected").alias("status"),
                           C("o_orderdate").alias("created_at"), C("o_orderdate").alias("validated_at"), (C("o_orderkey") % 10 + 1).cast("int").alias("priority"), "o_totalprice")


@query("a14_review_metrics", f"""WITH k AS {_TASKS_SQL} SELECT task_type, count(*) AS total, count_if(status IN ('validated','rejected'))::BIGINT AS total_validations, count_if(status='validated')::BIGINT AS approved, count_if(status='rejected')::BIGINT AS rejected,
 count_if(status='pending')::BIGINT AS pending, count_if(status='pending' AND priority >= 9)::BIGINT AS high_priority_pending, count_if(status IN ('validated','rejected') AND validated_at >= TIMESTAMP '1998-12-31' - INTERVAL 7 DAY)::BIGINT AS weekly_validations,
 round(coalesce(count_if(status='validated') * 100.0 / nullif(count_if(status IN ('validated','rejected')), 0), 0), 2) AS accuracy_rate, round(count_if(status IN ('validated','rejected')) / count(*) * 100, 1) AS validation_rate
 FROM k GROUP BY ROLLUP (task_type)""")
def _(t):
    return ro.review_metrics(tasks(t), L("1998-12-31").cast("timestamp"), "task_type", "status", "validated_at", "priority")


@query("a15_report_patterns", f"""WITH k AS (SELECT *, CASE WHEN l_linestatus = 'F' THEN 'resolved' ELSE 'open' END AS st FROM {_SHIP})
SELECT 'total' AS metric, '' AS value, count(*)::DOUBLE AS stat FROM k UNION ALL SELECT 'resolved', '', count_if(st='resolved')::DOUBLE FROM k UNION ALL SELECT 'resolution_rate', '', round(count_if(st='resolved') / count(*) * 100, 2) FROM k
UNION ALL SELECT 'avg_resolution_hours', '', round(avg((epoch_us(l_shipdate) - epoch_us(o_orderdate)) / 3.6e9) FILTER (st='resolved'), 2) FROM k
UNION ALL SELECT * FROM (SELECT 'component', l_suppkey::VARCHAR, count(*)::DOUBLE c FROM k GROUP BY l_suppkey ORDER BY c DESC, l_suppkey LIMIT 10) UNION ALL SELECT 'severity', o_orderpriority, count(*)::DOUBLE FROM k GROUP BY 2""")
def _(t):
    df = shipped(t).withColumn("st", F.when(C("l_linestatus") == "F", "resolved").otherwise("open"))
    return ro.report_patterns(df, "l_suppkey", "o_orderpriority", "st", "o_orderdate", "l_shipdate")


@query("a16_status_breakdown", """WITH k AS (SELECT CASE event_id % 7 WHEN 0 THEN 'Open' WHEN 1 THEN 'In Progress' WHEN 2 THEN 'Resolved' WHEN 3 THEN 'Closed' WHEN 4 THEN 'Done' WHEN 5 THEN 'New' END AS s FROM events)
SELECT 'bucket' AS metric, 'open' AS value, count_if(s IN ('Open','To Do','Backlog','New'))::BIGINT AS n FROM k UNION ALL SELECT 'bucket', 'in_progress', count_if(s IN ('In Progress'))::BIGINT FROM k UNION ALL SELECT 'bucket', 'resolved', count_if(s IN ('Resolved','Done'))::BIGINT FROM k
UNION ALL SELECT 'bucket', 'closed', count_if(s IN ('Closed'))::BIGINT FROM k UNION ALL SELECT 'status', coalesce(s, 'Unknown'), count(*) FROM k GROUP BY 2""")
def _(t):
    names = ["Open", "In Progress", "Resolved", "Closed", "Done", "New"]
    s = tx.first_match([(C("event_id") % 7 == i, L(n)) for i, n in enumerate(names)], L(None).cast("string"))
    return ro.status_breakdown(t.events.select(s.alias("s")), "s")


# ---------------------------------------------------------------- learning
_OUTCOME = "CASE event_type WHEN 'purchase' THEN 'success' WHEN 'error' THEN 'failure' ELSE 'open' END"


def outcomes(t):
    return t.events.withColumn("hyp", F.concat(L("H"), (C("user_id") % 23).cast("string"))).withColumn(
        "outcome", F.when(C("event_type") == "purchase", "success").when(C("event_type") == "error", "failure").otherwise("open"))


_HYP_SQL = f"(SELECT *, concat('H', user_id % 23) AS hyp, {_OUTCOME} AS outcome FROM events)"
_SUPP_SQL = f"(SELECT hyp, count(*) AS n_reports, round(-least(0.5, (count(*) - 2) * 0.1), 4)::DOUBLE AS delta, round(pow(0.8, count(*) - 2), 4) AS factor FROM {_HYP_SQL} WHERE event_type = 'error' AND value > 90 GROUP BY 1 HAVING count(*) >= 3)"


@query("a25_hypothesis_stats", f"""WITH g AS (SELECT hyp, count(*) AS visit_count, count_if(outcome='success')::BIGINT AS success_count, count_if(outcome='failure')::BIGINT AS failure_count, max(ts) AS last_seen FROM {_HYP_SQL} GROUP BY 1),
s AS (SELECT g.*, coalesce(f.factor, 1.0) AS factor, round(greatest(0.0, least(1.0, (CASE WHEN success_count + failure_count = 0 THEN 0.5 ELSE success_count / (success_count + failure_count) END * 0.7 + ln(1 + visit_count) * 0.08) * coalesce(f.factor, 1.0))), 4) AS confidence FROM g LEFT JOIN {_SUPP_SQL} f USING (hyp))
SELECT *, CASE WHEN confidence >= 0.70 THEN 'HIGH' WHEN confidence >= 0.40 THEN 'MEDIUM' ELSE 'LOW' END AS tier FROM s""")
def _(t):
    df = outcomes(t)
    factors = ro.suppression(df.filter("event_type = 'error' and value > 90"), "hyp").select("hyp", "factor")
    return ro.hypothesis_stats(df, "hyp", "outcome", "ts", factors)


@query("a26_suppression", f"SELECT * FROM {_SUPP_SQL}")
def _(t):
    return ro.suppression(outcomes(t).filter("event_type = 'error' and value > 90"), "hyp")


@query("a27_rebalance", "WITH e AS (SELECT user_id AS src, event_type AS dst, sum(value) AS weight FROM events GROUP BY 1, 2) SELECT src, dst, CASE WHEN (SELECT max(weight) FROM e) > 1.05 THEN round(weight / (SELECT max(weight) FROM e), 4) ELSE weight END AS new_weight FROM e")
def _(t):
    edges = t.events.groupBy(C("user_id").alias("src"), C("event_type").alias("dst")).agg(F.sum("value").alias("weight"))
    return ro.rebalance(edges, "weight").select("src", "dst", "new_weight")


@query("a28_compact", """WITH f AS (SELECT * FROM (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) rn FROM events) WHERE rn = 1)
SELECT concat(user_id, ':', event_type) AS id, event_id FROM f ORDER BY event_id DESC LIMIT 200""")
def _(t):
    return ro.compact(t.events.select(F.concat_ws(":", C("user_id").cast("string"), "event_type").alias("id"), "event_id"), "id", "event_id", 200)


@query("a29_promote_patterns", f"""WITH w AS (SELECT hyp, user_id, concat('u', user_id) AS entity, value / 100 AS score, event_id FROM {_HYP_SQL} WHERE event_type = 'purchase'),
st AS (SELECT hyp, count_if(outcome='success') / count_if(outcome IN ('success','failure')) AS success_rate FROM {_HYP_SQL} WHERE user_id % 5 <> 0 GROUP BY 1 HAVING count_if(outcome IN ('success','failure')) > 0 AND hyp <> 'H3'),
g AS (SELECT hyp, upper(entity) AS entity_key, count(*) AS turn_count, avg(score) AS mean_score, max_by(event_id, {{'s': score, 'e': -event_id}}) AS best_id FROM w GROUP BY 1, 2 HAVING count(*) >= 3)
SELECT hyp, entity_key, turn_count, best_id, round(coalesce(success_rate, mean_score), 6) AS rate, 0.8::DOUBLE AS confidence FROM g LEFT JOIN st USING (hyp) WHERE coalesce(success_rate, mean_score) >= 0.3""")
def _(t):
    df = outcomes(t)
    weak = df.filter("event_type = 'purchase'").select("hyp", F.concat(L("u"), C("user_id").cast("string")).alias("entity"), (C("value") / 100).alias("score"), "event_id")
    judged = F.count_if(C("outcome").isin("success", "failure"))
    stats = (df.filter("user_id % 5 <> 0").groupBy("hyp").agg(F.count_if(C("outcome") == "success").alias("s"), judged.alias("j"))
             .filter("j > 0 and hyp <> 'H3'").select("hyp", (C("s") / C("j")).alias("success_rate")))
    out = ro.promote_patterns(weak, stats, "hyp", "entity", "score", "event_id", min_rate=0.3)
    return out.select("hyp", "entity_key", "turn_count", C("best.event_id").alias("best_id"), F.round("rate", 6).alias("rate"), "confidence")


@query("a30_entity_memory", f"""WITH k AS (SELECT upper(concat('u', user_id)) AS entity_key, event_type AS cause, concat('P', event_id % 40) AS pattern, outcome, ts FROM {_HYP_SQL}),
c AS (SELECT entity_key, array_to_string(list(concat(cause, '=', n) ORDER BY cause), ',') AS causes, sum(n)::BIGINT AS n_outcomes FROM (SELECT entity_key, cause, count(*) n FROM k GROUP BY 1, 2) GROUP BY 1),
f AS (SELECT entity_key, outcome, pattern, row_number() OVER (PARTITION BY entity_key, outcome ORDER BY seen DESC, pattern) rn FROM (SELECT entity_key, outcome, pattern, min(ts) seen FROM k WHERE outcome IN ('success','failure') GROUP BY 1, 2, 3)),
l AS (SELECT entity_key, array_to_string(list(pattern ORDER BY rn) FILTER (outcome='success'), ',') AS success_patterns, array_to_string(list(pattern ORDER BY rn) FILTER (outcome='failure'), ',') AS failure_patterns FROM f WHERE rn <= 20 GROUP BY 1)
SELECT entity_key, causes, n_outcomes, coalesce(success_patterns, '') AS success_patterns, coalesce(failure_patterns, '') AS failure_patterns FROM c LEFT JOIN l USING (entity_key)""")
def _(t):
    df = outcomes(t).select(F.concat(L("u"), C("user_id").cast("string")).alias("entity"), C("event_type").alias("cause"), F.concat(L("P"), (C("event_id") % 40).cast("string")).alias("pattern"), "outcome", "ts")
    out = ro.entity_memory(df, "entity", "cause", "pattern", "outcome", "ts")
    join = lambda c: F.coalesce(F.array_join(c, ","), L("")).alias(c)
    return out.select("entity_key", F.array_join(F.transform("frequent_causes", lambda x: F.concat(x["cause"], L("="), x["n"].cast("string"))), ",").alias("causes"), "n_outcomes", join("success_patterns"), join("failure_patterns"))


_CORR_SQL = "(SELECT application AS app, cause AS kind, solution AS response, status AS reason, ticket_id FROM $tickets WHERE application <> '' AND cause <> '')"


def corrections(t):
    return t.tickets.filter("application <> '' and cause <> ''").select(C("application").alias("app"), C("cause").alias("kind"), C("solution").alias("response"), C("status").alias("reason"), "ticket_id")


@query("a31_draft_procedures", f"""SELECT app, kind, count(*) AS n_corrections, count(DISTINCT nullif(reason, '')) AS n_symptoms, concat('DRAFT-', upper(left(md5(concat(app, '::', kind)), 8))) AS procedure_id,
 concat('[DRAFT N3] ', kind, ' — ', app) AS title, 0.7::DOUBLE AS trust_score FROM {_CORR_SQL} GROUP BY app, kind HAVING count(*) >= 2""")
def _(t):
    return ro.draft_procedures(corrections(t), "app", "kind", "response", "reason", "ticket_id")


@query("a31_draft_steps", f"""WITH d AS (SELECT app, kind, left(response, 300) AS r, min(ticket_id) AS o FROM {_CORR_SQL} WHERE length(response) > 0 GROUP BY 1, 2, 3), n AS (SELECT *, row_number() OVER (PARTITION BY app, kind ORDER BY o, r) AS step FROM d)
SELECT app, kind, step, concat(step, '. ', r) AS text FROM n""")
def _(t):
    return ro.draft_steps(corrections(t), "app", "kind", "response", "ticket_id")


@query("a32_solution_index", """WITH v AS (SELECT cause, trim(solution) AS s FROM $tickets WHERE cause IS NOT NULL AND length(solution) > 10), l AS (SELECT cause, count(*) AS ticket_count FROM v GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20),
k AS (SELECT cause, array_to_string(list(concat('• ', left(s, 500)) ORDER BY s), chr(10) || '---' || chr(10)) AS solution_text FROM (SELECT cause, s, row_number() OVER (PARTITION BY cause ORDER BY s) rn FROM (SELECT DISTINCT cause, s FROM v)) WHERE rn <= 10 GROUP BY 1)
SELECT cause, ticket_count, solution_text FROM l JOIN k USING (cause)""")
def _(t):
    return ro.solution_index(t.tickets, "cause", "solution").drop("solutions")


@query("a33_summarize_clusters", f"""WITH k AS (SELECT *, user_id % 31 AS cluster_id, CASE WHEN category = 'Autre' THEN 'unknown' ELSE concat('net.', lower(category)) END AS kind FROM {TICKET_SQL}),
sz AS (SELECT cluster_id, count(*) AS size FROM k GROUP BY 1),
mk AS (SELECT cluster_id, kind AS incident_type FROM (SELECT cluster_id, kind, row_number() OVER (PARTITION BY cluster_id ORDER BY count(*) DESC, kind) rn FROM k GROUP BY 1, 2) WHERE rn = 1),
ma AS (SELECT cluster_id, application FROM (SELECT cluster_id, application, row_number() OVER (PARTITION BY cluster_id ORDER BY count(*) DESC, application) rn FROM k GROUP BY 1, 2) WHERE rn = 1),
cc AS (SELECT cluster_id, list(c ORDER BY rn) AS codes3 FROM (SELECT cluster_id, c, row_number() OVER (PARTITION BY cluster_id ORDER BY n DESC, c) rn FROM (SELECT cluster_id, c, count(*) n FROM (SELECT cluster_id, unnest(codes) c FROM k) GROUP BY 1, 2)) WHERE rn <= 3 GROUP BY 1),
ii AS (SELECT cluster_id, array_to_string(list(event_type ORDER BY rn), ',') AS top_intents FROM (SELECT cluster_id, event_type, row_number() OVER (PARTITION BY cluster_id ORDER BY count(*) DESC, event_type) rn FROM k GROUP BY 1, 2) WHERE rn <= 3 GROUP BY 1)
SELECT cluster_id, size, incident_type, application, coalesce(array_to_string(codes3, ','), '') AS top_error_codes, top_intents, CASE WHEN size >= 20 THEN 0.65 WHEN size >= 10 THEN 0.55 WHEN size >= 5 THEN 0.48 ELSE 0.35 END::DOUBLE AS trust_score,
 CASE WHEN len(codes3) > 0 THEN concat(replace(lower(codes3[1]), ' ', '_'), '_', split_part(incident_type, '.', 1)) ELSE concat('cluster_', left(md5(incident_type), 8)) END AS cluster_name
FROM sz JOIN mk USING (cluster_id) JOIN ma USING (cluster_id) LEFT JOIN cc USING (cluster_id) JOIN ii USING (cluster_id)""")
def _(t):
    df = tickets(t).withColumn("cluster_id", C("user_id") % 31).withColumn("kind", F.when(C("category") == "Autre", "unknown").otherwise(F.concat(L("net."), F.lower("category"))))
    out = ro.summarize_clusters(df, "cluster_id", "kind", "application", "event_type", "codes")
    return out.withColumn("top_error_codes", F.coalesce(F.array_join("top_error_codes", ","), L(""))).withColumn("top_intents", F.array_join("top_intents", ","))


@query("a34_artifact_stats", "SELECT lang AS language, count(*) AS files, sum(len(string_split(text, chr(10))))::BIGINT AS lines, sum(strlen(text))::BIGINT AS bytes FROM documents GROUP BY ROLLUP (lang)")
def _(t):
    df = t.documents.select(C("lang").alias("language"), F.size(F.split("text", "\n")).alias("lines"), F.octet_length("text").alias("bytes"))
    return ro.artifact_stats(df, "language", "lines", "bytes")


@query("a35_queue_stats", """WITH k AS (SELECT CASE event_type WHEN 'view' THEN 'pending' WHEN 'click' THEN 'reviewed' WHEN 'error' THEN 'corrected' ELSE 'skipped' END AS status, CASE WHEN user_id % 4 = 0 THEN NULL WHEN user_id % 4 = 1 THEN 'UNKNOWN' ELSE 'LOW_CONFIDENCE' END AS reason FROM events)
SELECT 'total' AS metric, 'total' AS value, count(*)::DOUBLE AS stat FROM k UNION ALL SELECT 'total', 'pending', count_if(status='pending')::DOUBLE FROM k UNION ALL SELECT 'total', 'reviewed', count_if(status IN ('reviewed','corrected'))::DOUBLE FROM k
UNION ALL SELECT 'total', 'corrected', count_if(status='corrected')::DOUBLE FROM k UNION ALL SELECT 'total', 'review_rate', round(count_if(status IN ('reviewed','corrected')) / count(*) * 100, 1) FROM k UNION ALL SELECT 'by_reason', coalesce(reason, '?'), count(*)::DOUBLE FROM k GROUP BY 2""")
def _(t):
    s = tx.first_match([(C("event_type") == a, L(b)) for a, b in (("view", "pending"), ("click", "reviewed"), ("error", "corrected"))], L("skipped"))
    r = F.when(C("user_id") % 4 == 1, "UNKNOWN").when(C("user_id") % 4 != 0, "LOW_CONFIDENCE")
    return ro.queue_stats(t.events.select(s.alias("status"), r.alias("reason")), "status", "reason")


@query("a36_movement_profile", """WITH k AS (SELECT user_id, ts, event_type, concat('svc', event_id % 5) AS service, coalesce(lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id), '') AS before FROM events),
x AS (SELECT user_id, ts, unnest(['all','service','transition']) AS kind, unnest(['', service, concat(before, '→', event_type)]) AS name FROM k) SELECT user_id, kind, name, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM x GROUP BY 1, 2, 3""")
def _(t):
    df = t.events.select("user_id", "event_id", "ts", "event_type", F.concat(L("svc"), (C("event_id") % 5).cast("string")).alias("service"))
    df = ordered.previous_values(df, ["user_id"], "ts", ["event_type"], ["event_id"]).withColumn("before", C("prev.event_type"))
    return ro.movement_profile(df, "user_id", "ts", "event_type", "service", "before")


_STOP = sql_list(fv.KEYWORD_STOP_WORDS)


@query("a37_ticket_patterns", f"""WITH k AS (SELECT *, coalesce(nullif(regexp_extract(resume, '\\b(\\d{{4}})\\b', 1), ''), list_filter(regexp_extract_all(lower(resume), '{fv.KEYWORD_PATTERN}'), lambda w: w NOT IN ({_STOP}))[1], 'unknown') AS pattern FROM $tickets),
s AS (SELECT pattern, array_to_string(list(x ORDER BY x), '|') AS samples FROM (SELECT pattern, x, row_number() OVER (PARTITION BY pattern ORDER BY x) rn FROM (SELECT DISTINCT pattern, left(resume, 80) x FROM k)) WHERE rn <= 3 GROUP BY 1)
SELECT pattern, count(*) AS n, bool_or(status IN ('Résolu','closed')) AS has_resolution, any_value(samples) AS samples, left(md5(pattern), 8) AS hash FROM k JOIN s USING (pattern) GROUP BY 1""")
def _(t):
    return ro.ticket_patterns(t.tickets, "resume", "status", "resume", ["Résolu", "closed"]).withColumn("samples", F.array_join("samples", "|"))


@query("a38_daily_activity", """WITH c AS (SELECT unnest(generate_series(DATE '2024-01-24', DATE '2024-01-30', INTERVAL 1 DAY))::DATE AS day), g AS (SELECT ts::DATE AS day, count(DISTINCT user_id) AS conversations, count(*) AS messages FROM events GROUP BY 1)
SELECT day, coalesce(conversations, 0) AS conversations, coalesce(messages, 0) AS messages FROM c LEFT JOIN g USING (day)""")
def _(t):
    return ro.daily_activity(t.events, "2024-01-31", "ts", "user_id")


_CHECK_NAMES = ["check_residual_references", "check_active_services", "get_blocked_tps", "check_shared_port_links", "other_check"]
_CHECK_SQL = "CASE l_linenumber % 5 " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(_CHECK_NAMES)) + " END"


def check_rows(t):
    return t.lineitem.select(tx.first_match([(C("l_linenumber") % 5 == i, L(n)) for i, n in enumerate(_CHECK_NAMES)], L(None).cast("string")).alias("query_name"), "l_suppkey", C("l_quantity").cast("long").alias("cnt"))


@query("a40_normalize_evidence", f"""SELECT query_name, count(*) AS n, sum(cnt)::BIGINT AS total, count(DISTINCT l_suppkey) AS n_members, CASE query_name WHEN 'check_residual_references' THEN 'has_residuals' WHEN 'check_active_services' THEN 'has_active_services' WHEN 'get_blocked_tps' THEN 'has_blocked_tp' WHEN 'check_shared_port_links' THEN 'has_shared_ports' ELSE 'has_data' END AS flag,
 CASE WHEN query_name = 'check_residual_references' THEN sum(cnt) > 0 ELSE count(*) > 0 END AS raised, CASE query_name WHEN 'check_residual_references' THEN 0.98 WHEN 'check_shared_port_links' THEN 0.96 ELSE 0.97 END::DOUBLE AS confidence
 FROM (SELECT {_CHECK_SQL} AS query_name, l_suppkey, l_quantity::BIGINT AS cnt FROM lineitem) GROUP BY 1""")
def _(t):
    return ro.normalize_evidence(check_rows(t), "query_name", "cnt", "l_suppkey")


@query("a41_log_evidence_summary", """WITH p AS (SELECT 'E' || (s_suppkey % 5) AS code, min(s_name) AS root_cause FROM supplier GROUP BY 1), k AS (SELECT event_type AS pattern, CASE WHEN event_type = 'error' OR user_id % 2 = 0 THEN concat('E', user_id % 9) END AS code FROM events),
g AS (SELECT pattern, code, count(*) AS n FROM k GROUP BY 1, 2) SELECT pattern, sum(n)::BIGINT AS match_count, count(code) AS n_codes, count(root_cause) AS n_known, min(root_cause) AS first_root_cause FROM g LEFT JOIN p USING (code) GROUP BY 1""")
def _(t):
    pats = t.supplier.groupBy(F.concat(L("E"), (C("s_suppkey") % 5).cast("string")).alias("code")).agg(F.min("s_name").alias("root_cause"))
    ev = t.events.select(C("event_type").alias("pattern"), F.when((C("event_type") == "error") | (C("user_id") % 2 == 0), F.concat(L("E"), (C("user_id") % 9).cast("string"))).alias("code"))
    return ro.log_evidence_summary(ev, pats, "pattern", "code")


@query("a42_update_trust", f"""WITH a AS (SELECT count(*) n FROM {_TASKS_SQL} WHERE status = 'validated' AND validated_at > TIMESTAMP '1998-06-30' - INTERVAL 7 DAY)
SELECT p_partkey, p_size / 50 AS trust, CASE WHEN (SELECT n FROM a) > 5 AND p_size / 50 > 0.6 THEN round(least(0.95, p_size / 50 + 0.02), 4) ELSE p_size / 50 END AS new_trust FROM part""")
def _(t):
    kb = t.part.select("p_partkey", (C("p_size") / 50).alias("trust"))
    return ro.update_trust(kb, tasks(t), L("1998-06-30").cast("timestamp"), "status", "validated_at", "trust")


@query("a43_probable_causes", """WITH m AS (SELECT event_id, CASE user_id % 3 WHEN 0 THEN 'TimeoutError' WHEN 1 THEN 'LockError' END AS error_type, CASE WHEN user_id % 2 = 0 THEN 'core' END AS module, s.s_suppkey, s.s_acctbal FROM events e JOIN supplier s ON s.s_suppkey % 60 = e.user_id % 60),
r AS (SELECT event_id, CASE WHEN s_suppkey % 3 = 0 THEN concat('cause', s_suppkey % 7) WHEN s_suppkey % 3 = 1 THEN concat('Pattern connu: ', coalesce(error_type, 'erreur'), ' dans ', coalesce(module, 'module')) END AS cause,
 CASE WHEN s_suppkey % 3 = 0 THEN (s_suppkey % 10) / 10 WHEN s_suppkey % 3 = 1 THEN 0.5 END AS probability, error_type, module FROM m),
u AS (SELECT DISTINCT event_id, cause, probability FROM r WHERE cause IS NOT NULL UNION SELECT DISTINCT event_id, concat(error_type, ' dans ', coalesce(module, 'module inconnu')), 0.4::DOUBLE FROM r WHERE error_type IS NOT NULL AND event_id NOT IN (SELECT event_id FROM r WHERE cause IS NOT NULL))
SELECT * FROM (SELECT event_id, cause, probability::DOUBLE AS probability, row_number() OVER (PARTITION BY event_id ORDER BY probability DESC, cause)::INTEGER AS rank FROM u) WHERE rank <= 5""")
def _(t):
    sig = t.supplier.select("s_suppkey", (C("s_suppkey") % 60).alias("k")).withColumns({
        "causes": F.when(C("s_suppkey") % 3 == 0, F.array(F.struct(F.concat(L("cause"), (C("s_suppkey") % 7).cast("string")).alias("cause"), ((C("s_suppkey") % 10) / 10).alias("probability")))),
        "known": F.when(C("s_suppkey") % 3 == 1, "see sheet"), "conf": L(None).cast("double")})
    ev = t.events.select("event_id", (C("user_id") % 60).alias("k"), F.when(C("user_id") % 3 == 0, "TimeoutError").when(C("user_id") % 3 == 1, "LockError").alias("error_type"), F.when(C("user_id") % 2 == 0, "core").alias("module"))
    m = ev.join(ro.telling_signatures(sig, "k", "causes", "known", "conf"), "k")
    return ro.probable_causes(m, "event_id", "causes", "known", "conf", "error_type", "module")


@query("a44_operation_profile", """WITH k AS (SELECT op AS operation, p_brand AS role, p_partkey FROM part, (SELECT unnest(['ring','widget','small','red']) AS op) WHERE contains(lower(p_name), op))
SELECT operation, role, count(DISTINCT p_partkey) AS n_members, min(p_partkey) AS first_member, max(p_partkey) AS last_member FROM k GROUP BY 1, 2""")
def _(t):
    return ro.operation_profile(t.part.withColumnRenamed("p_brand", "role"), "p_name", "role", "p_partkey", ["ring", "widget", "small", "red"])


@query("a45_review_ledger", """WITH k AS (SELECT user_id, ts, event_id, CASE event_type WHEN 'purchase' THEN 'approve' WHEN 'error' THEN 'reject' WHEN 'click' THEN 'correct' WHEN 'signup' THEN 'escalate' ELSE 'view' END AS action, (user_id % 10 + 1)::INTEGER AS p FROM events)
SELECT user_id, count(*) AS n_actions, coalesce(max_by(CASE action WHEN 'approve' THEN 'validated' WHEN 'correct' THEN 'validated' WHEN 'reject' THEN 'rejected' END, {'t': ts, 'e': event_id}) FILTER (action IN ('approve','correct','reject')), 'pending') AS status,
 CASE WHEN bool_or(action = 'escalate') THEN 10 ELSE max(p) END AS priority, round(greatest(-1.0, least(1.0, sum(CASE action WHEN 'approve' THEN 0.15 WHEN 'reject' THEN -0.20 ELSE 0 END)::DOUBLE)), 4) AS net_trust FROM k GROUP BY 1""")
def _(t):
    act = tx.first_match([(C("event_type") == a, L(b)) for a, b in (("purchase", "approve"), ("error", "reject"), ("click", "correct"), ("signup", "escalate"))], L("view"))
    df = t.events.select("user_id", "ts", "event_id", act.alias("action"), (C("user_id") % 10 + 1).cast("int").alias("p"))
    return ro.review_ledger(df, "user_id", "ts", "event_id", "action", "p")
