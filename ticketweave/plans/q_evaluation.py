"""Evaluation queries (A17-A24, A39, W12, R10): true label = quality, prediction = a rule on the document."""

from __future__ import annotations

from pyspark.sql import functions as F

from ticketweave.operators import evaluation as ev
from ticketweave.plans.registry import query

C, L = F.col, F.lit
PRED_SQL = "(SELECT l.doc_id, concat('q', quality, toxic) AS y, concat('q', (d.n_chars % 3 > 0)::INTEGER, CASE WHEN d.lang = 'en' THEN 0 ELSE toxic END) AS yhat, (d.n_chars % 97) / 97 AS p, d.source FROM labels l JOIN documents d USING (doc_id))"


def predictions(t):
    j = t.labels.join(t.documents.select("doc_id", "lang", "n_chars", "source"), "doc_id")
    text = lambda c: c.cast("string")
    return j.select("doc_id", F.concat(L("q"), text(C("quality")), text(C("toxic"))).alias("y"), F.concat(L("q"), F.when(C("n_chars") % 3 > 0, "1").otherwise("0"), F.when(C("lang") == "en", "0").otherwise(text(C("toxic")))).alias("yhat"),
                    (C("n_chars") % 97 / 97).alias("p"), "source")


REPORT = f"""(WITH k AS {PRED_SQL}, c AS (SELECT y AS label FROM k UNION SELECT yhat FROM k), a AS (SELECT label, count_if(y = label AND yhat = label)::BIGINT AS tp, count_if(yhat = label AND y <> label)::BIGINT AS fp, count_if(y = label AND yhat <> label)::BIGINT AS fn FROM c, k GROUP BY 1),
b AS (SELECT *, tp / greatest(tp + fp, 1) AS pr, tp / greatest(tp + fn, 1) AS re FROM a) SELECT label, tp, fp, fn, round(pr, 3) AS precision, round(re, 3) AS recall, round(2 * pr * re / greatest(pr + re, 1e-9), 3) AS f1, tp + fn AS support FROM b)"""


@query("a17_class_report", f"SELECT * FROM {REPORT}")
def _(t):
    return ev.class_report(predictions(t), "y", "yhat")


@query("a17_accuracy", f"SELECT count(*) AS total_samples, count_if(y <> yhat)::BIGINT AS error_count, round(count_if(y = yhat) / count(*), 3) AS accuracy, round(1 - count_if(y = yhat) / count(*), 3) AS error_rate FROM {PRED_SQL}")
def _(t):
    return ev.accuracy(predictions(t), "y", "yhat")


@query("a18_confusion_hotspots", f"SELECT concat(y, ' → ', yhat) AS pair, count(*) AS n FROM {PRED_SQL} WHERE y <> yhat GROUP BY 1 ORDER BY n DESC, pair LIMIT 10")
def _(t):
    return ev.confusion_hotspots(predictions(t), "y", "yhat")


@query("a18_critical_classes", f"SELECT * FROM {REPORT} WHERE recall < 0.5 AND support >= 5")
def _(t):
    return ev.critical_classes(predictions(t), "y", "yhat")


_SPLIT = "WITH cur AS (SELECT user_id % 9 AS label FROM events WHERE ts >= TIMESTAMP '2024-01-16' AND user_id % 9 <> 3), ref AS (SELECT user_id % 8 AS label FROM events WHERE ts < TIMESTAMP '2024-01-16'), c AS (SELECT label, count(*) / (SELECT count(*) FROM cur) AS c FROM cur GROUP BY 1), r AS (SELECT label, count(*) / (SELECT count(*) FROM ref) AS r FROM ref GROUP BY 1), j AS (SELECT coalesce(c.label, r.label) AS label, c, r FROM c FULL JOIN r ON c.label = r.label)"


def halves(t):
    e = t.events
    cur = e.filter("ts >= timestamp '2024-01-16'").select((C("user_id") % 9).alias("label"), "value").filter("label <> 3")
    return cur, e.filter("ts < timestamp '2024-01-16'").select((C("user_id") % 8).alias("label"))


@query("a19_drift_kl", f"{_SPLIT}, k AS (SELECT sum(coalesce(c, 1e-10) * ln(coalesce(c, 1e-10) / coalesce(r, 1e-10))) AS v FROM j) SELECT round(v, 4) AS kl_divergence, v > 0.15 AS drift_detected, CASE WHEN v > 0.40 THEN 'critical' WHEN v > 0.15 THEN 'warning' ELSE 'ok' END AS alert_level FROM k")
def _(t):
    return ev.drift_kl(*halves(t), "label")


@query("a19_drifted_labels", f"{_SPLIT}, d AS (SELECT label, coalesce(c, 0) AS c, coalesce(r, 0) AS r, coalesce(c, 0) - coalesce(r, 0) AS d FROM j) SELECT label, round(c * 100, 1) AS current_pct, round(r * 100, 1) AS training_pct, round(d * 100, 1) AS delta_pct, CASE WHEN d > 0 THEN 'increase' ELSE 'decrease' END AS direction FROM d WHERE abs(d) > 0.05")
def _(t):
    return ev.drifted_labels(*halves(t), "label")


@query("a20_prediction_drift", """WITH cur AS (SELECT CASE WHEN value > 120 THEN 'UNKNOWN' ELSE event_type END AS label, value / 100 AS conf FROM events), ref AS (SELECT event_type AS label FROM events WHERE user_id % 2 = 0), c AS (SELECT label, count(*) / (SELECT count(*) FROM cur) AS c FROM cur GROUP BY 1), r AS (SELECT label, count(*) / (SELECT count(*) FROM ref) AS r FROM ref GROUP BY 1),
k AS (SELECT sum(greatest(coalesce(r, 0), 1e-10) * ln(greatest(coalesce(r, 0), 1e-10) / greatest(coalesce(c, 0), 1e-10))) AS v FROM c FULL JOIN r ON c.label = r.label), m AS (SELECT count(*) AS n, count_if(label = 'UNKNOWN') / count(*) AS u, count_if(conf < 0.40) / count(*) AS l, avg(conf) AS a FROM cur),
x AS (SELECT *, CASE WHEN u > 0.30 THEN 'CRITICAL' WHEN u > 0.15 THEN 'WARNING' END AS ua, CASE WHEN l > 0.40 THEN 'WARNING' END AS la, CASE WHEN v > 0.40 THEN 'CRITICAL' WHEN v > 0.15 THEN 'WARNING' END AS da FROM m, k)
SELECT n AS total_predictions, round(u, 3) AS unknown_rate, round(l, 3) AS low_confidence_rate, round(a, 3) AS avg_confidence, round(v, 4) AS kl_divergence, ua AS unknown_alert, la AS low_conf_alert, da AS drift_alert, CASE WHEN 'CRITICAL' IN (coalesce(ua, ''), coalesce(la, ''), coalesce(da, '')) THEN 'CRITICAL' WHEN 'WARNING' IN (coalesce(ua, ''), coalesce(la, ''), coalesce(da, '')) THEN 'WARNING' ELSE 'OK' END AS health FROM x""")
def _(t):
    cur = t.events.select(F.when(C("value") > 120, "UNKNOWN").otherwise(C("event_type")).alias("label"), (C("value") / 100).alias("conf"))
    return ev.prediction_drift(cur, t.events.filter("user_id % 2 = 0").select(C("event_type").alias("label")), "label", "conf")


@query("a21_psi", f"""{_SPLIT}, p AS (SELECT label::VARCHAR AS label, greatest(coalesce(c, 0), 1e-4) AS c, greatest(coalesce(r, 0), 1e-4) AS r FROM j), x AS (SELECT *, (c - r) * ln(c / r) AS x FROM p)
SELECT label, round(r * 100, 1) AS ref_pct, round(c * 100, 1) AS cur_pct, round(x, 4) AS psi, CASE WHEN x > 0.025 THEN 'drift' ELSE 'ok' END AS status FROM x WHERE abs(x) > 0.005
UNION ALL SELECT NULL, NULL, NULL, round(sum(x), 4), CASE WHEN round(sum(x), 4) < 0.10 THEN 'stable' WHEN round(sum(x), 4) < 0.25 THEN 'moderate' ELSE 'significant' END FROM x""")
def _(t):
    return ev.psi(*halves(t), "label")


@query("a22_ece", f"WITH k AS {PRED_SQL}, b AS (SELECT floor(p * 10) AS b, count(*) AS n, avg(p) AS c, avg((y = yhat)::INTEGER) AS a FROM k WHERE p < 1 GROUP BY 1) SELECT round(sum(n / (SELECT count(*) FROM k) * abs(a - c)), 6) AS ece, sum(n)::BIGINT AS n_binned FROM b")
def _(t):
    return ev.ece(predictions(t), "p", C("y") == C("yhat"))


_CONF = "CASE WHEN y = yhat THEN least(p + 0.35, 1.0) ELSE p * 0.6 END"


@query("a23_best_threshold", f"""WITH k AS (SELECT {_CONF} AS p, (y = yhat)::INTEGER AS ok FROM {PRED_SQL}), g AS (SELECT i, i / 100 AS t FROM (SELECT unnest(generate_series(30, 95)) AS i)), m AS (SELECT i, avg(ok) AS acc, count(*) / (SELECT count(*) FROM k) AS cov, count(*) AS n FROM g JOIN k ON k.p >= g.t GROUP BY 1),
s AS (SELECT *, 2 * acc * cov / (acc + cov + 1e-9) AS score FROM m WHERE n >= 3 AND acc >= 0.80), b AS (SELECT first(struct_pack(i := i, a := acc, c := cov) ORDER BY score DESC, i) AS b FROM s) SELECT coalesce(round(b.i / 100, 2), 0.50) AS threshold, round(b.a, 6) AS accuracy, round(b.c, 6) AS coverage FROM b""")
def _(t):
    df = predictions(t).withColumn("c", F.when(C("y") == C("yhat"), F.least(C("p") + 0.35, L(1.0))).otherwise(C("p") * 0.6))
    return ev.best_threshold(df, "c", C("y") == C("yhat"))


_LONG = f"(SELECT source AS label, {_CONF} AS p, y = yhat AS ok FROM {PRED_SQL})"


@query("a24_class_thresholds", f"""WITH k AS {_LONG}, n AS (SELECT label, count_if(ok)::BIGINT AS n_true FROM k GROUP BY 1), g AS (SELECT unnest(generate_series(25, 90, 5)) AS i), m AS (SELECT label, i, avg(ok::INTEGER) AS prec, count(*) AS c FROM k JOIN g ON k.p >= g.i / 100 GROUP BY 1, 2), b AS (SELECT label, min(i) AS i FROM m WHERE c >= 2 AND prec >= 0.80 GROUP BY 1)
SELECT label, n_true, CASE WHEN n_true < 3 OR i IS NULL THEN 0.30 ELSE round(i / 100, 2) END AS threshold FROM n LEFT JOIN b USING (label)""")
def _(t):
    df = predictions(t).select(C("source").alias("label"), F.when(C("y") == C("yhat"), F.least(C("p") + 0.35, L(1.0))).otherwise(C("p") * 0.6).alias("p"), (C("y") == C("yhat")).alias("ok"))
    return ev.class_thresholds(df, "label", "p", C("ok"))


@query("a39_promotion_gate", f"""WITH k AS {PRED_SQL}, m AS (SELECT 'candidate' AS role, avg((y = yhat)::INTEGER) AS f1, avg(p) AS ece FROM k UNION ALL SELECT 'production', avg((substr(y, 1, 2) = substr(yhat, 1, 2))::INTEGER), avg(p * 0.95) FROM k),
x AS (SELECT max(f1) FILTER (role = 'candidate') AS cf, max(f1) FILTER (role = 'production') AS pf, max(ece) FILTER (role = 'candidate') AS ce, max(ece) FILTER (role = 'production') AS pe FROM m)
SELECT CASE WHEN cf - pf < -0.02 OR ce - pe > 0.05 THEN 'REJECT' ELSE 'PROMOTE' END AS decision, CASE WHEN cf - pf < -0.02 THEN 'degraded' ELSE 'ok' END AS f1_reason, CASE WHEN ce - pe > 0.05 THEN 'degraded' ELSE 'ok' END AS ece_reason, round(cf - pf, 6) AS delta_f1, round(ce - pe, 6) AS delta_ece FROM x""")
def _(t):
    p = predictions(t)
    rows = p.agg(F.avg((C("y") == C("yhat")).cast("double")).alias("a"), F.avg("p").alias("b"), F.avg((F.substring("y", 1, 2) == F.substring("yhat", 1, 2)).cast("double")).alias("c"), F.avg(C("p") * 0.95).alias("d"))
    metrics = rows.select(F.explode(F.array(F.struct(L("candidate").alias("role"), C("a").alias("f1"), C("b").alias("ece")), F.struct(L("production").alias("role"), C("c").alias("f1"), C("d").alias("ece")))).alias("x")).select("x.*")
    return ev.promotion_gate(metrics, "role", "f1", "ece")


@query("w12_top_errors", f"""WITH k AS {PRED_SQL}, x AS (SELECT doc_id, y, yhat, p, 'fp' AS kind, yhat AS label FROM k WHERE y <> yhat UNION ALL SELECT doc_id, y, yhat, p, 'fn', y FROM k WHERE y <> yhat) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY kind, label ORDER BY p DESC, doc_id)::INTEGER AS rank FROM x) WHERE rank <= 5""")
def _(t):
    return ev.top_errors(predictions(t), "y", "yhat", "p", "doc_id")


@query("r10_apply_thresholds", """WITH k AS (SELECT user_id, event_type AS label, count(*) / sum(count(*)) OVER (PARTITION BY user_id) AS prob FROM events GROUP BY 1, 2), th AS (SELECT * FROM (VALUES ('error', 0.3), ('click', 0.4), ('view', 0.45)) v(label, t)),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY prob DESC, label) AS rn FROM k), h AS (SELECT user_id, first(label ORDER BY rn) AS raw, max(prob) AS c, array_to_string(list(label ORDER BY rn), ',') AS top_labels FROM r WHERE rn <= 3 GROUP BY 1), j AS (SELECT h.*, coalesce(t, 0.5)::DOUBLE AS t FROM h LEFT JOIN th ON th.label = h.raw)
SELECT user_id, CASE WHEN c >= t THEN raw ELSE 'UNKNOWN' END AS predicted_label, raw AS raw_label, round(c, 3) AS confidence, CASE WHEN c >= 0.75 THEN 'HIGH' WHEN c >= 0.50 THEN 'MEDIUM' ELSE 'LOW' END AS tier, c >= t AS accepted, round(t, 3) AS threshold_applied, CASE WHEN c < t THEN CASE WHEN c < 0.35 THEN 'very_low' ELSE 'below_threshold' END END AS unknown_reason, top_labels FROM j""")
def _(t):
    n = t.events.groupBy("user_id", C("event_type").alias("label")).agg(F.count("*").alias("n"))
    probs = n.join(t.events.groupBy("user_id").agg(F.count("*").alias("s")), "user_id").select("user_id", "label", (C("n") / C("s")).alias("prob"))
    th = t.spark.createDataFrame([("error", 0.3), ("click", 0.4), ("view", 0.45)], "label string, threshold double")
    return ev.apply_thresholds(probs, th, "user_id", "label", "prob")
