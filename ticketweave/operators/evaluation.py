"""Model evaluation, drift, calibration and acceptance thresholds as aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticketweave.operators.ordered import first_k

_C, _L = F.col, F.lit


def class_report(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """tp, fp, fn, precision, recall, F1 and support per class, from the confusion counts only."""
    pairs = df.groupBy(_C(truth).alias("t"), _C(pred).alias("p")).agg(F.count("*").alias("n"))
    hit = _C("t") == _C("p")
    long = pairs.select(F.explode(F.array(
        F.struct(_C("t").alias("label"), F.when(hit, _C("n")).otherwise(0).alias("tp"), _L(0).cast("long").alias("fp"), F.when(hit, 0).otherwise(_C("n")).alias("fn")),
        F.struct(_C("p").alias("label"), _L(0).cast("long").alias("tp"), F.when(hit, 0).otherwise(_C("n")).alias("fp"), _L(0).cast("long").alias("fn")))).alias("x")).select("x.*")
    agg = long.groupBy("label").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    precision = _C("tp") / F.greatest(_C("tp") + _C("fp"), _L(1))
    recall = _C("tp") / F.greatest(_C("tp") + _C("fn"), _L(1))
    f1 = 2 * precision * recall / F.greatest(precision + recall, _L(1e-9))
    return agg.select("label", "tp", "fp", "fn", F.round(precision, 3).alias("precision"), F.round(recall, 3).alias("recall"),
                      F.round(f1, 3).alias("f1"), (_C("tp") + _C("fn")).alias("support"))


def accuracy(df: DataFrame, truth: str, pred: str) -> DataFrame:
    ok = F.count_if(_C(truth) == _C(pred))
    acc = ok / F.greatest(F.count("*"), _L(1))
    return df.agg(F.count("*").alias("total_samples"), (F.count("*") - ok).alias("error_count"), F.round(acc, 3).alias("accuracy"), F.round(1 - acc, 3).alias("error_rate"))


def confusion_hotspots(df: DataFrame, truth: str, pred: str, k: int = 10) -> DataFrame:
    wrong = df.filter(_C(truth) != _C(pred))
    pair = F.concat(_C(truth).cast("string"), _L(" → "), _C(pred).cast("string")).alias("pair")
    return wrong.groupBy(pair).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "pair").limit(k)


def critical_classes(df: DataFrame, truth: str, pred: str, recall: float = 0.5, support: int = 5) -> DataFrame:
    return class_report(df, truth, pred).filter((_C("recall") < recall) & (_C("support") >= support))


def _shares(df: DataFrame, label: str, name: str) -> DataFrame:
    """(label, share); the distribution is small, its total is a window over the counts."""
    counts = df.groupBy(_C(label).alias("label")).agg(F.count("*").alias("n"))
    total = df.agg(F.count("*")).scalar()
    return counts.select("label", (_C("n") / F.greatest(total, _L(1))).alias(name))


def _both(current: DataFrame, reference: DataFrame, label: str) -> DataFrame:
    return _shares(current, label, "cur").join(_shares(reference, label, "ref"), "label", "full")


def drift_kl(current: DataFrame, reference: DataFrame, label: str) -> DataFrame:
    """KL(current || reference), only missing labels at 1e-10, with the alert level."""
    p, q = F.coalesce("cur", _L(1e-10)), F.coalesce("ref", _L(1e-10))
    kl = _both(current, reference, label).agg(F.coalesce(F.sum(p * F.log(p / q)), _L(0.0)).alias("raw"))
    return kl.select(F.round("raw", 4).alias("kl_divergence"), (_C("raw") > 0.15).alias("drift_detected"),
                     F.when(_C("raw") > 0.40, "critical").when(_C("raw") > 0.15, "warning").otherwise("ok").alias("alert_level"))


def drifted_labels(current: DataFrame, reference: DataFrame, label: str, points: float = 0.05) -> DataFrame:
    """Labels whose share moved by more than ``points``."""
    cur, ref = F.coalesce("cur", _L(0.0)), F.coalesce("ref", _L(0.0))
    delta = cur - ref
    return _both(current, reference, label).filter(F.abs(delta) > points).select(
        "label", F.round(cur * 100, 1).alias("current_pct"), F.round(ref * 100, 1).alias("training_pct"), F.round(delta * 100, 1).alias("delta_pct"),
        F.when(delta > 0, "increase").otherwise("decrease").alias("direction"))


def prediction_drift(df: DataFrame, reference: DataFrame, label: str, confidence: str, unknown: str = "UNKNOWN") -> DataFrame:
    """KL(reference || current) with a floor, unknown and low-confidence rates, alerts and health in one row."""
    p, q = F.greatest(F.coalesce("ref", _L(0.0)), _L(1e-10)), F.greatest(F.coalesce("cur", _L(0.0)), _L(1e-10))
    kl = _both(df, reference, label).agg(F.coalesce(F.sum(p * F.log(p / q)), _L(0.0))).scalar()
    rate = lambda c: F.count_if(c) / F.greatest(F.count("*"), _L(1))
    row = df.agg(F.count("*").alias("total_predictions"), rate(_C(label) == unknown).alias("u"), rate(_C(confidence) < 0.40).alias("l"),
                 F.coalesce(F.avg(confidence), _L(0.0)).alias("a")).withColumn("kl", kl)
    level = lambda c, crit, warn: F.when(c > crit, "CRITICAL").when(c > warn, "WARNING") if crit is not None else F.when(c > warn, "WARNING")
    row = row.withColumns({"unknown_alert": level(_C("u"), 0.30, 0.15), "low_conf_alert": level(_C("l"), None, 0.40), "drift_alert": level(_C("kl"), 0.40, 0.15)})
    alerts = F.array("unknown_alert", "low_conf_alert", "drift_alert")
    health = F.when(F.array_contains(alerts, "CRITICAL"), "CRITICAL").when(F.array_contains(alerts, "WARNING"), "WARNING").otherwise("OK")
    return row.select("total_predictions", F.round("u", 3).alias("unknown_rate"), F.round("l", 3).alias("low_confidence_rate"), F.round("a", 3).alias("avg_confidence"),
                      F.round("kl", 4).alias("kl_divergence"), "unknown_alert", "low_conf_alert", "drift_alert", health.alias("health"))


def psi(current: DataFrame, reference: DataFrame, label: str) -> DataFrame:
    """Population stability index per label (floor 1e-4) plus the total as the row without label."""
    p, q = F.greatest(F.coalesce("cur", _L(0.0)), _L(1e-4)), F.greatest(F.coalesce("ref", _L(0.0)), _L(1e-4))
    parts = _both(current, reference, label).select(_C("label").cast("string").alias("label"), ((p - q) * F.log(p / q)).alias("x"), (p * 100).alias("c"), (q * 100).alias("r"))
    detail = parts.filter(F.abs("x") > 0.005).select(
        "label", F.round("r", 1).alias("ref_pct"), F.round("c", 1).alias("cur_pct"), F.round("x", 4).alias("psi"),
        F.when(_C("x") > 0.025, "drift").otherwise("ok").alias("status"))
    none = _L(None).cast("double")
    total = parts.agg(F.coalesce(F.sum("x"), _L(0.0)).alias("x")).select(
        _L(None).cast("string").alias("label"), none.alias("ref_pct"), none.alias("cur_pct"), F.round("x", 4).alias("psi"),
        F.when(F.round("x", 4) < 0.10, "stable").when(F.round("x", 4) < 0.25, "moderate").otherwise("significant").alias("status"))
    return detail.unionByName(total)


def ece(df: DataFrame, prob: str, correct: Column, bins: int = 10) -> DataFrame:
    """Expected calibration error; bins are [lo, hi), so a probability of exactly 1 counts in no bin."""
    n = df.agg(F.count("*")).scalar()
    per = (df.withColumn("_bin", F.floor(_C(prob) * bins)).filter(_C("_bin") < bins).groupBy("_bin")
           .agg(F.count("*").alias("n"), F.avg(prob).alias("conf"), F.avg(correct.cast("double")).alias("acc")))
    return per.agg(F.round(F.coalesce(F.sum(_C("n") / n * F.abs(_C("acc") - _C("conf"))), _L(0.0)), 6).alias("ece"), F.sum("n").alias("n_binned"))


def _grid_counts(df: DataFrame, keys: list[str], prob: str, correct: Column, start: int, step: int, cells: int) -> DataFrame:
    """Histogram on the threshold grid: rows of cell i pass thresholds 0..i. Rows below the grid sit in cell -1."""
    cell = F.least(F.floor((F.round(_C(prob) * 100, 6) - start) / step), _L(cells - 1))
    return (df.withColumn("_cell", F.greatest(cell, _L(-1)).cast("int")).groupBy(*keys, "_cell")
            .agg(F.count("*").alias("n"), F.sum(F.when(correct, 1).otherwise(0)).alias("ok")))


def best_threshold(df: DataFrame, prob: str, correct: Column, default: float = 0.50) -> DataFrame:
    """Global acceptance threshold over .30 to .95: accuracy at least .80, best harmonic mean with coverage."""
    cells = 66
    hist = _grid_counts(df, [], prob, correct, 30, 1, cells)
    total = hist.agg(F.sum("n")).scalar()
    grid = df.sparkSession.range(cells).select(_C("id").cast("int").alias("_cell"))
    w = Window.orderBy(F.desc("_cell")).rowsBetween(Window.unboundedPreceding, 0)
    curve = grid.join(hist, "_cell", "left").select("_cell", F.sum(F.coalesce("n", _L(0))).over(w).alias("n"), F.sum(F.coalesce("ok", _L(0))).over(w).alias("ok"))
    acc, cov = _C("ok") / _C("n"), _C("n") / total
    scored = curve.filter("n >= 3").withColumn("acc", acc).withColumn("cov", cov).filter("acc >= 0.80").withColumn("score", 2 * _C("acc") * _C("cov") / (_C("acc") + _C("cov") + 1e-9))
    best = scored.agg(F.max_by(F.struct("_cell", "acc", "cov"), F.struct("score", -_C("_cell"))).alias("b"))
    return best.select(F.coalesce(F.round((_C("b._cell") + 30) / 100, 2), _L(default)).alias("threshold"), F.round("b.acc", 6).alias("accuracy"), F.round("b.cov", 6).alias("coverage"))


def class_thresholds(df: DataFrame, label: str, prob: str, correct: Column, target: float = 0.80, rare: int = 3, default: float = 0.30) -> DataFrame:
    """Per class the smallest of .25, .30, ... .90 with precision at least ``target``; rare classes take the default.

    Rows are (class, probability of that class, class is true).
    """
    cells = 14
    hist = _grid_counts(df, [label], prob, correct, 25, 5, cells)
    w = Window.partitionBy(label).orderBy(F.desc("_cell")).rowsBetween(Window.unboundedPreceding, 0)
    classes = hist.groupBy(label).agg(F.sum("ok").alias("n_true"))
    grid = classes.select(label, F.explode(F.sequence(_L(-1), _L(cells - 1))).alias("_cell"))
    curve = grid.join(hist, [label, "_cell"], "left").select(label, "_cell", F.sum(F.coalesce("n", _L(0))).over(w).alias("n"), F.sum(F.coalesce("ok", _L(0))).over(w).alias("ok"))
    good = curve.filter((_C("_cell") >= 0) & (_C("n") >= 2)).filter(_C("ok") / _C("n") >= target).groupBy(label).agg(F.min("_cell").alias("cell"))
    value = F.when((_C("n_true") < rare) | _C("cell").isNull(), _L(default)).otherwise(F.round((_C("cell") * 5 + 25) / 100, 2))
    return classes.join(good, label, "left").select(label, _C("n_true").cast("long").alias("n_true"), value.alias("threshold"))


def promotion_gate(metrics: DataFrame, role: str, f1: str, ece_col: str, min_f1: float = -0.02, max_ece: float = 0.05) -> DataFrame:
    """Candidate against production: PROMOTE or REJECT with the reasons."""
    pick = lambda who, col: F.max(F.when(_C(role) == who, _C(col)))
    row = metrics.agg(pick("candidate", f1).alias("cf"), pick("production", f1).alias("pf"), pick("candidate", ece_col).alias("ce"), pick("production", ece_col).alias("pe"))
    bad_f1 = F.coalesce(F.round(_C("cf") - _C("pf"), 9) < min_f1, _L(False))
    bad_ece = F.coalesce(F.round(_C("ce") - _C("pe"), 9) > max_ece, _L(False))
    return row.select(
        F.when(bad_f1 | bad_ece, "REJECT").otherwise("PROMOTE").alias("decision"),
        F.when(bad_f1, "degraded").when(_C("pf").isNotNull() & _C("cf").isNotNull(), "ok").alias("f1_reason"),
        F.when(bad_ece, "degraded").when(_C("pe").isNotNull() & _C("ce").isNotNull(), "ok").alias("ece_reason"),
        F.round(_C("cf") - _C("pf"), 6).alias("delta_f1"), F.round(_C("ce") - _C("pe"), 6).alias("delta_ece"))


def top_errors(df: DataFrame, truth: str, pred: str, confidence: str, key: str, k: int = 5) -> DataFrame:
    """The ``k`` most confident false positives and false negatives of each class."""
    wrong = df.filter(_C(truth) != _C(pred)).select(key, truth, pred, confidence, F.explode(F.array(
        F.struct(_L("fp").alias("kind"), _C(pred).alias("label")), F.struct(_L("fn").alias("kind"), _C(truth).alias("label")))).alias("x"))
    rows = wrong.select(key, truth, pred, confidence, "x.kind", "x.label")
    return first_k(rows, ["kind", "label"], [F.desc_nulls_last(confidence), F.asc(key)], k).withColumnRenamed("rn", "rank")


def apply_thresholds(probs: DataFrame, thresholds: DataFrame, key: str, label: str, prob: str, default: float = 0.50) -> DataFrame:
    """Adaptive acceptance per row from long (key, label, probability): label or UNKNOWN, tier, reason, top three."""
    best = first_k(probs, [key], [F.desc(prob), F.asc(label)], 3)
    packed = best.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("rn", _C(label).alias("label"), _C(prob).alias("p")))).alias("top"))
    head = packed.select(key, _C("top")[0]["label"].alias("raw_label"), _C("top")[0]["p"].alias("conf"),
                         F.array_join(F.transform("top", lambda x: x["label"].cast("string")), ",").alias("top_labels"))
    joined = head.join(thresholds.select(_C(label).alias("raw_label"), _C("threshold").alias("t")), "raw_label", "left").withColumn("t", F.coalesce("t", _L(default)))
    ok = _C("conf") >= _C("t")
    return joined.select(
        key, F.when(ok, _C("raw_label").cast("string")).otherwise("UNKNOWN").alias("predicted_label"), _C("raw_label").cast("string").alias("raw_label"),
        F.round("conf", 3).alias("confidence"), F.when(_C("conf") >= 0.75, "HIGH").when(_C("conf") >= 0.50, "MEDIUM").otherwise("LOW").alias("tier"),
        ok.alias("accepted"), F.round("t", 3).alias("threshold_applied"),
        F.when(~ok, F.when(_C("conf") < 0.35, "very_low").otherwise("below_threshold")).alias("unknown_reason"), "top_labels")
