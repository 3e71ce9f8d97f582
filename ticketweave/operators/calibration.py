"""Classifier probabilities calibrated by isotonic curves from folds."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticketweave.lineage import written
from ticketweave.operators.retrieval import predict, train_classifier

_C, _L = F.col, F.lit
#: Probabilities are calibrated on a grid of so many steps, which bounds each curve whatever the number of rows.
CELLS = 1000


def cell(prob: str) -> Column:
    return F.round(_C(prob) * CELLS).cast("int")


def monotone(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Closest non-decreasing sequence in weighted squares: neighbours that fall are pooled to their mean."""
    pools: list[list[float]] = []
    for v, w in zip(values, weights):
        pools.append([v * w, w, 1])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            s, w2, n = pools.pop()
            pools[-1] = [pools[-1][0] + s, pools[-1][1] + w2, pools[-1][2] + n]
    return np.concatenate([np.full(int(n), s / w) for s, w, n in pools]) if pools else np.empty(0)


def isotonic_curves(scored: DataFrame, keys: Sequence[str], prob: str, correct: Column) -> DataFrame:
    """(keys, cell, calibrated): for each group of ``keys`` the share of correct rows as a non-decreasing curve over the grid.

    Rows are counted by grid cell first, so a group's task reads at most 1,001 rows. Cells without rows lie on the line between
    their neighbours, those outside take the nearest value. Rows whose probability is null are left out; a null ``correct``
    is not correct.
    """
    counted = (scored.filter(_C(prob).isNotNull()).groupBy(*keys, cell(prob).alias("cell"))
               .agg(F.count("*").alias("n"), F.sum(F.when(correct, 1).otherwise(0)).alias("hits")))
    schema = T.StructType([*[counted.schema[k] for k in keys], T.StructField("cell", T.IntegerType()), T.StructField("calibrated", T.DoubleType())])

    def curve(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("cell")
        grid = np.arange(CELLS + 1)
        out = pd.DataFrame({"cell": grid, "calibrated": np.interp(grid, part["cell"], monotone((part["hits"] / part["n"]).to_numpy(), part["n"].to_numpy()))})
        for k in keys:
            out[k] = part[k].iloc[0]
        return out[[*keys, "cell", "calibrated"]]

    return counted.groupBy(*keys).applyInPandas(curve, schema)


@dataclass
class Calibrated:
    """One classifier for each fold and the curves (_fold, label, cell, calibrated) learned on the rows it has not seen."""

    models: list[PipelineModel]
    curves: DataFrame


def _by_fold(models: Sequence[PipelineModel], parts: Sequence[DataFrame], key: str) -> DataFrame:
    scored = [predict(m, part, key).withColumn("_fold", _L(i)) for i, (m, part) in enumerate(zip(models, parts))]
    out = scored[0]
    for more in scored[1:]:
        out = out.unionByName(more)
    return out


def train_calibrated(df: DataFrame, text: str, label: str, key: str, folds: int = 3, min_rows: int = 2, max_features: int = 5000) -> Calibrated:
    """Fit a classifier on all folds but one, and a curve for each of its classes on the fold left out; in turn for each fold.

    A row's fold is a hash of its key, so it is repeatable. ``key`` is unique; rows without a key, label or text are left out,
    and a class counts in a fold only where the others hold ``min_rows`` of it.
    """
    rows = df.filter(_C(key).isNotNull() & _C(label).isNotNull() & _C(text).isNotNull())
    fold = F.pmod(F.xxhash64(_L("fold"), _C(key).cast("string")), _L(folds))
    models = [train_classifier(rows.filter(fold != i), text, label, key, min_rows, 0.0, max_features)[0] for i in range(folds)]
    unseen = _by_fold(models, [rows.filter(fold == i) for i in range(folds)], key)
    truth = rows.select(key, _C(label).cast("string").alias("_truth"))
    curves = isotonic_curves(unseen.join(truth, key), ["_fold", "label"], "probability", _C("label") == _C("_truth"))
    return Calibrated(models, written(curves, "curves"))


def predict_calibrated(model: Calibrated, df: DataFrame, key: str) -> DataFrame:
    """(key, label, probability), adding up to 1 for each row: calibrated and normalised per fold, then averaged over folds.

    Where every class of a fold is calibrated to 0, all are alike. A class that a fold does not know adds nothing there.
    """
    scored = _by_fold(model.models, [df] * len(model.models), key).withColumn("cell", cell("probability"))
    found = scored.join(model.curves, ["_fold", "label", "cell"], "left")
    own = F.coalesce("calibrated", _L(0.0))
    of_row = Window.partitionBy(key, "_fold")
    total, classes = F.sum(own).over(of_row), F.count("*").over(of_row)
    shares = found.select(key, "label", F.when(total > 0, own / total).otherwise(1 / classes).alias("_share"))
    return shares.groupBy(key, "label").agg((F.sum("_share") / len(model.models)).alias("probability"))
