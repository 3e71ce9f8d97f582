"""Text features and calibrated probabilities against brute force."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ticketweave.operators import calibration, evaluation, features


def char_wb(text, lo=3, hi=5):
    out = []
    for w in text.lower().split():
        w = f" {w} "
        if len(w) < lo:
            out.append(w)
        for n in range(lo, hi + 1):
            out += [w[i:i + n] for i in range(len(w) - n + 1)]
    return Counter(out)


def test_terms_of_one_text(spark):
    rows = [(1, "Éa b-c d_1 x éa"), (2, ""), (3, None), (4, "zz"), (5, "a ab abcdef")]
    df = spark.createDataFrame(rows, "k long, t string")
    got = {r.k: (r.w, r.c) for r in df.select("k", features.word_terms(F.col("t")).alias("w"), features.char_terms(F.col("t")).alias("c")).collect()}
    assert got[1][0] == ["ea", "b-c", "d_1", "ea", "ea b-c", "b-c d_1", "d_1 ea"]
    assert got[2] == ([], []) and not got[3][0] and not got[3][1] and got[4][0] == ["zz"]
    assert Counter(got[5][1]) == char_wb("a ab abcdef") and Counter(got[1][1]) == char_wb(rows[0][1])


@pytest.mark.parametrize("sublinear", [True, False])
def test_weights_against_a_plain_count(spark, sublinear):
    draw = random.Random(5)
    texts = {i: " ".join(draw.choice(["port", "vlan", "page", "login", "bug", "red", "blue"]) for _ in range(draw.randint(0, 12))) for i in range(60)}
    df = spark.createDataFrame(list(texts.items()) + [(99, None)], "k long, t string")
    got = {(r.k, r.term): (r.tf, r.df, r.weight) for r in features.term_weights(df, "k", "t", max_features=30, sublinear=sublinear).collect()}
    counts = {k: Counter(t.split() + [" ".join(p) for p in zip(t.split(), t.split()[1:])]) for k, t in texts.items()}
    seen, total = Counter(), Counter()
    for c in counts.values():
        seen.update(c.keys())
        total.update(c)
    words = sorted((w for w in seen if seen[w] >= 2), key=lambda w: (-total[w], w))[:30]
    want = {}
    for k, c in counts.items():
        w = {x: ((1 + math.log(c[x])) if sublinear else c[x]) * (math.log((1 + 61) / (1 + seen[x])) + 1) for x in words if x in c}
        size = math.sqrt(sum(v * v for v in w.values()))
        want |= {(k, x): (c[x], seen[x], v / size) for x, v in w.items()}
    assert got.keys() == want.keys()
    assert all(got[k][:2] == want[k][:2] and got[k][2] == pytest.approx(want[k][2]) for k in want)
    assert features.term_weights(df.limit(0), "k", "t").count() == 0
    top = features.heaviest_terms(features.term_weights(df, "k", "t"), "k", 3).collect()
    assert {r["rank"] for r in top} == {1, 2, 3} and {r.k for r in top} == {k for k, t in texts.items() if t}


def test_monotone_is_the_closest_rising_sequence():
    draw = np.random.default_rng(2)
    for n in (0, 1, 2, 7, 40):
        v, w = draw.random(n).round(1), draw.integers(1, 9, n).astype(float)
        mean = lambda a, b: (v[a:b] * w[a:b]).sum() / w[a:b].sum()
        want = [max(min(mean(a, b) for b in range(i + 1, n + 1)) for a in range(i + 1)) for i in range(n)]
        assert np.allclose(calibration.monotone(v, w), want)


def test_curves_of_groups(spark):
    rows = [("a", 0.2, False), ("a", 0.2, True), ("a", 0.4, False), ("a", 0.8, True), ("a", None, True), ("b", 1.0, None)]
    df = spark.createDataFrame(rows, "g string, p double, ok boolean")
    got = {(r.g, r.cell): r.calibrated for r in calibration.isotonic_curves(df, ["g"], "p", F.col("ok")).collect()}
    assert len(got) == 2 * 1001 and got["a", 0] == got["a", 400] == pytest.approx(1 / 3) and got["a", 600] == pytest.approx(2 / 3)
    assert got["a", 800] == got["a", 1000] == 1 and got["b", 0] == 0
    assert calibration.isotonic_curves(df.limit(0), ["g"], "p", F.col("ok")).count() == 0


def test_overconfident_scores_are_brought_down(spark):
    draw = random.Random(11)
    score = [(i, draw.random()) for i in range(4000)]
    df = spark.createDataFrame([(i, 0.5 + p / 2.01, draw.random() < 0.3 + 0.4 * p) for i, p in score], "k long, p double, ok boolean")
    curve = calibration.isotonic_curves(df.filter("k % 2 = 0").withColumn("g", F.lit(1)), ["g"], "p", F.col("ok"))
    after = df.filter("k % 2 = 1").withColumn("cell", calibration.cell("p")).join(curve, "cell")
    before = evaluation.ece(df.filter("k % 2 = 1"), "p", F.col("ok")).first().ece
    assert before > 0.2 and evaluation.ece(after, "calibrated", F.col("ok")).first().ece < 0.06


def test_calibrated_classifier(spark):
    draw = random.Random(3)
    words = {"net": ["vlan", "port", "switch", "cable"], "app": ["login", "page", "button", "form"], "db": ["table", "query", "index", "lock"]}
    rows = []
    for i in range(240):
        label = draw.choice(list(words))
        mixed = words[label] * 2 + draw.choice(list(words.values()))
        rows.append((i, " ".join(draw.choice(mixed) for _ in range(5)), label))
    rows += [(900, "vlan port", None), (901, None, "net"), (None, "login page", "app"), (902, "lone word", "single")]
    df = spark.createDataFrame(rows, "id long, t string, y string")
    model = calibration.train_calibrated(df, "t", "y", "id")
    probs = calibration.predict_calibrated(model, df.filter("id < 240"), "id").collect()
    sums, best = {}, {}
    for r in probs:
        assert 0 <= r.probability <= 1 + 1e-9
        sums[r.id] = sums.get(r.id, 0) + r.probability
        best[r.id] = max(best.get(r.id, (0, "")), (r.probability, r.label))
    assert len(sums) == 240 and all(abs(s - 1) < 1e-9 for s in sums.values()) and len(model.models) == 3
    assert sum(best[i][1] == y for i, _, y in rows[:240]) > 190


def test_char_weights_of_repeated_keys_and_of_a_vocabulary_of_rare_terms(spark):
    """Rows of one key count as one document wherever they lie, and terms of one document alone make room for rarer ones."""
    rows = [(1, "ab ab"), (2, "Été ab"), (1, "été"), (None, "ab"), (None, "xyzw"), (3, None), (4, "qqqqqq " * 9)]
    df = spark.createDataFrame(rows, "k long, t string").repartition(5)
    got = {(r.k, r.term): (r.tf, r.df, r.weight) for r in features.term_weights(df, "k", "t", features.char_terms, max_features=2, sublinear=False).collect()}
    texts = {}
    for k, t in rows:
        texts[k] = texts.get(k, Counter()) + char_wb(t or "")
    seen, total = Counter(), Counter()
    for c in texts.values():
        seen.update(c.keys())
        total.update(c)
    words = sorted((w for w in seen if seen[w] >= 2), key=lambda w: (-total[w], w))[:2]
    want = {}
    for k, c in texts.items():
        w = {x: c[x] * (math.log(6 / (1 + seen[x])) + 1) for x in words if x in c}
        size = math.sqrt(sum(v * v for v in w.values()))
        want |= {(k, x): (c[x], seen[x], v / size) for x, v in w.items()}
    assert words == [" ab", " ab "] and got.keys() == want.keys()
    assert all(got[k][:2] == want[k][:2] and got[k][2] == pytest.approx(want[k][2]) for k in want)


def test_char_terms_are_not_made_for_every_occurrence(spark):
    """A word's terms are made once, not wherever the word stands."""
    df = spark.createDataFrame([(i, "portable vlan portable") for i in range(50)], "k long, t string")
    made = features.term_weights(df, "k", "t", features.char_terms, sublinear=False)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in made and "Generate" not in made
    assert [Counter(features.char_runs(w)) for w in ("a", "été", "abcdef", "")] == [char_wb(w) if w else Counter(["  "]) for w in ("a", "été", "abcdef", "")]
