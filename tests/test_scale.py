"""Order statistics and grouped sums: exact on odd values, and without carrying every value through a shuffle."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import linear, models
from plumbline.plans import ordered


def test_percentiles_order_only_the_values_around_them(spark, monkeypatch):
    """Only values of the buckets that hold a wanted place are collapsed and ordered; the others are counted."""
    rng = random.Random(3)
    rows = [(rng.choice("ab"), rng.lognormvariate(0, 3) * rng.choice((1, 1, -1))) for _ in range(4000)]
    df = spark.createDataFrame(rows, "g string, v double")
    seen, totals = [], ordered.running_totals

    def counted(df, *args, **kwargs):
        seen.append(df.count())
        return totals(df, *args, **kwargs)

    monkeypatch.setattr(ordered, "running_totals", counted)
    got = {(r.g, r.prob): r.value for r in ordered.exact_percentiles(df, ["v"], (0.1, 0.5, 0.9), ["g"]).collect()}
    for g in "ab":
        for p in (0.1, 0.5, 0.9):
            assert got[g, p] == pytest.approx(np.percentile([v for h, v in rows if h == g], 100 * p), rel=1e-12)
    assert sum(seen) < 400


def test_percentiles_of_odd_values(spark):
    values = [0.0, -0.0, math.inf, -math.inf, 5e-324, -5e-324, 1.7e308, -3.0, 2.0, 2.0, 4.0, None, math.nan]
    df = spark.createDataFrame([(None, v) for v in values], "g string, v double")
    known = sorted(v for v in values if v is not None and not math.isnan(v))
    probs = [i / (len(known) - 1) for i in range(len(known))]
    for i, p in enumerate(probs):
        got = ordered.exact_percentiles(df, ["v"], (p,), ["g"]).collect()
        assert len(got) == 1 and got[0].g is None
        if 0 < i < len(known) - 1 and (p * (len(known) - 1)).is_integer():
            assert got[0].value == known[i]


def test_grouped_sums_per_model(spark):
    """Sums of each model, with NULL keys and NULL inputs, which add nothing."""
    rng = random.Random(4)
    rows = [(rng.choice((1, 2, None)), rng.choice(("x", "y")), rng.random(), rng.choice((None, rng.random()))) for _ in range(500)]
    df = spark.createDataFrame(rows, "k int, m string, a double, b double").repartition(5)
    got = linear.grouped_sums(df, ["k", "m"], ["a", "b"], F.col("a") + 1, F.col("b"), F.col("a") * 2)
    assert set(got) == {(k, m) for k, m, *_ in rows}
    for (k, m), (gram, against, loss, n) in got.items():
        own = [(a, b) for kk, mm, a, b in rows if (kk, mm) == (k, m)]
        x = np.array([(a, b or 0.0, 1.0) for a, b in own])
        w = np.array([a + 1 for a, _ in own])
        assert np.allclose(gram, (x * w[:, None]).T @ x)
        assert np.allclose(against, np.array([b or 0.0 for _, b in own]) @ x)
        assert loss == pytest.approx(2 * sum(a for a, _ in own)) and n == len(own)


def test_folds_and_whole_are_fitted_in_the_same_scans(spark, tmp_path, monkeypatch):
    """Each model has the minimum of its own loss; rows are packed once for all folds and the whole."""
    rng = np.random.default_rng(5)
    x = np.column_stack([rng.normal(size=900), rng.normal(size=900) * 40 + 300, np.ones(900)])
    y = (rng.random(900) < 1 / (1 + np.exp(-x[:, 0] - 0.02 * (x[:, 1] - 300)))).astype(float)
    v, fold = x @ [2.0, 0.1, 5.0] + rng.normal(size=900), rng.integers(0, 3, 900)
    rows = [(float(a), float(b), int(c), float(d), int(f)) for (a, b, _), c, d, f in zip(x, y, v, fold, strict=True)]
    df = spark.createDataFrame([*rows, (9.0, 9.0, None, None, 1)], "a double, b double, y int, v double, fold int").repartition(4)
    packed, pack = [], linear._packed
    monkeypatch.setattr(linear, "_packed", lambda *args: packed.append(1) or pack(*args))
    fits = linear.Linear("classify", 900).fit_folds(df, ["a", "b"], "y", "fold", 3)
    lines = linear.Linear("regress").fit_folds(df, ["a", "b"], "v", "fold", 3)
    assert len(packed) == 2
    for i in range(4):
        own = np.ones(900, bool) if i == 3 else fold != i
        w, ridge = np.zeros(3), np.diag([1, 1, 0.0]) * own.sum() / 900
        for _ in range(60):
            p = 1 / (1 + np.exp(-x[own] @ w))
            w -= np.linalg.solve((x[own] * (p * (1 - p))[:, None]).T @ x[own] + ridge, x[own].T @ (p - y[own]) + ridge @ w)
        assert np.allclose([*fits[i].coefficients, fits[i].intercept], w, rtol=1e-6, atol=1e-8)
        assert np.allclose([*lines[i].coefficients, lines[i].intercept], np.linalg.lstsq(x[own], v[own], rcond=None)[0], rtol=1e-6)
    models.save_model(spark, fits[3], f"file://{tmp_path}/m")
    assert models.load_model(spark, f"file://{tmp_path}/m") == fits[3]
    wholes = []
    held = models.cross_scores(df.filter("y is not null"), ["a", "b"], "y", linear.Linear("classify", 900), k=3, wholes=wholes)
    assert wholes == [fits[3]] and held.count() == 900
    assert held.filter(F.abs(F.col("score") - F.when(F.col("fold") == 0, fits[0].predict()).when(F.col("fold") == 1, fits[1].predict()).otherwise(fits[2].predict())) > 1e-12).isEmpty()


def test_linear_learner_on_odd_rows(spark):
    """Rows of one class have a sure model, rows without inputs are an error, as is a model without rows."""
    df = spark.createDataFrame([(1.0, 1, 0), (2.0, 1, 1), (3.0, 0, 1)], "a double, y int, fold int")
    sure, mixed = linear.Linear("classify", 3).fit_folds(df, ["a"], "y", "fold", 2, whole=False)[::-1]
    assert sure.coefficients == (0.0,) and models.predict_probability(sure, df).select("p").distinct().collect() == [(1.0,)]
    assert math.isfinite(mixed.intercept)
    with pytest.raises(ValueError):
        linear.Linear("classify", 3).fit(df.filter("a > 5"), ["a"], "y")
    with pytest.raises(Exception, match="missing"):
        linear.Linear("regress").fit(df.withColumn("a", F.when(F.col("a") < 3, F.col("a"))), ["a"], "y")
