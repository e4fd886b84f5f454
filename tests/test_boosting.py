"""Boosted trees against a plain implementation, and as learners of the library."""

import math
import random

import pytest
from pyspark.sql import functions as F

from plumbline.operators import boosting as b
from plumbline.operators import evaluate, models


def plain(rows, spec):
    """rows: (features, y). Leaf-wise boosting with exact splits on the values; returns a function of features."""
    ys = [y for _, y in rows]
    mean = sum(ys) / len(ys)
    start = math.log(mean / (1 - mean)) if spec.kind == "classify" else mean
    score, trees = [start] * len(rows), []

    def sums(ids):
        return sum(g[i] for i in ids), sum(h[i] for i in ids)

    def best(ids):
        g0, h0 = sums(ids)
        found = (0.0, None)
        for j in range(len(rows[0][0])):
            values = sorted({rows[i][0][j] for i in ids if rows[i][0][j] is not None})
            for v in values:
                for missing_left in (False, True):
                    left = [i for i in ids if (rows[i][0][j] is None and missing_left) or (rows[i][0][j] is not None and rows[i][0][j] <= v)]
                    right = [i for i in ids if i not in set(left)]
                    if len(left) < spec.least_rows or len(right) < spec.least_rows:
                        continue
                    (gl, hl), (gr, hr) = sums(left), sums(right)
                    gain = gl * gl / hl + gr * gr / hr - g0 * g0 / h0
                    if gain > found[0] + 1e-9:
                        found = (gain, (j, v, missing_left, left, right))
        return found

    for _ in range(spec.rounds):
        if spec.kind == "classify":
            p = [1 / (1 + math.exp(-s)) for s in score]
            g, h = [q - y for q, y in zip(p, ys, strict=True)], [q * (1 - q) for q in p]
        else:
            g, h = [s - y for s, y in zip(score, ys, strict=True)], [1.0] * len(rows)
        leaves = [(list(range(len(rows))), best(list(range(len(rows)))), ())]
        while len(leaves) < spec.leaves:
            k = max(range(len(leaves)), key=lambda i: leaves[i][1][0])
            ids, (gain, split), path = leaves[k]
            if split is None or gain <= 1e-9:
                break
            j, v, missing, left, right = split
            leaves[k : k + 1] = [(left, best(left), (*path, (j, v, missing, True))), (right, best(right), (*path, (j, v, missing, False)))]
        tree = []
        for ids, _, path in leaves:
            gs, hs = sums(ids)
            tree.append((path, -spec.rate * gs / hs))
            for i in ids:
                score[i] += tree[-1][1]
        trees.append(tree)
    return score


@pytest.mark.parametrize("kind", ["classify", "regress"])
def test_equals_a_plain_implementation(spark, kind):
    rng = random.Random(kind)
    rows = []
    for _ in range(160):
        x = [None if rng.random() < 0.15 else rng.randrange(12) / 4, rng.choice([0.0, 1.0, 2.0]), None if rng.random() < 0.05 else round(rng.random(), 2)]
        signal = (x[0] if x[0] is not None else 2.5) + x[1] * (x[2] or 0) + rng.gauss(0, 0.7)
        rows.append((x, float(signal > 2) if kind == "classify" else signal))
    spec = b.Boosted(kind, rounds=6, leaves=5, rate=0.3, least_rows=8)
    df = spark.createDataFrame([(i, *x, y) for i, (x, y) in enumerate(rows)], "i int, a double, b double, c double, y double").repartition(5)
    model = spec.fit(df, ["a", "b", "c"], "y")
    got = {r.i: r.s for r in df.select("i", model.raw().alias("s")).collect()}
    want = plain(rows, spec)
    assert all(got[i] == pytest.approx(want[i], abs=1e-6) for i in got)
    # the same trees from other blocks
    assert spec.fit(df.repartition(2, "i"), ["a", "b", "c"], "y").trees == model.trees


def test_folds_grown_together_equal_single_fits(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, rng.random(), None if i % 9 == 0 else rng.random(), i % 3) for i in range(600)]
    df = spark.createDataFrame([(i, a, c, f, int(a + (c or 0.7) + rng.gauss(0, 0.2) > 1)) for i, a, c, f in rows], "i int, a double, c double, fold int, y int")
    spec = b.Boosted(rounds=12)
    together = spec.fit_folds(df, ["a", "c"], "y", "fold", 3)
    assert len(together) == 4
    single = spec.fit(df, ["a", "c"], "y")
    assert single.trees == together[3].trees and single.start == together[3].start
    held = models.cross_scores(df, ["a", "c"], "y", spec, k=3)
    assert held.count() == 600 and evaluate.auc(held, "score", "y").first()["auc"] > 0.85
    stored = str(tmp_path / "m")
    models.save_model(spark, together[0], stored)
    again = models.load_model(spark, stored)
    x, y = (models.predict_probability(m, df, "p").agg(F.sum("p")).first()[0] for m in (together[0], again))
    assert x == y
    best, _, scores = models.select_best(df.fillna(0.5), ["a", "c"], "y", "classify", models.Learners(rounds=8, names=("linear", "boosted")), k=3)
    assert set(scores) == {"linear", "boosted"} and best in scores


def test_no_rows_no_signal_all_missing(spark):
    spec = b.Boosted(rounds=3)
    empty = spark.createDataFrame([], "a double, y int")
    assert spec.fit(empty, ["a"], "y").predict(spark.createDataFrame([(1.0,)], "a double"), "p").count() == 1
    flat = spark.createDataFrame([(None, i % 2) for i in range(100)], "a double, y int")
    model = spec.fit(flat, ["a"], "y")
    assert {round(r.p, 6) for r in model.predict(flat, "p").collect()} == {0.5}
