"""Models of all folds in the same scans, and rows written without what nobody reads."""

import math

import numpy as np
from pyspark.sql import functions as F

from plumbline.operators import boosting, linear, models


def rows(spark, n=600):
    i = F.col("id")
    return spark.range(0, n, 1, 4).select(
        i.alias("project_id"),
        F.when(i % 11 != 0, F.concat(F.lit("S"), (i % 9).cast("string"))).alias("state"),
        F.when(i % 13 != 0, F.concat(F.lit("sec"), (i % 4).cast("string"))).alias("sector"),
        F.when(i % 17 != 0, F.concat(F.lit("ag"), (i % 6).cast("string"))).alias("agency"),
        F.when(i % 7 != 0, 10.0 + i % 50).alias("original_cost_cr"),
        ((i * 37) % 41).cast("double").alias("expenditure_cum_cr"),
        (1992 + i % 9).cast("int").alias("approval_year"),
        F.when(i % 5 != 0, 1.0 + i % 6).alias("planned_duration_years"),
        F.when(i % 3 != 0, 8.0 + i % 9).alias("geo_latitude"),
        F.when(i % 3 != 0, 70.0 + i % 9).alias("geo_longitude"),
        F.lit(2001.92).alias("snap_year"),
        ((i * 7919) % 101 < 35 + 5 * (i % 6)).cast("int").alias("delayed"),
    )


def test_models_of_own_rows_equal_single_fits(spark):
    df = spark.createDataFrame([(float((7 * i) % 19), float(i % 5), int((13 * i) % 7 < 3), i % 3) for i in range(300)], "a double, b double, y int, k int")
    together = linear.Linear("classify", 1).fit_each(df, ["a", "b"], "y", "k", [2, 0])
    for key, got in zip([2, 0], together, strict=True):
        own = df.filter(F.col("k") == key)
        alone = linear.Linear("classify", own.count()).fit(own, ["a", "b"], "y")
        assert np.allclose([*got.coefficients, got.intercept], [*alone.coefficients, alone.intercept], atol=1e-7)


def plain_risk(cost, time, k):
    """Fold by fold, with the parts that serve one model."""
    inputs = models.TIME_FEATURES
    filled = [c for c in inputs if c not in ("sector_rate", "agency_rate", "geo_latitude", "geo_longitude")]
    states = models.evaluate.fold_assign(cost.select("state").filter("state is not null"), "group_balanced", k, group="state").distinct()
    fold = {r["state"]: r["fold"] for r in states.collect()}
    place = F.create_map(*[F.lit(x) for pair in fold.items() for x in pair])
    train, held = (models.raw_features(t).withColumn("__fold", place[F.col("state")]).localCheckpoint() for t in (time, cost))
    out = {}
    for i in range(k):
        own = train.filter(F.col("__fold") != i)
        params = models.fit_params(own, "delayed", filled, ("sector", "agency"))
        model = models.fit_stage(models.apply_params(own, params).select(*inputs, "delayed"), inputs, "delayed", linear.Linear("classify", own.count()))
        part = models.apply_params(held.filter(F.coalesce("__fold", F.lit(0)) == i), params).withColumn("p", model.predict())
        out |= {r["project_id"]: (r["p"], r["geo_latitude"], r["planned_duration_years"]) for r in part.collect()}
    return out


def test_schedule_risk_of_all_folds_in_shared_scans(spark, monkeypatch):
    time, cost = rows(spark).localCheckpoint(), rows(spark, 400).drop("delayed").localCheckpoint()
    spec, written, real = models.Learners(names=("linear",)), [], models.cut_lineage
    monkeypatch.setattr(models, "cut_lineage", lambda df: written.append(df.columns) or real(df))
    counts = []
    for k in (2, 3):
        written.clear()
        got = models.schedule_risk(cost, time, k=k, spec=spec, select=False)
        counts.append(len(written))
        if k == 3:
            continue
        want = plain_risk(cost, time, k)
        found = {r["project_id"]: (r["schedule_risk"], r["geo_latitude"], r["planned_duration_years"]) for r in got.collect()}
        assert got.columns == [*cost.columns, "schedule_risk"] and found.keys() == want.keys() and got.count() == 400
        assert all(math.isclose(a, b, abs_tol=1e-6) for key, x in found.items() for a, b in zip(x, want[key], strict=True))
    assert counts[0] == counts[1]  # more folds, no more tables


def test_schedule_risk_with_few_rows_leaves_the_base_rate(spark):
    time, cost = rows(spark, 90).localCheckpoint(), rows(spark, 40).drop("delayed").localCheckpoint()
    got = models.schedule_risk(cost, time, k=2, spec=models.Learners(names=("linear",)), select=False).collect()
    base = time.agg(F.avg("delayed")).first()[0]
    assert len(got) == 40 and {r["schedule_risk"] for r in got} == {base}
    assert any(r["geo_latitude"] is None for r in got)


def test_schedule_risk_of_other_learners(spark):
    time, cost = rows(spark).localCheckpoint(), rows(spark, 60).drop("delayed").localCheckpoint()
    got = models.schedule_risk(cost, time, k=2, spec=models.Learners(trees=3, names=("forest",)), select=False).collect()
    assert len(got) == 60 and all(0 <= r["schedule_risk"] <= 1 for r in got)


def test_histograms_read_the_rows_of_the_smaller_child():
    bins = np.array([[0, 1, 2, 3, 4, 5, 6, 7], [1, 1, 1, 1, 2, 2, 0, 2]], dtype=np.uint8)
    tree = boosting.Tree({0: (0, 2, True), 2: (1, 1, False)}, {0: (1, 2), 2: (3, 4)})
    assert {k: v.tolist() for k, v in tree.rows_of(bins, np.arange(8), {1, 3, 4}).items()} == {1: [0, 1, 2], 3: [3], 4: [4, 5, 6, 7]}
    assert tree.rows_of(bins, np.array([1, 5, 6]), {4})[4].tolist() == [5, 6]
    sums = np.zeros((2, boosting.BINS, 3), dtype=np.int64)
    for j in range(2):
        sums[j, :, 2] = np.bincount(bins[j], minlength=boosting.BINS)
    assert not boosting._right_is_smaller(sums, (0, 2, True)) and boosting._right_is_smaller(sums, (0, 5, False))
    assert boosting._right_is_smaller(sums, (1, 1, True)) and not boosting._right_is_smaller(sums, (1, 1, False))


def test_raw_rows_carry_what_features_read(spark):
    wide = rows(spark, 60).withColumns({"project_name": F.lit("x" * 50), "reasons": F.lit("y" * 50)})
    kept = models.raw_rows(wide, "project_id", "delayed")
    assert set(wide.columns) - set(kept.columns) == {"project_name", "reasons", "state"}
    names = ["project_id", "elapsed_share", "spend_pace", "log_original_cost"]
    assert sorted(models.raw_features(kept).select(names).collect()) == sorted(models.raw_features(wide).select(names).collect())
    assert "project_name" in models.raw_rows(wide.drop("agency")).columns  # the agency is parsed from it


def test_fit_frames_without_names(spark, monkeypatch):
    wide = rows(spark, 300).withColumns({"project_name": F.lit("x" * 50), "tor_months": F.col("delayed") * 6.0})
    written, real = [], models.cut_lineage
    monkeypatch.setattr(models, "cut_lineage", lambda df: written.append(df.columns) or real(df))
    est = models.fit_time(wide, "project_id", models.Learners(names=("linear",), folds=2))
    assert est.classify and not any("project_name" in columns for columns in written)
