"""Models of many splits from rows that are packed once, and metrics of many groups from one ordering."""

import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline import session
from plumbline.operators import evaluate, splits, survival
from plumbline.operators import experiments as ex
from plumbline.operators import models as m


def projects(spark, n=900):
    rng, rows = random.Random(11), []
    for i in range(n):
        cost, share = rng.uniform(50, 3000), rng.random()
        late = int(rng.random() < 0.2 + 0.6 * share)
        rows.append((i, f"S{i % 9}" if i % 31 else None, rng.choice("ABC"), rng.choice(["x", "y", None]), rng.randrange(2008, 2020), float(rng.choice([0, 3, 5])), cost, share * cost, late, late * float(rng.randrange(1, 60)), None if i % 7 == 0 else 20.0, 70.0, 2024.42, share - 0.3, int(share > 0.4), cost * 1.1 if i % 3 else None))
    names = "project_id, state, sector, agency, approval_year, planned_duration_years, original_cost_cr, expenditure_cum_cr, delayed, tor_months, geo_latitude, geo_longitude, snap_year, overrun_ratio, overrun_flag, revised_cost_cr"
    return spark.createDataFrame(rows, names.split(", ")).repartition(4).localCheckpoint()


def tables(spark):
    folder = session.shared_folder(spark)
    return {x for x in os.listdir(folder) if x.startswith("cut-")} if os.path.isdir(folder) else set()


def test_metrics_of_groups_from_one_ordering(spark):
    rng = random.Random(6)
    rows = [(i, i % 3, float(rng.randrange(6)) / 5, int(rng.random() < 0.4)) for i in range(500)] + [(i, 4, 0.5, 1) for i in range(500, 510)]
    df = spark.createDataFrame(rows, "i long, g int, s double, y int")
    got = {r["g"]: r for r in evaluate.ranking_by(df, "s", "y", "i", ["g"])}
    assert set(got) == {0, 1, 2, 4}
    for g, r in got.items():
        own = df.filter(f"g = {g}")
        top, at = evaluate.recall_at_top(own, "s", "y", "i").first(), evaluate.threshold_metrics(own, "s", "y").first()
        assert r["auc"] == evaluate.auc(own, "s", "y").first()["auc"]
        assert (r["recall_at_top"], r["lift"]) == (top["recall_at_top"], top["lift"])
        assert (r["flagged"], r["precision"], r["recall"]) == (at["flagged"], at["precision"], at["recall"])
        assert r["test_base_rate"] == own.agg(F.avg("y")).first()[0]


def test_medians_of_splits_are_exact(spark):
    rng = np.random.default_rng(2)
    odd = [None, 0.0, -0.0, math.inf, -math.inf, 5e-324, -3.5, 1e300]
    rows = [(float(rng.normal() * 10.0 ** rng.integers(-5, 6)), odd[i % 8], int(i % 5), int(i % 2), None if i % 3 else float(i)) for i in range(801)]
    df = spark.createDataFrame(rows, "a double, b double, c int, y int, t double").withColumn("__rid", F.lit(0)).repartition(5)
    layout = splits.Layout(("a", "b"), (), ("c",), 3, 1)
    blocks = splits.pack(df, layout, "y", "t")
    takes = [lambda codes, c=c: codes[0] <= c for c in (0, 2, 4)]
    found, targets = splits.medians(blocks, layout, takes, True)
    blocks.unpersist()
    for s, c in enumerate((0, 2, 4)):
        own = [r for r in rows if r[2] <= c]
        for j in (0, 1):
            assert found[s, j] == np.percentile([r[j] for r in own if r[j] is not None], 50, method="linear")
        assert targets[s] == np.median([r[4] for r in own if r[4] is not None and r[3] == 1])


def test_holdouts_pack_rows_once_and_leave_no_tables(spark, monkeypatch):
    df, packed, real = projects(spark), [], splits.pack
    monkeypatch.setattr(splits, "pack", lambda rows, *args: packed.append(rows.count()) or real(rows, *args))
    spec, before = m.Learners(names=("linear",)), tables(spark)
    ex.temporal_holdout(df, ex.TIME_TASK, (2013, 2014, 2015, 2016), ("full", "decay", "rolling"), spec).collect()
    assert len(packed) == 1 and packed[0] <= 900  # not a copy for each cutoff and mode
    ex.ablation(df, ex.TIME_TASK, {"none": ["log_original_cost"], "all": list(ex.TIME_TASK.inputs)}, k=3, spec=spec).collect()
    assert len(packed) == 2 and packed[1] <= 900
    found = {(r.experiment, r.cutoff, r.metric): r.value for r in ex.augmented_holdout(df, df, ex.COST_TASK, (2013, 2015), spec).collect()}
    assert len(packed) == 6 and found["augment_gain", 2013, "n_added"] == df.filter("approval_year <= 2013").count()
    assert tables(spark) == before


def test_schedule_check_scores_rows_of_all_cutoffs_in_place(spark):
    df, cutoffs = projects(spark), (2013, 2015)
    prices = spark.createDataFrame([(y, 100.0 + y % 7, 50.0, 70.0) for y in range(2008, 2020)], "year int, wpi_metal double, wpi_cement double, fx_usd double")
    before = tables(spark)
    got = {(r.experiment, r.cutoff, r.metric): r.value for r in ex.external_schedule_check(df, df, df, cutoffs, prices, 2015).collect()}
    assert tables(spark) == before
    assert {k[0] for k in got} == {"schedule_check", *[f"schedule_{v}" for v in ex.SCHEDULE_VARIANTS]}
    assert all(0.5 < got[f"schedule_{v}", c, "auc"] <= 1 for v in ex.SCHEDULE_VARIANTS for c in cutoffs)
    task = ex.Task("cost", "overrun_flag", "overrun_ratio", ("sector",), ex.TIME_TASK.inputs)
    rows = ex._columns(df, task, (), (*ex.TIME_TASK.rate_groups, "state"))
    a, b = ex.external_schedule_risk(rows, rows, df, cutoffs, 3, least=10)
    a, b = ({r["__rid"]: r for r in x.collect()} for x in (a, b))
    assert len(a) == len(b) == 900 and all(len(r["schedule_risk"]) == 2 and all(0 < p < 1 for p in r["schedule_risk"]) for r in [*a.values(), *b.values()])
    base = df.agg(F.avg("delayed")).first()[0]
    assert all(r["schedule_risk"] == [pytest.approx(base)] * 2 for r in a.values() if r["state"] is None)  # a state of no fold
    assert {k: r["schedule_risk"] for k, r in a.items()} != {k: r["schedule_risk"] for k, r in b.items()}


def test_concordance_of_groups_equals_each(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["a", "b", None]), float(rng.randrange(12)), int(rng.random() < 0.5), rng.choice([None, rng.randrange(5) / 4])) for _ in range(300)] + [("c", 1.0, 0, 0.5)]
    df = spark.createDataFrame(rows, "g string, months double, event int, risk double")
    got = {r.g: (r.c_index, r.usable_pairs) for r in survival.c_index(df, by=["g"]).collect()}
    assert set(got) == {"a", "b", "c", None} and got["c"] == (None, 0.0)
    for g in ("a", "b", None):
        one = survival.c_index(df.filter(F.col("g").eqNullSafe(F.lit(g)))).first()
        assert got[g] == (pytest.approx(one["c_index"]), one["usable_pairs"])


def test_survival_report_takes_all_cutoffs_together(spark, monkeypatch):
    df = projects(spark).withColumns({"planned_doc_year": F.col("approval_year") + 3, "log_cost": F.log("original_cost_cr")})
    calls, real, before = [], survival.c_index, tables(spark)
    monkeypatch.setattr(survival, "c_index", lambda *args, **kwargs: calls.append(1) or real(*args, **kwargs))
    got = {(r.cutoff, r.metric): r.value for r in survival.survival_report(df, df, ["log_cost", "expenditure_cum_cr"], (2012, 2014, 2030), 2024.42).collect()}
    assert len(calls) == 1 and tables(spark) == before
    assert got[2030, "n_test"] == 0 and (2030, "c_index") not in got
    later = df.filter("approval_year between 2013 and 2014")
    assert got[2012, "n_test"] == later.count() and got[2012, "event_rate"] == pytest.approx(later.agg(F.avg("delayed")).first()[0])
    assert all(0 <= got[c, k] <= 1 for c in (2012, 2014) for k in ("c_index", "c_index_events", "c_index_binary", "auc_hazard", "auc_binary"))
