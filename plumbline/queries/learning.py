"""Models and experiments on the driver tables.

The tables are independent noise, so these show mechanics, not quality. Learner
sizes are parameters; ``classifiers`` has the full ones, the others here keep a whole run short.
"""

from pyspark.sql import functions as F

from ..operators import evaluate as ev
from ..operators import experiments as ex
from ..operators import features, isotonic
from ..operators import models as m
from ..operators.assembly import attach_by_key, derive_snapshot_labels
from ..session import passing
from ..sources import driver_tables as dt
from ..sources import sinks
from ..streaming import reports
from .base import query
from .storage import scratch

#: The classifiers at their full size.
FULL = m.Learners()
ALL = m.Learners(trees=100, rounds=100)
LINEAR = m.Learners(names=("linear",), folds=2)
INPUTS = ["log_original_cost", "expenditure_ratio", "planned_duration_years", "elapsed_share", "spend_pace"]
FX = ("BUILDING", "MACHINERY")
CUTOFFS = (1996, 1997, 1998, 1999)


def time_rows(spark, d):
    return dt.time_table(spark, d).filter("delayed is not null")


def time_frame(spark, d):
    """Features and labels of the dated rows, written once: fits and metrics read them many times."""
    rows = m.raw_rows(time_rows(spark, d), "project_id", "delayed", "tor_months")
    return m.cut_lineage(m.raw_features(rows).select("project_id", "approval_year", "delayed", "tor_months", *INPUTS))


def dated_cost(spark, d):
    """Cost rows with the dates of their order, and a row key from all that tells rows apart."""
    dates = dt.order_dates(spark, d)
    cost = attach_by_key(dt.cost_table(spark, d), dates, ["project_id"], ["approval_year", "planned_duration_years"], "first", ["approval_year"])
    return cost.withColumn("row_key", F.xxhash64("project_id", "line", "project_name", "original_cost_cr", "anticipated_cost_cr"))


@query("classifiers")
def _(spark, d):
    frame = time_frame(spark, d).persist()
    train, test = frame.filter("approval_year <= 1999"), frame.filter("approval_year > 1999")
    out = None
    for name, stage in m.classifiers(train.count(), FULL).items():
        scored = m.predict_probability(m.fit_stage(train, INPUTS, "delayed", stage), test)
        row = ev.auc(scored, "p", "delayed").select(F.lit(name).alias("learner"), "auc", "n_pos", "n_neg")
        out = row if out is None else out.unionByName(row)
    return out


@query("regressors")
def _(spark, d):
    late = time_frame(spark, d).filter("delayed = 1").withColumn("target", features.capped_log_months(F.col("tor_months"))).persist()
    train, test = late.filter("approval_year <= 1999"), late.filter("approval_year > 1999")
    out = None
    for name, stage in m.regressors(ALL).items():
        back = m.predict_value(m.fit_stage(train, INPUTS, "target", stage), test, "pred").withColumn("pred", F.expm1("pred"))
        row = ev.regression_metrics(back.select("tor_months", "pred"), "tor_months", "pred", train).select(
            F.lit(name).alias("learner"), "n", "mae", "r2", "naive_mae", "improvement_pct"
        )
        out = row if out is None else out.unionByName(row)
    return out


@query("select_best")
def _(spark, d):
    frame = ev.fold_assign(time_frame(spark, d), "stratified", 3, key="project_id", label="delayed")
    spec = m.Learners(trees=20, rounds=40)
    best, _, scores = m.select_best(frame, INPUTS, "delayed", "classify", spec, k=3)
    return spark.createDataFrame([(k, float(v), k == best) for k, v in scores.items()], "learner string, auc double, chosen boolean")


@query("score_batch_time")
def _(spark, d):
    est = m.fit_time(time_rows(spark, d), "project_id", LINEAR)
    rows = dt.time_table(spark, d).withColumn("planned_duration_years", F.when(F.col("project_id") % 3 != 0, F.col("planned_duration_years")))
    return m.score_batch(rows, est).select("project_id", "schedule_used", "delay_prob", "delay_months_estimate", "mae_bound")


@query("score_batch_cost")
def _(spark, d):
    prices = m.cut_lineage(dt.yearly_prices(spark, d))  # a row per year, read by the fit and by the scores
    cost = m.schedule_risk(dated_cost(spark, d), time_rows(spark, d), spec=LINEAR, select=False)
    cost = m.cut_lineage(cost)
    est = m.fit_cost(cost, "row_key", prices, 2000, FX, LINEAR)
    scored = m.score_batch(cost, est, prices, 2000, FX)
    return scored.select("project_id", "line", "project_name", "schedule_used", "p", "ratio", "overrun_cr", "exposure_cr", "anticipated_estimate_cr", "mae_bound")


def logistic_estimator(rows, task, label, inputs, groups, medians):
    """One schedule-aware logistic model with its serving parameters, without selection."""
    with passing(rows.sparkSession):
        raw = m.raw_features(m.raw_rows(rows, label, *inputs))
        raw = m.cut_lineage(raw.select(*[c for c in raw.columns if c in {label, "sector", "geo_latitude", "geo_longitude", *inputs, *groups}]))
        params = m.fit_params(raw, label, medians, groups)
        frame = m.cut_lineage(m.apply_params(raw, params).select(*inputs, label))
        return m.Estimator(task, params, {}, {"aware": inputs}, 0.0, {"aware": m.fit_stage(frame, inputs, label, m.classifiers(frame.filter(F.col(label).isNotNull()).count(), LINEAR)["linear"])})


@query("score_projects")
def _(spark, d):
    time_est = logistic_estimator(time_rows(spark, d), "time", "delayed", INPUTS, ("sector", "agency"), INPUTS)
    cost = m.cut_lineage(dated_cost(spark, d).drop("row_key", "project_name"))  # scores and results need neither
    dated = m.score_batch(cost, time_est).select(*cost.columns, F.col("delay_prob").alias("schedule_risk"))
    inputs = ["log_original_cost", "expenditure_ratio", "schedule_risk", "sector_rate"]
    cost_est = logistic_estimator(dated, "cost", "overrun_flag", inputs, ("sector",), inputs[:3])
    scored = m.score_projects(cost, time_est, cost_est)
    return scored.select("project_id", "line", "time_schedule_used", "delay_prob", "schedule_risk", "p")


@query("schedule_risk")
def _(spark, d):
    risk = m.schedule_risk(dated_cost(spark, d), time_rows(spark, d), spec=LINEAR, select=False)
    return risk.groupBy("state").agg(F.count("schedule_risk").alias("n"), F.avg("schedule_risk").alias("mean_risk"))


@query("serve_features")
def _(spark, d):
    rows = time_rows(spark, d)
    params = m.fit_params(m.raw_features(rows), "delayed", INPUTS, ("sector", "agency"))
    est = m.Estimator("time", params, {}, {}, 0.0)
    return m.serve_features(dt.time_table(spark, d), est).select("project_id", *INPUTS, "sector_rate", "agency_rate", "geo_latitude", "geo_longitude")


def oof_scores(spark, d):
    frame = ev.fold_assign(time_frame(spark, d), "stratified", 3, key="project_id", label="delayed")
    stage = m.classifiers(frame.count(), LINEAR)["linear"]
    return m.cut_lineage(m.cross_scores(frame.persist(), INPUTS, "delayed", stage, k=3))


@query("calibrate")
def _(spark, d):
    oof = oof_scores(spark, d)
    model = m.calibrate(oof, "score", "delayed")
    return isotonic.apply_isotonic(oof, model, "score").select("project_id", "score", "calibrated")


@query(
    "calibrate_share", "time",
    """WITH c AS (SELECT round(expenditure_cum_cr / original_cost_cr, 2) AS x, count(*) AS n, CAST(sum(delayed) AS DOUBLE) AS s FROM time_t
                  WHERE delayed IS NOT NULL AND expenditure_cum_cr IS NOT NULL GROUP BY ALL),
       r AS (SELECT x, row_number() OVER (ORDER BY x) AS i, sum(n) OVER (ORDER BY x) AS w, sum(s) OVER (ORDER BY x) AS t, n, s FROM c),
       spans AS (SELECT a.i AS i, b.i AS j, (b.t - a.t + a.s) / (b.w - a.w + a.n) AS mean FROM r a JOIN r b ON a.i <= b.i),
       low AS (SELECT i, j AS at, min(mean) OVER (PARTITION BY i ORDER BY j DESC) AS m FROM spans)
       SELECT r.x AS share, r.n AS n, round(max(low.m), 6) AS calibrated FROM r JOIN low ON low.at = r.i GROUP BY r.x, r.n""",
)
def _(spark, d):
    """Share of delays that never falls with the share spent: the greatest of the least means of all spans around a value."""
    rows = time_rows(spark, d).withColumn("share", F.round(F.col("expenditure_cum_cr") / F.col("original_cost_cr"), 2)).select("share", "delayed").filter("share is not null")
    model = m.calibrate(rows, "share", "delayed")
    counts = rows.groupBy("share").agg(F.count(F.lit(1)).alias("n"))
    return isotonic.apply_isotonic(counts, model, "share").withColumn("calibrated", F.round("calibrated", 6))


@query("stack")
def _(spark, d):
    oof = oof_scores(spark, d)
    model = m.stack(oof, ["score"], "delayed", ["log_original_cost"])
    return m.predict_probability(model, oof, "stacked").select("project_id", "score", "stacked")


@query("driver_analysis")
def _(spark, d):
    frame = time_frame(spark, d)
    return m.driver_analysis(m.fit_logistic(frame, INPUTS, "delayed"), frame)


@query("permutation_drop")
def _(spark, d):
    frame = time_frame(spark, d)
    model = m.fit_logistic(frame, INPUTS, "delayed")
    return m.permutation_drop(model, frame, "delayed", "project_id", ["planned_duration_years", "spend_pace"])


@query("model_registry")
def _(spark, d):
    root = scratch(spark, "registry")
    est = m.fit_time(time_rows(spark, d), "project_id", LINEAR)
    m.save_version(spark, {"time": est}, root)
    m.save_version(spark, {"time": est}, root)
    version, loaded = m.load_latest(spark, root)
    scored = m.score_batch(dt.time_table(spark, d), loaded["time"])
    return scored.groupBy("sector").agg(F.count("delay_prob").alias("n"), F.avg("delay_prob").alias("mean_p")).withColumn("version", F.lit(version))


@query("ingest_and_retrain")
def _(spark, d):
    table, root = scratch(spark, "time"), scratch(spark, "registry")
    t = dt.time_table(spark, d).withColumn("project_id", F.col("project_id").cast("string"))
    sinks.write_table(t.filter("approval_year <= 1999"), table)
    done = m.ingest_and_retrain(spark, table, root, t.filter("approval_year >= 1999"), ["project_id"], "project_id", LINEAR)
    return spark.createDataFrame([tuple(done.values())], ", ".join(f"{k} long" for k in done))


@query("stream_score")
def _(spark, d):
    root, source, out = scratch(spark, "registry"), scratch(spark, "arrivals"), scratch(spark, "scored")
    m.save_version(spark, {"time": m.fit_time(time_rows(spark, d), "project_id", LINEAR)}, root)
    dt.time_table(spark, d).write.parquet(source)
    stream = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
    scored = reports.stream_score(spark, stream, root, "time").select("project_id", "schedule_used", "delay_prob")
    writer = scored.writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch(spark, "checkpoint"))
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(scored.schema).parquet(out)


@query("stream_score_latest")
def _(spark, d):
    """Two deliveries to one stream; a model saved between them scores the second one."""
    root, source, out, checkpoint = (scratch(spark, x) for x in ("registry", "arrivals", "scored", "checkpoint"))
    rows = dt.time_table(spark, d)
    for year in ("approval_year <= 1995", "approval_year > 1995"):
        m.save_version(spark, {"time": logistic_estimator(time_rows(spark, d).filter(year), "time", "delayed", INPUTS, ("sector", "agency"), INPUTS)}, root)
        rows.filter(year).write.mode("append").parquet(source)
        stream = spark.readStream.schema(rows.schema).parquet(source)
        reports.stream_score_latest(stream, root, "time", out, checkpoint).awaitTermination()
    scored = spark.read.parquet(out)
    return scored.groupBy("model_version").agg(F.count("delay_prob").alias("n"), F.min("approval_year").alias("first_year"), F.max("approval_year").alias("last_year"))


@query("temporal_holdout")
def _(spark, d):
    return ex.temporal_holdout(dt.time_table(spark, d), ex.TIME_TASK, CUTOFFS, ("full", "decay", "rolling"), LINEAR)


def snapshot(spark, d):
    snap = derive_snapshot_labels(dt.snapshot_table(spark, d))
    return snap.withColumn("agency", F.col("agency"))


@query("external_holdout")
def _(spark, d):
    return ex.external_holdout(dt.time_table(spark, d), snapshot(spark, d), ex.TIME_TASK, CUTOFFS, LINEAR)


@query("ablation")
def _(spark, d):
    configs = {"none": INPUTS[:2], "pace": [*INPUTS[:2], "elapsed_share", "spend_pace"], "all": [*INPUTS, "sector_rate", "agency_rate"]}
    return ex.ablation(dt.time_table(spark, d), ex.TIME_TASK, configs, k=5, spec=LINEAR)


@query("ab_compare")
def _(spark, d):
    from ..operators.assembly import attach_year_covariates

    with passing(spark):
        yearly = m.cut_lineage(dt.yearly_prices(spark, d).select("year", "wpi_metal", "fx_usd"))  # a row per year
        train, test = (m.cut_lineage(ex.narrow(t, ex.TIME_TASK)) for t in (dt.time_table(spark, d), snapshot(spark, d)))
        base = ex.external_holdout(train, test, ex.TIME_TASK, CUTOFFS, LINEAR, written=True)
        extra = ["wpi_metal", "fx_usd"]
        more = ex.external_holdout(
            attach_year_covariates(train, yearly, extra), attach_year_covariates(test, yearly, extra), ex.TIME_TASK, CUTOFFS, LINEAR,
            experiment="external_covariates", extra=extra,
        )
    return ex.ab_compare(base, more)


@query("augmented_holdout")
def _(spark, d):
    snap = snapshot(spark, d)
    time = ex.augmented_holdout(dt.time_table(spark, d), snap, ex.TIME_TASK, CUTOFFS, LINEAR)
    return time.unionByName(ex.augmented_holdout(dated_cost(spark, d).drop("row_key"), snap, ex.COST_TASK, CUTOFFS, LINEAR))


@query("external_schedule_check")
def _(spark, d):
    return ex.external_schedule_check(dated_cost(spark, d), snapshot(spark, d), time_rows(spark, d), CUTOFFS, dt.yearly_prices(spark, d), 2000, FX)


@query("ingest_and_retrain_cost")
def _(spark, d):
    """A report of cost rows: the table takes it up, and the cost model is fitted anew beside the kept time model."""
    table, root = scratch(spark, "cost"), scratch(spark, "registry")
    m.save_version(spark, {"time": logistic_estimator(time_rows(spark, d), "time", "delayed", INPUTS, ("sector", "agency"), INPUTS)}, root)
    with passing(spark):
        rows = dated_cost(spark, d)
        rows = m.cut_lineage(rows.withColumns({c: F.col(c).cast("string") for c in ("project_id", "line")}))
        sinks.write_table(rows.filter("approval_year <= 1999"), table)
        done = m.ingest_and_retrain(spark, table, root, rows.filter("approval_year >= 1999"), ["project_id", "line"], "row_key", LINEAR, task="cost")
    _, kept = m.load_latest(spark, root)
    return spark.createDataFrame([(*done.values(), "time" in kept, "cost" in kept)], ", ".join([*(f"{k} long" for k in done), "time_kept boolean", "cost_fitted boolean"]))
