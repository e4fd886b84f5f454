"""Censored survival on the driver tables."""

from pyspark.sql import functions as F

from ..operators import survival as op
from ..operators.assembly import derive_snapshot_labels
from ..sources import driver_tables as dt
from .base import query


def rounded(df, digits, *columns):
    return df.withColumns({c: F.round(c, digits) for c in columns})


TRAIN = """
surv AS (SELECT *, greatest(CASE WHEN coalesce(delayed, 0) > 0 THEN planned_duration_years * 12 + tor_months ELSE planned_duration_years * 12 END, 0.5) AS months,
           coalesce(delayed, 0) AS event FROM time_t)"""


def train_rows(spark, d):
    return op.survival_times(dt.time_table(spark, d), snapshot=False)


@query("survival_times_train", "time", "WITH " + TRAIN.strip() + " SELECT project_id, months, event FROM surv")
def _(spark, d):
    return train_rows(spark, d).select("project_id", "months", "event")


@query(
    "survival_times_snapshot", "snap",
    """SELECT project_id, line, project_name, original_cost_cr, round(greatest(CASE WHEN coalesce(delayed, 0) > 0 THEN planned_duration_years * 12 + tor_months
         ELSE greatest(greatest(least(CAST(original_doc_year AS DOUBLE), 2001.92::DOUBLE) - approval_year - 0.5, 0) * 12, 0.5) END, 0.5), 6) AS months, coalesce(delayed, 0) AS event FROM snap_t""",
)
def _(spark, d):
    snap = derive_snapshot_labels(dt.snapshot_table(spark, d))
    out = op.survival_times(snap, True, dt.SNAP_YEAR)
    return rounded(out.select("project_id", "line", "project_name", "original_cost_cr", "months", "event"), 6, "months")


@query(
    "person_period", "time",
    "WITH " + TRAIN.strip() + """,
    p AS (SELECT project_id, event, CAST(least(greatest(ceil(months / 12), 1), 400) AS INTEGER) AS last FROM surv)
    SELECT project_id, CAST(period AS INTEGER) AS period, CAST(least(period, 14) AS INTEGER) AS period_bucket, CAST(period = last AND event = 1 AS INTEGER) AS y
    FROM p, unnest(range(1, last + 1)) AS r(period)""",
)
def _(spark, d):
    return op.person_period(train_rows(spark, d)).select("project_id", "period", "period_bucket", "y")


@query(
    "life_table", "time",
    "WITH " + TRAIN.strip() + """,
    p AS (SELECT event, CAST(least(greatest(ceil(months / 12), 1), 400) AS INTEGER) AS last FROM surv)
    SELECT CAST(period AS INTEGER) AS period, count(*) AS at_risk, count(*) FILTER (period = last AND event = 1) AS events,
      round(count(*) FILTER (period = last AND event = 1) / count(*), 6) AS hazard FROM p, unnest(range(1, last + 1)) AS r(period) GROUP BY period""",
)
def _(spark, d):
    return rounded(op.life_table(train_rows(spark, d)), 6, "hazard")


@query(
    "survival_risk", "time",
    """WITH h AS (SELECT project_id, 0.02::DOUBLE + 0.001::DOUBLE * (project_id % 7) AS h, CAST(ceil(coalesce(tor_months, 0) * 4 / 12) AS INTEGER) AS k FROM time_t)
       SELECT project_id, round(1 - exp(coalesce((SELECT sum(ln(1 - h.h * i)) FROM range(1, 15) r(i) WHERE i <= k), 0) + greatest(k - 14, 0) * ln(1 - h.h * 14)), 6) AS risk FROM h""",
)
def _(spark, d):
    h = F.lit(0.02) + 0.001 * (F.col("project_id") % 7)
    hazards = F.transform(F.sequence(F.lit(1), F.lit(14)), lambda i: F.col("h") * i)
    rows = dt.time_table(spark, d).withColumn("h", h).withColumn("hazards", hazards)
    risk = op.survival_risk(F.col("hazards"), F.coalesce("tor_months", F.lit(0.0)) * 4)
    return rows.select("project_id", F.round(risk, 6).alias("risk"))


@query(
    "c_index", "time",
    "WITH " + TRAIN.strip() + """,
    c AS (SELECT months AS t, event AS e, round(expenditure_cum_cr / original_cost_cr, 2) AS r, count(*) AS n FROM surv GROUP BY ALL),
    p AS (SELECT sum(CASE WHEN a.t < b.t AND a.e = 1 THEN a.n * b.n END) AS ordered,
            sum(CASE WHEN a.t < b.t AND a.e = 1 THEN a.n * b.n * CASE WHEN a.r > b.r THEN 1.0::DOUBLE WHEN a.r = b.r THEN 0.5::DOUBLE ELSE 0 END END) AS wins,
            sum(CASE WHEN a.t = b.t AND a.e = 1 AND b.e = 1 AND a.r < b.r THEN a.n * b.n END) AS tied FROM c a, c b WHERE a.e = 1 AND a.t <= b.t)
    SELECT round((wins + 0.5 * coalesce(tied, 0)) / (ordered + coalesce(tied, 0)), 6) AS c_index, CAST(ordered + coalesce(tied, 0) AS DOUBLE) AS usable_pairs FROM p""",
)
def _(spark, d):
    rows = train_rows(spark, d).withColumn("risk", F.round(F.col("expenditure_cum_cr") / F.col("original_cost_cr"), 2))
    return rounded(op.c_index(rows), 6, "c_index")


FEATURES = ["log_original_cost", "expenditure_ratio", "planned_duration_years"]


def static(df):
    from ..operators.features import base_cost_features

    return base_cost_features(df)


@query("fit_hazard")
def _(spark, d):
    tr = static(train_rows(spark, d))
    model = op.fit_hazard(tr, FEATURES)
    return op.bucket_hazards(tr, model).select(
        "project_id", F.round(op.survival_risk(F.col("hazards"), F.lit(60.0)), 6).alias("risk_5y")
    )


@query("bucket_hazards")
def _(spark, d):
    tr = static(train_rows(spark, d))
    return op.bucket_hazards(tr, op.fit_hazard(tr, FEATURES)).select("project_id", "hazards")


@query("baseline_hazard")
def _(spark, d):
    tr = static(train_rows(spark, d))
    return op.baseline_hazard(tr, op.fit_hazard(tr, FEATURES))


@query("survival_report")
def _(spark, d):
    train = static(dt.time_table(spark, d))
    test = static(derive_snapshot_labels(dt.snapshot_table(spark, d)))
    return op.survival_report(train, test, FEATURES, (1996, 1997, 1998, 1999), dt.SNAP_YEAR)
