"""Learners, selection, serving, registry."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..plans.ordered import exact_percentiles
from ..session import cut_lineage, passing, sized
from ..sources.sinks import latest_version, read_table, write_metrics, write_table
from . import assembly, evaluate, features, isotonic
from .boosting import Boosted, BoostedModel
from .linear import Linear, LinearFit

Model = PipelineModel | BoostedModel | LinearFit

COST_FEATURES = (
    "log_original_cost", "expenditure_ratio", "log_expenditure", "sector_rate", "geo_latitude", "geo_longitude",
    "revise_log", "elapsed_share", "spend_pace", "price_esc", "price_level_approval", "schedule_risk",
)
TIME_FEATURES = (
    "log_original_cost", "expenditure_ratio", "planned_duration_years", "sector_rate", "geo_latitude", "geo_longitude",
    "elapsed_share", "spend_pace", "agency_rate",
)
DATE_FEATURES = ("elapsed_share", "spend_pace", "price_esc", "price_level_approval")
MIN_ROWS = 100
MIN_DELAYED_ROWS = 20


# --------------------------------------------------------------------------- learners
@dataclass(frozen=True)
class Learners:
    """Learner settings; the defaults are the full-size ones."""

    trees: int = 400
    rounds: int = 400
    names: tuple[str, ...] = ("linear", "forest", "boosted")
    seed: int = 42
    folds: int = 5
    iterations: int = 200
    tolerance: float = 1e-9


def _assembler(inputs: Sequence[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=list(inputs), outputCol="features", handleInvalid="error")


def fit_logistic(df: DataFrame, inputs: Sequence[str], label: str, weight: str | None = None, c: float = 1.0) -> PipelineModel:
    """L2 logistic regression with a penalty on the summed loss: MLlib averages it, hence 1 / (C n)."""
    n = df.agg(F.sum(weight) if weight else F.count(F.lit(1))).first()[0] or 1
    stage = LogisticRegression(
        featuresCol="features", labelCol="__label", regParam=1.0 / (c * float(n)), elasticNetParam=0.0,
        standardization=False, maxIter=200,
    )
    if weight:
        stage = stage.setWeightCol(weight)
    data = df.withColumn("__label", F.col(label).cast("double"))
    return Pipeline(stages=[_assembler(inputs), stage]).fit(data)


def classifiers(n: int, spec: Learners = Learners()) -> dict:
    table = {
        "linear": lambda: Linear("classify", n, spec.iterations, spec.tolerance),
        "forest": lambda: RandomForestClassifier(
            labelCol="__label", numTrees=spec.trees, maxDepth=8, minInstancesPerNode=8, featureSubsetStrategy="sqrt", seed=spec.seed
        ),
        "boosted": lambda: Boosted("classify", rounds=spec.rounds),
    }
    return {k: table[k]() for k in spec.names}


def regressors(spec: Learners = Learners()) -> dict:
    table = {
        "linear": lambda: Linear("regress"),
        "forest": lambda: RandomForestRegressor(
            labelCol="__label", numTrees=spec.trees, maxDepth=8, minInstancesPerNode=8, featureSubsetStrategy="all", seed=spec.seed
        ),
        "boosted": lambda: Boosted("regress", rounds=spec.rounds),
    }
    return {k: table[k]() for k in spec.names}


def fit_stage(df: DataFrame, inputs: Sequence[str], label: str, stage) -> Model:
    if isinstance(stage, Boosted | Linear):
        return stage.fit(df, inputs, label)
    return Pipeline(stages=[_assembler(inputs), stage]).fit(df.withColumn("__label", F.col(label).cast("double")))


ML_COLUMNS = ("features", "rawPrediction", "probability", "prediction")


def save_model(spark: SparkSession, model: Model, path: str) -> None:
    if isinstance(model, BoostedModel):
        model.save(spark, f"{path}/boosted")
    elif isinstance(model, LinearFit):
        model.save(spark, f"{path}/linear")
    else:
        model.write().overwrite().save(f"{path}/pipeline")


def load_model(spark: SparkSession, path: str) -> Model:
    for kind, own in (("boosted", BoostedModel), ("linear", LinearFit)):
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{kind}")
        if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
            return own.load(spark, f"{path}/{kind}")
    return PipelineModel.load(f"{path}/pipeline")


def model_inputs(model: Model) -> list[str]:
    return list(model.inputs if isinstance(model, BoostedModel | LinearFit) else model.stages[0].getInputCols())


def predict_probability(model: Model, df: DataFrame, output: str = "p") -> DataFrame:
    if isinstance(model, BoostedModel):
        return model.predict(df, output)
    if isinstance(model, LinearFit):
        return df.withColumn(output, model.predict())
    return model.transform(df).withColumn(output, vector_to_array("probability")[1]).drop(*ML_COLUMNS)


def predict_value(model: Model, df: DataFrame, output: str = "ratio") -> DataFrame:
    if isinstance(model, BoostedModel):
        return model.predict(df, output)
    if isinstance(model, LinearFit):
        return df.withColumn(output, model.predict())
    return model.transform(df).withColumn(output, F.col("prediction")).drop(*ML_COLUMNS)


# --------------------------------------------------------------------------- selection
def cross_scores(df: DataFrame, inputs: Sequence[str], label: str, stage, fold: str = "fold", k: int = 5, kind: str = "p",
                 wholes: list | None = None) -> DataFrame:
    """Out-of-fold predictions of one learner: k fits (boosted and linear ones in the same scans), one union of the held-out rows.

    A linear learner is fitted on all rows in the same scans too if ``wholes`` is given, and that model is put there.
    """
    out = None
    if isinstance(stage, Linear):
        fits = stage.fit_folds(df, inputs, label, fold, k, whole=wholes is not None)
        if wholes is not None:
            wholes.append(fits[k])
        score = F.lit(None).cast("double")
        for i in range(k):
            score = F.when(F.col(fold) == i, fits[i].predict()).otherwise(score)
        return df.filter(F.col(fold).between(0, k - 1)).withColumn("score", score)
    together = stage.fit_folds(df, inputs, label, fold, k, whole=False) if isinstance(stage, Boosted) else None
    for i in range(k):
        model = together[i] if together else fit_stage(df.filter(F.col(fold) != i), inputs, label, stage)
        held = df.filter(F.col(fold) == i)
        part = predict_probability(model, held, "score") if kind == "p" else predict_value(model, held, "score")
        out = part if out is None else out.unionByName(part)
    return out


def select_best(
    df: DataFrame, inputs: Sequence[str], label: str, task: str, spec: Learners = Learners(), fold: str = "fold", k: int = 5,
    repeat: str | None = None, shift: str | None = None, actual: str | None = None, wholes: dict | None = None,
):
    """Best learner by mean fold AUC (``classify``) or mean fold MAE (``regress``): (name, metric, scores per learner).

    For regression ``label`` is the transformed target; ``shift`` names its shift column
    and ``actual`` the untransformed one. ``df`` is read many times, so it should be written. ``wholes`` (without ``repeat``) takes up the
    models of all rows that came with the folds, by learner.
    """
    rows = df.select(*dict.fromkeys([*inputs, label, fold, *[c for c in (repeat, shift, actual) if c]]))
    n = rows.count()
    learners = classifiers(n, spec) if task == "classify" else regressors(spec)
    repeats = [None] if repeat is None else [r[0] for r in rows.select(repeat).distinct().orderBy(repeat).collect()]
    scores: dict[str, float] = {}
    for name, stage in learners.items():
        values = []
        for r in repeats:
            part = rows if r is None else rows.filter(F.col(repeat) == r)
            whole = [] if wholes is not None and r is None else None
            held = cross_scores(part, inputs, label, stage, fold, k, "p" if task == "classify" else "v", whole)
            if whole:
                wholes[name] = whole[0]
            held = held.select(*dict.fromkeys([fold, label, "score", *[c for c in (shift, actual) if c]]))
            if task == "classify":
                held = cut_lineage(held)  # written once: the metric reads the scores several times and must not score the rows again
                found = evaluate.auc(held, "score", label, by=[fold]).agg(F.avg("auc")).first()[0]
            else:
                back = features.inverse_shifted_log(F.col("score"), F.col(shift)) if shift else F.col("score")
                found = (
                    held.withColumn("__e", F.abs(back - F.col(actual or label)))
                    .groupBy(fold).agg(F.avg("__e").alias("m")).agg(F.avg("m")).first()[0]
                )
            if found is not None:
                values.append(float(found))
        if values:
            scores[name] = sum(values) / len(values)
    if not scores:
        return None, None, {}
    pick = max if task == "classify" else min
    best = pick(sorted(scores), key=lambda s: scores[s])
    return best, scores[best], scores


# --------------------------------------------------------------------------- feature frames
@dataclass
class FrameParams:
    """What serving needs from training: scalars, and written tables of rates (k, v) and mean places (k, lat, lon) of any size."""

    medians: dict[str, float] = field(default_factory=dict)
    rates: dict[str, DataFrame] = field(default_factory=dict)
    overall: dict[str, float] = field(default_factory=dict)
    places: DataFrame | None = None
    overall_place: tuple[float, float] = fv.DEFAULT_LAT_LON


def raw_features(df: DataFrame, prices: DataFrame | None = None, reference_year: int = fv.PRICE_REFERENCE_YEAR,
                 fx_sectors: Sequence[str] = fv.FX_SECTORS, year_fallback: bool = True) -> DataFrame:
    """The projections shared by training and serving; serving has no whole column to inspect, so no fallback there."""
    out = features.pace_features(features.base_cost_features(df), year_fallback=year_fallback)
    if "revised_cost_cr" in df.columns:
        out = features.revise_log(out)
    if prices is not None:
        out = features.price_escalation(out, prices, reference_year, fx_sectors)
    return out


#: Columns that ``raw_features`` and ``fit_params`` read.
RAW_COLUMNS = (
    "original_cost_cr", "expenditure_cum_cr", "revised_cost_cr", "approval_year", "planned_duration_years", "planned_doc_year",
    "original_doc_year", "snap_year", "sector", "agency", "geo_latitude", "geo_longitude",
)


def raw_rows(df: DataFrame, *more: str) -> DataFrame:
    """The columns of ``df`` that ``raw_features`` and ``fit_params`` read, and ``more``, written: the count that settles the durations reads
    the rows once more, and should not join the tables anew."""
    wanted = {*RAW_COLUMNS, *more, *(() if "agency" in df.columns else ("project_name",))}
    return cut_lineage(df.select(*[c for c in df.columns if c in wanted]))


def fit_params(df: DataFrame, label: str, medians: Sequence[str], groups: Sequence[str] = ("sector",)) -> FrameParams:
    """Medians, smoothed rates and mean places of a training frame; rates and places stay tables."""
    params = FrameParams()
    with passing(df.sparkSession):
        found = exact_percentiles(df, list(medians)).select("column", "value").collect()
    params.medians = {r["column"]: r["value"] for r in found}
    for g in groups:
        rates = features.rate_map(df.filter(F.col(g).isNotNull()), g, label)
        params.rates[g] = sized(rates.select(F.col(g).cast("string").alias("k"), F.col("rate").cast("double").alias("v")), keep=True)
    lat, lon = (F.when(F.col("geo_latitude").isNotNull() & F.col("geo_longitude").isNotNull(), F.col(c)) for c in ("geo_latitude", "geo_longitude"))
    mean = df.agg(F.avg(F.col(label).cast("double")).alias("m"), F.avg(lat).alias("lat"), F.avg(lon).alias("lon")).first()
    base = mean["m"]
    params.overall = {g: base for g in groups}
    located = df.filter(F.col("geo_latitude").isNotNull() & F.col("geo_longitude").isNotNull())
    cells = located.filter("sector IS NOT NULL").groupBy(F.col("sector").cast("string").alias("k")).agg(
        F.avg(F.col("geo_latitude").cast("double")).alias("lat"), F.avg(F.col("geo_longitude").cast("double")).alias("lon")
    )
    params.places = sized(cells, keep=True)
    if mean["lat"] is not None:
        params.overall_place = (mean["lat"], mean["lon"])
    return params


def apply_params(df: DataFrame, params: FrameParams, rates: bool = True) -> DataFrame:
    """Fill medians and places, and (for serving) attach the stored rates: one path for train and serve.

    Tables are joined as their written size advises; a key they do not hold, or NULL, gets the overall value.
    """
    both = F.col("geo_latitude").isNotNull() & F.col("geo_longitude").isNotNull()
    lat, lon = (F.lit(float(x)) for x in params.overall_place)
    out = df
    if params.places is not None:
        places = params.places.select(F.col("k").alias("__k"), F.col("lat").alias("__lat"), F.col("lon").alias("__lon"))
        out = out.join(places, F.col("sector").cast("string") == F.col("__k"), "left")
        lat, lon = F.coalesce("__lat", lat), F.coalesce("__lon", lon)
    out = out.withColumns(
        {"geo_latitude": F.when(both, F.col("geo_latitude")).otherwise(lat), "geo_longitude": F.when(both, F.col("geo_longitude")).otherwise(lon)}
    ).drop("__k", "__lat", "__lon")
    for c, m in params.medians.items():
        if c in out.columns:
            out = out.withColumn(c, F.coalesce(F.col(c).cast("double"), F.lit(m), F.lit(0.0)))
    if rates:
        for g, table in params.rates.items():
            known = table.select(F.col("k").alias("__k"), F.col("v").alias("__v"))
            joined = out.join(known, F.col(g).cast("string") == F.col("__k"), "left")
            out = joined.withColumn(f"{g}_rate", F.coalesce("__v", F.lit(params.overall[g]))).drop("__k", "__v")
    return out


def _fit_params_each(df: DataFrame, label: str, medians: Sequence[str], groups: Sequence[str], by: str) -> FrameParams:
    """``fit_params`` of every value of ``by`` (models, few) in the same scans. Numbers are dicts by model; the tables carry it as ``m``."""
    params = FrameParams()
    for r in exact_percentiles(df, list(medians), by=[by]).select(by, "column", "value").collect():  # a row per model and column
        params.medians.setdefault(r["column"], {})[r[by]] = r["value"]
    y = F.col(label).cast("double")
    for g in groups:
        cells = sized(df.filter(F.col(g).isNotNull() & y.isNotNull()).groupBy(F.col(by).alias("m"), F.col(g).cast("string").alias("k")).agg(F.sum(y).alias("s"), F.count(y).alias("n")))
        overall = cells.groupBy(F.col("m").alias("__m")).agg((F.sum("s") / F.sum("n")).alias("o"))
        rate = (F.col("s") + fv.SMOOTHING_M * F.col("o")) / (F.col("n") + fv.SMOOTHING_M)
        params.rates[g] = sized(cells.join(F.broadcast(overall), F.col("m") == F.col("__m")).select("m", "k", rate.alias("v")))
    located = F.col("geo_latitude").isNotNull() & F.col("geo_longitude").isNotNull()
    lat, lon = (F.avg(F.when(located, F.col(c).cast("double"))) for c in ("geo_latitude", "geo_longitude"))
    means = df.groupBy(by).agg(F.avg(y).alias("y"), lat.alias("lat"), lon.alias("lon")).collect()  # a row per model
    params.overall = {g: {r[by]: r["y"] for r in means} for g in groups}
    params.overall_place = {r[by]: fv.DEFAULT_LAT_LON if r["lat"] is None else (r["lat"], r["lon"]) for r in means}
    cells = df.filter(located & F.col("sector").isNotNull()).groupBy(F.col(by).alias("m"), F.col("sector").cast("string").alias("k"))
    params.places = sized(cells.agg(lat.alias("lat"), lon.alias("lon")))
    return params


def _apply_params_each(df: DataFrame, params: FrameParams, by: str) -> DataFrame:
    """``apply_params``, with rates, of the model that ``by`` names in each row; rows of no model stay as they are."""

    def of(numbers: dict[int, float]) -> Column:
        return F.coalesce(F.lit(None).cast("double"), *[F.when(F.col(by) == m, F.lit(float(v))) for m, v in numbers.items() if v is not None])

    def known(out: DataFrame, table: DataFrame, group: str) -> DataFrame:
        there = table.withColumnsRenamed({c: f"__{c}" for c in table.columns})
        return out.join(there, (F.col(by) == F.col("__m")) & (F.col(group).cast("string") == F.col("__k")), "left").drop("__m", "__k")

    stays = (F.col("geo_latitude").isNotNull() & F.col("geo_longitude").isNotNull()) | ~F.col(by).isin(list(params.overall_place))
    lat, lon = (of({m: place[i] for m, place in params.overall_place.items()}) for i in (0, 1))
    out = known(df, params.places, "sector").withColumns(
        {
            "geo_latitude": F.when(stays, F.col("geo_latitude")).otherwise(F.coalesce("__lat", lat)),
            "geo_longitude": F.when(stays, F.col("geo_longitude")).otherwise(F.coalesce("__lon", lon)),
        }
    ).drop("__lat", "__lon")
    out = out.withColumns({c: F.coalesce(F.col(c).cast("double"), of(m)) for c, m in params.medians.items() if c in out.columns})
    for g, table in params.rates.items():
        out = known(out, table, g).withColumn(f"{g}_rate", F.coalesce("__v", of(params.overall[g]))).drop("__v")
    return out


# --------------------------------------------------------------------------- estimators
@dataclass
class Estimator:
    """A fitted schedule-aware and schedule-blind pair with everything serving needs."""

    task: str
    params: FrameParams
    metrics: dict[str, float]
    features: dict[str, list[str]]
    shift: float
    classify: dict[str, Model] = field(default_factory=dict)
    regress: dict[str, Model] = field(default_factory=dict)
    prices: dict | None = None


def _folds(df: DataFrame, label: str, key: str, spec: Learners, seed: int = 7) -> DataFrame:
    return evaluate.fold_assign(df, "stratified", spec.folds, key=key, label=label, seed=seed)


def _fit_variants(frame: DataFrame, est: Estimator, label: str, target: str, spec: Learners, reg_rows: Column | None) -> None:
    reg = frame if reg_rows is None else frame.filter(reg_rows)
    n, n_reg = frame.count(), reg.count()
    for variant, cols in est.features.items():
        if variant == "blind" and n < MIN_ROWS:
            continue
        wholes: dict[str, Model] = {}
        best, score, _ = select_best(frame, cols, label, "classify", spec, k=spec.folds, wholes=wholes)
        if best is None:
            continue
        est.metrics[f"{variant}_auc"] = score
        est.classify[variant] = wholes.get(best) or fit_stage(frame, cols, label, classifiers(n, spec)[best])
        if n_reg < MIN_DELAYED_ROWS:
            continue
        # The regressor sees the continuous out-of-fold rate, not the binary one.
        if "sector_rate_reg" in reg.columns:
            reg_frame = reg.drop("sector_rate").withColumnRenamed("sector_rate_reg", "sector_rate")
        else:
            reg_frame = reg
        wholes = {}
        best_r, mae, _ = select_best(reg_frame, cols, "__target", "regress", spec, k=spec.folds, shift="__shift", actual=target, wholes=wholes)
        est.metrics[f"{variant}_mae"] = mae
        est.regress[variant] = wholes.get(best_r) or fit_stage(reg_frame, cols, "__target", regressors(spec)[best_r])


def fit_cost(
    df: DataFrame,
    key: str,
    prices: DataFrame | None = None,
    reference_year: int = fv.PRICE_REFERENCE_YEAR,
    fx_sectors: Sequence[str] = fv.FX_SECTORS,
    spec: Learners = Learners(),
) -> Estimator:
    """Cost overrun: probability and ratio, schedule-aware and schedule-blind.

    ``df`` carries schedule_risk (see ``schedule_risk``) for the aware variant.
    """
    with passing(df.sparkSession):
        rows = raw_features(df.filter("overrun_flag is not null"), prices, reference_year, fx_sectors)
        aware = [c for c in COST_FEATURES if c in rows.columns or c == "sector_rate"]
        blind = [c for c in aware if c not in DATE_FEATURES and c != "schedule_risk"]
        filled = [c for c in aware if c not in ("sector_rate", "geo_latitude", "geo_longitude")]
        read = [*[c for c in aware if c != "sector_rate"], "sector", "overrun_flag", "overrun_ratio", "fold"]
        rows = cut_lineage(_folds(rows, "overrun_flag", key, spec).select(*dict.fromkeys(read)))
        params = fit_params(rows, "overrun_flag", filled)
        shift = max(0.0, -float(rows.agg(F.min("overrun_ratio")).first()[0] or 0.0)) + 1.0
        frame = features.oof_target_rate(rows, "sector", "overrun_flag")
        frame = features.oof_target_rate(frame, "sector", "overrun_ratio", output="sector_rate_reg")
        frame = apply_params(frame, params, rates=False).withColumns(
            {"__shift": F.lit(shift), "__target": F.log1p(F.col("overrun_ratio") + shift)}
        )
        frame = cut_lineage(frame.select(*dict.fromkeys([*aware, "sector_rate_reg", "overrun_flag", "overrun_ratio", "fold", "__shift", "__target"])))
        est = Estimator("cost", params, {}, {"aware": aware, "blind": blind}, shift)
        _fit_variants(frame, est, "overrun_flag", "overrun_ratio", spec, F.col("overrun_ratio").isNotNull())
    return est


def fit_time(df: DataFrame, key: str, spec: Learners = Learners()) -> Estimator:
    """Delay: probability on all rows, log months on delayed rows only."""
    with passing(df.sparkSession):
        rows = raw_features(df.filter("delayed is not null"))
        if "agency" not in rows.columns:
            rows = features.agency_column(rows)
        aware, blind = list(TIME_FEATURES), [c for c in TIME_FEATURES if c not in DATE_FEATURES]
        filled = [c for c in aware if c not in ("sector_rate", "agency_rate", "geo_latitude", "geo_longitude")]
        read = [*[c for c in aware if c not in ("sector_rate", "agency_rate")], "sector", "agency", "delayed", "tor_months", "fold"]
        rows = cut_lineage(_folds(rows, "delayed", key, spec).select(*dict.fromkeys(read)))
        params = fit_params(rows, "delayed", filled, ("sector", "agency"))
        frame = features.oof_target_rate(features.oof_target_rate(rows, "sector", "delayed"), "agency", "delayed")
        frame = apply_params(frame, params, rates=False).withColumns(
            {"__shift": F.lit(0.0), "__target": features.capped_log_months(F.col("tor_months"))}
        )
        frame = cut_lineage(frame.select(*dict.fromkeys([*aware, "delayed", "tor_months", "fold", "__shift", "__target"])))
        est = Estimator("time", params, {}, {"aware": aware, "blind": blind}, 0.0)
        _fit_variants(frame, est, "delayed", "tor_months", spec, (F.col("delayed") == 1) & F.col("tor_months").isNotNull())
    return est


def serve_features(df: DataFrame, est: Estimator, prices: DataFrame | None = None,
                   reference_year: int = fv.PRICE_REFERENCE_YEAR, fx_sectors: Sequence[str] = fv.FX_SECTORS) -> DataFrame:
    """Serving rows through the same operators as training, with the stored parameters."""
    rows = raw_features(df, prices, reference_year, fx_sectors, year_fallback=False)
    if est.task == "time" and "agency" not in rows.columns:
        rows = features.agency_column(rows)
    return apply_params(rows, est.params)


def score_batch(df: DataFrame, est: Estimator, prices: DataFrame | None = None,
                reference_year: int = fv.PRICE_REFERENCE_YEAR, fx_sectors: Sequence[str] = fv.FX_SECTORS) -> DataFrame:
    """Route each row to the aware or blind models and add the estimates.

    Stateless projections and small joins only, so it serves streams too.
    """
    known = F.coalesce((F.col("approval_year") >= 1960) & (F.col("planned_duration_years") > 0), F.lit(False))
    rows = serve_features(df.withColumn("schedule_used", known), est, prices, reference_year, fx_sectors)
    variants = [v for v in ("aware", "blind") if v in est.classify]
    out = None
    for v in variants:
        part = rows if len(variants) == 1 else rows.filter(F.col("schedule_used") == (v == "aware"))
        part = predict_probability(est.classify[v], part, "p")
        if v in est.regress:
            part = predict_value(est.regress[v], part, "__pred")
            value = F.expm1("__pred") - est.shift
            part = part.withColumn("estimate", value).drop("__pred")
        else:
            part = part.withColumn("estimate", F.lit(None).cast("double"))
        part = part.withColumns({"mae_bound": F.lit(est.metrics.get(f"{v}_mae")).cast("double"), "schedule_used": F.lit(v == "aware")})
        out = part if out is None else out.unionByName(part)
    if est.task == "time":
        return out.withColumnsRenamed({"p": "delay_prob", "estimate": "delay_months_estimate"})
    orig = F.coalesce("original_cost_cr", F.lit(0.0))
    over = F.greatest(F.lit(0.0), F.col("estimate") * orig)
    return out.withColumns(
        {
            "ratio": F.col("estimate"),
            "overrun_cr": over,
            "exposure_cr": F.col("p") * over,
            "anticipated_estimate_cr": orig * (1 + F.col("estimate")),
        }
    ).drop("estimate")


def score_projects(df: DataFrame, time_est: Estimator, cost_est: Estimator, prices: DataFrame | None = None,
                   reference_year: int = fv.PRICE_REFERENCE_YEAR, fx_sectors: Sequence[str] = fv.FX_SECTORS) -> DataFrame:
    """Both estimates of each row: the delay probability of a dated row is the cost model's ``schedule_risk``.

    The input columns are carried as one value past the time model, so that the cost model sees what came in. Stateless, for
    streams too.
    """
    carried = df.drop("schedule_risk")
    timed = score_batch(carried.withColumn("__row", F.struct(*carried.columns)), time_est)
    rows = timed.select(
        "__row.*",
        F.col("schedule_used").alias("time_schedule_used"),
        "delay_prob",
        "delay_months_estimate",
        F.col("mae_bound").alias("delay_mae_bound"),
        F.when(F.col("schedule_used"), F.col("delay_prob")).alias("schedule_risk"),
    )
    return score_batch(rows, cost_est, prices, reference_year, fx_sectors)


# --------------------------------------------------------------------------- schedule risk
def schedule_risk(
    cost: DataFrame, time: DataFrame, inputs: Sequence[str] = TIME_FEATURES, k: int = 5, spec: Learners = Learners(),
    select: bool = True, kind: str = "group_balanced",
) -> DataFrame:
    """P(delayed) per cost row from a time model that saw only other states.

    Both tables carry ``state``. Whole states go to k folds; per fold a time
    model is fitted on the other states' rows, with its own medians and rates.
    Fewer than 100 rows there leave the base rate. ``select=False`` fits the
    first learner instead of choosing by cross-validation, for large data.
    """
    cost = cut_lineage(cost)  # read for the folds, for their states and for the features
    states = evaluate.fold_assign(cost.select("state").filter("state is not null"), kind, k, group="state").distinct()
    states = states.select(F.col("state").alias("__s"), F.col("fold").alias("__fold"))
    folded = cost.join(states, F.col("state") == F.col("__s"), "left").withColumn("__fold", F.coalesce("__fold", F.lit(0))).drop("__s")
    train = raw_features(raw_rows(time.filter("delayed is not null"), "state", "delayed"))
    if "agency" not in train.columns:
        train = features.agency_column(train)
    train = train.join(states, F.col("state") == F.col("__s"), "left").drop("__s")
    train = cut_lineage(train.select(*dict.fromkeys(["state", "sector", "agency", "delayed", "__fold", *[c for c in train.columns if c in inputs]])))
    base = train.agg(F.avg("delayed")).first()[0]
    base = 0.5 if base is None else float(base)
    prepared = raw_features(folded)
    if "agency" not in prepared.columns:
        prepared = features.agency_column(prepared)
    filled = [c for c in inputs if c not in ("sector_rate", "agency_rate", "geo_latitude", "geo_longitude")]
    prepared = prepared.select(*dict.fromkeys([*cost.columns, "agency", "__fold", *[c for c in prepared.columns if c in inputs]]))
    # the rows of each model side by side: those of the other folds
    seen = {r["__fold"]: r["n"] for r in train.filter("__fold is not null").groupBy("__fold").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows_of = {i: sum(n for f, n in seen.items() if f != i) for i in range(k)}
    able = [i for i in range(k) if rows_of[i] >= MIN_ROWS]
    risk = F.lit(base)
    if able:
        others = F.filter(F.array(*[F.lit(i) for i in able]), lambda i: i != F.col("__fold"))
        copies = train.filter("__fold is not null").withColumn("__model", F.explode(others)).drop("__fold")
        params = _fit_params_each(copies, "delayed", filled, ("sector", "agency"), "__model")
        ready = cut_lineage(_apply_params_each(copies, params, "__model").select(*inputs, "delayed", "__model"))  # read by every step of the fits
        name, models = spec.names[0], {}
        stage = classifiers(1, spec)[name]
        if not select and isinstance(stage, Linear):
            models = dict(zip(able, stage.fit_each(ready, inputs, "delayed", "__model", able), strict=True))
        for i in able if not models else ():
            own = ready.filter(F.col("__model") == i).drop("__model")
            if select:
                inner = own.withColumn("fold", F.pmod(F.xxhash64(*inputs), F.lit(3)).cast("int"))
                name = select_best(inner, inputs, "delayed", "classify", spec, k=3)[0] or spec.names[0]
            models[i] = fit_stage(own, inputs, "delayed", classifiers(rows_of[i], spec)[name])
        prepared = _apply_params_each(prepared, params, "__fold")
        if not all(isinstance(m, LinearFit) for m in models.values()):
            out = prepared.filter(~F.col("__fold").isin(able)).withColumn("schedule_risk", risk).select(*cost.columns, "schedule_risk")
            for i, model in models.items():
                part = predict_probability(model, prepared.filter(F.col("__fold") == i), "schedule_risk")
                out = out.unionByName(part.select(*cost.columns, "schedule_risk"))
            return out
        for i, model in models.items():
            risk = F.when(F.col("__fold") == i, model.predict()).otherwise(risk)
    return prepared.withColumn("schedule_risk", risk).select(*cost.columns, "schedule_risk")


# --------------------------------------------------------------------------- ensembles and explanation
def calibrate(oof: DataFrame, score: str, label: str) -> DataFrame:
    """Isotonic calibration fitted on out-of-fold scores: blocks of scores, for ``isotonic.apply_isotonic``."""
    return isotonic.fit_isotonic(oof, score, label)


def stack(df: DataFrame, scores: Sequence[str], label: str, raw: Sequence[str] = ()) -> PipelineModel:
    """Logistic regression on out-of-fold scores, with raw features if given."""
    return fit_logistic(df, [*scores, *raw], label)


def soft_vote(df: DataFrame, scores: Sequence[str], output: str = "p") -> DataFrame:
    return df.withColumn(output, sum((F.col(c) for c in scores), F.lit(0.0)) / len(scores))


def driver_analysis(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Mean absolute contribution coef x (x - mean) per feature of a linear model, largest first."""
    inputs = model.stages[0].getInputCols()
    weights = model.stages[-1].coefficients.toArray()
    means = df.agg(F.struct(*[F.avg(c).alias(c) for c in inputs]).alias("m")).scalar()
    terms = F.array(
        *[
            F.struct(F.lit(c).alias("feature"), F.abs((F.col(c) - F.col("__m").getField(c)) * F.lit(float(w))).alias("v"))
            for c, w in zip(inputs, weights, strict=True)
        ]
    )
    return (
        df.withColumn("__m", means)
        .select(F.explode(terms).alias("t"))
        .groupBy("t.feature")
        .agg(F.avg("t.v").alias("importance"))
        .orderBy(F.col("importance").desc(), "feature")
    )


def permutation_drop(model: PipelineModel, df: DataFrame, label: str, key: str, inputs: Sequence[str] | None = None) -> DataFrame:
    """AUC lost when one feature is shuffled between rows, per feature.

    The shuffle is a join of row hash order with itself shifted: values are
    dealt out by a salted hash within buckets of a few thousand rows.
    """
    names = list(inputs or model_inputs(model))
    rows = df.select(key, label, *model_inputs(model))
    base = evaluate.auc(predict_probability(model, rows), "p", label).select("auc").first()[0]
    out = None
    for c in names:
        moved = shuffle_column(rows, c, key)
        part = evaluate.auc(predict_probability(model, moved), "p", label).select(
            F.lit(c).alias("feature"), (F.lit(base) - F.col("auc")).alias("auc_drop")
        )
        out = part if out is None else out.unionByName(part)
    return out.orderBy(F.col("auc_drop").desc(), "feature")


def shuffle_column(df: DataFrame, column: str, key: str, bucket_rows: int = 4096) -> DataFrame:
    """Move the values of ``column`` between rows; the set of values is kept exactly.

    Rows fall into hash buckets of about ``bucket_rows``; within a bucket, values
    in one hash order are handed to rows in another.
    """
    from pyspark.sql import Window

    n = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    bucketed = df.withColumn("__n", n).withColumn(
        "__bucket", F.pmod(F.xxhash64(key), F.greatest(F.lit(1), F.ceil(F.col("__n") / bucket_rows)).cast("long"))
    )
    seat = Window.partitionBy("__bucket").orderBy(F.xxhash64(key, F.lit("seat")), key)
    draw = Window.partitionBy("__bucket").orderBy(F.xxhash64(key, F.lit(column)), key)
    seats = bucketed.drop(column).withColumn("__pos", F.row_number().over(seat))
    values = bucketed.select("__bucket", F.row_number().over(draw).alias("__pos"), F.col(column))
    return seats.join(values, ["__bucket", "__pos"]).drop("__bucket", "__pos", "__n").select(*df.columns)


# --------------------------------------------------------------------------- registry
def save_version(spark: SparkSession, estimators: dict[str, Estimator], root: str) -> int:
    """Store the estimators as the next version; estimators of the latest version that are not given are carried over.

    Models go to a folder of their own, and the commit fails if another version was committed meanwhile.
    """
    base, path, _ = latest_version(spark, f"{root}/versions")
    folder = f"{root}/models/{uuid.uuid4().hex}"
    rows = []
    for name, est in estimators.items():
        for kind, table in (("classify", est.classify), ("regress", est.regress)):
            for variant, model in table.items():
                save_model(spark, model, f"{folder}/{name}/{kind}/{variant}")
        tables = {**{f"rates/{g}": t for g, t in est.params.rates.items()}, **({} if est.params.places is None else {"places": est.params.places})}
        for part, t in tables.items():
            t.write.parquet(f"{folder}/{name}/{part}")
        state = {
            "task": est.task,
            "metrics": est.metrics,
            "features": est.features,
            "shift": est.shift,
            "classify": sorted(est.classify),
            "regress": sorted(est.regress),
            "medians": est.params.medians,
            "rates": sorted(est.params.rates),
            "overall": est.params.overall,
            "places": est.params.places is not None,
            "overall_place": est.params.overall_place,
        }
        rows.append((name, folder, json.dumps(state)))
    table = spark.createDataFrame(rows, "name string, folder string, state string")
    if path is not None:
        table = table.unionByName(spark.read.parquet(path).filter(~F.col("name").isin(list(estimators))))
    version = committed = write_table(table, f"{root}/versions", base=base)
    metrics = [
        (name, version, est.task, m, float(v)) for name, est in estimators.items() for m, v in est.metrics.items() if v is not None
    ]
    if metrics:
        write_metrics(
            spark.createDataFrame(metrics, "experiment string, cutoff int, task string, metric string, value double"), f"{root}/metrics"
        )
    return committed


def load_latest(spark: SparkSession, root: str) -> tuple[int, dict[str, Estimator]]:
    """Latest committed version and its estimators."""
    version, path, _ = latest_version(spark, f"{root}/versions")
    if path is None:
        raise FileNotFoundError(f"no model version in {root}")
    out = {}
    for row in spark.read.parquet(path).collect():
        s = json.loads(row["state"])
        own = f"{row['folder']}/{row['name']}"
        rates = {g: spark.read.schema("k string, v double").parquet(f"{own}/rates/{g}") for g in s["rates"]}
        places = spark.read.schema("k string, lat double, lon double").parquet(f"{own}/places") if s["places"] else None
        params = FrameParams(s["medians"], rates, s["overall"], places, tuple(s["overall_place"]))
        est = Estimator(s["task"], params, s["metrics"], s["features"], s["shift"])
        for kind, table in (("classify", est.classify), ("regress", est.regress)):
            for variant in s[kind]:
                table[variant] = load_model(spark, f"{own}/{kind}/{variant}")
        out[row["name"]] = est
    return version, out


def ingest_and_retrain(
    spark: SparkSession, table: str, registry: str, new: DataFrame, keys: Sequence[str], key: str, spec: Learners = Learners(), task: str = "time"
) -> dict:
    """Upsert a report into the TIME (or, with ``task`` cost, the COST) table, age TIME labels, refit, register.

    Returns row deltas and versions. The data version is committed before the fit, the model version after it; the other
    task's estimator stays in the new version.
    """
    base, path, _ = latest_version(spark, table)
    if path is None:
        raise FileNotFoundError(f"no committed version in {table}")
    before = spark.read.parquet(path)
    n_before = before.count()
    merged = assembly.upsert(before, new, keys)
    merged = assembly.census_age(merged) if task == "time" else merged
    data_version = write_table(merged.select(*before.columns), table, base=base)
    after = read_table(spark, table)
    n_after = after.count()
    fitted = fit_time(after, key, spec) if task == "time" else fit_cost(after, key, spec=spec)
    model_version = save_version(spark, {task: fitted}, registry)
    return {"rows_before": n_before, "rows_after": n_after, "rows_delta": n_after - n_before, "data_version": data_version, "model_version": model_version}
