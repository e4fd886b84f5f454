"""Experiments: temporal and external holdouts, ablation, A/B.

Linear and logistic models of all cutoffs, modes, folds and feature sets are fitted and measured in the same scans of packed rows
(``splits``); other learners go through a driver loop over configurations. Every experiment returns metric rows
(experiment, cutoff, task, metric, value).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..session import cut_lineage, passing, sized
from ..sources.sinks import METRICS_SCHEMA
from . import assembly, evaluate, features, models, splits

MIN_TRAIN, MIN_TEST = 200, 30
MIN_TRAIN_EXTERNAL = 100


@dataclass(frozen=True)
class Task:
    """What one model pair learns from a table."""

    name: str
    label: str
    target: str
    rate_groups: tuple[str, ...]
    inputs: tuple[str, ...]


COST_TASK = Task(
    "cost", "overrun_flag", "overrun_ratio", ("sector",),
    ("log_original_cost", "expenditure_ratio", "log_expenditure", "geo_latitude", "geo_longitude", "elapsed_share", "spend_pace", "revise_log"),
)
TIME_TASK = Task(
    "time", "delayed", "tor_months", ("sector", "agency"),
    ("log_original_cost", "expenditure_ratio", "planned_duration_years", "geo_latitude", "geo_longitude", "elapsed_share", "spend_pace"),
)


def metric_rows(spark, rows: Sequence[tuple]) -> DataFrame:
    clean = [(e, int(c) if c is not None else None, t, m, float(v)) for e, c, t, m, v in rows if v is not None]
    return spark.createDataFrame(clean, METRICS_SCHEMA)


def split_frames(train: DataFrame, test: DataFrame, task: Task, cutoff: int, mode: str, extra: Sequence[str] = ()):
    """Train and test features with encoders and medians fitted on the training rows only."""
    inputs = [*task.inputs, *extra]

    def raw(df: DataFrame) -> DataFrame:
        return models.raw_features(df)

    tr, te = raw(train), raw(test)
    filled = [c for c in inputs if c not in ("geo_latitude", "geo_longitude")]
    medians = {r["column"]: r["value"] for r in models.exact_percentiles(tr, filled).select("column", "value").collect()}
    defaults = {"geo_latitude": fv.DEFAULT_LAT_LON[0], "geo_longitude": fv.DEFAULT_LAT_LON[1]}
    out = []
    for df in (tr, te):
        for group in task.rate_groups:
            rates = features.train_rate(train, group, task.label, cutoff, mode)
            df = features.apply_rate(df, rates, group, f"{group}_rate")
        df = df.withColumns(
            {c: F.coalesce(F.col(c).cast("double"), F.lit(medians.get(c)).cast("double"), F.lit(defaults.get(c, 0.0))) for c in inputs}
        )
        keep = [*inputs, *[f"{g}_rate" for g in task.rate_groups], task.label, task.target]
        out.append(cut_lineage(df.select(*dict.fromkeys(keep))))
    return out[0], out[1], [*inputs, *[f"{g}_rate" for g in task.rate_groups]]


def evaluate_split(
    train: DataFrame,
    test: DataFrame,
    task: Task,
    cutoff: int,
    mode: str = "full",
    spec: models.Learners = models.Learners(),
    extra: Sequence[str] = (),
    least: tuple[int, int] = (MIN_TRAIN, MIN_TEST),
) -> dict[str, float | None]:
    """Metrics of the best classifier and regressor on one split; empty when a side is too small."""
    n_train, n_test = train.count(), test.count()
    found: dict[str, float | None] = {"n_train": n_train, "n_test": n_test}
    if n_train < least[0] or n_test < least[1]:
        return found
    tr, te, inputs = split_frames(train, test, task, cutoff, mode, extra)
    best_auc, best = -1.0, None
    for name, stage in models.classifiers(n_train, spec).items():
        model = models.fit_stage(tr, inputs, task.label, stage)
        scored = models.predict_probability(model, te, "p").select("p", task.label)
        value = evaluate.auc(scored, "p", task.label).first()["auc"]
        found[f"auc_{name}"] = value
        if value is not None and value > best_auc:
            best_auc, best = value, scored
    if best is not None:
        # written once, so the id that settles equal scores stays the same in every later job
        held = cut_lineage(best.withColumn("rid", F.monotonically_increasing_id()))
        at = evaluate.threshold_metrics(held, "p", task.label).first()
        top = evaluate.recall_at_top(held, "p", task.label, "rid").first()
        rate = held.agg(F.avg(task.label)).first()[0]
        found |= {
            "auc": best_auc,
            "test_base_rate": rate,
            "flagged": at["flagged"],
            "precision": at["precision"],
            "recall": at["recall"],
            "recall_at_top": top["recall_at_top"],
            "lift": top["lift"],
        }
    reg_tr, reg_te = tr.filter(F.col(task.target).isNotNull()), te.filter(F.col(task.target).isNotNull())
    if task.name == "time":
        reg_tr, reg_te = reg_tr.filter(f"{task.label} = 1"), reg_te.filter(f"{task.label} = 1")
    if reg_tr.limit(models.MIN_DELAYED_ROWS).count() < models.MIN_DELAYED_ROWS or not reg_te.limit(1).count():
        return found
    low = reg_tr.agg(F.min(task.target)).first()[0]
    shift = 0.0 if task.name == "time" else max(0.0, -float(low)) + 1.0
    capped = F.least(F.col(task.target), F.lit(fv.TOR_CAP_MONTHS)) if task.name == "time" else F.col(task.target)
    ready = reg_tr.withColumn("__target", F.log1p(capped + shift))
    best_mae = None
    for name, stage in models.regressors(spec).items():
        model = models.fit_stage(ready, inputs, "__target", stage)
        back = models.predict_value(model, reg_te, "pred").withColumn("pred", F.expm1("pred") - shift)
        row = evaluate.regression_metrics(back, task.target, "pred", reg_tr).first()
        found[f"mae_{name}"] = row["mae"]
        if best_mae is None or row["mae"] < best_mae["mae"]:
            best_mae = row
    found |= {"mae": best_mae["mae"], "r2": best_mae["r2"], "naive_mae": best_mae["naive_mae"], "improvement_pct": best_mae["improvement_pct"]}
    return found


# --------------------------------------------------------------------------- all splits in the same scans
PLACES = {"geo_latitude": fv.DEFAULT_LAT_LON[0], "geo_longitude": fv.DEFAULT_LAT_LON[1]}


def narrow(df: DataFrame, task: Task, extra: Sequence[str] = ()) -> DataFrame:
    """The columns that ``_columns`` reads."""
    wanted = {*models.RAW_COLUMNS, *task.rate_groups, task.label, task.target, *extra}
    return df.select(*[c for c in df.columns if c in wanted])


def _columns(df: DataFrame, task: Task, extra: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Raw features and labels of all rows, written once, with a row id that settles equal scores."""
    rows = models.raw_features(df)
    names = dict.fromkeys([*task.inputs, *extra, *task.rate_groups, task.label, task.target, "approval_year", *keep])
    return cut_lineage(rows.select(*names).withColumn("__rid", F.monotonically_increasing_id()))


def _upto(i: int, cutoffs: Sequence[int]) -> splits.Takes:
    return lambda codes, c=cutoffs[i]: codes[0] <= c


def _after(i: int, cutoffs: Sequence[int], width: int) -> splits.Takes:
    return lambda codes, c=cutoffs[i]: (codes[0] >= c + 1) & (codes[0] <= c + width)


def _sizes(rows: DataFrame, within: Sequence[Column]) -> list[int]:
    """Rows that hold each of the conditions, in one scan."""
    return list(rows.agg(*[F.count(F.when(c, 1)).alias(f"n{i}") for i, c in enumerate(within)]).first())


def linear_holdouts(
    train: DataFrame, test: DataFrame, task: Task, cutoffs: Sequence[int], modes: Sequence[str] = ("full",), extra: Sequence[str] = (),
    least: tuple[int, int] = (MIN_TRAIN, MIN_TEST), width: int = 2,
) -> dict[tuple[int, str], dict[str, float | None]]:
    """Metrics per (cutoff, mode) of logistic and linear models, all splits in the same scans; sizes alone where a side is too small."""
    if set(modes) - {"full", "decay", "rolling"}:
        raise ValueError(f"unknown encoding mode among {modes}")
    tr = _columns(train, task, extra)
    te = tr if test is train else _columns(test, task, extra)
    year, window = F.col("approval_year"), fv.ROLLING_WINDOW_YEARS
    n = _sizes(tr, [c for at in cutoffs for c in (year <= at, (year <= at) & (year >= at - window))])
    sizes, recent = dict(zip(cutoffs, n[::2], strict=True)), dict(zip(cutoffs, n[1::2], strict=True))
    tests = dict(zip(cutoffs, _sizes(te, [year.between(at + 1, at + width) for at in cutoffs]), strict=True))
    out = {(c, m): {"n_train": sizes[c], "n_test": tests[c]} for c in cutoffs for m in modes}
    fit = [c for c in cutoffs if sizes[c] >= least[0] and tests[c] >= least[1]]
    if not fit:
        return out

    def weight(at: int, mode: str) -> Column:
        past = F.when(year <= at, 1.0).otherwise(0.0)
        if mode == "decay":
            return past * F.exp(-F.log(F.lit(2.0)) * F.greatest(at - year, F.lit(0)) / fv.RECENCY_HALF_LIFE)
        return past * F.when(year >= at - window, 1.0).otherwise(0.0) if mode == "rolling" and recent[at] else past

    layout = splits.Layout((*task.inputs, *extra), task.rate_groups, ("approval_year",), len(fit), len(fit) * len(modes))
    attach = splits.rate_arrays(tr.filter(year <= max(fit)), task.rate_groups, layout.codes, task.label, [weight(c, m) for c in fit for m in modes])

    def packed(rows: DataFrame) -> DataFrame:
        return splits.pack(attach(rows), layout, task.label, task.target)

    if te is tr:
        a = b = packed(tr.filter(year <= max(fit) + width))
    else:
        a, b = packed(tr.filter(year <= max(fit))), packed(te.filter(year.between(min(fit) + 1, max(fit) + width)))
    each = [splits.Model((c, m), i, i * len(modes) + j) for i, c in enumerate(fit) for j, m in enumerate(modes)]
    learns, later = [_upto(i, fit) for i in range(len(fit))], [_after(i, fit, width) for i in range(len(fit))]
    for key, found in splits.measured(a, b, layout, learns, later, each, task.name == "time", models.MIN_DELAYED_ROWS, defaults=PLACES).items():
        out[key] |= found
    return out


def _is_linear(spec: models.Learners) -> bool:
    return tuple(spec.names) == ("linear",)


def temporal_holdout(
    df: DataFrame,
    task: Task,
    cutoffs: Sequence[int],
    modes: Sequence[str] = ("full", "decay", "rolling"),
    spec: models.Learners = models.Learners(),
) -> DataFrame:
    """Train up to each cutoff, test on the next two years, per encoding mode, plus the verdict per cutoff."""
    rows, by_cutoff = [], {}
    clean, together = assembly.clean_for_eval(df, task.label), {}
    if _is_linear(spec):
        with passing(df.sparkSession):
            kept = cut_lineage(narrow(clean, task))
            together = linear_holdouts(kept, kept, task, cutoffs, modes)
    else:
        clean = cut_lineage(clean)
    for cutoff in cutoffs:
        train, test = assembly.temporal_split(clean, cutoff)
        for mode in modes:
            found = together[cutoff, mode] if together else evaluate_split(train, test, task, cutoff, mode, spec)
            rows += [(f"temporal_{mode}", cutoff, task.name, m, v) for m, v in found.items()]
            if found.get("auc") is not None:
                by_cutoff.setdefault(cutoff, {})[mode] = found["auc"]
    for cutoff, aucs in by_cutoff.items():
        best = max(sorted(aucs), key=lambda m: aucs[m])
        rows.append(("temporal_verdict", cutoff, task.name, f"best_mode_{best}", aucs[best]))
        if "full" in aucs:
            rows.append(("temporal_verdict", cutoff, task.name, "gain_over_full", aucs[best] - aucs["full"]))
    return metric_rows(df.sparkSession, rows)


def external_holdout(
    train: DataFrame, test: DataFrame, task: Task, cutoffs: Sequence[int], spec: models.Learners = models.Learners(),
    mode: str = "full", experiment: str = "external", extra: Sequence[str] = (), written: bool = False,
) -> DataFrame:
    """Train on one document up to the cutoff, test on another document's next two years. ``written`` tables are not written again."""
    rows, together = [], {}
    a, b = (assembly.clean_for_eval(df, task.label) for df in (train, test))
    least = (MIN_TRAIN_EXTERNAL, MIN_TEST)
    if _is_linear(spec):
        with passing(train.sparkSession):
            x, y = (narrow(df, task, extra) if written else cut_lineage(narrow(df, task, extra)) for df in (a, b))
            together = linear_holdouts(x, y, task, cutoffs, (mode,), extra, least)
    else:
        a, b = cut_lineage(a), cut_lineage(b)
    for cutoff in cutoffs:
        tr, te = assembly.temporal_split(a, cutoff)[0], assembly.temporal_split(b, cutoff)[1]
        found = together[cutoff, mode] if together else evaluate_split(tr, te, task, cutoff, mode, spec, extra, least)
        rows += [(experiment, cutoff, task.name, m, v) for m, v in found.items()]
    return metric_rows(train.sparkSession, rows)


def ablation(
    df: DataFrame,
    task: Task,
    configs: Mapping[str, Sequence[str]],
    group: str = "state",
    k: int = 5,
    spec: models.Learners = models.Learners(),
    kind: str = "group_balanced",
) -> DataFrame:
    """Mean AUC over group folds per feature subset, and its gain over the first subset.

    Rates and medians are refitted per fold, on training groups only.
    """
    rows = []
    known = df.filter(F.col(task.label).isNotNull())
    means: dict[str, float] = {}
    sums: dict[str, dict[str, list[float]]] = {c: {} for c in configs}
    if _is_linear(spec):
        with passing(df.sparkSession):
            kept = cut_lineage(narrow(known, task, (group,)))  # read for the folds and for the features
            rows_ = _columns(evaluate.fold_assign(kept, kind, k, group=group), task, (), ("fold",))
            layout = splits.Layout(task.inputs, task.rate_groups, ("fold",), k, k)
            attach = splits.rate_arrays(rows_, task.rate_groups, layout.codes, task.label, [F.when(F.col("fold") != i, 1.0).otherwise(0.0) for i in range(k)])
            packed = splits.pack(attach(rows_), layout, task.label, task.target)
            each = [splits.Model((i, c), i, i, frozenset(columns)) for i in range(k) for c, columns in configs.items()]
            others, own = ([lambda codes, i=i, out=out: (codes[0] != i) == out for i in range(k)] for out in (True, False))
            found = splits.measured(packed, packed, layout, others, own, each, task.name == "time", models.MIN_DELAYED_ROWS, regress=False, defaults=PLACES)
        for (_, config), metrics in sorted(found.items()):
            if metrics.get("auc") is not None:
                sums[config].setdefault("linear", []).append(metrics["auc"])
    else:
        clean = cut_lineage(evaluate.fold_assign(known, kind, k, group=group))
    for i in range(0 if _is_linear(spec) else k):
        train, test = clean.filter(F.col("fold") != i), clean.filter(F.col("fold") == i)
        if not test.limit(1).count():
            continue
        tr, te, everything = split_frames(train, test, task, 9999, "full")
        n = tr.count()
        for config, columns in configs.items():
            inputs = [c for c in columns if c in everything]
            for name, stage in models.classifiers(n, spec).items():
                scored = models.predict_probability(models.fit_stage(tr, inputs, task.label, stage), te, "p")
                value = evaluate.auc(scored.select("p", task.label), "p", task.label).first()["auc"]
                if value is not None:
                    sums[config].setdefault(name, []).append(value)
    for config, per in sums.items():
        for name, values in per.items():
            rows.append((f"ablation_{config}", None, task.name, f"auc_{name}", sum(values) / len(values)))
        if per:
            means[config] = max(sum(v) / len(v) for v in per.values())
            rows.append((f"ablation_{config}", None, task.name, "auc", means[config]))
    first = next(iter(configs))
    rows += [(f"ablation_{c}", None, task.name, "auc_gain", v - means[first]) for c, v in means.items() if first in means and c != first]
    return metric_rows(df.sparkSession, rows)


def ab_compare(
    base: DataFrame, variant: DataFrame, metrics: Sequence[str] = ("auc", "mae"), keys: Sequence[str] = ("cutoff", "task")
) -> DataFrame:
    """Join two metric tables: AUC difference and MAE gain in percent."""
    a = base.filter(F.col("metric").isin(*metrics)).select(*keys, "metric", F.col("value").alias("base"))
    b = variant.filter(F.col("metric").isin(*metrics)).select(*keys, "metric", F.col("value").alias("variant"))
    gain = F.when(F.col("metric").startswith("mae"), (1 - F.col("variant") / F.nullif(F.col("base"), F.lit(0.0))) * 100).otherwise(
        F.col("variant") - F.col("base")
    )
    return a.join(b, [*keys, "metric"]).withColumn("gain", gain)


def augmented_holdout(
    train: DataFrame, snapshot: DataFrame, task: Task, cutoffs: Sequence[int], spec: models.Learners = models.Learners()
) -> DataFrame:
    """Do resolved rows of the later document help? The external holdout with and without them, and the gains.

    The added training rows are the snapshot's labelled rows approved up to the cutoff; the test rows, its next two years, are
    the same in both runs. Both tables carry ``snap_year``, so each side keeps the pace of its own vintage.
    Metric rows of ``external``, ``external_augmented`` and ``augment_gain`` (AUC difference, MAE gain in percent, added rows).
    """
    with passing(train.sparkSession):
        train, snapshot = (cut_lineage(narrow(df, task, ("project_name",) if not _is_linear(spec) else ())) for df in (train, snapshot))  # read by both holdouts
        more = assembly.augment_train(train, snapshot.filter(F.col("approval_year").isNotNull()), task.label)
        base = external_holdout(train, snapshot, task, cutoffs, spec, written=True)
        variant = external_holdout(more, snapshot, task, cutoffs, spec, experiment="external_augmented", written=True)
    gains = ab_compare(base, variant, ("auc", "auc_linear", "mae", "n_train"))
    gain = F.when(F.col("metric") == "n_train", F.col("variant") - F.col("base")).otherwise(F.col("gain"))
    named = F.when(F.col("metric") == "n_train", F.lit("n_added")).otherwise(F.col("metric"))
    rows = gains.select(F.lit("augment_gain").alias("experiment"), "cutoff", "task", named.alias("metric"), gain.alias("value"))
    return base.unionByName(variant).unionByName(rows.filter("value is not null"))


# --------------------------------------------------------------------------- schedule risk across documents
#: Features beside the plain ones, per variant of the external check.
SCHEDULE_VARIANTS: dict[str, tuple[str, ...]] = {
    "off": (),
    "sch": ("schedule_risk",),
    "px": ("price_esc", "price_level_approval"),
    "sch_px": ("schedule_risk", "price_esc", "price_level_approval"),
    "rev": ("revise_log",),
    "sch_px_rev": ("schedule_risk", "price_esc", "price_level_approval", "revise_log"),
}


def external_schedule_risk(
    train: DataFrame, test: DataFrame, time: DataFrame, cutoffs: Sequence[int], k: int = 5, group: str = "state",
    least: int = MIN_TRAIN_EXTERNAL,
) -> tuple[DataFrame, DataFrame]:
    """Both tables with ``schedule_risk``, a list by cutoff: P(delayed) of a logistic time model of the states of that cutoff's training rows.

    ``train`` and ``test`` are tables of ``_columns``, which carry the state. The states of
    the training rows up to a cutoff are dealt to ``k`` folds by size. A training row is scored by the model of the other folds' states,
    a test row by the model of all of them: its document gave no time row. No row's own delay is seen. A model with fewer than
    ``least`` rows, or rows without one, give the mean of all labels. The models of all cutoffs and folds are fitted in the same scans.
    """
    year, task, cutoffs = F.col("approval_year"), TIME_TASK, list(cutoffs)
    counts = train.filter(F.col(group).isNotNull()).groupBy(group).agg(*[F.count(F.when(year <= c, 1)).alias(f"__n{i}") for i, c in enumerate(cutoffs)])
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("__i"), F.col(f"__n{i}").alias("__n")) for i in range(len(cutoffs))])).alias("e")
    seen = cut_lineage(counts.select(group, each).select(group, "e.*").filter("__n > 0"))  # a row per state and cutoff
    ranked = evaluate.global_rank(seen, [F.col("__i").asc(), F.col("__n").desc(), F.col(group).asc()], "__deal")
    per = {r["__i"]: r["count"] for r in seen.groupBy("__i").count().collect()}
    before = F.lit(0)
    for i in range(len(cutoffs)):
        before = F.when(F.col("__i") == i, F.lit(sum(per.get(j, 0) for j in range(i)))).otherwise(before)
    held = F.pmod(F.col("__deal") - before, F.lit(k))
    codes = tuple(f"__own{i}" for i in range(len(cutoffs)))
    dealt = sized(ranked.groupBy(group).agg(*[F.max(F.when(F.col("__i") == i, held)).cast("int").alias(c) for i, c in enumerate(codes)]))
    rows = _columns(time.filter(F.col(task.label).isNotNull()), task, (), (group,))
    base = rows.agg(F.avg(F.col(task.label).cast("double"))).first()[0]
    base = 0.5 if base is None else float(base)
    # a time row belongs to the models of the folds other than its state's, and to that of all states (-1)
    places = [(i, h) for i in range(len(cutoffs)) for h in range(-1, k)]
    learned = rows.join(dealt, group)
    member = [F.when(F.col(codes[i]).isNotNull() & ((F.lit(h) == -1) | (F.col(codes[i]) != h)), 1.0).otherwise(0.0) for i, h in places]
    layout = splits.Layout(task.inputs, task.rate_groups, codes, len(places), len(places))
    attach = splits.rate_arrays(learned, task.rate_groups, codes, task.label, member)
    packed = splits.pack(attach(learned), layout, task.label, task.target)
    takes = [lambda codes, i=i, h=h: ~np.isnan(codes[i]) & ((h == -1) | (codes[i] != h)) for i, h in places]
    known = splits.facts(packed, layout, takes, True)
    able = [splits.Model(places[s], s, s) for s in sorted(known) if known[s][0] >= least]
    fills = splits.filled(splits.medians(packed, layout, takes, True)[0], layout, PLACES)
    weights = splits.fit_logistic(packed, layout, takes, fills, able) if able else {}
    packed.unpersist()
    fitted = {able[i].key: (able[i].set, b) for i, b in weights.items()}

    def scored(df: DataFrame, own: bool) -> DataFrame:
        there = df.join(dealt, group, "left") if own else df.withColumns({c: F.lit(None).cast("int") for c in codes})
        return splits.chances(attach(there), layout, df.columns, fitted, fills, own, base, "schedule_risk")

    return scored(train, True), scored(test, False)


def external_schedule_check(
    cost: DataFrame, snapshot: DataFrame, time: DataFrame, cutoffs: Sequence[int], prices: DataFrame, reference_year: int = fv.PRICE_REFERENCE_YEAR,
    fx_sectors: Sequence[str] = fv.FX_SECTORS, k: int = 5, least: tuple[int, int] = (MIN_TRAIN_EXTERNAL, MIN_TEST),
) -> DataFrame:
    """Cost models with and without schedule risk, price escalation and the recorded revision, tested on another document.

    ``cost`` (with approval years) trains up to each cutoff, ``snapshot`` gives the next two years, ``time`` the delays that the risk is
    learned from. Metric rows of ``schedule_<variant>``; linear and logistic models of all cutoffs and variants in the same scans.
    """
    task = Task(COST_TASK.name, COST_TASK.label, COST_TASK.target, COST_TASK.rate_groups, tuple(c for c in COST_TASK.inputs if c != "revise_log"))
    more = ("schedule_risk", "price_esc", "price_level_approval", "revise_log")

    inputs = (*task.inputs, *more[1:])

    def ready(df: DataFrame) -> DataFrame:
        read = (*TIME_TASK.rate_groups, *TIME_TASK.inputs, "state")
        df = cut_lineage(narrow(assembly.clean_for_eval(df, task.label), task, read))  # read for the features and for their durations
        return _columns(features.price_escalation(df, prices, reference_year, fx_sectors), task, more[1:], read)

    year, cutoffs = F.col("approval_year"), list(cutoffs)
    with passing(cost.sparkSession):
        prices = cut_lineage(prices)  # a row per year
        tr, te = ready(cost), ready(snapshot)
        sizes = dict(zip(cutoffs, _sizes(tr, [year <= c for c in cutoffs]), strict=True))
        tests = dict(zip(cutoffs, _sizes(te, [year.between(c + 1, c + 2) for c in cutoffs]), strict=True))
        rows = [("schedule_check", c, task.name, m, n[c]) for c in cutoffs for m, n in (("n_train", sizes), ("n_test", tests))]
        fit = [c for c in cutoffs if sizes[c] >= least[0] and tests[c] >= least[1]]
        if fit:
            tr, te = tr.filter(year <= max(fit)), te.filter(year.between(min(fit) + 1, max(fit) + 2))
            time = cut_lineage(narrow(time, TIME_TASK, ("state",)))
            layout = splits.Layout(inputs, task.rate_groups, ("approval_year",), len(fit), len(fit), ("schedule_risk",))
            attach = splits.rate_arrays(tr, task.rate_groups, layout.codes, task.label, [F.when(year <= c, 1.0).otherwise(0.0) for c in fit])
            a, b = (splits.pack(attach(df), layout, task.label, task.target) for df in external_schedule_risk(tr, te, time, fit, k))
            shared = {*task.inputs, *[f"{g}_rate" for g in task.rate_groups]}
            each = [splits.Model((c, v), i, i, frozenset({*shared, *used})) for i, c in enumerate(fit) for v, used in SCHEDULE_VARIANTS.items()]
            learns, later = [_upto(i, fit) for i in range(len(fit))], [_after(i, fit, 2) for i in range(len(fit))]
            for (cutoff, variant), found in splits.measured(a, b, layout, learns, later, each, False, models.MIN_DELAYED_ROWS, defaults=PLACES).items():
                rows += [(f"schedule_{variant}", cutoff, task.name, m, v) for m, v in found.items()]
    return metric_rows(cost.sparkSession, rows)
