"""Delay as censored time to event."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark import RDD
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..plans.ordered import exact_percentiles, null_safe_join, running_totals, scalar_medians
from ..session import cut_lineage, passing
from ..sources.sinks import METRICS_SCHEMA
from . import linear, splits

BUCKET = "period_bucket"


def survival_times(df: DataFrame, snapshot: bool, snap_year: float = fv.VINTAGE_SNAPSHOT) -> DataFrame:
    """Months to the event or to censoring as ``months``, and the event flag.

    An event happens at planned + tor months. Without one, a training row is
    censored at its plan, a snapshot row where it was last seen: from half a year
    into the approval year to the planned completion or the snapshot.
    """
    event = F.coalesce(F.col("delayed") > 0, F.lit(False))
    years = F.col("planned_duration_years")
    planned = F.when(years > 0, years * 12).otherwise(fv.DEFAULT_PLANNED_MONTHS)
    tor = F.coalesce("tor_months", F.lit(0.0)) if "tor_months" in df.columns else F.lit(0.0)
    censor = planned
    if snapshot:
        doc_column = next(c for c in ("original_doc_year", "planned_doc_year") if c in df.columns)
        median = scalar_medians(df, [doc_column])[doc_column]
        df = df.withColumn("__doc", F.coalesce(F.col(doc_column).cast("double"), median, F.lit(fv.DEFAULT_DOC_YEAR)))
        start = F.col("approval_year") + 0.5
        seen = F.greatest(F.least("__doc", F.lit(snap_year)) - start, F.lit(0.0)) * 12
        limit = F.greatest(F.lit(snap_year) - start, F.lit(0.0)) * 12
        censor = F.greatest(F.least(seen, limit), F.lit(fv.MIN_MONTHS))
    months = F.greatest(F.when(event, planned + tor).otherwise(censor), F.lit(fv.MIN_MONTHS))
    return df.withColumns({"months": months.cast("double"), "event": event.cast("int")}).drop("__doc")


def person_period(df: DataFrame, cap: int = fv.PERIOD_CAP) -> DataFrame:
    """One row per subject and year under observation; y = 1 only in an event's last period."""
    rows = df.withColumn("__last", _last_period()).withColumn("period", F.explode(F.sequence(F.lit(1), F.col("__last"))))
    return rows.withColumns(
        {
            BUCKET: F.least("period", F.lit(cap)),
            "y": ((F.col("period") == F.col("__last")) & (F.col("event") == 1)).cast("int"),
        }
    ).drop("__last")


def life_table(df: DataFrame) -> DataFrame:
    """At risk, events and empirical hazard per period.

    Built from one row per distinct (last period, event), so the person-period
    rows are never materialised.
    """
    ends = df.groupBy(_last_period().alias("last")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("event").cast("long")).alias("d"))
    per = ends.withColumn("period", F.explode(F.sequence(F.lit(1), F.col("last"))))
    return per.groupBy("period").agg(
        F.sum("n").alias("at_risk"),
        F.sum(F.when(F.col("period") == F.col("last"), F.col("d")).otherwise(0)).alias("events"),
        (F.sum(F.when(F.col("period") == F.col("last"), F.col("d")).otherwise(0)) / F.sum("n")).alias("hazard"),
    )


# --------------------------------------------------------------------------- hazard model
def _last_period() -> Column:
    return F.least(F.greatest(F.ceil(F.col("months") / 12), F.lit(1)), F.lit(fv.MAX_PERIODS)).cast("int")


def fit_hazards(
    df: DataFrame, by: Sequence[str], features: Sequence[str], cap: int = fv.PERIOD_CAP, c: float = 1.0, steps: int = 50, tolerance: float = 1e-9
) -> dict[tuple, linear.LinearFit]:
    """Discrete-time hazards for every value of ``by``: logistic regressions on features and one-hot periods.

    The fit is that of the person-period rows, of which a subject has up to ``MAX_PERIODS``. All its periods from ``cap`` on have the
    same hazard, so they are one term with their number as weight: a Newton step of all models reads each subject once and sums
    at most ``cap`` terms of it inside the scan, into one Gram matrix per model and bucket. The inputs of a fit are the features, then
    ``__b1`` to ``__b<cap>``. Subjects without a feature, time or event are left out.
    """
    by, features = list(by), list(features)
    known = F.col("months").isNotNull() & F.col("event").isNotNull()
    for name in features:
        known = known & F.col(name).isNotNull() & ~F.isnan(F.col(name).cast("double"))
    rows = df.filter(known)
    keys = [tuple(r) for r in rows.select(*by).distinct().collect()]  # a row per model
    number = F.lit(-1)
    for i, key in enumerate(keys):
        same = F.lit(True)
        for name, value in zip(by, key, strict=True):
            same = same & (F.col(name) == F.lit(value))
        number = F.when(same, i).otherwise(number)
    layout = _layout(features, "__model", len(keys))
    blocks = _packed(rows.withColumn("__model", number), layout)
    found = _fit_hazards(blocks, layout, [lambda codes, i=i: codes[0] == i for i in range(len(keys))], range(len(keys)), cap, c, steps, tolerance)
    blocks.unpersist()
    return {key: found[i] for i, key in enumerate(keys)}


def _layout(features: Sequence[str], code: str, n: int) -> splits.Layout:
    return splits.Layout(tuple(features), (), (code,), n, 1)


def _packed(df: DataFrame, layout: splits.Layout) -> RDD:
    """Subjects packed for the scans of all models, with the event as label and the months as target."""
    return splits.pack(df.withColumn("__rid", F.lit(0)), layout, "event", "months")


def _fit_hazards(
    blocks: RDD, layout: splits.Layout, takes: Sequence[splits.Takes], wanted: Sequence[int], cap: int = fv.PERIOD_CAP, c: float = 1.0, steps: int = 50, tolerance: float = 1e-9
) -> dict[int, linear.LinearFit]:
    """Hazards of the wanted splits by number, over packed subjects; see ``fit_hazards``."""
    p = len(layout.raw)
    size, width, low = p + cap + 1, linear._width(p + 1), np.tril_indices(p + 1)
    fill = np.zeros(p)

    def sums(places: dict[tuple, np.ndarray]) -> dict[tuple, tuple[np.ndarray, np.ndarray, float, float]]:
        def of(rows: splits.Rows) -> dict[int, np.ndarray]:
            out = {}
            for (i,), b in places.items():
                at = takes[i](rows.codes)
                if not at.any():
                    continue
                taken = rows.taken(at)
                last = np.clip(np.ceil(taken.rest[1] / 12), 1, fv.MAX_PERIODS)
                order = np.argsort(-last, kind="stable")  # the subjects of a period come first
                x, last, event = taken.inputs(0, 0, fill)[:, order], last[order], taken.rest[0][order]
                own, plain = np.minimum(last, cap), np.append(b[:p], b[-1]) @ x
                found = np.zeros((cap, width))
                for bucket in range(1, cap + 1):
                    n = int(np.searchsorted(-own, -bucket, side="right"))  # subjects that reach it
                    if not n:
                        break
                    eta, z = plain[:n] + b[p + bucket - 1], x[:, :n]
                    times = last[:n] - (cap - 1) if bucket == cap else 1.0
                    ended = event[:n] * (own[:n] == bucket)
                    small = np.exp(-np.abs(eta))
                    whole = 1 + small
                    prob = np.where(eta >= 0, 1.0, small) / whole
                    loss = times * (np.maximum(eta, 0) + np.log1p(small)) - ended * eta
                    found[bucket - 1] = np.concatenate([((z * (times * small / (whole * whole))) @ z.T)[low], z @ (times * prob - ended), [loss.sum(), n]])
                out[i] = found.ravel()
            return out

        out = {}
        place = [*range(p), size - 1]  # of the features and the intercept
        for i, found in splits._scan(blocks, layout, of).items():
            whole, slope, value, n = np.zeros((size, size)), np.zeros(size), 0.0, 0.0
            for bucket, v in enumerate(found.reshape(cap, width), 1):
                gram, against, loss, terms = linear._unpacked(v, p + 1)
                own = p + bucket - 1
                whole[np.ix_(place, place)] += gram
                whole[own, place], whole[place, own], whole[own, own] = gram[-1], gram[-1], gram[-1, -1]
                slope[place] += against
                slope[own] = against[-1]
                value, n = value + loss, n + terms
            out[i,] = whole, slope, value, n
        return out

    at = linear.newton([(i,) for i in wanted], np.append(np.full(size - 1, 1 / c), 0.0), sums, steps, tolerance)
    inputs = (*layout.raw, *[f"__b{b}" for b in range(1, cap + 1)])
    return {i: linear.LinearFit(inputs, tuple(map(float, b[:-1])), float(b[-1]), True) for (i,), b in at.items()}


def fit_hazard(df: DataFrame, features: Sequence[str], cap: int = fv.PERIOD_CAP) -> linear.LinearFit:
    """One discrete-time hazard of all rows; see ``fit_hazards``."""
    return fit_hazards(df.withColumn("__all", F.lit(1)), ["__all"], features, cap).get((1,)) or linear.LinearFit(
        (*features, *[f"__b{b}" for b in range(1, cap + 1)]), (0.0,) * (len(features) + cap), 0.0, True
    )


def bucket_hazards(df: DataFrame, model: linear.LinearFit, cap: int = fv.PERIOD_CAP) -> DataFrame:
    """Hazards of buckets 1..cap as an array column, one row per subject.

    The fitted logistic is linear, so the bucket terms are added to one linear
    predictor per subject instead of scoring every subject ``cap`` times.
    """
    features = [c for c in model.inputs if not c.startswith("__b")]
    eta = F.lit(model.intercept)
    for name, weight in zip(features, model.coefficients, strict=False):
        eta = eta + F.col(name).cast("double") * F.lit(weight)
    steps = [F.lit(w) for w in model.coefficients[len(features) :]]
    hazards = F.transform(
        F.array(*steps), lambda s: F.least(F.greatest(1 / (1 + F.exp(-(F.col("__eta") + s))), F.lit(1e-9)), F.lit(1 - 1e-9))
    )
    return df.withColumn("__eta", eta).withColumn("hazards", hazards).drop("__eta")


def survival_risk(hazards: Column, months: Column, cap: int = fv.PERIOD_CAP) -> Column:
    """P(delayed within ``months``): one minus the product of (1 - h); the last bucket repeats past ``cap``."""
    k = F.greatest(F.ceil(months / 12), F.lit(0)).cast("int")
    inside = F.aggregate(
        F.slice(hazards, F.lit(1), F.least(k, F.lit(cap))), F.lit(0.0), lambda acc, h: acc + F.log1p(-h)
    )
    beyond = F.greatest(k - cap, F.lit(0)) * F.log1p(-F.element_at(hazards, cap))
    return F.when(months.isNotNull(), 1 - F.exp(inside + beyond))


def baseline_hazard(train: DataFrame, model: linear.LinearFit, cap: int = fv.PERIOD_CAP) -> DataFrame:
    """Hazard per bucket at the median of every feature."""
    features = [c for c in model.inputs if not c.startswith("__b")]
    medians = scalar_medians(train, features)
    one = train.agg(F.count(F.lit(1)).alias("n")).select(*[medians[c].alias(c) for c in features])
    return bucket_hazards(one, model, cap).select(F.posexplode("hazards").alias("i", "hazard")).select(
        (F.col("i") + 1).alias("bucket"), "hazard"
    )


# --------------------------------------------------------------------------- concordance
def c_index(df: DataFrame, months: str = "months", event: str = "event", risk: str = "risk", by: Sequence[str] = ()) -> DataFrame:
    """Harrell's concordance, exact, without pairing rows; with ``by`` that of every group, in the same scans.

    Equal times count only between two events with different risks, at one half.
    For unequal times the shorter one must be an event: concordant if its risk
    is higher, one half if equal.

    Rows collapse to counts per (time, risk). Times get dense ranks, and every
    pair of different ranks is separated at exactly one bit level of the rank:
    there both share a node and the earlier one lies on side 0. Within each
    (level, node) a running total over risk counts the concordant pairs. That is
    log2(distinct times) copies of the collapsed counts and no join of rows with rows.
    """
    by = list(by)
    cells = cut_lineage(
        df.filter(F.col(months).isNotNull() & F.col(risk).isNotNull())
        .groupBy(*by, F.col(months).cast("double").alias("t"), F.col(risk).cast("double").alias("r"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(event).cast("long")).alias("e"))
    )
    times = cells.groupBy(*by, "t").agg(F.sum("n").alias("n"), F.sum("e").alias("e"), F.sum(F.col("e").cast("double") * F.col("e")).alias("ee"))
    ranked = cut_lineage(running_totals(times.withColumn("one", F.lit(1)), "t", ["one", "n"], by))
    # usable pairs: events with anyone later, and event pairs of one time with different risks
    e = F.col("e").cast("double")
    pairs = ranked.groupBy(*by).agg(
        F.sum(e * (F.col("n_total") - F.col("n_before") - F.col("n"))).alias("ordered"),
        F.sum((e * e - F.col("ee")) / 2).alias("tied"),
    )
    ranks = ranked.select(*[F.col(k).alias(f"__{k}") for k in by], F.col("t").alias("__t"), F.col("one_before").alias("rank"), F.col("one_total").alias("size"))
    levels = F.sequence(F.lit(0), F.greatest(F.ceil(F.log2(F.greatest(F.col("size"), F.lit(2)).cast("double"))), F.lit(1)).cast("int") - 1)
    same = F.col("t") == F.col("__t")
    for k in by:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    placed = cells.join(ranks, same).withColumn("level", F.explode(levels))
    bit = F.expr("shiftright(rank, level)")
    nodes = (
        placed.withColumn("side", bit % 2)
        .groupBy(*by, "level", F.floor(bit / 2).alias("node"), "r")
        .agg(
            F.sum(F.when(F.col("side") == 0, F.col("e")).otherwise(0)).alias("early"),
            F.sum(F.when(F.col("side") == 1, F.col("n")).otherwise(0)).alias("late"),
            F.sum("n").alias("rows"),
        )
    )
    scanned = running_totals(nodes, "r", ["rows", "late"], [*by, "level", "node"])
    won = F.sum(F.col("early").cast("double") * (F.col("late_before").cast("double") + F.col("late").cast("double") / 2)).alias("wins")
    if by:
        summary = null_safe_join(pairs, scanned.groupBy(*by).agg(won), by, "left")
    else:
        summary = pairs.withColumn("wins", scanned.agg(won).scalar())
    usable = F.coalesce(F.col("ordered"), F.lit(0.0)) + F.coalesce(F.col("tied"), F.lit(0.0))
    concordant = F.coalesce("wins", F.lit(0.0)) + 0.5 * F.coalesce(F.col("tied"), F.lit(0.0))
    return summary.select(*by, F.when(usable > 0, concordant / usable).alias("c_index"), usable.alias("usable_pairs"))


def survival_report(
    train: DataFrame,
    test: DataFrame,
    features: Sequence[str],
    cutoffs: Sequence[int],
    snap_year: float = fv.VINTAGE_SNAPSHOT,
    horizon_months: float = 60.0,
    least: tuple[int, int] = (100, 30),
) -> DataFrame:
    """Metric rows per cutoff: sizes, censored share, median follow-up, C-index of the hazard and binary models, and both AUCs.

    ``train`` and ``test`` carry the features, dates and labels of both documents; the binary model sees the same features.
    The models of all cutoffs are fitted in the same scans. A cutoff with fewer rows than ``least`` gives sizes alone.
    """
    from .evaluate import auc

    spark, features = train.sparkSession, list(features)
    with passing(spark):
        year, cutoffs = F.col("approval_year"), [int(c) for c in cutoffs]
        timed = survival_times(train, False).select(*features, "approval_year", "months", "event").dropna(subset=features)
        layout = _layout(features, "approval_year", len(cutoffs))
        learns = [lambda codes, c=c: codes[0] <= c for c in cutoffs]
        blocks = _packed(timed.filter(year <= max(cutoffs)), layout)
        found = splits.facts(blocks, layout, learns, False)
        sizes = {c: int(found[i][0]) if i in found else 0 for i, c in enumerate(cutoffs)}
        kept = [c for c in ("original_doc_year", "planned_doc_year") if c in test.columns][:1]
        read = dict.fromkeys([*features, *kept, "approval_year", "planned_duration_years", "delayed", *(["tor_months"] if "tor_months" in test.columns else [])])
        later = cut_lineage(test.dropna(subset=features).filter(year.between(min(cutoffs) + 1, max(cutoffs) + 2)).select(*read))
        counts = later.agg(*[F.count(F.when(year.between(c + 1, c + 2), 1)) for c in cutoffs]).first()
        tests = dict(zip(cutoffs, counts, strict=True))
        rows = [("survival", c, "time", m, float(n)) for c in cutoffs for m, n in (("n_train", sizes[c]), ("n_test", tests[c]))]
        fit = [i for i, c in enumerate(cutoffs) if sizes[c] >= least[0] and tests[c] >= least[1]]
        if fit:
            hazards = _fit_hazards(blocks, layout, learns, fit)
            each = [splits.Model((i,), i, 0) for i in fit]
            weights = splits.fit_logistic(blocks, layout, learns, np.zeros((len(cutoffs), len(features))), each)
            binaries = {fit[j]: linear.LinearFit(tuple(features), tuple(map(float, b[:-1])), float(b[-1]), True) for j, b in weights.items()}
        blocks.unpersist()
        scored = None
        for i in fit:
            c = cutoffs[i]
            te = survival_times(later.filter(year.between(c + 1, c + 2)), True, snap_year)
            planned = scalar_medians(te, ["planned_duration_years"])["planned_duration_years"]
            part = bucket_hazards(te, hazards[i]).withColumn("__plan", F.coalesce("planned_duration_years", planned) * 12).select(
                F.lit(c).alias("cutoff"),
                "months",
                "event",
                survival_risk(F.col("hazards"), F.lit(horizon_months)).alias("risk"),
                survival_risk(F.col("hazards"), F.col("__plan")).alias("risk_plan"),
                binaries[i].predict().alias("risk_binary"),
            )
            scored = part if scored is None else scored.unionByName(part)
        if scored is not None:
            # Several metrics read the scored rows: written once, so every metric plan starts from a plain scan. Those of all cutoffs are taken together.
            scored = cut_lineage(scored)
            rates = {r["cutoff"]: r["rate"] for r in scored.groupBy("cutoff").agg(F.avg("event").alias("rate")).collect()}
            median = {r["cutoff"]: r["value"] for r in exact_percentiles(scored, ["months"], by=["cutoff"]).collect()}
            kinds = [("c_index", F.col("risk")), ("c_index_events", F.when(F.col("event") == 1, F.col("risk"))), ("c_index_binary", F.col("risk_binary"))]
            pairs = scored.select("cutoff", "months", "event", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("risk")) for k, v in kinds])).alias("k")).select("cutoff", "months", "event", "k.*")
            told = {(r["cutoff"], r["kind"]): r["c_index"] for r in c_index(pairs, by=["cutoff", "kind"]).collect()}
            kinds = [("auc_hazard", F.col("risk_plan")), ("auc_binary", F.col("risk_binary"))]
            ranks = scored.select("cutoff", "event", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("risk")) for k, v in kinds])).alias("k")).select("cutoff", "event", "k.*")
            told |= {(r["cutoff"], r["kind"]): r["auc"] for r in auc(ranks, "risk", "event", ["cutoff", "kind"]).collect()}
            for c in (cutoffs[i] for i in fit):
                values = {"event_rate": rates[c], "censored_share": 1 - rates[c], "median_followup_months": median.get(c)}
                values |= {k: told.get((c, k)) for k in ("c_index", "c_index_events", "c_index_binary", "auc_hazard", "auc_binary")}
                rows += [("survival", c, "time", m, v) for m, v in values.items()]
    return spark.createDataFrame(rows, METRICS_SCHEMA)
