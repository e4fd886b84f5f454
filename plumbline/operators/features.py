"""Leak-free features and scores. Projections, small aggregates and N:1 joins only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.text import extract_agency, strip
from ..plans.ordered import scalar_medians
from ..session import sized


def _floor0(name: str) -> Column:
    """Value with a floor of 0; NULL stays NULL (greatest would skip it)."""
    return F.when(F.col(name) < 0, F.lit(0.0)).otherwise(F.col(name))


def _spent() -> Column:
    return F.greatest(F.coalesce("expenditure_cum_cr", F.lit(0.0)), F.lit(0.0))


def _clip(c: Column, low: float, high: float) -> Column:
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(low)), F.lit(high)))


def base_cost_features(df: DataFrame) -> DataFrame:
    orig, spent = _floor0("original_cost_cr"), _spent()
    return df.withColumns(
        {
            "log_original_cost": F.log1p(orig),
            "expenditure_ratio": F.when(orig.isNotNull(), spent / F.greatest(orig, F.lit(1e-9))),
            "log_expenditure": F.log1p(spent),
        }
    )


def snap_vintage(df: DataFrame, snap_year: float | None = None, per_row: bool = True) -> DataFrame:
    """Measurement vintage: forced, per row (snapshot rows carry original_doc_year), or one for the frame."""
    if "snap_year" in df.columns and snap_year is None:
        return df
    if snap_year is not None:
        return df.withColumn("snap_year", F.lit(float(snap_year)))
    if "original_doc_year" not in df.columns:
        return df.withColumn("snap_year", F.lit(fv.VINTAGE_ANNEXURE))
    seen = F.col("original_doc_year").isNotNull()
    if not per_row:
        seen = df.agg(F.count("original_doc_year").alias("n")).scalar() > 0
    return df.withColumn("snap_year", F.when(seen, F.lit(fv.VINTAGE_SNAPSHOT)).otherwise(F.lit(fv.VINTAGE_ANNEXURE)))


def pace_features(df: DataFrame, snap_year: float | None = None, year_fallback: bool = True) -> DataFrame:
    """elapsed_share and spend_pace.

    The planned completion year stands in for the duration only when the whole
    duration column is empty (a scalar subquery decides); a stream has no whole
    column and switches this off.
    """
    if "approval_year" not in df.columns:
        return df.withColumns({"elapsed_share": F.lit(None).cast("double"), "spend_pace": F.lit(None).cast("double")})
    df = snap_vintage(df, snap_year)
    fallback = next((c for c in ("planned_doc_year", "original_doc_year") if c in df.columns), None)
    by_year = F.col(fallback) - F.col("approval_year") if fallback else F.lit(None)
    if "planned_duration_years" in df.columns and not year_fallback:
        dur = F.col("planned_duration_years")
    elif "planned_duration_years" in df.columns:
        filled = df.agg(F.count("planned_duration_years").alias("n")).scalar()
        dur = F.when(filled > 0, F.col("planned_duration_years")).otherwise(by_year)
    else:
        dur = by_year
    dur = dur.cast("double")
    elapsed = F.col("snap_year") - F.col("approval_year")
    share = F.when(
        (dur > 0) & elapsed.isNotNull(),
        _clip(elapsed / F.greatest(dur, F.lit(fv.MIN_DURATION_YEARS)), 0.0, fv.MAX_ELAPSED_SHARE),
    )
    ratio = F.when(
        F.col("original_cost_cr").isNotNull(), _spent() / F.greatest(_floor0("original_cost_cr"), F.lit(1e-9))
    )
    shared = df.withColumn("elapsed_share", share)
    pace = _clip(ratio / F.greatest("elapsed_share", F.lit(fv.MIN_ELAPSED_SHARE)), 0.0, fv.MAX_SPEND_PACE)
    return shared.withColumn("spend_pace", F.when(F.col("elapsed_share").isNotNull(), pace))


def median_impute(
    df: DataFrame, columns: Sequence[str], train: DataFrame | None = None, defaults: dict[str, float] | None = None
) -> DataFrame:
    """Fill with medians of ``train`` (default: ``df``), then with a default."""
    defaults = {"elapsed_share": fv.DEFAULT_ELAPSED_SHARE, "spend_pace": fv.DEFAULT_SPEND_PACE, **(defaults or {})}
    medians = scalar_medians(df if train is None else train, columns)
    return df.withColumns({c: F.coalesce(F.col(c), medians[c], F.lit(defaults.get(c, 0.0))) for c in columns})


def price_escalation(
    df: DataFrame,
    prices: DataFrame,
    reference_year: int = fv.PRICE_REFERENCE_YEAR,
    fx_sectors: Sequence[str] = fv.FX_SECTORS,
) -> DataFrame:
    """price_esc = ln(index at reference / index at approval), price_level_approval = ln(index at approval)."""
    index = prices.select(
        F.col("year").alias("__year"),
        F.col("fx_usd").alias("__fx"),
        (0.5 * (F.col("wpi_metal") + F.col("wpi_cement"))).alias("__works"),
    )
    # One row per year is a key, so the reference row is a scalar.
    ref = index.filter(F.col("__year") == reference_year).agg(
        F.struct(F.max("__fx").alias("fx"), F.max("__works").alias("works")).alias("r")
    )
    uses_fx = F.upper(F.trim("sector")).isin(*fx_sectors)
    joined = df.withColumn("__ref", ref.scalar()).join(
        sized(index), F.col("approval_year").cast("int") == F.col("__year"), "left"
    )
    at = F.when(uses_fx, F.col("__fx")).otherwise(F.col("__works"))
    ref_at = F.when(uses_fx, F.col("__ref.fx")).otherwise(F.col("__ref.works"))
    known = (at > 0) & ref_at.isNotNull()
    return joined.withColumns(
        {
            "price_esc": F.when(known, F.log(ref_at / at)),
            "price_level_approval": F.when(known, F.log(at)),
        }
    ).drop("__year", "__fx", "__works", "__ref")


def revise_log(df: DataFrame) -> DataFrame:
    orig = _floor0("original_cost_cr")
    rev = F.coalesce(F.col("revised_cost_cr"), orig)
    gain = F.when(rev > orig, rev - orig).otherwise(F.when(orig.isNotNull(), F.lit(0.0)))
    return df.withColumn("revise_log", F.log1p(gain / F.greatest(orig, F.lit(1e-9))))


# --------------------------------------------------------------------------- target encoders
def oof_target_rate(
    df: DataFrame,
    group: str,
    target: str,
    fold: str = "fold",
    m: float = fv.SMOOTHING_M,
    output: str | None = None,
) -> DataFrame:
    """Out-of-fold m-estimate of ``target`` per ``group`` without a loop over folds.

    Sums per (group, fold) are taken once with map-side combine; what the other
    folds hold is the group total less the own fold. A group that the other
    folds do not know, and a NULL group, gets their overall mean.
    """
    output = output or f"{group}_rate"
    y = F.col(target).cast("double")
    cells = df.filter(y.isNotNull()).groupBy(group, fold).agg(F.sum(y).alias("s"), F.count(y).alias("n"))
    per_fold = cells.groupBy(fold).agg(F.sum("s").alias("fs"), F.sum("n").alias("fn"))
    # the folds' means are one small map, taken once, so the rows are joined a single time
    folds = F.collect_list(F.struct(F.col(fold).alias("f"), "fs", "fn"))
    sums = per_fold.agg(folds.alias("e"), F.sum("fs").alias("ts"), F.sum("fn").alias("tn"))
    known = F.filter("e", lambda x: x.f.isNotNull() & (F.col("tn") > x.fn))
    overall = sums.select(F.map_from_entries(F.transform(known, lambda x: F.struct(x.f, (F.col("ts") - x.fs) / (F.col("tn") - x.fn)))))
    known_group = cells.filter(F.col(group).isNotNull())
    totals = known_group.groupBy(group).agg(F.sum("s").alias("ts"), F.sum("n").alias("tn"))
    others = known_group.join(totals, group).select(
        F.col(group).alias("__g"),
        F.col(fold).alias("__f"),
        (F.col("ts") - F.col("s")).alias("__s"),
        (F.col("tn") - F.col("n")).alias("__n"),
    )
    joined = df.join(sized(others), (F.col(group) == F.col("__g")) & (F.col(fold) == F.col("__f")), "left").withColumn(
        "__overall", F.try_element_at(overall.scalar(), F.col(fold))
    )
    weight = F.coalesce("__n", F.lit(0)) + F.lit(float(m))
    rate = F.when(
        (F.coalesce("__n", F.lit(0)) > 0) & (weight > 0), (F.col("__s") + F.lit(float(m)) * F.col("__overall")) / weight
    ).otherwise(F.col("__overall"))
    return joined.withColumn(output, rate).drop("__g", "__f", "__s", "__n", "__overall")


def oof_mean(df: DataFrame, group: str, target: str, fold: str = "fold", output: str | None = None) -> DataFrame:
    return oof_target_rate(df, group, target, fold, 0.0, output)


def rate_map(df: DataFrame, group: str, target: str, m: float = fv.SMOOTHING_M) -> DataFrame:
    """Full-table smoothed rate per group: group, rate, overall."""
    y = F.col(target).cast("double")
    cells = df.filter(y.isNotNull()).groupBy(group).agg(F.sum(y).alias("s"), F.count(y).alias("n"))
    overall = cells.agg((F.sum("s") / F.sum("n")).alias("overall")).scalar()
    return (
        cells.withColumn("overall", overall)
        .select(group, ((F.col("s") + m * F.col("overall")) / (F.col("n") + m)).alias("rate"), "overall")
    )


def apply_rate(df: DataFrame, rates: DataFrame, group: str, output: str) -> DataFrame:
    """Attach the rate; an unknown group takes the base rate."""
    base = rates.agg(F.max("overall").alias("o")).scalar()
    lookup = rates.select(F.col(group).alias("__g"), F.col("rate").alias("__rate"))
    return (
        df.join(sized(lookup), F.col(group) == F.col("__g"), "left")
        .withColumn("__base", base)
        .withColumn(output, F.coalesce("__rate", "__base"))
        .drop("__g", "__rate", "__base")
    )


def train_rate(
    train: DataFrame,
    group: str,
    target: str,
    cutoff: int,
    mode: str = "full",
    m: float = fv.SMOOTHING_M,
    year: str = "approval_year",
    half_life: float = fv.RECENCY_HALF_LIFE,
    window: int = fv.ROLLING_WINDOW_YEARS,
) -> DataFrame:
    """Smoothed rate from training rows only: group, rate, overall.

    ``full`` weighs rows equally, ``decay`` halves the weight every ``half_life``
    years before the cutoff, ``rolling`` keeps the last ``window`` years (all
    rows if that leaves none). A group whose weights sum to zero enters with its
    plain mean, at weight zero.
    """
    y = F.col(target).cast("double")
    if mode == "full":
        weight = F.lit(1.0)
    elif mode == "decay":
        weight = F.exp(-F.log(F.lit(2.0)) * F.greatest(F.lit(cutoff) - F.col(year), F.lit(0)) / half_life)
    elif mode == "rolling":
        recent = F.col(year) >= cutoff - window
        # known before the plan: as a subquery it would stand inside that of the overall rate, which cannot be compiled
        weight = F.lit(1.0) if train.filter(recent).isEmpty() else F.when(recent, 1.0).otherwise(0.0)
    else:
        raise ValueError(f"unknown encoding mode: {mode}")
    rows = train.filter(y.isNotNull())
    cells = rows.withColumn("__w", weight).groupBy(group).agg(
        F.sum(F.col("__w") * y).alias("wy"), F.sum("__w").alias("w"), F.avg(y).alias("plain")
    )
    overall = cells.agg((F.sum("wy") / F.sum("w")).alias("o")).scalar()
    mean = F.when(F.col("w") > 1e-12, F.col("wy") / F.col("w")).otherwise(F.col("plain"))
    return cells.withColumn("overall", overall).select(
        group, ((mean * F.col("w") + m * F.col("overall")) / (F.col("w") + m)).alias("rate"), "overall"
    )


def agency_column(df: DataFrame, output: str = "agency") -> DataFrame:
    """Agency parsed from the name; NULL when the name has no tail."""
    return df.withColumn(output, extract_agency(F.col("project_name")))


def agency_rate(df: DataFrame, target: str, fold: str = "fold", output: str = "agency_rate") -> DataFrame:
    """Out-of-fold rate per parsed agency; rows without one get the fold mean."""
    parsed = df.withColumn("__agency", extract_agency(F.col("project_name")))
    return oof_target_rate(parsed, "__agency", target, fold, output=output).drop("__agency")


# --------------------------------------------------------------------------- small projections
def ratio_buckets(df: DataFrame, ratio: str = "expenditure_ratio") -> DataFrame:
    """Right-closed buckets at 0.2, 0.5, 1 and 2, one-hot."""
    edges = [("lt20pct", None, 0.2), ("20to50", 0.2, 0.5), ("50to100", 0.5, 1.0), ("100to200", 1.0, 2.0), ("gt200", 2.0, None)]
    out = {}
    for name, low, high in edges:
        hit = F.lit(True)
        if low is not None:
            hit = hit & (F.col(ratio) > low)
        if high is not None:
            hit = hit & (F.col(ratio) <= high)
        out[f"expb_{name}"] = F.coalesce(hit & F.col(ratio).isNotNull(), F.lit(False)).cast("int")
    return df.withColumns(out)


def interactions(df: DataFrame, rate: str = "sector_rate") -> DataFrame:
    return df.withColumns(
        {
            "exp_x_sector": F.col("expenditure_ratio") * F.col(rate),
            "exp_x_logcost": F.col("expenditure_ratio") * F.col("log_original_cost"),
        }
    )


def observation_window_age(df: DataFrame, current_year: int = fv.CURRENT_YEAR) -> DataFrame:
    """Diagnostic only: how long a project could have been observed. Never a served feature."""
    median = scalar_medians(df, ["approval_year"])["approval_year"]
    return df.withColumn("observation_age", F.lit(current_year) - F.coalesce(F.col("approval_year").cast("double"), median))


def shifted_log_target(df: DataFrame, target: str, output: str = "log_target", shift: str = "target_shift") -> DataFrame:
    """log1p(y + shift) with shift = max(0, -min) + 1 as a column for the inverse."""
    low = df.agg(F.min(target).alias("m")).scalar()
    return df.withColumn(shift, F.greatest(F.lit(0.0), -low) + 1.0).withColumn(
        output, F.log1p(F.col(target) + F.col(shift))
    )


def inverse_shifted_log(pred: Column, shift: Column) -> Column:
    return F.expm1(pred) - shift


def capped_log_months(c: Column) -> Column:
    return F.log1p(F.least(c, F.lit(fv.TOR_CAP_MONTHS)))


# --------------------------------------------------------------------------- scores and text
def _expenditure_share() -> Column:
    orig = F.coalesce("original_cost_cr", F.lit(0.0))
    return F.when(orig > 0, F.coalesce("expenditure_cum_cr", F.lit(0.0)) / orig).otherwise(0.0)


def _cost_score() -> Column:
    pct = F.coalesce("cost_overrun_pct", F.lit(0.0))
    return F.bround(0.7 * _clip(pct / 200.0, 0.0, 1.0) + 0.3 * _clip((_expenditure_share() - 0.5) / 2.0, 0.0, 1.0), 2)


def _delayed() -> Column:
    return F.coalesce(F.col("delayed").cast("int"), F.lit(0)) != 0


def risk_scores(df: DataFrame) -> DataFrame:
    """cost_risk and delay_risk; a table without tor_months gets the floor delay risk."""
    if "tor_months" in df.columns:
        tor = F.when(_delayed(), F.coalesce("tor_months", F.lit(0.0))).otherwise(0.0)
        delay = F.bround(F.least(F.lit(1.0), tor / 60.0), 2)
    else:
        delay = F.lit(0.05)
    return df.withColumns({"cost_risk": _cost_score(), "delay_risk": delay})


def risk_scores_alt(df: DataFrame) -> DataFrame:
    """Variant used for the explanation data set: delay blends overrun and shortness of the plan."""
    if "tor_months" in df.columns:
        planned = F.col("planned_duration_years")
        planned = F.when(planned.isNull() | (planned == 0), F.lit(fv.DEFAULT_DURATION_YEARS)).otherwise(planned)
        late = F.least(F.lit(1.0), F.coalesce("tor_months", F.lit(0.0)) / 60.0)
        delay = F.bround(F.least(F.lit(1.0), 0.6 * late + 0.4 * _clip(1.0 - planned / 10.0, 0.0, 1.0)), 2)
    else:
        delay = F.lit(0.0)
    return df.withColumns({"cost_risk": _cost_score(), "delay_risk": delay})


def risk_tier(score: Column) -> Column:
    tier = None
    for floor, name in fv.TIERS:
        tier = F.when(score >= floor, name) if tier is None else tier.when(score >= floor, name)
    return tier.otherwise(fv.LOWEST_TIER)


def reason_text(df: DataFrame) -> Column:
    """The recorded reason unless it is a filler word, else one composed from the numbers."""
    raw = strip(F.coalesce("reasons", F.lit("")))
    usable = (raw != "") & ~F.lower(raw).isin(*fv.JUNK_REASONS)
    tor = F.coalesce("tor_months", F.lit(0.0)) if "tor_months" in df.columns else F.lit(0.0)
    late = _delayed() if "delayed" in df.columns else F.lit(False)
    pct = F.coalesce("cost_overrun_pct", F.lit(0.0))
    months = F.format_string("%.0f", tor)
    percent = F.format_string("%.1f", pct)
    delay_part = F.when(late & (tor >= 60), F.concat(F.lit("time overrun of "), months, F.lit(" months, far beyond the sanctioned duration")))
    delay_part = delay_part.when(
        late & (tor >= 24), F.concat(F.lit("time overrun of "), months, F.lit(" months against the sanctioned schedule"))
    ).when(late & (tor > 0), F.concat(F.lit("time slippage of "), months, F.lit(" months")))
    cost_part = F.when(
        pct > 20, F.concat(F.lit("cost overrun of "), percent, F.lit("% above the original sanctioned cost"))
    ).when(pct > 5, F.concat(F.lit("modest cost escalation of "), percent, F.lit("% over the original cost")))
    slow_part = F.when(late & (_expenditure_share() < 0.3), F.lit("slow physical/financial progress (low expenditure vs scope)"))
    parts = F.concat_ws("; ", delay_part, cost_part, slow_part)
    composed = F.when(parts == "", F.lit("no material cost or time overrun reported to date")).otherwise(parts)
    return F.when(usable, raw).otherwise(F.concat(composed, F.lit(".")))


def _crore(c: Column) -> Column:
    return F.when(c.isNull(), F.lit("n/a")).otherwise(F.concat(F.lit("₹"), F.format_number(c, 1), F.lit(" Cr")))


def risk_narrative(df: DataFrame) -> Column:
    """One explanation sentence set per row; needs cost_risk, delay_risk and reason columns."""
    pct = F.coalesce("cost_overrun_pct", F.lit(0.0))
    share = F.bround(_expenditure_share(), 3)
    spent = F.coalesce("expenditure_cum_cr", F.lit(0.0))
    tor = F.coalesce("tor_months", F.lit(0.0)) if "tor_months" in df.columns else F.lit(0.0)
    cost, delay = F.col("cost_risk"), F.col("delay_risk")
    head = F.concat(F.lit("**"), F.col("project_name"), F.lit("** ("), F.coalesce("sector", F.lit("Unknown")), F.lit(")."))
    ant = F.col("anticipated_cost_cr")
    budget = F.concat(
        F.lit("Original cost "), _crore(F.coalesce("original_cost_cr", F.lit(0.0))),
        F.lit("; estimated (anticipated) cost "), _crore(F.when(ant != 0, ant)),
        F.lit("; expenditure so far "), _crore(spent), F.lit(" ("),
        F.when(share != 0, F.format_string("%.1f%%", share * 100)).otherwise(F.lit("n/a")), F.lit(" of original)."),
    )
    months = F.when(tor != 0, F.format_string("%.1f", tor)).otherwise(F.lit("None"))
    delay_part = F.when(
        delay > 0.05, F.concat(F.lit("Rated "), risk_tier(delay), F.lit(" **delay risk** (TOR ~"), months, F.lit(" months)."))
    )
    cost_part = F.when(
        (cost > 0.25) | (pct != 0),
        F.concat(
            risk_tier(cost), F.lit(" **cost risk**, driven by a cost overrun of **"),
            F.format_string("%.1f", pct), F.lit("%** over the original budget."),
        ),
    ).otherwise(F.lit("Currently **low cost risk** with no material cost overrun."))
    return F.concat_ws(
        " ",
        head,
        budget,
        delay_part,
        cost_part,
        F.concat(F.lit("Noted causes: "), reason_text(df), F.lit(".")),
        F.lit("Recommended action: re-baseline the flagged milestone and escalate if the exposure persists beyond one review cycle."),
    )


def portfolio_view(df: DataFrame) -> DataFrame:
    """Scores, tiers and reason per project: what the portfolio questions read."""
    scored = risk_scores(df)
    return scored.withColumns(
        {
            "cost_tier": risk_tier(F.col("cost_risk")),
            "delay_tier": risk_tier(F.col("delay_risk")),
            "explanation": reason_text(df),
        }
    )


def instruction_dataset(
    time: DataFrame, cost: DataFrame, per_source: int | None = None, order: Sequence[str] = ("project_name",)
) -> DataFrame:
    """Explanation examples (instruction, JSON input, text output) from delayed, cost and on-time rows.

    The cause of a risky row is chosen by a hash of its input, so reruns agree.
    ``per_source`` is the documented size of the sample (half of it for the last two sources).
    """

    def limited(df: DataFrame, n: int | None) -> DataFrame:
        return df if n is None else df.orderBy(*order).limit(n)

    half = None if per_source is None else per_source // 2
    delayed = risk_scores_alt(limited(time.filter("delayed = 1"), per_source)).withColumn("kind", F.lit("delayed"))
    on_time = (
        risk_scores_alt(limited(time.filter("delayed = 0"), half))
        .withColumns({"delay_risk": F.lit(0.05), "cost_overrun_pct": F.lit(0.0)})
        .withColumn("kind", F.lit("on_time"))
    )
    costs = risk_scores_alt(limited(cost.drop("tor_months"), half)).withColumn("kind", F.lit("cost"))
    tall = None
    for part in (delayed, costs, on_time):
        part = part.select(
            F.coalesce("sector", F.lit("Unknown")).alias("sector"),
            F.coalesce(F.col("cost_overrun_pct").cast("double"), F.lit(0.0)).alias("cost_overrun_pct"),
            F.bround(_expenditure_share(), 3).alias("expenditure_ratio"),
            F.col("cost_risk").cast("double").alias("cost_risk"),
            F.col("delay_risk").cast("double").alias("delay_risk"),
            "kind",
        )
        tall = part if tall is None else tall.unionByName(part)
    record = F.to_json(F.struct("cost_overrun_pct", "cost_risk", "delay_risk", "expenditure_ratio", "sector"))
    tall = tall.withColumn("input", record)
    causes = F.array(*[F.lit(c) for c in fv.HIGH_RISK_CAUSES])
    drawn = F.get(causes, F.pmod(F.xxhash64("input"), F.lit(len(fv.HIGH_RISK_CAUSES))).cast("int"))
    calm = (F.col("kind") == "on_time") | ((F.col("kind") == "cost") & (F.col("cost_risk") < 0.25))
    cause = F.when(calm, F.lit(fv.LOW_RISK_CAUSE)).otherwise(drawn)
    percent = F.format_string("%.1f", F.col("cost_overrun_pct"))
    schedule = (F.col("kind") != "cost") & (F.col("delay_risk") > 0.05)
    text = (
        F.when(
            schedule,
            F.concat_ws(
                " ",
                F.concat(
                    F.lit("The project in "), F.col("sector"), F.lit(" is rated "), risk_tier(F.col("delay_risk")),
                    F.lit(" delay risk with a cost overrun of "), percent,
                    F.lit("%. The primary exposure is schedule: "), cause, F.lit("."),
                ),
                F.when(F.col("cost_risk") > 0.45, F.lit("Cost pressure is also material, so both schedule and budget need joint attention.")),
            ),
        )
        .when(
            F.col("cost_risk") > 0.25,
            F.concat(
                F.lit("This "), F.col("sector"), F.lit(" project shows "), risk_tier(F.col("cost_risk")),
                F.lit(" cost risk with an overrun of "), percent, F.lit("%. The main driver is cost escalation; "), cause, F.lit("."),
            ),
        )
        .otherwise(
            F.concat(F.lit("This "), F.col("sector"), F.lit(" project is currently low risk. "), cause, F.lit(" No proactive intervention is required."))
        )
    )
    action = F.lit(
        "Recommended action: review the flagged driver, re-baseline the affected milestone, and escalate if it "
        "persists for more than one review cycle."
    )
    return tall.select(
        F.lit("Explain the risk of the following infrastructure project in 2-3 sentences.").alias("instruction"),
        "input",
        F.concat_ws(" ", text, action).alias("output"),
    ).dropDuplicates(["input", "output"])


def multi_threshold_tier(delay: Column, overrun: Column) -> Column:
    tier = None
    for name, months, pct in fv.DELAY_COST_TIERS:
        hit = (delay >= months) & (overrun >= pct)
        tier = F.when(hit, name) if tier is None else tier.when(hit, name)
    return tier.otherwise(fv.DELAY_COST_TIERS[-1][0])


def penalty_score(df: DataFrame) -> DataFrame:
    """Deterministic delay penalty in months; two or more major blockers add 0.6 of it."""
    land = F.col("land_acquisition_pct")
    pending = F.col("env_clearance_status") == "Pending"
    tier3 = F.col("contractor_tier") == "Tier 3"
    litigation = F.col("litigation_active")

    def months(cond: Column, value: int) -> Column:
        return F.when(cond, value).otherwise(0)

    risk = (
        months(land < 50, fv.PENALTY_LAND_BELOW_50)
        + months((land >= 50) & (land < 80), fv.PENALTY_LAND_BELOW_80)
        + months(pending, fv.PENALTY_ENV_PENDING)
        + months(F.col("env_clearance_status") == "In-Review", fv.PENALTY_ENV_IN_REVIEW)
        + months(litigation, fv.PENALTY_LITIGATION)
        + months(tier3, fv.PENALTY_TIER_3)
        + months(F.col("contractor_tier") == "Tier 2", fv.PENALTY_TIER_2)
        + months(F.col("state_region") == "North-East", fv.PENALTY_NORTH_EAST)
    )
    blockers = months(land < 60, 1) + months(pending, 1) + months(litigation, 1) + months(tier3, 1)
    return df.withColumn("penalty_months", risk.cast("double")).withColumn("blockers", blockers).withColumn(
        "penalty_score", F.col("penalty_months") * F.when(F.col("blockers") >= 2, 1 + fv.INTERACTION_SCALE).otherwise(1.0)
    )


