"""Portfolio questions over the view of ``features.portfolio_view``.

Filters, conditional aggregates and top-k. Small group tables are sorted; row
tables are only ever cut with ``orderBy().limit()``, which keeps k rows per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..plans.ordered import exact_percentiles, running_totals

HIGH = 0.45


def _count(cond: Column) -> Column:
    return F.count(F.when(cond, F.lit(1)))


# --------------------------------------------------------------------------- dashboard
def portfolio_filter(
    view: DataFrame,
    sector: str | None = None,
    tier: str | None = None,
    delay: str | None = None,
    scale: str | None = None,
) -> DataFrame:
    cost, late = F.col("cost_risk"), F.col("delay_risk")
    bands = {
        "Critical": (cost >= 0.70) | (late >= 0.70),
        "High": ((cost >= 0.45) & (cost < 0.70)) | ((late >= 0.45) & (late < 0.70)),
        "Moderate": ((cost >= 0.25) & (cost < 0.45)) | ((late >= 0.25) & (late < 0.45)),
        "Low": (cost < 0.25) & (late < 0.25),
    }
    states = {"Delayed": F.col("tor_months") > 0, "On Schedule": F.col("tor_months") <= 0}
    sizes = {
        "Mega": F.col("original_cost_cr") >= 1000,
        "Major": (F.col("original_cost_cr") >= 150) & (F.col("original_cost_cr") < 1000),
    }
    if sector is not None:
        view = view.filter(F.col("sector") == sector)
    for value, table in ((tier, bands), (delay, states), (scale, sizes)):
        if value is not None:
            view = view.filter(table[value])
    return view


def portfolio_kpis(filtered: DataFrame, whole: DataFrame) -> DataFrame:
    total = whole.agg(F.count(F.lit(1)).alias("n")).scalar()
    sums = filtered.agg(
        F.count(F.lit(1)).alias("n_projects"),
        F.coalesce(F.sum("original_cost_cr"), F.lit(0.0)).alias("total_original_cr"),
        F.coalesce(F.sum("anticipated_cost_cr"), F.lit(0.0)).alias("total_anticipated_cr"),
        F.coalesce(F.avg("cost_overrun_pct"), F.lit(0.0)).alias("mean_overrun_pct"),
        F.coalesce(F.avg("tor_months"), F.lit(0.0)).alias("mean_delay_months"),
        _count(F.col("tor_months") > 0).alias("delayed_count"),
        _count((F.col("cost_risk") >= HIGH) | (F.col("delay_risk") >= HIGH)).alias("high_risk_count"),
    )
    return sums.withColumn("__total", total).select(
        "n_projects",
        (F.col("n_projects") / F.col("__total") * 100).alias("share_pct"),
        "total_original_cr",
        "total_anticipated_cr",
        F.greatest(F.lit(0.0), F.col("total_anticipated_cr") - F.col("total_original_cr")).alias("overrun_cr"),
        "mean_overrun_pct",
        "mean_delay_months",
        "delayed_count",
        "high_risk_count",
    )


def sector_benchmark(view: DataFrame) -> DataFrame:
    return (
        view.groupBy("sector")
        .agg(
            F.count("project_name").alias("projects"),
            F.round(F.avg("cost_risk"), 2).alias("avg_cost_risk"),
            F.round(F.avg("delay_risk"), 2).alias("avg_delay_risk"),
            F.round(F.avg("cost_overrun_pct"), 2).alias("avg_overrun_pct"),
            F.round(F.avg("tor_months"), 2).alias("avg_delay_months"),
            F.round(F.sum("original_cost_cr"), 2).alias("total_sanctioned_cr"),
            F.round(F.sum("anticipated_cost_cr"), 2).alias("total_anticipated_cr"),
        )
        .withColumn(
            "fiscal_overrun_cr",
            F.round(F.greatest(F.lit(0.0), F.col("total_anticipated_cr") - F.col("total_sanctioned_cr")), 1),
        )
        .orderBy(F.col("fiscal_overrun_cr").desc(), "sector")
    )


def top_sectors_by_overrun(view: DataFrame, n: int = 10) -> DataFrame:
    return (
        view.groupBy("sector")
        .agg(
            F.count("project_name").alias("projects"),
            F.sum("original_cost_cr").alias("total_original_cr"),
            F.sum("anticipated_cost_cr").alias("total_anticipated_cr"),
        )
        .withColumn("overrun_cr", F.greatest(F.lit(0.0), F.col("total_anticipated_cr") - F.col("total_original_cr")))
        .orderBy(F.col("overrun_cr").desc(), "sector")
        .limit(n)
    )


def avg_delay_by_sector(view: DataFrame, n: int = 12) -> DataFrame:
    return (
        view.groupBy("sector")
        .agg(F.avg("tor_months").alias("avg_delay_months"), F.count("project_name").alias("projects"))
        .orderBy(F.col("avg_delay_months").desc_nulls_last(), "sector")
        .limit(n)
    )


def overrun_histogram(view: DataFrame, bins: int = 35) -> DataFrame:
    """Rows per equal-width bin of cost_overrun_pct and tier; the top edge belongs to the last bin."""
    pct = F.col("cost_overrun_pct")
    edges = view.agg(F.struct(F.min(pct).alias("low"), F.max(pct).alias("high")).alias("e")).scalar()
    width = (F.col("__e.high") - F.col("__e.low")) / bins
    cut = F.when(width > 0, F.least(F.floor((pct - F.col("__e.low")) / width), F.lit(bins - 1))).otherwise(F.lit(0))
    return (
        view.filter(pct.isNotNull())
        .select("cost_tier", pct, edges.alias("__e"))
        .groupBy(cut.cast("int").alias("bin"), "cost_tier")
        .agg(F.count(F.lit(1)).alias("projects"))
    )


def risk_scatter(view: DataFrame, n: int = 150, order: str = "project_id") -> DataFrame:
    size = F.sqrt(F.coalesce("original_cost_cr", F.lit(150.0)))
    return view.orderBy(order).limit(n).select(
        order, "sector", "cost_risk", "delay_risk", F.least(F.greatest(size, F.lit(6.0)), F.lit(22.0)).alias("bubble_size")
    )


LIST_SORTS = {
    "overrun": "cost_overrun_pct",
    "delay": "tor_months",
    "cost_risk": "cost_risk",
    "delay_risk": "delay_risk",
    "size": "original_cost_cr",
}


def project_list(
    view: DataFrame, contains: str = "", sort: str = "overrun", page_size: int = 25, page: int = 0, tie: str = "project_id"
) -> DataFrame:
    rows = view
    if contains.strip():
        rows = rows.filter(F.contains(F.lower("project_name"), F.lit(contains.strip().lower())))
    ordered = rows.orderBy(F.col(LIST_SORTS[sort]).desc_nulls_last(), tie)
    return ordered.offset(page * page_size).limit(page_size).select(
        tie, "project_name", "sector", "original_cost_cr", "anticipated_cost_cr", "cost_overrun_pct", "tor_months",
        "cost_tier", "delay_tier",
    )


def sector_risk_means(view: DataFrame) -> DataFrame:
    return view.groupBy("sector").agg(
        F.avg("cost_risk").alias("cost_risk"), F.avg("delay_risk").alias("delay_risk"), F.count("project_name").alias("n")
    )


# --------------------------------------------------------------------------- states
def state_table(view: DataFrame) -> DataFrame:
    """State rows from project rows."""
    return state_risk_index(
        view.groupBy("state").agg(
            F.count(F.lit(1)).alias("n_projects"),
            F.round(F.avg("cost_overrun_pct"), 2).alias("cost_overrun_pct"),
            F.min("tor_months").cast("int").alias("tor_min_months"),
            F.max("tor_months").cast("int").alias("tor_max_months"),
        )
    )


def state_risk_index(states: DataFrame) -> DataFrame:
    top = F.col("tor_max_months")
    return states.withColumn("delay_risk", F.when(top.isNotNull(), F.least(top, F.lit(120)) / 120.0))


def triage_action() -> Column:
    pct, risk, tor = F.col("cost_overrun_pct"), F.col("delay_risk"), F.col("tor_max_months")
    return (
        F.when((pct >= 50) | (risk >= 0.9) | (tor >= 150), "Escalate")
        .when((pct >= 25) | (risk >= 0.6) | (tor >= 60), "Review")
        .otherwise("Monitor")
    )


def state_triage(states: DataFrame) -> DataFrame:
    return states.withColumn("action", triage_action())


def state_kpis(states: DataFrame) -> DataFrame:
    pct = F.col("cost_overrun_pct")
    return states.agg(
        F.count(F.lit(1)).alias("n_states"),
        F.sum("n_projects").alias("total_projects"),
        F.min_by("state", F.struct(-pct, F.col("state"))).alias("worst_state"),
        F.max(pct).alias("worst_overrun_pct"),
        _count(triage_action() != "Monitor").alias("need_action"),
        F.avg(pct).alias("mean_overrun_pct"),
    )


def state_watchlist(states: DataFrame, n: int = 12) -> DataFrame:
    return (
        state_triage(states)
        .withColumn("score", F.col("cost_overrun_pct") + 100 * F.col("delay_risk"))
        .orderBy(F.col("score").desc_nulls_last(), "state")
        .limit(n)
    )


def exposure_concentration(states: DataFrame, n: int = 5) -> DataFrame:
    exposed = states.withColumn("exposure", F.col("n_projects") * F.col("cost_overrun_pct"))
    totals = exposed.agg(
        F.struct(F.sum("exposure").alias("total"), _count(triage_action() == "Escalate").alias("escalate")).alias("t")
    ).scalar()
    top = exposed.orderBy(F.col("exposure").desc_nulls_last(), "state").limit(n)
    return (
        top.agg(
            F.sum("exposure").alias("top"),
            F.max("exposure").alias("first"),
            F.min_by("state", F.struct(-F.col("exposure"), F.col("state"))).alias("top_state"),
        )
        .withColumn("t", totals)
        .select(
            F.col("t.total").alias("total_exposure"),
            (F.col("top") / F.col("t.total") * 100).alias("top_share_pct"),
            "top_state",
            (F.col("first") / F.col("t.total") * 100).alias("first_share_pct"),
            F.col("t.escalate").alias("escalate_count"),
        )
    )


def state_detail(states: DataFrame) -> DataFrame:
    """Competition rank by overrun and share of projects, for every state (one row per state in one window)."""
    return state_triage(states).select(
        "state",
        "n_projects",
        F.rank().over(Window.orderBy(F.col("cost_overrun_pct").desc_nulls_last())).alias("overrun_rank"),
        (F.col("n_projects") / F.sum("n_projects").over(Window.partitionBy(F.lit(1))) * 100).alias("share_pct"),
        "delay_risk",
        "action",
    )


def top_overrun_states(states: DataFrame, n: int = 5) -> DataFrame:
    return states.orderBy(F.col("cost_overrun_pct").desc_nulls_last(), "state").limit(n)


# --------------------------------------------------------------------------- cohorts
def cohort_base_rates(df: DataFrame, label: str, year: str = "approval_year") -> DataFrame:
    return df.filter(F.col(year).isNotNull()).groupBy(year).agg(
        F.avg((F.col(label) > 0).cast("double")).alias("rate"), F.count(label).alias("n")
    )


BANDS = ((1980, 1995), (1996, 2005), (2006, 2015), (2016, 2019), (2020, 2021), (2022, None))


def year_band(year: Column, bands: Sequence[tuple[int, int | None]] = BANDS) -> Column:
    out = None
    for low, high in bands:
        name = f"{low}+" if high is None else f"{low}-{high}"
        hit = (year >= low) if high is None else year.between(low, high)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def censoring_bands(
    df: DataFrame, label: str, bands: Sequence[tuple[int, int | None]] = BANDS, year: str = "approval_year"
) -> DataFrame:
    return (
        df.withColumn("band", year_band(F.col(year), bands))
        .filter(F.col("band").isNotNull())
        .groupBy("band")
        .agg(F.avg((F.col(label) > 0).cast("double")).alias("rate"), F.count(label).alias("n"))
    )


def cohort_pace_profile(df: DataFrame, label: str, cutoffs: Sequence[int], width: int = 2) -> DataFrame:
    """n, base rate and quartiles of elapsed_share and spend_pace per test window.

    Windows overlap, so a row is repeated once per window it belongs to.
    """
    year = F.col("approval_year")
    windows = F.array_compact(
        F.array(*[F.when((year > c) & (year <= c + width), F.lit(c)) for c in cutoffs])
    )
    rows = df.withColumn("cutoff", F.explode(windows))
    base = rows.groupBy("cutoff").agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col(label) > 0).cast("double")).alias("base_rate")
    )
    q = exact_percentiles(rows, ["elapsed_share", "spend_pace"], (0.25, 0.5, 0.75), by=["cutoff"])
    wide = q.groupBy("cutoff").agg(
        *[
            F.max(F.when((F.col("column") == c) & (F.col("prob") == p), F.col("value"))).alias(f"{c}_p{int(p * 100)}")
            for c in ("elapsed_share", "spend_pace")
            for p in (0.25, 0.5, 0.75)
        ]
    )
    return base.join(wide, "cutoff", "left")


# --------------------------------------------------------------------------- questions
def _has(column: str, word: str) -> Column:
    return F.contains(F.lower(column), F.lit(word))


def search_mask(keyword: str) -> Column:
    word = keyword.strip().lower()
    mask = _has("project_name", word) | _has("sector", word)
    for fragment, words in fv.SEARCH_SYNONYMS.items():
        if word in words:
            mask = mask | _has("sector", fragment)
    return F.coalesce(mask, F.lit(False))


def search_projects(view: DataFrame, keyword: str, limit: int = 10, order: str = "project_id") -> DataFrame:
    """First matches by ``order`` with the number of all matches as ``found``."""
    hits = view.filter(search_mask(keyword))
    found = hits.agg(F.count(F.lit(1)).alias("n")).scalar()
    columns = [order, "project_name", "sector", "cost_risk", "delay_risk", "cost_overrun_pct"]
    return hits.orderBy(order).limit(min(limit, 50)).select(*columns).withColumn("found", found)


def sector_stats(view: DataFrame, sector: str = "ALL") -> DataFrame:
    """Means per sector, or of the sectors matching ``sector`` (synonyms apply when nothing matches)."""
    means = [
        F.count("project_name").alias("n"),
        F.avg("cost_risk").alias("mean_cost_risk"),
        F.avg("delay_risk").alias("mean_delay_risk"),
        F.avg("cost_overrun_pct").alias("mean_overrun"),
    ]
    wanted = sector.strip()
    if wanted.upper() in ("ALL", "EVERY", "PORTFOLIO", ""):
        return view.groupBy("sector").agg(*means).orderBy(F.col("mean_overrun").desc_nulls_last(), "sector")
    direct = F.coalesce(_has("sector", wanted.lower()), F.lit(False))
    synonym = next((v for k, v in fv.SECTOR_SYNONYMS.items() if k in wanted.lower()), None)
    if synonym is None:
        return view.filter(direct).agg(*means).withColumn("sector", F.lit(wanted))
    matched = view.filter(direct).agg(F.count(F.lit(1)).alias("n")).scalar()
    rows = view.withColumn("__m", matched)
    keep = F.when(F.col("__m") > 0, direct).otherwise(F.upper("sector") == synonym)
    return rows.filter(keep).agg(*means).withColumn("sector", F.lit(wanted))


def top_risk_projects(view: DataFrame, n: int = 10, tie: str = "project_id") -> DataFrame:
    return (
        view.withColumn("combined", (F.col("cost_risk") + F.col("delay_risk")) / 2)
        .orderBy(F.col("combined").desc_nulls_last(), tie)
        .limit(min(n, 50))
        .select(tie, "project_name", "sector", "cost_risk", "delay_risk", "combined")
    )


def rank_projects(
    view: DataFrame,
    metric: str = "cost_overrun_pct",
    keyword: str = "",
    n: int = 5,
    ascending: bool = False,
    tie: str = "project_id",
) -> DataFrame:
    if metric not in view.columns:
        raise ValueError(f"unknown metric: {metric}")
    rows = view
    if keyword:
        rows = rows.filter(_has("project_name", keyword.lower()) | _has("sector", keyword.lower()))
    by = F.col(metric).asc_nulls_last() if ascending else F.col(metric).desc_nulls_last()
    columns = [tie, "project_name", "sector", metric, "cost_risk", "delay_risk", "cost_overrun_pct", "original_cost_cr"]
    return rows.orderBy(by, tie).limit(min(n, 50)).select(*dict.fromkeys(columns))


def project_detail(view: DataFrame, name: str, order: str = "project_id") -> DataFrame:
    """The project of that name, ignoring case, else the first whose name contains it."""
    wanted = name.lower()
    lowered = F.lower("project_name")
    return (
        view.filter(F.contains(lowered, F.lit(wanted)))
        .orderBy((lowered != wanted).cast("int"), order)
        .limit(1)
        .select(
            order, "project_name", "sector", "original_cost_cr", "anticipated_cost_cr", "expenditure_cum_cr",
            "cost_overrun_pct", "cost_risk", "cost_tier", "delay_risk", "delay_tier", "tor_months", "reasons",
        )
    )


def portfolio_overview(view: DataFrame) -> DataFrame:
    return view.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("cost_overrun_pct").alias("mean_cost_overrun"),
        F.avg("cost_risk").alias("mean_cost_risk"),
        F.avg("delay_risk").alias("mean_delay_risk"),
        _count(F.col("cost_risk") >= HIGH).alias("critical_high_cost"),
        _count(F.col("delay_risk") >= HIGH).alias("critical_high_delay"),
    )


def keyword_overlap_search(view: DataFrame, query: str, order: str = "project_id") -> DataFrame:
    """The project that a question is about: one whose whole name (over six characters) stands in it, else the one whose
    name contains most query words; the earliest row on ties."""
    import re

    words = sorted(set(re.findall(r"[a-z0-9]{4,}", query.lower())) - set(fv.QUERY_STOP))
    name = F.lower("project_name")
    named = F.coalesce((F.length("project_name") > 6) & F.lit(query.lower()).contains(name), F.lit(False))
    hits = sum((_has("project_name", w).cast("int") for w in words), F.lit(0))
    return (
        view.withColumns({"hits": hits, "__named": named})
        .filter("__named OR hits > 0")
        .orderBy(F.col("__named").desc(), F.when(~F.col("__named"), -F.col("hits")), order)
        .limit(1)
        .select(order, "project_name", "hits")
    )


# --------------------------------------------------------------------------- screening
def exposure() -> Column:
    """Probability-weighted overrun: p x max(0, ratio x original cost)."""
    return F.col("p") * F.greatest(F.lit(0.0), F.col("ratio") * F.col("original_cost_cr"))


def screen_clean(scored: DataFrame, thresholds: Sequence[float] = (0.5, 0.6, 0.7)) -> DataFrame:
    """Among rows without a declared overrun: flagged count, share, cost and exposure per threshold."""
    clean = scored.filter(F.col("overrun_flag") == 0)
    aggs = [F.count(F.lit(1)).alias("clean")]
    for i, t in enumerate(thresholds):
        hit = F.col("p") >= t
        aggs += [
            _count(hit).alias(f"f{i}"),
            F.sum(F.when(hit, F.col("original_cost_cr")).otherwise(0.0)).alias(f"c{i}"),
            F.sum(F.when(hit, exposure()).otherwise(0.0)).alias(f"e{i}"),
        ]
    wide = clean.agg(*aggs)
    rows = F.array(
        *[
            F.struct(
                F.lit(float(t)).alias("threshold"),
                F.col("clean"),
                F.col(f"f{i}").alias("flagged"),
                (F.col(f"f{i}") / F.nullif(F.col("clean"), F.lit(0))).alias("share"),
                F.col(f"c{i}").alias("cost_cr"),
                F.col(f"e{i}").alias("exposure_cr"),
            )
            for i, t in enumerate(thresholds)
        ]
    )
    return wide.select(F.explode(rows).alias("r")).select("r.*")


def exposure_top_share(scored: DataFrame, shares: Sequence[float] = (0.2, 0.3)) -> DataFrame:
    """Share of the clean rows' exposure held by their top 20 % and 30 %.

    Works on the distribution of distinct exposures: rows tied at the cut are
    equal, so how many of them fall inside is all that matters.
    """
    dist = (
        scored.filter(F.col("overrun_flag") == 0)
        .select(F.coalesce(exposure(), F.lit(0.0)).alias("e"))
        .groupBy("e")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    placed = running_totals(dist, "e", ["n"], descending=True)
    k = F.greatest(F.lit(1), F.bround(F.col("n_total") * F.col("top_share")))
    inside = F.greatest(F.lit(0), F.least(F.col("n"), k - F.col("n_before")))
    return (
        placed.withColumn("top_share", F.explode(F.array(*[F.lit(float(s)) for s in shares])))
        .groupBy("top_share")
        .agg(
            F.max(k).cast("long").alias("k"),
            F.sum(F.col("e") * inside).alias("top_exposure_cr"),
            F.sum(F.col("e") * F.col("n")).alias("total_exposure_cr"),
        )
        .withColumn("captured_share", F.col("top_exposure_cr") / F.nullif(F.col("total_exposure_cr"), F.lit(0.0)))
    )


def screen_by_sector(scored: DataFrame, threshold: float = 0.6) -> DataFrame:
    hit = F.col("p") >= threshold
    return scored.filter(F.col("overrun_flag") == 0).groupBy("sector").agg(
        F.count(F.lit(1)).alias("clean"),
        _count(hit).alias("flagged"),
        (_count(hit) / F.count(F.lit(1))).alias("share"),
        F.sum(F.when(hit, exposure()).otherwise(0.0)).alias("exposure_cr"),
    )


def savings_scenarios(scored: DataFrame, fractions: Sequence[float] = (0.1, 0.2, 0.3, 0.5)) -> DataFrame:
    total = scored.filter(F.col("overrun_flag") == 0).agg(F.sum(exposure()).alias("total_exposure_cr"))
    return total.withColumn("prevented", F.explode(F.array(*[F.lit(float(f)) for f in fractions]))).withColumn(
        "saved_cr", F.col("prevented") * F.col("total_exposure_cr")
    )


def top_sectors(df: DataFrame, n: int = 4) -> DataFrame:
    return df.groupBy("sector").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "sector").limit(n)
