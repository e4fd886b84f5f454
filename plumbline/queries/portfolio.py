"""Portfolio questions on the driver tables."""

from pyspark.sql import functions as F

from ..operators import portfolio as op
from ..sources import driver_tables as dt
from .base import query, view


def rounded(df, digits, *columns):
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query(
    "portfolio_filter", "view",
    """SELECT project_id, sector, cost_risk, delay_risk, tor_months, original_cost_cr FROM view_t
       WHERE sector = 'BUILDING' AND ((cost_risk >= 0.45 AND cost_risk < 0.70) OR (delay_risk >= 0.45 AND delay_risk < 0.70))
         AND tor_months > 0 AND original_cost_cr >= 1000""",
)
def _(spark, d):
    rows = op.portfolio_filter(view(spark, d), "BUILDING", "High", "Delayed", "Mega")
    return rows.select("project_id", "sector", "cost_risk", "delay_risk", "tor_months", "original_cost_cr")


@query(
    "portfolio_filter_low", "view",
    """SELECT sector, count(*) AS n FROM view_t WHERE cost_risk < 0.25 AND delay_risk < 0.25 AND tor_months <= 0 GROUP BY sector""",
)
def _(spark, d):
    return op.portfolio_filter(view(spark, d), None, "Low", "On Schedule").groupBy("sector").agg(F.count(F.lit(1)).alias("n"))


@query(
    "portfolio_kpis", "view",
    """WITH f AS (SELECT * FROM view_t WHERE tor_months > 0)
       SELECT count(*) AS n_projects, round(count(*) / (SELECT count(*) FROM view_t) * 100, 6) AS share_pct,
         round(sum(original_cost_cr), 2) AS total_original_cr, round(sum(anticipated_cost_cr), 2) AS total_anticipated_cr,
         round(greatest(0.0, sum(anticipated_cost_cr) - sum(original_cost_cr)), 2) AS overrun_cr,
         round(avg(cost_overrun_pct), 6) AS mean_overrun_pct, round(avg(tor_months), 6) AS mean_delay_months,
         count(*) FILTER (tor_months > 0) AS delayed_count,
         count(*) FILTER (cost_risk >= 0.45 OR delay_risk >= 0.45) AS high_risk_count FROM f""",
)
def _(spark, d):
    v = view(spark, d)
    out = op.portfolio_kpis(op.portfolio_filter(v, delay="Delayed"), v)
    out = rounded(out, 6, "share_pct", "mean_overrun_pct", "mean_delay_months")
    return rounded(out, 2, "total_original_cr", "total_anticipated_cr", "overrun_cr")


BENCHMARK_SQL = """
WITH b AS (
  SELECT sector, count(project_name) AS projects, round(avg(cost_risk), 2) AS avg_cost_risk, round(avg(delay_risk), 2) AS avg_delay_risk,
    round(avg(cost_overrun_pct), 2) AS avg_overrun_pct, round(avg(tor_months), 2) AS avg_delay_months,
    round(sum(original_cost_cr), 2) AS total_sanctioned_cr, round(sum(anticipated_cost_cr), 2) AS total_anticipated_cr
  FROM view_t GROUP BY sector)
SELECT *, round(greatest(0.0, total_anticipated_cr - total_sanctioned_cr), 1) AS fiscal_overrun_cr FROM b
ORDER BY fiscal_overrun_cr DESC, sector"""


@query("sector_benchmark", "view", BENCHMARK_SQL)
def sector_benchmark(spark, d):
    return op.sector_benchmark(view(spark, d))


@query(
    "top_sectors_by_overrun", "view",
    """SELECT sector, count(project_name) AS projects, round(sum(original_cost_cr), 2) AS total_original_cr,
         round(sum(anticipated_cost_cr), 2) AS total_anticipated_cr,
         round(greatest(0.0, sum(anticipated_cost_cr) - sum(original_cost_cr)), 2) AS overrun_cr
       FROM view_t GROUP BY sector ORDER BY overrun_cr DESC, sector LIMIT 10""",
)
def _(spark, d):
    return rounded(op.top_sectors_by_overrun(view(spark, d)), 2, "total_original_cr", "total_anticipated_cr", "overrun_cr")


@query(
    "avg_delay_by_sector", "view",
    """SELECT sector, round(avg(tor_months), 6) AS avg_delay_months, count(project_name) AS projects FROM view_t
       GROUP BY sector ORDER BY avg_delay_months DESC, sector LIMIT 12""",
)
def _(spark, d):
    return rounded(op.avg_delay_by_sector(view(spark, d)), 6, "avg_delay_months")


@query(
    "overrun_histogram", "view",
    """WITH e AS (SELECT min(cost_overrun_pct) AS low, (max(cost_overrun_pct) - min(cost_overrun_pct)) / 35 AS width FROM view_t)
       SELECT CAST(CASE WHEN width > 0 THEN least(floor((cost_overrun_pct - low) / width), 34) ELSE 0 END AS INTEGER) AS bin,
         cost_tier, count(*) AS projects FROM view_t, e GROUP BY 1, 2""",
)
def _(spark, d):
    return op.overrun_histogram(view(spark, d))


@query(
    "risk_scatter", "view",
    """SELECT project_id, sector, cost_risk, delay_risk, round(least(greatest(sqrt(coalesce(original_cost_cr, 150)), 6), 22), 6) AS bubble_size
       FROM view_t ORDER BY project_id LIMIT 150""",
)
def _(spark, d):
    return rounded(op.risk_scatter(view(spark, d)), 6, "bubble_size")


@query(
    "project_list", "view",
    """SELECT project_id, project_name, sector, original_cost_cr, anticipated_cost_cr, cost_overrun_pct, tor_months, cost_tier, delay_tier
       FROM view_t WHERE lower(project_name) LIKE '%urgent%' ORDER BY tor_months DESC NULLS LAST, project_id LIMIT 25 OFFSET 25""",
)
def _(spark, d):
    return op.project_list(view(spark, d), "Urgent", "delay", 25, 1)


@query(
    "sector_risk_means", "view",
    """SELECT sector, round(avg(cost_risk), 6) AS cost_risk, round(avg(delay_risk), 6) AS delay_risk, count(project_name) AS n
       FROM view_t GROUP BY sector""",
)
def _(spark, d):
    return rounded(op.sector_risk_means(view(spark, d)), 6, "cost_risk", "delay_risk")


def states(spark, d):
    return op.state_table(view(spark, d))


@query(
    "state_kpis", "state",
    """SELECT count(*) AS n_states, CAST(sum(n_projects) AS BIGINT) AS total_projects,
         (SELECT state FROM state_t ORDER BY cost_overrun_pct DESC, state LIMIT 1) AS worst_state,
         max(cost_overrun_pct) AS worst_overrun_pct, count(*) FILTER (action <> 'Monitor') AS need_action,
         round(avg(cost_overrun_pct), 6) AS mean_overrun_pct FROM state_a""",
)
def _(spark, d):
    return rounded(op.state_kpis(states(spark, d)), 6, "mean_overrun_pct")


@query("state_triage", "state", "SELECT state, cost_overrun_pct, round(delay_risk, 6) AS delay_risk, tor_max_months, action FROM state_a")
def _(spark, d):
    out = op.state_triage(states(spark, d)).select("state", "cost_overrun_pct", "delay_risk", "tor_max_months", "action")
    return rounded(out, 6, "delay_risk")


@query(
    "state_watchlist", "state",
    """SELECT state, n_projects, action, round(cost_overrun_pct + 100 * delay_risk, 6) AS score FROM state_a
       ORDER BY cost_overrun_pct + 100 * delay_risk DESC, state LIMIT 12""",
)
def _(spark, d):
    return rounded(op.state_watchlist(states(spark, d)).select("state", "n_projects", "action", "score"), 6, "score")


@query(
    "exposure_concentration", "state",
    """WITH x AS (SELECT *, n_projects * cost_overrun_pct AS e FROM state_a),
         top AS (SELECT * FROM x ORDER BY e DESC, state LIMIT 5)
       SELECT round((SELECT sum(e) FROM x), 2) AS total_exposure, round(sum(e) / (SELECT sum(e) FROM x) * 100, 6) AS top_share_pct,
         (SELECT state FROM top ORDER BY e DESC, state LIMIT 1) AS top_state,
         round(max(e) / (SELECT sum(e) FROM x) * 100, 6) AS first_share_pct,
         (SELECT count(*) FROM x WHERE action = 'Escalate') AS escalate_count FROM top""",
)
def _(spark, d):
    out = op.exposure_concentration(states(spark, d))
    return rounded(rounded(out, 2, "total_exposure"), 6, "top_share_pct", "first_share_pct")


@query(
    "state_detail", "state",
    """SELECT state, n_projects, CAST(rank() OVER (ORDER BY cost_overrun_pct DESC) AS INTEGER) AS overrun_rank,
         round(n_projects / sum(n_projects) OVER () * 100, 6) AS share_pct, round(delay_risk, 6) AS delay_risk, action FROM state_a""",
)
def _(spark, d):
    return rounded(op.state_detail(states(spark, d)), 6, "share_pct", "delay_risk")


@query("top_overrun_states", "state", "SELECT state, n_projects, cost_overrun_pct FROM state_t ORDER BY cost_overrun_pct DESC, state LIMIT 5")
def _(spark, d):
    return op.top_overrun_states(states(spark, d)).select("state", "n_projects", "cost_overrun_pct")


@query("state_risk_index", "state", "SELECT state, tor_max_months, round(delay_risk, 6) AS delay_risk FROM state_t")
def _(spark, d):
    return rounded(states(spark, d).select("state", "tor_max_months", "delay_risk"), 6, "delay_risk")


@query(
    "cohort_base_rates", "time",
    """SELECT approval_year, round(avg(CASE WHEN delayed IS NOT NULL THEN CAST(delayed > 0 AS DOUBLE) END), 6) AS rate, count(delayed) AS n
       FROM time_t GROUP BY approval_year""",
)
def _(spark, d):
    return rounded(op.cohort_base_rates(dt.time_table(spark, d), "delayed"), 6, "rate")


DRIVER_BANDS = ((1995, 1996), (1997, 1998), (1999, 2000), (2001, None))


@query(
    "censoring_bands", "time",
    """SELECT CASE WHEN approval_year BETWEEN 1995 AND 1996 THEN '1995-1996' WHEN approval_year BETWEEN 1997 AND 1998 THEN '1997-1998'
         WHEN approval_year BETWEEN 1999 AND 2000 THEN '1999-2000' WHEN approval_year >= 2001 THEN '2001+' END AS band,
         round(avg(CAST(delayed > 0 AS DOUBLE)), 6) AS rate, count(delayed) AS n FROM time_t GROUP BY 1""",
)
def _(spark, d):
    return rounded(op.censoring_bands(dt.time_table(spark, d), "delayed", DRIVER_BANDS), 6, "rate")


@query(
    "cohort_pace_profile", "time",
    """WITH p AS (SELECT *, CASE WHEN planned_duration_years > 0
             THEN least(greatest((snap_year - approval_year) / greatest(planned_duration_years, 0.5), 0), 6) END AS share FROM time_t),
         q AS (SELECT *, CASE WHEN share IS NOT NULL THEN least(greatest(greatest(expenditure_cum_cr, 0) / greatest(original_cost_cr, 1e-9)
             / greatest(share, 0.1::DOUBLE), 0), 12) END AS pace FROM p),
         w AS (SELECT c AS cutoff, q.* FROM q, (VALUES (1997), (1998), (1999)) v(c) WHERE approval_year > c AND approval_year <= c + 2)
       SELECT cutoff, count(*) AS n, round(avg(CAST(delayed > 0 AS DOUBLE)), 6) AS base_rate,
         round(quantile_cont(share, 0.25), 6) AS elapsed_share_p25, round(quantile_cont(share, 0.5), 6) AS elapsed_share_p50,
         round(quantile_cont(share, 0.75), 6) AS elapsed_share_p75, round(quantile_cont(pace, 0.25), 6) AS spend_pace_p25,
         round(quantile_cont(pace, 0.5), 6) AS spend_pace_p50, round(quantile_cont(pace, 0.75), 6) AS spend_pace_p75
       FROM w GROUP BY cutoff""",
)
def _(spark, d):
    from ..operators.features import pace_features

    out = op.cohort_pace_profile(pace_features(dt.time_table(spark, d)), "delayed", (1997, 1998, 1999))
    return rounded(out, 6, *[c for c in out.columns if c not in ("cutoff", "n")])


@query(
    "search_projects", "view",
    """SELECT project_id, project_name, sector, cost_risk, delay_risk, cost_overrun_pct, count(*) OVER () AS found
       FROM view_t WHERE lower(project_name) LIKE '%build%' OR lower(sector) LIKE '%build%' ORDER BY project_id LIMIT 50""",
)
def _(spark, d):
    return op.search_projects(view(spark, d), "build", 80)


STATS = """count(project_name) AS n, round(avg(cost_risk), 6) AS mean_cost_risk, round(avg(delay_risk), 6) AS mean_delay_risk,
    round(avg(cost_overrun_pct), 6) AS mean_overrun"""
STAT_COLUMNS = ("mean_cost_risk", "mean_delay_risk", "mean_overrun")


@query("sector_stats_all", "view", f"SELECT sector, {STATS} FROM view_t GROUP BY sector ORDER BY mean_overrun DESC, sector")
def _(spark, d):
    return rounded(op.sector_stats(view(spark, d), "ALL"), 6, *STAT_COLUMNS)


@query("sector_stats_one", "view", f"SELECT 'machin' AS sector, {STATS} FROM view_t WHERE lower(sector) LIKE '%machin%'")
def _(spark, d):
    return rounded(op.sector_stats(view(spark, d), "machin"), 6, *STAT_COLUMNS)


@query(
    "top_risk_projects", "view",
    """SELECT project_id, project_name, sector, cost_risk, delay_risk, round((cost_risk + delay_risk) / 2, 6) AS combined FROM view_t
       ORDER BY (cost_risk + delay_risk) / 2 DESC, project_id LIMIT 50""",
)
def _(spark, d):
    return rounded(op.top_risk_projects(view(spark, d), 50), 6, "combined")


@query(
    "rank_projects", "view",
    """SELECT project_id, project_name, sector, tor_months, cost_risk, delay_risk, cost_overrun_pct, original_cost_cr FROM view_t
       WHERE lower(project_name) LIKE '%medium%' OR lower(sector) LIKE '%medium%' ORDER BY tor_months ASC NULLS LAST, project_id LIMIT 20""",
)
def _(spark, d):
    return op.rank_projects(view(spark, d), "tor_months", "MEDIUM", 20, True)


@query(
    "project_detail", "view",
    """SELECT project_id, project_name, sector, original_cost_cr, anticipated_cost_cr, expenditure_cum_cr, cost_overrun_pct, cost_risk,
         cost_tier, delay_risk, delay_tier, tor_months, reasons FROM view_t WHERE lower(project_name) LIKE '%project 12%'
       ORDER BY CAST(lower(project_name) <> 'project 12' AS INTEGER), project_id LIMIT 1""",
)
def _(spark, d):
    return op.project_detail(view(spark, d), "Project 12")


@query(
    "portfolio_overview", "view",
    """SELECT count(*) AS n, round(avg(cost_overrun_pct), 6) AS mean_cost_overrun, round(avg(cost_risk), 6) AS mean_cost_risk,
         round(avg(delay_risk), 6) AS mean_delay_risk, count(*) FILTER (cost_risk >= 0.45) AS critical_high_cost,
         count(*) FILTER (delay_risk >= 0.45) AS critical_high_delay FROM view_t""",
)
def _(spark, d):
    return rounded(op.portfolio_overview(view(spark, d)), 6, "mean_cost_overrun", "mean_cost_risk", "mean_delay_risk")


@query(
    "keyword_overlap_search", "view",
    """WITH h AS (SELECT project_id, project_name, CAST(contains(lower(project_name), 'urgent') AS INTEGER)
           + CAST(contains(lower(project_name), 'nation') AS INTEGER) AS hits FROM view_t)
       SELECT * FROM h WHERE hits > 0 ORDER BY hits DESC, project_id LIMIT 1""",
)
def _(spark, d):
    return op.keyword_overlap_search(view(spark, d), "What about the URGENT nation delay?")


@query(
    "full_name_search", "view",
    """WITH h AS (SELECT project_id, 'Project ' || CAST(project_id AS VARCHAR) AS project_name FROM view_t)
       SELECT *, CAST(contains(project_name, '345') AS INTEGER) * 0 AS hits FROM h
       WHERE contains('tell me about project 345 of the portfolio', lower(project_name)) AND length(project_name) > 6 ORDER BY project_id LIMIT 1""",
)
def _(spark, d):
    named = view(spark, d).withColumn("project_name", F.concat(F.lit("Project "), F.col("project_id").cast("string")))
    return op.keyword_overlap_search(named, "Tell me about Project 345 of the portfolio")


SCORED_SQL = """
scored AS (SELECT *, least(1.0::DOUBLE, expenditure_cum_cr / (original_cost_cr + expenditure_cum_cr)) AS p, 0.3::DOUBLE AS ratio FROM cost_t),
clean AS (SELECT *, p * greatest(0.0, ratio * original_cost_cr) AS e FROM scored WHERE overrun_flag = 0)"""


def scored(spark, d):
    """Cost rows with a stand-in probability (spend share) and ratio."""
    spent, orig = F.col("expenditure_cum_cr"), F.col("original_cost_cr")
    return dt.cost_table(spark, d).withColumns({"p": F.least(F.lit(1.0), spent / (orig + spent)), "ratio": F.lit(0.3)})


@query(
    "screen_clean", "cost",
    "WITH " + SCORED_SQL.strip() + """
    SELECT t AS threshold, count(*) AS clean, count(*) FILTER (p >= t) AS flagged, round(count(*) FILTER (p >= t) / count(*), 6) AS share,
      round(coalesce(sum(original_cost_cr) FILTER (p >= t), 0), 2) AS cost_cr, round(coalesce(sum(e) FILTER (p >= t), 0), 2) AS exposure_cr
    FROM clean, (VALUES (0.5::DOUBLE), (0.6::DOUBLE), (0.7::DOUBLE)) v(t) GROUP BY t""",
)
def _(spark, d):
    return rounded(rounded(op.screen_clean(scored(spark, d)), 6, "share"), 2, "cost_cr", "exposure_cr")


@query(
    "exposure_top_share", "cost",
    "WITH " + SCORED_SQL.strip() + """,
    r AS (SELECT e, row_number() OVER (ORDER BY e DESC) AS rn, count(*) OVER () AS n FROM clean)
    SELECT t AS top_share, CAST(max(greatest(1, round_even(n * t, 0))) AS BIGINT) AS k,
      round(sum(e) FILTER (rn <= greatest(1, round_even(n * t, 0))), 2) AS top_exposure_cr, round(sum(e), 2) AS total_exposure_cr,
      round(sum(e) FILTER (rn <= greatest(1, round_even(n * t, 0))) / sum(e), 6) AS captured_share
    FROM r, (VALUES (0.2::DOUBLE), (0.3::DOUBLE)) v(t) GROUP BY t""",
)
def _(spark, d):
    out = op.exposure_top_share(scored(spark, d))
    return rounded(rounded(out, 2, "top_exposure_cr", "total_exposure_cr"), 6, "captured_share")


@query(
    "screen_by_sector", "cost",
    "WITH " + SCORED_SQL.strip() + """
    SELECT sector, count(*) AS clean, count(*) FILTER (p >= 0.6) AS flagged, round(count(*) FILTER (p >= 0.6) / count(*), 6) AS share,
      round(coalesce(sum(e) FILTER (p >= 0.6), 0), 2) AS exposure_cr FROM clean GROUP BY sector""",
)
def _(spark, d):
    return rounded(rounded(op.screen_by_sector(scored(spark, d)), 6, "share"), 2, "exposure_cr")


@query(
    "savings_scenarios", "cost",
    "WITH " + SCORED_SQL.strip() + """
    SELECT t AS prevented, round(sum(e), 2) AS total_exposure_cr, round(t * sum(e), 2) AS saved_cr
    FROM clean, (VALUES (0.1::DOUBLE), (0.2::DOUBLE), (0.3::DOUBLE), (0.5::DOUBLE)) v(t) GROUP BY t""",
)
def _(spark, d):
    return rounded(op.savings_scenarios(scored(spark, d)), 2, "total_exposure_cr", "saved_cr")


@query("top_sectors", "time", "SELECT sector, count(*) AS n FROM time_t GROUP BY sector ORDER BY n DESC, sector LIMIT 4")
def _(spark, d):
    return op.top_sectors(dt.time_table(spark, d))
