"""Registry of queries and the SQL views their oracles share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators import features
from ..session import cut_lineage
from ..sources import driver_tables as dt

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_ORDER_LINES = """
lines_by_order AS (
  SELECT l_orderkey, round(sum(l_extendedprice), 2) AS anticipated_cost_cr,
         round(sum(CASE WHEN l_linestatus = 'F' THEN l_extendedprice END), 2) AS spent, max(l_shipdate) AS last_ship
  FROM lineitem GROUP BY l_orderkey)"""

_TIME = """
time_base AS (
  SELECT o.*, c_mktsegment, n_name, n_nationkey, anticipated_cost_cr, spent,
         CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS planned,
         year(o_orderdate) * 12 + month(o_orderdate) AS start_m,
         year(last_ship) * 12 + month(last_ship) AS last_m
  FROM orders o JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  LEFT JOIN lines_by_order ON o_orderkey = l_orderkey),
time_t AS (
  SELECT o_orderkey AS project_id, c_mktsegment AS sector,
         'Project ' || CAST(o_orderkey AS VARCHAR) || ' - [0' || CAST(o_custkey AS VARCHAR) || ']' || o_orderpriority
           || ',' || n_name AS project_name,
         n_name AS state, o_orderpriority AS agency, year(o_orderdate) AS approval_year,
         CAST(planned AS DOUBLE) AS planned_duration_years, year(o_orderdate) + planned AS planned_doc_year,
         start_m + planned * 12 AS original_doc_index, last_m AS anticipated_doc_index,
         o_totalprice AS original_cost_cr, anticipated_cost_cr, coalesce(spent, 0.0) AS expenditure_cum_cr,
         CASE WHEN last_m IS NOT NULL THEN CAST(greatest(last_m - start_m - planned * 12, 0) AS DOUBLE) END AS tor_months,
         CAST(last_m > start_m + planned * 12 AS INTEGER) AS delayed,
         coalesce(greatest(0.0, round(100 * (anticipated_cost_cr - o_totalprice) / CASE WHEN o_totalprice > 0 THEN o_totalprice END, 4)), 0.0)
           AS cost_overrun_pct,
         coalesce(greatest(0.0, round(100 * (anticipated_cost_cr - o_totalprice) / CASE WHEN o_totalprice > 0 THEN o_totalprice END, 4)), 0.0) / 100
           AS overrun_ratio,
         CASE o_orderstatus WHEN 'F' THEN 'Land acquisition pending' WHEN 'O' THEN 'N/A' END AS reasons,
         CASE WHEN o_orderkey % 5 <> 0 THEN 8 + n_nationkey * 1.0::DOUBLE + (o_orderkey % 7) * 0.01::DOUBLE END AS geo_latitude,
         CASE WHEN o_orderkey % 5 <> 0 THEN 70 + n_nationkey * 0.9::DOUBLE END AS geo_longitude,
         2001.92::DOUBLE AS snap_year
  FROM time_base)"""

_COST = """
cost_base AS (
  SELECT *, round(l_quantity * p_retailprice, 2) AS original_cost_cr,
         round(l_extendedprice * (1 + l_tax), 4) AS anticipated_cost_cr
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation ON s_nationkey = n_nationkey),
cost_t AS (
  SELECT l_orderkey AS project_id, l_linenumber AS line, p_type AS sector,
         'Line ' || CAST(l_orderkey AS VARCHAR) || ' ' || p_name || ' [' || CAST(l_partkey AS VARCHAR) || ']' || s_name
           || ',' || n_name AS project_name,
         n_name AS state, s_name AS agency, original_cost_cr,
         CASE WHEN l_returnflag <> 'N' THEN l_extendedprice END AS revised_cost_cr, anticipated_cost_cr,
         round(l_extendedprice * (1 - l_discount), 4) AS expenditure_cum_cr,
         (anticipated_cost_cr - original_cost_cr) / original_cost_cr AS overrun_ratio,
         CAST((anticipated_cost_cr - original_cost_cr) / original_cost_cr > 0.05 AS INTEGER) AS overrun_flag,
         round(100 * ((anticipated_cost_cr - original_cost_cr) / original_cost_cr), 2) AS cost_overrun_pct,
         CASE WHEN l_suppkey % 4 <> 0 THEN 8 + n_nationkey * 1.0::DOUBLE END AS geo_latitude,
         CASE WHEN l_suppkey % 4 <> 0 THEN 70 + n_nationkey * 0.9::DOUBLE END AS geo_longitude,
         year(l_shipdate) * 12 + month(l_shipdate) AS anticipated_doc_index, 2001.92::DOUBLE AS snap_year
  FROM cost_base)"""

_SNAPSHOT = """
snap_raw AS (
  SELECT c.* EXCLUDE (overrun_ratio, overrun_flag, cost_overrun_pct), approval_year, t.planned_doc_year AS original_doc_year,
         t.original_doc_index
  FROM cost_t c JOIN time_t t ON c.project_id = t.project_id),
snap_eff AS (
  SELECT *, coalesce(revised_cost_cr, anticipated_cost_cr) AS eff, anticipated_doc_index - original_doc_index AS gap
  FROM snap_raw),
snap_pct AS (
  SELECT *, CASE WHEN original_cost_cr > 0 AND eff <> 0
              THEN greatest(0.0, round_even((eff - original_cost_cr) / original_cost_cr * 100, 4)) ELSE 0.0 END AS cost_overrun_pct
  FROM snap_eff),
snap_t AS (
  SELECT * EXCLUDE (eff, gap), CAST(cost_overrun_pct > 0 AS INTEGER) AS overrun_flag,
         round_even(cost_overrun_pct / 100, 6) AS overrun_ratio, CAST(gap > 0 AS INTEGER) AS delayed,
         CASE WHEN gap IS NOT NULL THEN CAST(greatest(gap, 0) AS DOUBLE) END AS tor_months,
         CASE WHEN gap IS NOT NULL THEN CAST(original_doc_year - approval_year AS DOUBLE) END AS planned_duration_years
  FROM snap_pct)"""

_VIEW = """
scored_t AS (
  SELECT *,
    round_even(0.7::DOUBLE * least(greatest(coalesce(cost_overrun_pct, 0) / 200.0::DOUBLE, 0), 1)
      + 0.3::DOUBLE * least(greatest((CASE WHEN original_cost_cr > 0 THEN coalesce(expenditure_cum_cr, 0) / original_cost_cr ELSE 0 END
          - 0.5::DOUBLE) / 2.0::DOUBLE, 0), 1), 2) AS cost_risk,
    round_even(least(1.0::DOUBLE, CASE WHEN coalesce(delayed, 0) <> 0 THEN coalesce(tor_months, 0) ELSE 0 END / 60.0::DOUBLE), 2)
      AS delay_risk
  FROM time_t),
view_t AS (
  SELECT *,
    CASE WHEN cost_risk >= 0.7 THEN 'Critical' WHEN cost_risk >= 0.45 THEN 'High' WHEN cost_risk >= 0.25 THEN 'Medium' ELSE 'Low' END AS cost_tier,
    CASE WHEN delay_risk >= 0.7 THEN 'Critical' WHEN delay_risk >= 0.45 THEN 'High' WHEN delay_risk >= 0.25 THEN 'Medium' ELSE 'Low' END AS delay_tier
  FROM scored_t)"""

_STATE = """
state_t AS (
  SELECT *, least(tor_max_months, 120) / 120.0::DOUBLE AS delay_risk
  FROM (SELECT state, count(*) AS n_projects, round(avg(cost_overrun_pct), 2) AS cost_overrun_pct,
               CAST(min(tor_months) AS INTEGER) AS tor_min_months, CAST(max(tor_months) AS INTEGER) AS tor_max_months
        FROM view_t GROUP BY state)),
state_a AS (
  SELECT *, CASE WHEN cost_overrun_pct >= 50 OR delay_risk >= 0.9 OR tor_max_months >= 150 THEN 'Escalate'
                 WHEN cost_overrun_pct >= 25 OR delay_risk >= 0.6 OR tor_max_months >= 60 THEN 'Review' ELSE 'Monitor' END AS action
  FROM state_t)"""

_CELLS = """
doc_lines AS (
  SELECT doc_id, parts[i] AS line, CAST(i - 1 AS INTEGER) AS i
  FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents) d, unnest(range(1, len(parts) + 1)) AS r(i)),
named_lines AS (
  SELECT doc_id, i, line, trim(regexp_replace(line, '[^A-Za-z0-9 ]', '', 'g')) AS name,
         length(trim(regexp_replace(line, '[^A-Za-z0-9 ]', '', 'g'))) AS n FROM doc_lines),
cells_t AS (
  SELECT doc_id, i // 5 AS page, i % 5 AS "row", line,
    CASE WHEN n < 30 THEN ['', upper(name), '', '', '', '', '', '', '', '', '']
    ELSE [CAST(i + 1 AS VARCHAR), name, lpad(CAST(1 + n % 12 AS VARCHAR), 2, '0') || '/' || CAST(1995 + n % 7 AS VARCHAR),
      format('{:,.2f}', n * 10.0::DOUBLE) || chr(10) || CASE WHEN n % 2 = 0 THEN '-' ELSE format('{:,.2f}', n * 12.5::DOUBLE) END,
      CASE WHEN n % 11 = 0 THEN 'N.A.' ELSE format('{:,.2f}', n * 11.5::DOUBLE) END,
      format('{:,.2f}', n * 5.5::DOUBLE) || ' - ',
      lpad(CAST(1 + (n + 3) % 12 AS VARCHAR), 2, '0') || '/' || CAST(1995 + (n + 3) % 7 AS VARCHAR) || chr(10) || '-',
      lpad(CAST(1 + (n + 5) % 12 AS VARCHAR), 2, '0') || '/' || CAST(1995 + (n + 5) % 7 AS VARCHAR),
      CAST(n % 50 AS VARCHAR), CASE WHEN n % 3 = 0 THEN '-' ELSE CAST(n % 30 AS VARCHAR) END,
      CASE WHEN n % 4 = 0 THEN 'Land' || chr(10) || 'acquisition' ELSE 'Nil' END] END AS cells
  FROM named_lines),
flagged_cells AS (
  SELECT *, cells[1] = '' AND cells[2] <> '' AND regexp_matches(cells[2], '[A-Za-z]') AND cells[2] = upper(cells[2])
              AND len(list_filter(cells[4:], lambda c: trim(c) <> '')) = 0 AS is_header,
         regexp_full_match(cells[1], '[0-9]+') AND cells[2] <> '' AND lower(cells[2]) NOT IN ('total', 'grand total') AS is_project
  FROM cells_t),
filled_cells AS (
  SELECT *, coalesce(last_value(CASE WHEN is_header THEN cells[2] END IGNORE NULLS)
           OVER (PARTITION BY doc_id ORDER BY page, "row" ROWS UNBOUNDED PRECEDING), 'Unknown') AS sector
  FROM flagged_cells)"""

_RULES = """
rules_t AS (
  SELECT project_id, sector,
    CASE WHEN state IN ('NATION_0', 'NATION_1', 'NATION_2') THEN 'North-East' ELSE state END AS state_region,
    CAST(o_orderdate AS DATE) AS start_date,
    CAST(o_orderdate AS DATE) + CAST(planned_duration_years * 365 AS INTEGER) AS original_completion_date,
    CAST(o_orderdate AS DATE) + CAST(planned_duration_years * 365 AS INTEGER) + CAST(coalesce(tor_months, 0) AS INTEGER) * 30
      AS revised_completion_date,
    original_cost_cr AS original_budget_cr, coalesce(anticipated_cost_cr, original_cost_cr) AS revised_budget_cr,
    CAST((project_id * 7) % 101 AS DOUBLE) AS physical_progress_pct, CAST((project_id * 13) % 101 AS DOUBLE) AS financial_progress_pct,
    CAST((project_id * 11) % 101 AS DOUBLE) AS land_acquisition_pct,
    ['Cleared', 'Pending', 'In-Review'][CAST(o_custkey % 3 + 1 AS INTEGER)] AS env_clearance_status,
    project_id % 4 = 0 AS litigation_active, ['Tier 1', 'Tier 2', 'Tier 3'][CAST(project_id % 3 + 1 AS INTEGER)] AS contractor_tier,
    CAST(coalesce(tor_months, 0) AS INTEGER) AS delay_months, cost_overrun_pct
  FROM time_t JOIN orders ON project_id = o_orderkey)"""

_PRICES = """
prices_t AS (
  SELECT year(o_orderdate) AS year, CASE WHEN year(o_orderdate) <> 1997 THEN round(avg(l_extendedprice), 2) END AS wpi_metal,
         round(avg(l_quantity), 4) AS wpi_cement, round(avg(l_tax * 1000), 4) AS fx_usd
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY year(o_orderdate))"""

_PARTS = {
    "time": (_ORDER_LINES, _TIME),
    "cost": (_COST,),
    "snap": (_ORDER_LINES, _TIME, _COST, _SNAPSHOT),
    "view": (_ORDER_LINES, _TIME, _VIEW),
    "state": (_ORDER_LINES, _TIME, _VIEW, _STATE),
    "cells": (_CELLS,),
    "rules": (_ORDER_LINES, _TIME, _RULES),
    "prices": (_PRICES,),
}


def with_views(needs: str, sql: str) -> str:
    """``sql`` (a SELECT, or further CTEs and a SELECT after 'WITH') on top of the views it needs."""
    parts: dict[str, None] = {}
    for need in needs.split():
        for part in _PARTS[need]:
            parts[part] = None
    order = [_ORDER_LINES, _TIME, _COST, _SNAPSHOT, _VIEW, _STATE, _CELLS, _RULES, _PRICES]
    ctes = [p.strip() for p in order if p in parts]
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return "WITH " + ",\n".join([*ctes, body[5:]])
    return "WITH " + ",\n".join(ctes) + "\n" + body if ctes else body


def query(name: str, needs: str = "", sql: str | None = None):
    """Register a query; ``sql`` is its oracle on top of the views in ``needs``."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query: {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_views(needs, sql)
        return fn

    return register


_WRITTEN: dict[tuple[str, str], DataFrame] = {}


def view(spark: SparkSession, folder: str) -> DataFrame:
    """The scored portfolio view, written once per application and folder and read by every page.

    Input tables are taken as unchanging while the application runs; ``refresh_view`` forgets what was written.
    """
    key = (spark.sparkContext.applicationId, folder)
    if key not in _WRITTEN:
        _WRITTEN[key] = cut_lineage(features.portfolio_view(dt.time_table(spark, folder)))
    return _WRITTEN[key]


def refresh_view(folder: str) -> None:
    for key in [k for k in _WRITTEN if k[1] == folder]:
        del _WRITTEN[key]
