"""Fixed schemas of the domain tables."""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {"s": T.StringType(), "d": T.DoubleType(), "i": T.IntegerType(), "b": T.BooleanType(), "t": T.DateType()}


def _schema(spec: str) -> T.StructType:
    fields = (item.split(":") for item in spec.split())
    return T.StructType([T.StructField(name, _TYPES[kind], True) for name, kind in fields])


COST = _schema(
    "sector:s project_name:s original_cost_cr:d revised_cost_cr:d anticipated_cost_cr:d expenditure_cum_cr:d "
    "cost_overrun_pct:d overrun_flag:i overrun_ratio:d geo_latitude:d geo_longitude:d"
)
TIME = _schema(
    "sector:s project_name:s original_cost_cr:d anticipated_cost_cr:d expenditure_cum_cr:d approval_year:d "
    "planned_doc_year:d tor_months:d cost_overrun_pct:d reasons:s delayed:i planned_duration_years:d overrun_ratio:d "
    "geo_latitude:d geo_longitude:d"
)
SNAPSHOT = _schema(
    "sector:s project_name:s original_cost_cr:d revised_cost_cr:d anticipated_cost_cr:d expenditure_cum_cr:d "
    "approval_year:d original_doc_year:d tor_months:d delayed:d planned_duration_years:d cost_overrun_pct:d "
    "overrun_flag:i overrun_ratio:d physical_progress:d geo_latitude:d geo_longitude:d"
)
STATE = _schema("state:s n_projects:i cost_overrun_pct:d tor_min_months:i tor_max_months:i delay_risk:d")
PRICE = _schema("year:i wpi_metal:d wpi_cement:d fx_usd:d")
MACRO = _schema("year:i wpi_inflation_pct:d cpi_inflation_pct:d repo_rate_pct:d gdp_growth_pct:d")
RULES = _schema(
    "project_id:s sector:s state_region:s executing_agency:s start_date:t original_completion_date:t "
    "revised_completion_date:t original_budget_cr:d revised_budget_cr:d expenditure_todate_cr:d "
    "physical_progress_pct:d financial_progress_pct:d land_acquisition_pct:d env_clearance_status:s "
    "litigation_active:b contractor_tier:s delay_months:i cost_overrun_pct:d risk_level:s geo_latitude:d "
    "geo_longitude:d"
)

PROJECT_TABLES = {"cost": COST, "time": TIME, "snapshot": SNAPSHOT, "rules": RULES}
DIMENSIONS = {"state": STATE, "price": PRICE, "macro": MACRO}
