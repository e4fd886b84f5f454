"""Readers, writers and streams: driver rows go out through a sink and come back through a source."""

import uuid

from pyspark.sql import functions as F

from ..operators import assembly
from ..session import shared_folder
from ..sources import driver_tables as dt
from ..sources import sinks, tables
from ..streaming import reports
from .base import query


def scratch(spark, name):
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


PROJECT_COLUMNS = (
    "sector", "project_name", "original_cost_cr", "anticipated_cost_cr", "expenditure_cum_cr", "approval_year", "planned_doc_year",
    "tor_months", "cost_overrun_pct", "reasons", "delayed", "planned_duration_years", "overrun_ratio", "geo_latitude", "geo_longitude",
)
DOMAIN_SQL = """SELECT sector, project_name, original_cost_cr, anticipated_cost_cr, expenditure_cum_cr, CAST(approval_year AS DOUBLE) AS approval_year,
  CAST(planned_doc_year AS DOUBLE) AS planned_doc_year, tor_months, round(cost_overrun_pct, 4) AS cost_overrun_pct, reasons, delayed, planned_duration_years,
  round(overrun_ratio, 6) AS overrun_ratio, round(geo_latitude, 6) AS geo_latitude, round(geo_longitude, 6) AS geo_longitude FROM time_t"""


def domain_rows(spark, d):
    t = dt.time_table(spark, d).select(*PROJECT_COLUMNS)
    return t.withColumns(
        {
            "approval_year": F.col("approval_year").cast("double"),
            "planned_doc_year": F.col("planned_doc_year").cast("double"),
            "overrun_ratio": F.round("overrun_ratio", 6),
            "geo_latitude": F.round("geo_latitude", 6),
            "geo_longitude": F.round("geo_longitude", 6),
        }
    )


@query("read_projects_parquet", "time", DOMAIN_SQL)
def _(spark, d):
    path = scratch(spark, "projects")
    domain_rows(spark, d).withColumn("tor_months", F.coalesce("tor_months", F.lit(float("nan")))).write.parquet(path)
    return tables.read_projects(spark, path, "time")


@query("read_projects_csv", "time", DOMAIN_SQL)
def _(spark, d):
    path = scratch(spark, "projects")
    domain_rows(spark, d).write.option("header", True).csv(path)
    return tables.read_projects(spark, path, "time", "csv")


@query("read_dim", "prices", "SELECT year, wpi_metal, wpi_cement, fx_usd FROM prices_t")
def _(spark, d):
    path = scratch(spark, "prices")
    dt.yearly_prices(spark, d).coalesce(1).write.option("header", True).csv(path)
    return tables.read_dim(spark, path, "price")


@query(
    "read_portal_export", "",
    """SELECT CAST(o_orderkey + 1 AS INTEGER) AS serial, c_mktsegment AS sector, 'Ministry, ' || o_orderstatus AS line_ministry, 'P' || CAST(o_orderkey AS VARCHAR) AS project_id,
         'Line one' || chr(10) || o_orderpriority AS project_name, o_totalprice AS original_cost_cr, CAST(NULL AS DOUBLE) AS revised_cost_cr, CAST(o_custkey AS DOUBLE) AS expenditure_cum_cr
       FROM orders JOIN customer ON o_custkey = c_custkey""",
)
def _(spark, d):
    path = scratch(spark, "export")
    orders = dt.load(spark, d, "orders").join(dt.load(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    quoted = F.concat(
        F.lit('"'),
        F.concat_ws(
            '","',
            (F.col("o_orderkey") + 1).cast("string"), "c_mktsegment", F.concat(F.lit("Ministry, "), "o_orderstatus"),
            F.concat(F.lit("P"), F.col("o_orderkey").cast("string")), F.concat(F.lit("Line one\n"), "o_orderpriority"),
            F.format_number("o_totalprice", 2), F.lit("-"), F.col("o_custkey").cast("string"),
        ),
        F.lit('"'),
    )
    title = '"Sector wise report"\n\n"Sr.\nNo.","Sector","Line Ministry","ProjectID","Project\nName","Original\nCost","Latest Revised Cost","Expenditure"'
    head = spark.range(1).select(F.lit(title).alias("value"))
    head.unionByName(orders.select(quoted.alias("value"))).write.text(path)
    return tables.read_portal_export(spark, path)


@query("write_table", "time", "SELECT sector, count(*) AS n, min(approval_year) AS first_year FROM time_t WHERE approval_year > 1998 GROUP BY sector")
def _(spark, d):
    table = scratch(spark, "table")
    t = dt.time_table(spark, d).select("project_id", "sector", "approval_year")
    sinks.write_table(t, table)
    # the second version is computed from the first, which must stay readable meanwhile
    sinks.write_table(sinks.read_table(spark, table).filter("approval_year > 1998"), table)
    return sinks.read_table(spark, table).groupBy("sector").agg(F.count(F.lit(1)).alias("n"), F.min("approval_year").alias("first_year"))


@query(
    "write_metrics", "time",
    """SELECT 'base_rate' AS experiment, approval_year AS cutoff, 'time' AS task, 'rate' AS metric, round(avg(CAST(delayed > 0 AS DOUBLE)), 6) AS value FROM time_t GROUP BY approval_year
       UNION ALL SELECT 'base_rate', approval_year, 'time', 'n', CAST(count(delayed) AS DOUBLE) FROM time_t GROUP BY approval_year""",
)
def _(spark, d):
    from ..operators.portfolio import cohort_base_rates

    path = scratch(spark, "metrics")
    rates = cohort_base_rates(dt.time_table(spark, d), "delayed")
    for metric in ("rate", "n"):
        row = rates.select(
            F.lit("base_rate").alias("experiment"), F.col("approval_year").alias("cutoff"), F.lit("time").alias("task"),
            F.lit(metric).alias("metric"), F.round(F.col(metric).cast("double"), 6).alias("value"),
        )
        sinks.write_metrics(row, path)
    return spark.read.schema(sinks.METRICS_SCHEMA).parquet(path)


@query("write_jsonl", "view", "SELECT project_id, sector, cost_risk, reasons FROM view_t")
def _(spark, d):
    from .base import view

    path = scratch(spark, "jsonl")
    sinks.write_jsonl(view(spark, d).select("project_id", "sector", "cost_risk", "reasons"), path)
    return spark.read.schema("project_id long, sector string, cost_risk double, reasons string").json(path)


@query(
    "stream_upsert", "",
    """SELECT CAST(user_id AS VARCHAR) AS user_id, event_type, event_id, value FROM (
         SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""",
)
def _(spark, d):
    table, checkpoint = scratch(spark, "events"), scratch(spark, "checkpoint")
    schema = dt.load(spark, d, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    reports.stream_upsert(stream, table, ["user_id", "event_type"], ["ts", "event_id"], checkpoint).awaitTermination()
    return sinks.read_table(spark, table).select("user_id", "event_type", "event_id", "value")


@query(
    "stream_upsert_census", "time",
    """SELECT CAST(project_id AS VARCHAR) AS project_id, sector, coalesce(delayed, 0) AS delayed,
         CASE WHEN coalesce(delayed, 0) = 0 OR tor_months IS NULL THEN 0 ELSE least(tor_months, 240) END AS tor_months, CAST(planned_doc_year - approval_year AS DOUBLE) AS planned_duration_years
       FROM time_t""",
)
def _(spark, d):
    """The TIME table kept by a stream of yearly reports, labels aged as they arrive; each project arrives twice, the last row counts."""
    source, table = scratch(spark, "reports"), scratch(spark, "time")
    t = dt.time_table(spark, d).select("project_id", "sector", "approval_year", "planned_doc_year", "tor_months", F.coalesce("delayed", F.lit(0)).alias("delayed"))
    first = t.withColumns({"report": F.lit(0), "tor_months": F.lit(900.0), "delayed": F.lit(1)})
    both = first.unionByName(t.withColumn("report", F.lit(1)))
    both.write.partitionBy("report").parquet(source)
    stream = spark.readStream.schema(both.schema).parquet(source)
    age = lambda rows: assembly.census_age(rows.withColumn("planned_duration_years", F.lit(None).cast("double")))
    reports.stream_upsert(stream, table, ["project_id"], ["report"], scratch(spark, "checkpoint"), prepare=age).awaitTermination()
    return sinks.read_table(spark, table).select("project_id", "sector", "delayed", "tor_months", "planned_duration_years")
