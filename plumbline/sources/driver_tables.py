"""Order-and-line tables seen as project tables.

An order is a project: its customer gives sector and state, its lines give the
anticipated cost and the completion date. A line is a cost row. ``events``
stands for arriving reports and ``documents`` for extracted report pages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SNAP_YEAR = 2001.92
PAGE_LINES = 5


_SCHEMAS: dict[str, T.StructType] = {}


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Read a driver table; its schema is inferred once per path, since inference is a Spark job of its own."""
    path = f"{folder}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def _month(c):
    return F.year(c) * 12 + F.month(c)


def nation_centroids(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("n_nationkey")
    return load(spark, folder, "nation").select(
        F.col("n_name").alias("state"), (8 + key * 1.0).alias("lat"), (70 + key * 0.9).alias("lon")
    )


def _order_lines(spark: SparkSession, folder: str) -> DataFrame:
    price = F.col("l_extendedprice")
    return (
        load(spark, folder, "lineitem")
        .groupBy("l_orderkey")
        .agg(
            F.round(F.sum(price), 2).alias("anticipated_cost_cr"),
            F.round(F.sum(F.when(F.col("l_linestatus") == "F", price)), 2).alias("spent"),
            F.max("l_shipdate").alias("last_ship"),
        )
    )


def time_table(spark: SparkSession, folder: str) -> DataFrame:
    """TIME: one row per order, unique project_id."""
    orders = load(spark, folder, "orders")
    customer = load(spark, folder, "customer")
    nation = load(spark, folder, "nation")
    key, planned = F.col("o_orderkey"), F.substring("o_orderpriority", 1, 1).cast("double")
    start = _month(F.col("o_orderdate"))
    gap = _month(F.col("last_ship")) - (start + planned.cast("int") * 12)
    orig, ant = F.col("o_totalprice"), F.col("anticipated_cost_cr")
    pct = F.coalesce(F.greatest(F.lit(0.0), F.round(100 * (ant - orig) / F.when(orig > 0, orig), 4)), F.lit(0.0))
    place = key % 5 != 0
    base = (
        orders.join(customer, orders.o_custkey == customer.c_custkey)
        .join(nation, customer.c_nationkey == nation.n_nationkey)
        .join(_order_lines(spark, folder), key == F.col("l_orderkey"), "left")
    )
    return base.select(
        key.alias("project_id"),
        F.col("c_mktsegment").alias("sector"),
        F.concat(
            F.lit("Project "), key.cast("string"), F.lit(" - [0"), F.col("o_custkey").cast("string"), F.lit("]"),
            F.col("o_orderpriority"), F.lit(","), F.col("n_name"),
        ).alias("project_name"),
        F.col("n_name").alias("state"),
        F.col("o_orderpriority").alias("agency"),
        F.year("o_orderdate").alias("approval_year"),
        planned.alias("planned_duration_years"),
        (F.year("o_orderdate") + planned.cast("int")).alias("planned_doc_year"),
        (start + planned.cast("int") * 12).alias("original_doc_index"),
        _month(F.col("last_ship")).alias("anticipated_doc_index"),
        orig.alias("original_cost_cr"),
        ant,
        F.coalesce("spent", F.lit(0.0)).alias("expenditure_cum_cr"),
        F.greatest(gap, F.when(gap.isNotNull(), F.lit(0))).cast("double").alias("tor_months"),
        (gap > 0).cast("int").alias("delayed"),
        pct.alias("cost_overrun_pct"),
        (pct / 100).alias("overrun_ratio"),
        F.when(F.col("o_orderstatus") == "F", F.lit("Land acquisition pending"))
        .when(F.col("o_orderstatus") == "O", F.lit("N/A"))
        .alias("reasons"),
        F.when(place, 8 + F.col("n_nationkey") * 1.0 + (key % 7) * 0.01).alias("geo_latitude"),
        F.when(place, 70 + F.col("n_nationkey") * 0.9).alias("geo_longitude"),
        F.lit(SNAP_YEAR).alias("snap_year"),
    )


def order_dates(spark: SparkSession, folder: str) -> DataFrame:
    """project_id, approval_year and planned_duration_years of the TIME rows, without their lines."""
    orders, customer, nation = (load(spark, folder, t) for t in ("orders", "customer", "nation"))
    placed = orders.join(customer, orders.o_custkey == customer.c_custkey).join(nation, customer.c_nationkey == nation.n_nationkey)
    return placed.select(
        F.col("o_orderkey").alias("project_id"),
        F.year("o_orderdate").alias("approval_year"),
        F.substring("o_orderpriority", 1, 1).cast("double").alias("planned_duration_years"),
    )


def cost_table(spark: SparkSession, folder: str) -> DataFrame:
    """COST: one row per order line; project_id repeats."""
    line = load(spark, folder, "lineitem")
    part = load(spark, folder, "part")
    supplier = load(spark, folder, "supplier")
    nation = load(spark, folder, "nation")
    orig = F.round(F.col("l_quantity") * F.col("p_retailprice"), 2)
    ant = F.round(F.col("l_extendedprice") * (1 + F.col("l_tax")), 4)
    ratio = (F.col("anticipated_cost_cr") - F.col("original_cost_cr")) / F.col("original_cost_cr")
    place = F.col("l_suppkey") % 4 != 0
    base = (
        line.join(part, line.l_partkey == part.p_partkey)
        .join(supplier, line.l_suppkey == supplier.s_suppkey)
        .join(nation, supplier.s_nationkey == nation.n_nationkey)
        .withColumn("original_cost_cr", orig)
        .withColumn("anticipated_cost_cr", ant)
    )
    return base.select(
        F.col("l_orderkey").alias("project_id"),
        F.col("l_linenumber").alias("line"),
        F.col("p_type").alias("sector"),
        F.concat(
            F.lit("Line "), F.col("l_orderkey").cast("string"), F.lit(" "), F.col("p_name"), F.lit(" ["),
            F.col("l_partkey").cast("string"), F.lit("]"), F.col("s_name"), F.lit(","), F.col("n_name"),
        ).alias("project_name"),
        F.col("n_name").alias("state"),
        F.col("s_name").alias("agency"),
        "original_cost_cr",
        F.when(F.col("l_returnflag") != "N", F.col("l_extendedprice")).alias("revised_cost_cr"),
        "anticipated_cost_cr",
        F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4).alias("expenditure_cum_cr"),
        ratio.alias("overrun_ratio"),
        (ratio > 0.05).cast("int").alias("overrun_flag"),
        F.round(100 * ratio, 2).alias("cost_overrun_pct"),
        F.when(place, 8 + F.col("n_nationkey") * 1.0).alias("geo_latitude"),
        F.when(place, 70 + F.col("n_nationkey") * 0.9).alias("geo_longitude"),
        _month(F.col("l_shipdate")).alias("anticipated_doc_index"),
        F.lit(SNAP_YEAR).alias("snap_year"),
    )


def snapshot_table(spark: SparkSession, folder: str) -> DataFrame:
    """SNAPSHOT before labels: cost rows with the dates of their order."""
    dates = time_table(spark, folder).select(
        "project_id", "approval_year", F.col("planned_doc_year").alias("original_doc_year"), "original_doc_index"
    )
    return cost_table(spark, folder).drop("overrun_ratio", "overrun_flag", "cost_overrun_pct").join(dates, "project_id")


def cell_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Extracted cells: every document line is one table row, short lines are header rows."""
    lines = load(spark, folder, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    name = F.trim(F.regexp_replace("line", "[^A-Za-z0-9 ]", ""))
    named = lines.withColumn("name", name).withColumn("n", F.length("name"))
    n, i = F.col("n"), F.col("i")

    def money(c):
        return F.format_number(c, 2)

    def date(shift):
        return F.concat(F.lpad((1 + (n + shift) % 12).cast("string"), 2, "0"), F.lit("/"), (1995 + (n + shift) % 7).cast("string"))

    blank = F.lit("")
    header = F.array(blank, F.upper("name"), *[blank] * 9)
    data = F.array(
        (i + 1).cast("string"),
        F.col("name"),
        date(0),
        F.concat(money(n * 10.0), F.lit("\n"), F.when(n % 2 == 0, F.lit("-")).otherwise(money(n * 12.5))),
        F.when(n % 11 == 0, F.lit("N.A.")).otherwise(money(n * 11.5)),
        F.concat(money(n * 5.5), F.lit(" - ")),
        F.concat(date(3), F.lit("\n-")),
        date(5),
        (n % 50).cast("string"),
        F.when(n % 3 == 0, F.lit("-")).otherwise((n % 30).cast("string")),
        F.when(n % 4 == 0, F.lit("Land\nacquisition")).otherwise(F.lit("Nil")),
    )
    return named.select(
        "doc_id",
        F.floor(i / PAGE_LINES).cast("int").alias("page"),
        (i % PAGE_LINES).alias("row"),
        "line",
        # A generator keeps the optimizer from copying the cell expressions into every predicate on cells.
        F.explode(F.array(F.when(n < 30, header).otherwise(data))).alias("cells"),
    )


def rule_table(spark: SparkSession, folder: str) -> DataFrame:
    """Rule table: planned and revised dates and budgets of an order plus progress figures from its keys."""
    t = time_table(spark, folder)
    orders = load(spark, folder, "orders").select("o_orderkey", "o_orderdate", "o_custkey")
    key = F.col("project_id")
    start = F.to_date("o_orderdate")
    days = (F.col("planned_duration_years") * 365).cast("int")
    return t.join(orders, key == F.col("o_orderkey")).select(
        key,
        "sector",
        F.when(F.col("state").isin("NATION_0", "NATION_1", "NATION_2"), F.lit("North-East")).otherwise(F.col("state")).alias("state_region"),
        start.alias("start_date"),
        F.date_add(start, days).alias("original_completion_date"),
        F.date_add(start, days + F.coalesce("tor_months", F.lit(0.0)).cast("int") * 30).alias("revised_completion_date"),
        F.col("original_cost_cr").alias("original_budget_cr"),
        F.coalesce("anticipated_cost_cr", "original_cost_cr").alias("revised_budget_cr"),
        ((key * 7) % 101).cast("double").alias("physical_progress_pct"),
        ((key * 13) % 101).cast("double").alias("financial_progress_pct"),
        ((key * 11) % 101).cast("double").alias("land_acquisition_pct"),
        F.element_at(F.array(F.lit("Cleared"), F.lit("Pending"), F.lit("In-Review")), (F.col("o_custkey") % 3 + 1).cast("int")).alias("env_clearance_status"),
        (key % 4 == 0).alias("litigation_active"),
        F.element_at(F.array(F.lit("Tier 1"), F.lit("Tier 2"), F.lit("Tier 3")), (key % 3 + 1).cast("int")).alias("contractor_tier"),
        F.coalesce("tor_months", F.lit(0.0)).cast("int").alias("delay_months"),
        "cost_overrun_pct",
    )


def yearly_prices(spark: SparkSession, folder: str) -> DataFrame:
    """Price index by order year: three price levels derived from the lines of that year."""
    o = load(spark, folder, "orders").select("o_orderkey", F.year("o_orderdate").alias("year"))
    line = load(spark, folder, "lineitem").select("l_orderkey", "l_extendedprice", "l_quantity", "l_tax")
    return (
        line.join(o, line.l_orderkey == o.o_orderkey)
        .groupBy("year")
        .agg(
            F.when(F.col("year") != 1997, F.round(F.avg("l_extendedprice"), 2)).alias("wpi_metal"),
            F.round(F.avg("l_quantity"), 4).alias("wpi_cement"),
            F.round(F.avg(F.col("l_tax") * 1000), 4).alias("fx_usd"),
        )
    )
