"""Readers: fixed schemas, NaN to NULL, loud on malformed input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..functions import fixed_values as fv
from ..functions.text import strip


def nan_to_null(df: DataFrame) -> DataFrame:
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats}) if floats else df


def _read(spark: SparkSession, path: str, schema: T.StructType, fmt: str) -> DataFrame:
    if fmt == "csv":
        reader = spark.read.schema(schema).options(header=True, multiLine=True, escape='"', mode="FAILFAST", nanValue="NaN")
        return nan_to_null(reader.csv(path))
    if fmt == "parquet":
        return nan_to_null(spark.read.schema(schema).parquet(path))
    raise ValueError(f"unknown format: {fmt}")


def read_projects(spark: SparkSession, path: str, kind: str, fmt: str = "parquet") -> DataFrame:
    """COST, TIME, SNAPSHOT or rule table. Large tables belong in parquet; CSV cells may hold line breaks."""
    return _read(spark, path, schemas.PROJECT_TABLES[kind], fmt)


def read_dim(spark: SparkSession, path: str, kind: str, fmt: str = "csv") -> DataFrame:
    """State, price or macro table. Joins leave the broadcast choice to the size statistics."""
    return _read(spark, path, schemas.DIMENSIONS[kind], fmt)


def state_centroids(spark: SparkSession) -> DataFrame:
    rows = [(n, lat, lon) for n, (lat, lon) in fv.STATE_CENTROIDS.items()]
    return spark.createDataFrame(rows, "state string, lat double, lon double")


PORTAL_COLUMNS = (
    "serial",
    "sector",
    "line_ministry",
    "project_id",
    "project_name",
    "original_cost_cr",
    "revised_cost_cr",
    "expenditure_cum_cr",
)


def read_portal_export(spark: SparkSession, path: str) -> DataFrame:
    """Portal CSV: title lines and the multi-line header fall out because their first cell is no number."""
    raw = T.StructType([T.StructField(c, T.StringType()) for c in PORTAL_COLUMNS])
    rows = spark.read.schema(raw).options(header=False, multiLine=True, escape='"').csv(path)
    number = ("original_cost_cr", "revised_cost_cr", "expenditure_cum_cr")
    return (
        rows.filter(strip(F.col("serial")).rlike("^[0-9]+$"))
        .withColumn("serial", strip(F.col("serial")).cast("int"))
        .withColumns({c: strip(F.replace(F.col(c), F.lit(","))).try_cast("double") for c in number})
    )
