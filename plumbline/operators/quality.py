"""Data-quality checks: one aggregate each, loud when asked to be."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class SchemaViolation(ValueError):
    """A table does not have the promised shape."""


def schema_report(df: DataFrame, expected: Sequence[str], not_null: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """One row per finding: check, column, violations."""
    missing = [c for c in expected if c not in df.columns]
    extra = [c for c in df.columns if c not in expected]
    required = [c for c in not_null if c in df.columns]
    rows = [
        F.struct(F.lit("missing_column").alias("check"), F.lit(c).alias("column"), F.lit(1).cast("long").alias("violations"))
        for c in missing
    ] + [
        F.struct(F.lit("extra_column").alias("check"), F.lit(c).alias("column"), F.lit(1).cast("long").alias("violations"))
        for c in extra
    ]
    counts = df.agg(*[F.sum(F.col(c).isNull().cast("long")).alias(c) for c in required]) if required else None
    out = []
    if counts is not None:
        rows += [
            F.struct(F.lit("null").alias("check"), F.lit(c).alias("column"), F.coalesce(F.col(c), F.lit(0)).alias("violations"))
            for c in required
        ]
        out.append(counts.select(F.explode(F.array(*rows)).alias("r")).select("r.*"))
    elif rows:
        out.append(df.agg(F.count(F.lit(1)).alias("n")).select(F.explode(F.array(*rows)).alias("r")).select("r.*"))
    if keys:
        dup = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(
            F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("violations")
        )
        out.append(dup.select(F.lit("duplicate_key").alias("check"), F.lit("|".join(keys)).alias("column"), "violations"))
    result = out[0]
    for part in out[1:]:
        result = result.unionByName(part)
    return result


def validate_schema(df: DataFrame, expected: Sequence[str], not_null: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Raise ``SchemaViolation`` unless every finding is zero; returns ``df`` for chaining."""
    findings = schema_report(df, expected, not_null, keys).filter("violations > 0").collect()  # a row for each check and column
    if findings:
        raise SchemaViolation("; ".join(f"{r['check']} {r['column']}: {r['violations']}" for r in findings))
    return df


def rule_conditions(gap_points: float = 25.0, eps: float = 1e-6) -> dict[str, Column]:
    """Rule name -> condition that holds for a valid row (NULL inputs count as invalid)."""
    c = F.col
    close = F.abs(c("revised_budget_cr") - c("original_budget_cr")) <= 1e-8 + 1e-5 * F.abs(c("original_budget_cr"))
    return {
        "chronology_start_lt_orig": c("start_date") < c("original_completion_date"),
        "chronology_orig_lt_revised": ~(c("delay_months") > 0)
        | (c("original_completion_date") < c("revised_completion_date")),
        "zero_delay_cost_equal": (c("delay_months") != 0) | close,
        "high_delay_cost_gte_15pct": ~((c("delay_months") > 12) & (c("revised_budget_cr") > c("original_budget_cr")))
        | (c("revised_budget_cr") >= 1.15 * c("original_budget_cr")),
        "physical_financial_gap": c("financial_progress_pct") - c("physical_progress_pct") <= gap_points + eps,
        "land_constraint": ~(c("physical_progress_pct") > 60) | (c("land_acquisition_pct") > 75),
    }


def validate_rules(df: DataFrame, rules: Mapping[str, Column] | None = None) -> DataFrame:
    """Violations and verdict per rule, all rules in one pass."""
    rules = rules or rule_conditions()
    sums = df.agg(
        *[F.sum(F.when(F.coalesce(cond, F.lit(False)), 0).otherwise(1)).alias(name) for name, cond in rules.items()]
    )
    rows = F.array(*[F.struct(F.lit(n).alias("rule"), F.coalesce(F.col(n), F.lit(0)).alias("violations")) for n in rules])
    return sums.select(F.explode(rows).alias("r")).select(
        "r.rule", "r.violations", (F.col("r.violations") == 0).alias("passed")
    )


def target_leak_check(df: DataFrame, features: Sequence[str], label: str, threshold: float = 0.98) -> DataFrame:
    """Share of rows where feature > 0 equals the label, and single-feature AUC.

    A feature at or above ``threshold`` on either measure is flagged collinear.
    """
    from .evaluate import auc

    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("score")) for f in features])
    tall = df.filter(F.col(label).isNotNull()).select(F.explode(pairs).alias("p"), F.col(label).alias("label")).select(
        "p.feature", "p.score", "label"
    )
    agree = tall.groupBy("feature").agg(
        F.avg(((F.coalesce(F.col("score"), F.lit(0.0)) > 0).cast("int") == F.col("label")).cast("double")).alias("agreement")
    )
    scored = auc(tall.filter(F.col("score").isNotNull()), "score", "label", by=["feature"])
    strength = F.greatest(F.col("auc"), 1 - F.col("auc"))
    return agree.join(scored.select("feature", "auc"), "feature", "left").select(
        "feature",
        "agreement",
        "auc",
        F.coalesce((F.col("agreement") >= threshold) | (strength >= threshold), F.lit(False)).alias("collinear"),
    )


def profile(df: DataFrame, numeric: Sequence[str]) -> DataFrame:
    """Row count, nulls, distinct values, mean, min and max per numeric column, one pass over value counts."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in numeric])
    per_value = (
        df.select(F.explode(pairs).alias("p")).select("p.column", "p.value").groupBy("column", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    filled = F.when(F.col("value").isNotNull(), F.col("n"))
    return per_value.groupBy("column").agg(
        F.sum("n").alias("rows"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("nulls"),
        F.count("value").alias("distinct_values"),
        (F.sum(F.col("value") * F.col("n")) / F.sum(filled)).alias("mean"),
        F.min("value").alias("minimum"),
        F.max("value").alias("maximum"),
    )


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
