"""Order statistics without a single-task window.

A window with no partition key moves every row into one task. The recipes here first collapse the input to one row per distinct
value (partial aggregation on the map side) and deal these by value into ranges of about equal size, which is written once: a range
partitioning samples its bounds, so they must not be drawn again. A local window inside each range and the totals of earlier
ranges give exact running sums; metrics probe them as plain filters and sums. Only the ranges' totals, a few for each task, are
ordered globally.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, sized

_PART = "__part"


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join that treats NULL keys as equal and keeps one copy of the keys; the range is never NULL."""
    renamed = right.select(
        *[F.col(k).alias(f"__r_{k}") for k in keys],
        *[c for c in right.columns if c not in keys],
    )
    cond = None
    for k in keys:
        term = left[k] == renamed[f"__r_{k}"] if k == _PART else left[k].eqNullSafe(renamed[f"__r_{k}"])
        cond = term if cond is None else cond & term
    joined = left.join(renamed, cond, how)
    return joined.drop(*[f"__r_{k}" for k in keys])


def running_totals(
    df: DataFrame,
    order_col: str,
    totals: Sequence[str],
    by: Sequence[str] = (),
    descending: bool = False,
) -> DataFrame:
    """Exclusive running sums and group totals, distributed.

    ``df`` holds one row per (``by``, ``order_col``). For every column c in ``totals`` the result adds ``c_before`` (sum over earlier
    rows) and ``c_total`` (sum over the group). Runs one job that writes ``df`` by ranges; the result reads what was written.
    """
    by = list(by)
    keys = [F.col(k) for k in [*by, order_col]]
    placed = cut_lineage(df.repartitionByRange(*keys).withColumn(_PART, F.spark_partition_id()))
    local = Window.partitionBy(_PART, *by).orderBy(order_col).rowsBetween(Window.unboundedPreceding, -1)
    scanned = placed.select("*", *[F.coalesce(F.sum(c).over(local), F.lit(0)).alias(f"__l_{c}") for c in totals])
    per_part = placed.groupBy(*by, _PART).agg(*[F.sum(c).alias(f"__s_{c}") for c in totals])
    group = Window.partitionBy(*by)  # a row for each range that the group reaches into
    earlier = group.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_part.select(
        *by,
        _PART,
        *[F.coalesce(F.sum(f"__s_{c}").over(earlier), F.lit(0)).alias(f"__o_{c}") for c in totals],
        *[F.sum(f"__s_{c}").over(group).alias(f"{c}_total") for c in totals],
    )
    joined = null_safe_join(scanned, offsets, [*by, _PART])

    def before(c: str) -> Column:
        lower = F.col(f"__l_{c}") + F.col(f"__o_{c}")
        return F.col(f"{c}_total") - lower - F.coalesce(F.col(c), F.lit(0)) if descending else lower

    return joined.select(*df.columns, *[before(c).alias(f"{c}_before") for c in totals], *[f"{c}_total" for c in totals])


def _values(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """One row per (``by``, column name, non-null value) of every row."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns])
    rows = df.select(*by, F.explode(pairs).alias("p")).select(*by, "p.column", "p.value")
    return rows.filter(F.col("value").isNotNull() & ~F.isnan("value"))


def value_counts(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """One row per (``by``, column name, distinct non-null value) with its count ``n``."""
    return _values(df, columns, by).groupBy(*by, "column", "value").agg(F.count(F.lit(1)).alias("n"))


def _bucket(v: Column) -> Column:
    """A whole number that never falls with ``v``: 64 buckets between a number and its double, on both sides of zero."""
    size = F.lit(100_000) + F.floor(F.least(F.log2(F.abs(v)), F.lit(1100.0)) * 64)
    return F.when(v == 0, F.lit(0).cast("long")).when(v > 0, size).otherwise(-size)


def exact_percentiles(
    df: DataFrame,
    columns: Sequence[str],
    probs: Sequence[float] = (0.5,),
    by: Sequence[str] = (),
) -> DataFrame:
    """Exact percentiles with linear interpolation: ``by``, column, prob, value.

    The built-in ``percentile`` keeps every distinct value of a group in one task. Here the columns are written once, rows are counted
    by bucket in the first scan (``_bucket``, combined on the map side), and only the values of the buckets that hold a wanted place are
    collapsed and ordered, over (group, bucket, range).
    """
    by, columns = list(by), list(dict.fromkeys(columns))
    keys = [*by, "column"]
    rows = cut_lineage(df.select(*by, *[F.col(c).cast("double").alias(c) for c in columns if c not in by]))
    located = _values(rows, columns, by).withColumn("__bucket", _bucket(F.col("value")))
    group = Window.partitionBy(*keys)  # a row per bucket, which are limited by the range of a double
    earlier = group.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = located.groupBy(*keys, "__bucket").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.select("*", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n_before"), F.sum("n").over(group).alias("n_total"))

    def holds(position: Column) -> Column:
        return (F.col("n_before") <= position) & (position < F.col("n_before") + F.col("n"))

    wanted = F.lit(False)
    for p in probs:
        rank = F.lit(float(p)) * (F.col("n_total") - 1)
        wanted = wanted | holds(F.floor(rank)) | holds(F.ceil(rank))
    wanted = sized(counts.filter(wanted).select(*keys, "__bucket", F.col("n_before").alias("__first"), F.col("n_total").alias("__size")))
    held = null_safe_join(located, wanted, [*keys, "__bucket"])
    dist = held.groupBy(*keys, "__bucket", "value", "__first", "__size").agg(F.count(F.lit(1)).alias("n"))
    placed = running_totals(dist, "value", ["n"], [*keys, "__bucket"])
    placed = placed.withColumns({"n_before": F.col("n_before") + F.col("__first"), "n_total": F.col("__size")})
    return (
        placed.withColumn("prob", F.explode(F.array(*[F.lit(float(p)) for p in probs])))
        .withColumn("rank", F.col("prob") * (F.col("n_total") - 1))
        .filter(holds(F.floor("rank")) | holds(F.ceil("rank")))
        .groupBy(*keys, "prob")
        .agg(
            F.max(F.when(holds(F.floor("rank")), F.col("value"))).alias("low"),
            F.max(F.when(holds(F.ceil("rank")), F.col("value"))).alias("high"),
            F.max(F.col("rank") - F.floor("rank")).alias("part"),
        )
        .select(*keys, "prob", (F.col("low") + F.col("part") * (F.col("high") - F.col("low"))).alias("value"))
    )


def medians_row(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row with the exact median of each column (NULL for an empty column)."""
    found = exact_percentiles(df, columns, (0.5,))
    return found.agg(*[F.max(F.when(F.col("column") == c, F.col("value"))).alias(c) for c in columns])


def scalar_medians(df: DataFrame, columns: Sequence[str]) -> dict[str, Column]:
    """Medians as lazy scalar-subquery columns, keyed by column name."""
    packed = medians_row(df, columns).select(F.struct(*columns)).scalar()
    return {c: packed.getField(c) for c in columns}


def rank_cut(df: DataFrame, score: str, tie_id: str, k: Callable[[Column], Column]) -> DataFrame:
    """Rows of the top k by ``score`` descending, ties by the unique ``tie_id`` ascending; NULL scores come last.

    ``k`` maps the row count to the number wanted; it may be any share of the table, so there is no sort-and-limit: the cut is
    found on the distribution of scores. Its score and the last id that is taken of the rows tied there are two values, known before the rows are filtered.
    """
    rows = cut_lineage(df)
    dist = rows.groupBy(F.col(score).alias("__score")).agg(F.count(F.lit(1)).alias("n"))
    placed = running_totals(dist, "__score", ["n"], descending=True)
    wanted = F.least(k(F.col("n_total")), F.col("n_total"))
    holds = (F.col("n_before") < wanted) & (F.col("n_before") + F.col("n") >= wanted)
    cut = placed.filter(holds).select("__score", "n", (wanted - F.col("n_before")).alias("room")).first()
    if cut is None:
        return rows.limit(0)
    at = F.lit(cut["__score"]).cast(df.schema[score].dataType)
    above = F.col(score).isNotNull() if cut["__score"] is None else F.col(score) > at
    tied = F.col(score).eqNullSafe(at)
    if cut["room"] < cut["n"]:
        ids = rows.filter(tied).select(F.col(tie_id).alias("__id"), F.lit(1).alias("n"))
        last = running_totals(ids, "__id", ["n"]).filter(F.col("n_before") == cut["room"] - 1).select("__id").first()
        tied = tied & (F.col(tie_id) <= F.lit(last["__id"]))
    return rows.filter(above | tied)


def global_rank(df: DataFrame, order: Sequence[Column], output: str) -> DataFrame:
    """``df`` with its 0-based place in ``order``: a range partitioning, and the counts of earlier parts added.

    Runs once and is written, since the bounds of a range partitioning may differ between runs.
    """
    sorted_ = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__place", F.monotonically_increasing_id())
    placed = cut_lineage(sorted_.withColumn("__part", F.shiftright("__place", 33)))
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part
    parts = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(earlier), F.lit(0)))
    place = F.col("__before") + F.col("__place").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(F.broadcast(parts.select("__part", "__before")), "__part").select(*df.columns, place.alias(output))
