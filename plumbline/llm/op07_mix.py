"""Mixing sources to target token numbers by entropy balancing.

Every document gets a rate r >= 0, the expected number of its copies. Among all rates that give each source its target, those
closest to the base rates q in token-weighted relative entropy are r = q * exp(lambda of the source), cut at the copy limit.
The lambdas solve a convex dual; its gradient and curvature are sums per source, taken by Spark in each Newton step from lambda 0
on. Base rates come from the documents: texts of symbols are repeated less than texts of letters (``base_rate``). Rates are
rounded to whole copies along one running total per source, so a source misses its target by about one document at most; a
few single copies then close most of that gap.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut_lineage, query, table, word_count

#: Rates are whole multiples of 1 / SCALE, so that their sums do not depend on an order of addition.
SCALE = 1_000_000


def weighted_sources(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1)) -> DataFrame:
    """``sizes`` (source, source_size) with ``weight``: the weights in turn, sources by code point, NULL last.

    Ranks come from a range partitioning and the counts of earlier parts, not from a window over all sources.
    """
    placed = cut_lineage(
        sizes.withColumn("missing", F.col("source").isNull())
        .repartitionByRange(F.col("missing"), F.col("source"))
        .sortWithinPartitions("missing", "source")
        .withColumn("place", F.monotonically_increasing_id())
        .withColumn("part", F.shiftright("place", 33))
    )
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each task
    parts = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    turn = (F.col("before") + F.col("place").bitwiseAND((1 << 33) - 1)) % len(weights)
    choose = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))
    return placed.join(parts, "part").select("source", "source_size", choose.alias("weight"))


def level_targets(weighted: DataFrame, limit: float = 3.0) -> DataFrame:
    """``weighted`` with ``target``: shares of all sizes by weight, none above ``limit`` times its source's size.

    What is cut off is shared again among the others by weight until no target is too large. Only the level, one number,
    goes through the driver; it rises in each round, and each round cuts at least one source.
    """
    total = weighted.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while True:
        cut = F.col("source_size") * limit <= F.col("weight") * level
        fixed, weight = weighted.agg(F.coalesce(F.sum(F.when(cut, F.col("source_size") * limit)), F.lit(0.0)), F.coalesce(F.sum(F.when(~cut, F.col("weight"))), F.lit(0.0))).first()
        new = (total - fixed) / weight if weight else level
        if new <= level * (1 + 1e-12):
            return weighted.withColumn("target", F.least(F.col("source_size") * limit, F.col("weight") * max(level, new)).cast("double"))
        level = new


def base_rate(text: Column, floor: float = 0.5, steps: int = 32) -> Column:
    """Base rate of a text, from ``floor`` to 1 by its share of letters and white space, in ``steps`` even steps.

    Few distinct rates keep the sums of a Newton step small. NULL and empty texts have rate 1.
    """
    share = F.try_divide(F.regexp_count(text, F.lit(r"[\p{L}\s]")), F.char_length(text))
    return F.coalesce(F.lit(floor) + (1 - floor) * F.round(share * steps) / steps, F.lit(1.0))


def balance(mass: DataFrame, targets: DataFrame, limit: float = 3.0, tolerance: float = 1e-9, steps: int = 60) -> DataFrame:
    """source, lambda of the dual: sum of tokens * min(limit, q * exp(lambda)) = target for every source.

    ``mass`` holds source, q (base rate) and tokens (their sum over documents of that q); ``targets`` holds source and target.
    Every lambda starts at 0 and each Newton step is one aggregation; a source stops where all its rates are at the limit.
    Sources stay distributed.

    The step is Newton's in exp(lambda), in which the sum is concave, rising and made of straight pieces: from below it never
    passes the solution and ends on the right piece after finitely many steps; from above one step leads below, or, where
    the tangent meets no positive value, lambda falls by one.
    """
    rows = cut_lineage(mass.join(targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s"))
    now = cut_lineage(rows.select(F.col("source").alias("s")).distinct().withColumn("lam", F.lit(0.0)))
    for _ in range(steps):
        rate = F.col("q") * F.exp("lam")
        moved = rows.join(now, F.col("source").eqNullSafe(F.col("s"))).groupBy("s", "lam").agg(
            (F.sum(F.col("tokens") * F.least(F.lit(limit), rate)) - F.max("target")).alias("gap"),
            F.sum(F.when(rate < limit, F.col("tokens") * rate).otherwise(0.0)).alias("bend"),
            F.max("target").alias("target"),
        )
        off = F.abs("gap") / F.greatest(F.col("target"), F.lit(1.0))
        over = (F.col("gap") > 0) & (F.col("gap") >= F.col("bend"))
        step = F.when(off <= tolerance, F.lit(0.0)).when(over, F.lit(-1.0)).when(F.col("bend") > 0, F.log1p(-F.try_divide("gap", "bend"))).otherwise(F.lit(0.0))
        state = cut_lineage(moved.select("s", (F.col("lam") + step).alias("lam"), F.when(step == 0, F.lit(0.0)).otherwise(off).alias("off")))
        worst = state.agg(F.max("off")).first()[0]
        now = state.select("s", "lam")
        if worst is None or worst <= tolerance:
            break
    return now.withColumnRenamed("s", "source").withColumnRenamed("lam", "lambda")


def copies(docs: DataFrame, rates: DataFrame, limit: float = 3.0, seed: int = 7) -> DataFrame:
    """``docs`` (id, source, size, q, salt, and any more) with ``copies``: whole numbers whose running total follows that of the rates.

    ``salt`` is a hash of the id and the text, so rows without an id are spread too. Within a source documents stand by size class, then by
    that hash, size, id; the total is cut into strata of one size class and one
    hash slice, so a source with any share of all rows is spread over tasks; strata pass on their totals. A document of rate r
    gets floor(r) or ceil(r) copies. Equal rows are told apart only by their number, so reruns give the same copies.
    """
    rated = docs.join(rates.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").withColumn(
        "rate", F.coalesce(F.round(F.least(F.lit(limit), F.col("q") * F.exp("lambda")) * SCALE).cast("long"), F.lit(0))
    )
    slices = max(16, math.ceil(docs.count() / 500_000))
    placed = rated.withColumn("class", F.floor(4 * F.log2(F.col("size") + 1.0)).cast("int")).withColumn("slice", F.pmod(F.xxhash64("salt", F.lit(seed)), F.lit(slices)).cast("int"))
    strata = placed.groupBy("source", "class", "slice").agg(F.sum("rate").alias("sum"))
    earlier = Window.partitionBy("source").orderBy("class", "slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = strata.select(F.col("source").alias("s2"), F.col("class").alias("c2"), F.col("slice").alias("l2"), F.coalesce(F.sum("sum").over(earlier), F.lit(0)).alias("offset"))
    within = Window.partitionBy("source", "class", "slice").orderBy("size", "id", "salt").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = placed.withColumn("run", F.sum("rate").over(within))
    joined = run.join(offsets, F.col("source").eqNullSafe(F.col("s2")) & (F.col("class") == F.col("c2")) & (F.col("slice") == F.col("l2")))
    start = F.pmod(F.xxhash64("source", F.lit(seed)), F.lit(SCALE))
    upto = F.expr("offset + run") + start
    return joined.select(*docs.columns, (F.floor(upto / SCALE) - F.floor((upto - F.col("rate")) / SCALE)).cast("long").alias("copies"))


def settle(given: DataFrame, targets: DataFrame, limit: int, rounds: int = 3) -> DataFrame:
    """``given`` (id, source, size, copies) with what a source still misses made up by one document a round.

    The document whose size comes nearest to the gap, and for which one copy more or less is allowed, is taken once more or
    less; so the gap falls from about the largest size to a difference of sizes. Ties go to the least id.
    """
    rows = cut_lineage(given.withColumn("row", F.monotonically_increasing_id()))
    goals = cut_lineage(targets.select(F.col("source").alias("s"), "target"))
    for _ in range(rounds):
        sums = rows.groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("sum"))
        gaps = cut_lineage(sums.join(goals, F.col("source").eqNullSafe(F.col("s"))).select("s", (F.col("target") - F.col("sum")).alias("gap")))
        near = rows.join(gaps, F.col("source").eqNullSafe(F.col("s"))).withColumn("off", F.abs(F.abs("gap") - F.col("size")))
        free = ((F.col("gap") > 0) & (F.col("copies") < limit)) | ((F.col("gap") < 0) & (F.col("copies") > 0))
        best = near.filter(free & (F.col("off") < F.abs("gap"))).groupBy("s").agg(F.min(F.struct("off", "id", "row", F.signum("gap").cast("long").alias("more"))).alias("b"))
        picked = cut_lineage(best.select("s", F.col("b.row").alias("row"), F.col("b.more").alias("more")))
        if picked.isEmpty():
            break
        rows = cut_lineage(rows.join(picked.select("row", "more"), "row", "left").withColumn("copies", F.col("copies") + F.coalesce("more", F.lit(0))).select(*rows.columns))
    return rows.drop("row")


def mix(
    docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), limit: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    base: Column | None = None, row_col: str | None = None,
) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken of every document, and ``row_col`` if it is named.

    ``base`` is the documents' base rate, above 0 and of few distinct values (``base_rate`` of the text unless given). NULL and
    empty texts have size 0 and no copies that count; a NULL source is a source of its own, last in order. If all
    sources are at the limit the rest of the total is not given out. An empty table gives an empty result.
    """
    text = F.col(text_col)
    own = [] if row_col is None else [F.col(row_col).cast("long").alias("__row")]
    rows = cut_lineage(
        docs.select(
            F.col(id_col).cast("long").alias("id"), F.col(source_col).alias("source"), word_count(text).alias("size"),
            (base_rate(text) if base is None else base.cast("double")).alias("q"), F.xxhash64(F.col(id_col).cast("long"), text).alias("salt"), *own,
        )
    )
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = cut_lineage(level_targets(cut_lineage(weighted_sources(sizes, weights)), limit))
    mass = rows.groupBy("source", "q").agg(F.sum("size").alias("tokens"))
    rates = balance(mass, targets.select("source", "target"), float(limit))
    given = settle(copies(rows, rates, float(limit)), targets, limit)
    told = targets.select(F.col("source").alias("t"), "source_size", "target")
    out = given.join(told, F.col("source").eqNullSafe(F.col("t")))
    return out.select(
        F.col("id").alias("doc_id"), "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"),
        *([] if row_col is None else [F.col("__row").alias(row_col)]),
    )


@query("op7_mix")
def op7_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mix(table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken")
