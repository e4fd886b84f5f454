"""Folds and exact metrics, all on distributions instead of global sorts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.ordered import exact_percentiles, global_rank, rank_cut, running_totals
from ..session import cut_lineage


# --------------------------------------------------------------------------- folds
def fold_assign(
    df: DataFrame,
    kind: str,
    k: int = 5,
    key: str | None = None,
    group: str | None = None,
    label: str | None = None,
    repeats: int = 1,
    seed: int = 7,
    method: str = "hash",
    output: str = "fold",
) -> DataFrame:
    """Deterministic folds; no shuffle except for ``group_balanced``.

    kfold           by key
    stratified      by (label, key): equal shares per label in expectation
    repeated        as stratified, once per repeat (adds ``repeat`` and multiplies the rows)
    group           whole groups together, by a hash of the group
    group_balanced  whole groups together, groups dealt out by size then name
    ``method='mod'`` replaces the hash of an integer key by the key itself.
    """

    def spread(*cols: Column) -> Column:
        if method == "mod":
            return F.pmod(F.col(key), F.lit(k)).cast("int")
        return F.pmod(F.xxhash64(*cols, F.lit(seed)), F.lit(k)).cast("int")

    if kind == "kfold":
        return df.withColumn(output, spread(F.col(key)))
    if kind == "stratified":
        return df.withColumn(output, spread(F.col(label), F.col(key)))
    if kind == "repeated":
        rows = df.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
        return rows.withColumn(output, spread(F.col(label), F.col(key), F.col("repeat")))
    if kind == "group":
        return df.withColumn(output, F.pmod(F.xxhash64(group, F.lit(seed)), F.lit(k)).cast("int"))
    if kind == "group_balanced":
        sizes = df.groupBy(F.col(group).alias("__g")).agg(F.count(F.lit(1)).alias("__n"))
        ranked = global_rank(sizes, [F.col("__n").desc(), F.col("__g").asc()], "__deal")
        folds = ranked.select("__g", F.pmod("__deal", F.lit(k)).cast("int").alias(output))
        return df.join(folds, df[group].eqNullSafe(folds["__g"])).drop("__g")
    raise ValueError(f"unknown fold kind: {kind}")


def fold_leak_report(df: DataFrame, group: str, fold: str = "fold") -> DataFrame:
    """Per fold: rows and groups on both sides, and the groups they share (0 for group folds)."""
    cells = df.groupBy(group, fold).agg(F.count(F.lit(1)).alias("n"))
    spans = cells.groupBy(group).agg(F.count(F.lit(1)).alias("folds"))
    joined = cells.join(spans.select(F.col(group).alias("__g"), "folds"), cells[group].eqNullSafe(F.col("__g")))
    totals = cells.agg(F.struct(F.sum("n").alias("rows"), F.countDistinct(F.coalesce(F.col(group).cast("string"), F.lit(""))).alias("groups"))).scalar()
    per_fold = joined.groupBy(fold).agg(
        F.sum("n").alias("n_val"),
        F.count(F.lit(1)).alias("groups_val"),
        F.sum((F.col("folds") > 1).cast("long")).alias("shared_groups"),
    )
    return per_fold.withColumn("__t", totals).select(
        fold,
        (F.col("__t.rows") - F.col("n_val")).alias("n_train"),
        "n_val",
        (F.col("__t.groups") - F.col("groups_val") + F.col("shared_groups")).alias("groups_train"),
        "groups_val",
        "shared_groups",
    )


# --------------------------------------------------------------------------- classification
def auc(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Exact AUC with ties at one half: ``by``, auc, n_pos, n_neg (NULL auc with one class only)."""
    by = list(by)
    y = F.col(label).cast("long")
    dist = (
        df.filter(F.col(label).isNotNull())
        .groupBy(*by, F.col(score).cast("double").alias("__score"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("pos"))
    )
    placed = running_totals(dist, "__score", ["n", "pos"], by)
    neg_before = (F.col("n_before") - F.col("pos_before")).cast("double")
    neg = (F.col("n") - F.col("pos")).cast("double")
    sums = placed.groupBy(*by).agg(
        F.sum(F.col("pos") * (neg_before + neg / 2)).alias("wins"),
        F.sum("pos").alias("n_pos"),
        F.sum(F.col("n") - F.col("pos")).alias("n_neg"),
    )
    pairs = F.col("n_pos").cast("double") * F.col("n_neg").cast("double")
    return sums.select(*by, F.when(pairs > 0, F.col("wins") / pairs).alias("auc"), "n_pos", "n_neg")


def threshold_metrics(df: DataFrame, score: str, label: str, threshold: float = 0.5, by: Sequence[str] = ()) -> DataFrame:
    flag, pos = F.col(score) >= threshold, F.col(label) == 1
    tp = F.count(F.when(flag & pos, F.lit(1)))
    flagged = F.count(F.when(flag, F.lit(1)))
    positives = F.count(F.when(pos, F.lit(1)))
    return (
        df.groupBy(*by)
        .agg(tp.alias("tp"), flagged.alias("flagged"), positives.alias("positives"))
        .select(
            *by,
            "flagged",
            F.coalesce(F.col("tp") / F.nullif(F.col("flagged"), F.lit(0)), F.lit(0.0)).alias("precision"),
            F.coalesce(F.col("tp") / F.nullif(F.col("positives"), F.lit(0)), F.lit(0.0)).alias("recall"),
        )
    )


def recall_at_top(df: DataFrame, score: str, label: str, tie_id: str, top: float = 0.2) -> DataFrame:
    """Share of all positives among the top ``top`` of rows, and its lift over chance."""
    rows = cut_lineage(df.select(score, label, tie_id))
    chosen = rank_cut(rows, score, tie_id, lambda n: F.greatest(F.lit(1), F.bround(n * F.lit(float(top))).cast("long")))
    positives = rows.agg(F.count(F.when(F.col(label) == 1, F.lit(1)))).first()[0]
    return (
        chosen.agg(F.count(F.lit(1)).alias("k"), F.count(F.when(F.col(label) == 1, F.lit(1))).alias("captured"))
        .withColumn("positives", F.lit(positives))
        .withColumn("recall_at_top", F.coalesce(F.col("captured") / F.nullif(F.col("positives"), F.lit(0)), F.lit(0.0)))
        .withColumn("lift", F.col("recall_at_top") / top)
    )


def recall_at_top_by(df: DataFrame, score: str, label: str, tie_id: str, by: Sequence[str], top: float = 0.2) -> DataFrame:
    """``recall_at_top`` of every group: ``by``, recall_at_top, lift. The cuts of all groups are found in the same scans."""
    by = list(by)
    rows = cut_lineage(df.select(*by, F.col(score).alias("__s"), (F.col(label) == 1).cast("long").alias("__y"), F.col(tie_id).alias("__id")))
    dist = rows.groupBy(*by, "__s").agg(F.count(F.lit(1)).alias("n"), F.sum("__y").alias("pos"))
    placed = running_totals(dist, "__s", ["n", "pos"], by, descending=True)
    wanted = F.greatest(F.lit(1), F.bround(F.col("n_total") * F.lit(float(top))).cast("long"))
    at = placed.filter((F.col("n_before") < wanted) & (F.col("n_before") + F.col("n") >= wanted))
    cut = cut_lineage(at.select(*by, "__s", (wanted - F.col("n_before")).alias("room"), F.col("pos_before").alias("above"), F.col("pos_total").alias("positives")))
    tied = rows.join(cut.select(*by, "__s", "room"), [*by, "__s"])
    ordered = running_totals(tied.select(*by, "__id", "room", "__y", F.lit(1).alias("one")), "__id", ["one"], by)
    inside = ordered.filter("one_before < room").groupBy(*by).agg(F.sum("__y").alias("taken"))
    recall = F.coalesce((F.col("above") + F.coalesce("taken", F.lit(0))) / F.nullif(F.col("positives"), F.lit(0)), F.lit(0.0))
    return cut.join(inside, by, "left").select(*by, recall.alias("recall_at_top"), (recall / top).alias("lift"))


def ranking_by(df: DataFrame, score: str, label: str, tie_id: str, by: Sequence[str], top: float = 0.2, recall: bool = True, threshold: float = 0.5) -> list[dict]:
    """Per group (few): auc, test_base_rate, flagged, precision, recall, recall_at_top and lift, from one ordering of the distinct scores; without ``recall``
    the AUC alone. Equal scores at the cut are settled by ``tie_id`` and only then read again. Labels are 0 or 1."""
    by, y = list(by), F.col(label).cast("long")
    dist = df.groupBy(*by, F.col(score).cast("double").alias("__score")).agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("pos"))
    placed = running_totals(dist, "__score", ["n", "pos"], by)
    neg = (F.col("n") - F.col("pos")).cast("double")
    after = F.col("n_total") - F.col("n_before") - F.col("n")  # rows of higher scores
    wanted = F.greatest(F.lit(1), F.bround(F.col("n_total") * F.lit(float(top))).cast("long"))
    cut = F.struct(F.col("__score").alias("score"), "n", (wanted - after).alias("room"), (F.col("pos_total") - F.col("pos_before") - F.col("pos")).alias("above"), "pos")
    flag = F.col("__score") >= threshold
    found = placed.groupBy(*by).agg(
        F.sum(F.col("pos") * ((F.col("n_before") - F.col("pos_before")).cast("double") + neg / 2)).alias("wins"),
        F.sum("pos").alias("n_pos"),
        F.sum(F.col("n") - F.col("pos")).alias("n_neg"),
        F.sum(F.when(flag, F.col("n")).otherwise(0)).alias("flagged"),
        F.sum(F.when(flag, F.col("pos")).otherwise(0)).alias("tp"),
        F.max(F.when((after < wanted) & (after + F.col("n") >= wanted), cut)).alias("cut"),
    )
    rows = [r.asDict(True) for r in found.collect()]  # a row per group
    for r in rows:
        pairs = float(r["n_pos"]) * float(r["n_neg"])
        r["auc"] = r["wins"] / pairs if pairs > 0 else None
    if not recall:
        return rows
    taken = {tuple(r[k] for k in by): r["cut"]["pos"] for r in rows if r["cut"]}
    part = [r for r in rows if r["cut"] and r["cut"]["room"] < r["cut"]["n"] and r["cut"]["score"] is not None]
    if part:
        types = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in by)
        cuts = df.sparkSession.createDataFrame([(*[r[k] for k in by], r["cut"]["score"], r["cut"]["room"]) for r in part], f"{types}, __s double, room long")
        tied = df.select(*by, F.col(score).cast("double").alias("__s"), y.alias("__y"), F.col(tie_id).alias("__id")).join(F.broadcast(cuts), [*by, "__s"])
        ordered = running_totals(tied.select(*by, "__id", "room", "__y", F.lit(1).alias("one")), "__id", ["one"], by)
        inside = ordered.filter("one_before < room").groupBy(*by).agg(F.sum("__y").alias("taken")).collect()
        taken |= {tuple(r[k] for k in by): r["taken"] for r in inside}
    for r in rows:
        n, above = r["n_pos"] + r["n_neg"], r["cut"]["above"] if r["cut"] else 0
        hit = (above + taken.get(tuple(r[k] for k in by), 0)) / r["n_pos"] if r["n_pos"] else 0.0
        r |= {
            "test_base_rate": r["n_pos"] / n if n else None, "precision": r["tp"] / r["flagged"] if r["flagged"] else 0.0, "recall": r["tp"] / r["n_pos"] if r["n_pos"] else 0.0,
            "recall_at_top": hit, "lift": hit / top,
        }
    return rows


def auc_by_segment(df: DataFrame, score: str, label: str, segment: str, largest: int = 4, least: int = 10) -> DataFrame:
    """AUC within the largest segments that have both classes and at least ``least`` rows."""
    sizes = df.groupBy(segment).agg(F.count(F.lit(1)).alias("n"))
    top = sizes.orderBy(F.col("n").desc(), segment).limit(largest).filter(F.col("n") >= least)
    rows = df.join(top.select(segment), segment, "left_semi")
    return auc(rows, score, label, [segment]).filter(F.col("auc").isNotNull())


# --------------------------------------------------------------------------- regression
def regression_metrics(df: DataFrame, actual: str, predicted: str, train: DataFrame | None = None) -> DataFrame:
    """mae, r2, MAE of the training median, and the improvement over it in percent."""
    median = exact_percentiles(df if train is None else train, [actual]).select("value").scalar()
    y, p = F.col(actual), F.col(predicted)
    both = df.filter(y.isNotNull() & p.isNotNull()).withColumn("__median", median)
    sums = both.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.abs(y - p)).alias("mae"),
        F.sum((y - p) * (y - p)).alias("sse"),
        F.var_pop(y).alias("var"),
        F.avg(F.abs(y - F.col("__median"))).alias("naive_mae"),
    )
    return sums.select(
        "n",
        "mae",
        (1 - F.col("sse") / F.nullif(F.col("n") * F.col("var"), F.lit(0.0))).alias("r2"),
        "naive_mae",
        ((1 - F.col("mae") / F.nullif(F.col("naive_mae"), F.lit(0.0))) * 100).alias("improvement_pct"),
    )


def observation_note(df: DataFrame, label: str, cutoff: int, years: int = 3, year: str = "approval_year") -> DataFrame:
    """Label rate per approval year after the cutoff: how much of the drop is a short observation window."""
    return (
        df.filter(F.col(year).between(cutoff + 1, cutoff + years))
        .groupBy(year)
        .agg(F.avg((F.col(label) > 0).cast("double")).alias("rate"), F.count(label).alias("n"))
    )
