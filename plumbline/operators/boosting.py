"""Histogram boosting with leaf-wise trees, several models (the folds of a cross-validation and the whole) in the same scans.

Features become small bin numbers once, in blocks of rows that are written. A split round is one distributed sum: every block adds up
gradients per (model, node, feature, bin), and the driver sees only these sums, whose size does not depend on the rows. It picks
splits by gain, the best leaf first, missing values to the side where they gain more. Gradients are summed as whole numbers, so
neither the order of blocks nor a recomputed block changes a tree.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage, shared_folder

#: Bin 0 is for missing values.
BINS = 256
BLOCK_ROWS = 65_536
SCALE = float(1 << 30)
#: Rounds after which the scores are written to the shared folder and their lineage ends.
CHECKPOINT = 25
#: Up to so many tasks hand their sums to the driver directly; they are as large as the histograms of a few nodes.
FEW_TASKS = 32


@dataclass(frozen=True)
class Boosted:
    """Settings; the defaults are the full-size ones. ``kind`` is classify (log loss) or regress (squared loss)."""

    kind: str = "classify"
    rounds: int = 400
    leaves: int = 8
    rate: float = 0.05
    least_rows: int = 20
    least_hessian: float = 1e-3

    def fit(self, df: DataFrame, inputs: Sequence[str], label: str) -> BoostedModel:
        return self.fit_folds(df, inputs, label, None, 0)[0]

    def fit_folds(self, df: DataFrame, inputs: Sequence[str], label: str, fold: str | None, k: int, whole: bool = True) -> list[BoostedModel]:
        """Models that leave out folds 0..k-1 and, with ``whole``, one of all rows, grown side by side. Rows without a label are left out;
        the bin bounds are those of all rows."""
        inputs = list(inputs)
        number = F.lit(-1) if fold is None else F.coalesce(F.col(fold).cast("int"), F.lit(-1))
        rows = df.filter(F.col(label).isNotNull()).select(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(inputs)], F.col(label).cast("double").alias("y"), number.alias("fold"))
        rows = cut_lineage(rows)
        bounds = _bounds(rows, len(inputs))
        left_out = [*range(k), *([-2] if whole else [])]
        sums = rows.groupBy("fold").agg(F.sum("y").alias("s"), F.count(F.lit(1)).alias("n")).collect()  # a row for each fold
        start = []
        for m in left_out:
            total, n = (sum(r[c] for r in sums if r["fold"] != m) for c in ("s", "n"))
            mean = total / n if n else 0.0
            start.append(float(np.log(np.clip(mean, 1e-12, 1 - 1e-12) / (1 - np.clip(mean, 1e-12, 1 - 1e-12)))) if self.kind == "classify" else mean)
        trees = _grow(rows, bounds, left_out, start, self)
        return [BoostedModel(self, inputs, s, t) for s, t in zip(start, trees, strict=True)]


@dataclass
class Tree:
    """Inner nodes by number: feature, bound bin, is missing left; ``kids`` are the numbers of both children; a leaf has a value."""

    split: dict[int, tuple[int, int, bool]] = field(default_factory=dict)
    kids: dict[int, tuple[int, int]] = field(default_factory=dict)
    value: dict[int, float] = field(default_factory=dict)

    def rows_of(self, bins: np.ndarray, rows: np.ndarray, wanted: set[int]) -> dict[int, np.ndarray]:
        """Those of ``rows`` in each wanted node; ``bins`` has a line for each feature. Only nodes above wanted ones are split."""
        needed = set(wanted)
        for node in sorted(self.split, reverse=True):  # parents have smaller numbers than their children
            if needed.intersection(self.kids[node]):
                needed.add(node)
        at = {0: rows}
        for node in sorted(self.split):
            if node in at and needed.intersection(self.kids[node]):
                feature, bound, missing_left = self.split[node]
                x = bins[feature][at[node]]
                left = (x <= bound) if missing_left else (x <= bound) & (x > 0)  # a missing value is bin 0
                for kid, side in zip(self.kids[node], (left, ~left), strict=True):
                    if kid in needed:
                        at[kid] = at[node][side]
        return {node: at[node] for node in wanted}


@dataclass
class BoostedModel:
    settings: Boosted
    inputs: list[str]
    start: float
    #: Trees as (feature, threshold, missing left, left, right, value) per node; a leaf has feature -1.
    trees: list[list[tuple]]

    def raw(self) -> Column:
        """Summed score of a row, in Arrow batches."""
        trees = [[np.array(x) for x in zip(*nodes, strict=True)] for nodes in self.trees]
        start = self.start

        @F.pandas_udf("double")
        def score(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            for columns in batches:
                columns = (columns,) if isinstance(columns, pd.Series) else columns  # one input comes without its tuple
                x = np.stack([c.to_numpy(dtype="float64", na_value=np.nan) for c in columns], axis=1)
                total, rows = np.full(len(x), start), np.arange(len(x))
                for feature, threshold, missing_left, left, right, value in trees:
                    at = np.zeros(len(x), dtype=np.int64)
                    while True:
                        inner = feature[at] >= 0
                        if not inner.any():
                            break
                        v = x[rows, np.maximum(feature[at], 0)]
                        side = np.where(np.isnan(v), missing_left[at], v <= threshold[at])
                        at = np.where(inner, np.where(side, left[at], right[at]), at)
                    total += value[at]
                yield pd.Series(total)

        return score(*[F.col(c).cast("double") for c in self.inputs])

    def predict(self, df: DataFrame, output: str) -> DataFrame:
        """``df`` with the probability of label 1, or the value."""
        raw = self.raw()
        return df.withColumn(output, 1 / (1 + F.exp(-raw)) if self.settings.kind == "classify" else raw)

    def save(self, spark: SparkSession, path: str) -> None:
        told = {"settings": asdict(self.settings), "inputs": self.inputs, "start": self.start, "trees": self.trees}
        spark.createDataFrame([(json.dumps(told),)], "model string").coalesce(1).write.mode("overwrite").text(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> BoostedModel:
        told = json.loads(spark.read.text(path).first()[0])
        return BoostedModel(Boosted(**told["settings"]), told["inputs"], told["start"], [[tuple(n) for n in t] for t in told["trees"]])


# --------------------------------------------------------------------------- training
def _bounds(rows: DataFrame, n: int) -> list[np.ndarray]:
    """Upper bounds of bins 1, 2, ... per feature: quantiles; values above the last bound fall in one more bin."""
    probs = [i / (BINS - 2) for i in range(1, BINS - 2)]
    present = [F.when(~F.isnan(f"x{i}"), F.col(f"x{i}")) for i in range(n)]
    found = rows.agg(*[F.percentile_approx(x, probs, 100_000) for x in present]).first()
    return [np.unique(np.array(b or [], dtype=np.float64)) for b in found]


def _blocks(rows: DataFrame, bounds: list[np.ndarray]) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for i in range(0, len(part), BLOCK_ROWS):
                p = part.iloc[i : i + BLOCK_ROWS]
                bins = np.zeros((len(p), len(bounds)), dtype=np.uint8)
                for j, b in enumerate(bounds):
                    x = p[f"x{j}"].to_numpy(dtype="float64")
                    bins[:, j] = np.where(np.isnan(x), 0, 1 + np.searchsorted(b, x))
                yield pd.DataFrame({"bins": [bins.tobytes()], "y": [p["y"].to_numpy().tobytes()], "fold": [p["fold"].to_numpy(dtype="int32").tobytes()]})

    return rows.mapInPandas(run, "bins binary, y binary, fold binary")


def _grow(rows: DataFrame, bounds: list[np.ndarray], left_out: list[int], start: list[float], spec: Boosted) -> list[list[list[tuple]]]:
    spark, width, models = rows.sparkSession, len(bounds), range(len(left_out))
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(spark))

    def opened(row) -> tuple:
        y, fold = np.frombuffer(row["y"]), np.frombuffer(row["fold"], dtype=np.int32)
        score = np.repeat(np.array(start)[:, None], len(y), axis=1)
        return np.ascontiguousarray(np.frombuffer(row["bins"], dtype=np.uint8).reshape(len(y), width).T), y, fold, score

    blocks = cut_lineage(_blocks(rows, bounds))
    n_blocks = blocks.count()
    data = blocks.coalesce(max(1, min(n_blocks, context.defaultParallelism))).rdd.map(opened).persist(StorageLevel.MEMORY_AND_DISK)

    def histograms(current, trees: list[Tree], wanted: list[list[int]]) -> list[dict[int, np.ndarray]]:
        """Sums of gradient, hessian and rows per bin of the wanted nodes of each model."""

        def add(part: Iterator[tuple]) -> Iterator[np.ndarray]:
            out = np.zeros((sum(map(len, wanted)), width, BINS, 3), dtype=np.int64)
            for bins, y, fold, score in part:
                slot = 0
                for m in models:
                    if not wanted[m]:
                        continue
                    if spec.kind == "classify":
                        p = 1 / (1 + np.exp(-score[m]))
                        g, h = np.rint((p - y) * SCALE), np.rint(p * (1 - p) * SCALE)
                    else:
                        g, h = np.rint((score[m] - y) * SCALE), None  # a hessian of 1 for each row
                    found = trees[m].rows_of(bins, np.flatnonzero(fold != left_out[m]), set(wanted[m]))
                    for node in wanted[m]:
                        rows = found[node]
                        own_g, own_h = g[rows], None if h is None else h[rows]
                        for j in range(width):
                            x = bins[j][rows]
                            n = np.bincount(x, minlength=BINS)
                            out[slot, j, :, 0] += np.bincount(x, own_g, BINS).astype(np.int64)
                            out[slot, j, :, 1] += n * int(SCALE) if own_h is None else np.bincount(x, own_h, BINS).astype(np.int64)
                            out[slot, j, :, 2] += n
                        slot += 1
            yield out

        # sums of few tasks are added at once, those of many in two steps
        total = iter(current.mapPartitions(add).treeReduce(np.add, 1 if current.getNumPartitions() <= FEW_TASKS else 2))
        return [{node: next(total) for node in nodes} for nodes in wanted]

    def moved(values: list[tuple[Tree, dict[int, float]]]):
        def add(block: tuple) -> tuple:
            bins, y, fold, score = block
            gain = []
            for tree, value in values:
                own = np.zeros(len(y))
                for node, rows in tree.rows_of(bins, np.arange(len(y)), set(value)).items():
                    own[rows] = value[node]
                gain.append(own)
            return bins, y, fold, score + np.array(gain)

        return add

    grown: list[list[list[tuple]]] = [[] for _ in models]
    stale: list = []
    for round_ in range(spec.rounds):
        trees, known, made = [Tree() for _ in models], [{} for _ in models], [1] * len(left_out)
        best: list[dict[int, tuple]] = [{} for _ in models]
        wanted: list[list[int]] = [[0] for _ in models]
        spare: list[dict[int, tuple[int, int]]] = [{} for _ in models]  # splits made ahead of their turn
        ahead = [Tree() for _ in models]  # all splits whose children have sums
        leaves = [[0] for _ in models]
        while any(wanted):
            sums = histograms(data, ahead, wanted)
            while stale:  # the new scores are there now
                stale.pop().unpersist()
            for m, found in enumerate(sums):
                known[m] |= found
                for node in list(found):
                    parent = next((p for p, k in ahead[m].kids.items() if node in k), None)
                    if parent is not None:  # its sibling's sums are what is left of the parent's
                        known[m][sum(ahead[m].kids[parent]) - node] = known[m][parent] - found[node]
            for m in models:
                for node in known[m]:
                    if node not in best[m]:
                        best[m][node] = _split(known[m][node], spec)
                wanted[m] = []
                while len(leaves[m]) < spec.leaves:  # the best leaf first, as long as its children are known
                    node = max(leaves[m], key=lambda x: (best[m][x][0], -x))
                    if best[m][node][0] <= 0:
                        break
                    if node not in spare[m]:
                        open_ = sorted((x for x in leaves[m] if best[m][x][0] > 0 and x not in spare[m]), key=lambda x: (-best[m][x][0], x))
                        for x in open_[: spec.leaves - len(leaves[m])]:
                            spare[m][x] = ahead[m].kids[x] = (made[m], made[m] + 1)
                            ahead[m].split[x] = best[m][x][1]
                            wanted[m].append(made[m] + _right_is_smaller(known[m][x], best[m][x][1]))  # the rows of one child are read
                            made[m] += 2
                        break
                    leaves[m].remove(node)
                    leaves[m] += spare[m][node]
                    trees[m].split[node], trees[m].kids[node] = best[m][node][1], spare[m][node]
        values = []
        for m in models:
            value = {}
            for node in leaves[m]:
                g, h, _ = known[m][node][0].sum(axis=0) if width else (0, 1, 0)
                value[node] = -spec.rate * g / h if h and trees[m].split else 0.0
            trees[m].value = value
            values.append((trees[m], value))
            grown[m].append(_told(trees[m], bounds))
        if not any(t.split for t in trees):
            break
        if round_ + 1 < spec.rounds:
            before, data = data, data.map(moved(values)).persist(StorageLevel.MEMORY_AND_DISK)
            if (round_ + 1) % CHECKPOINT == 0:
                data.checkpoint()
            stale.append(before)
    for x in [*stale, data]:
        x.unpersist()
    return grown


def _right_is_smaller(sums: np.ndarray, split: tuple[int, int, bool]) -> bool:
    feature, bound, missing_left = split
    rows = sums[feature, :, 2]
    left = rows[1 : bound + 1].sum() + (rows[0] if missing_left else 0)
    return bool(2 * left > rows.sum())


def _split(sums: np.ndarray, spec: Boosted) -> tuple[float, tuple[int, int, bool]]:
    """Gain and (feature, last bin on the left, is missing left) of the best split; ties go to the first feature and bin, missing to the right."""
    whole = sums[0].sum(axis=0).astype(np.float64)
    below = np.cumsum(sums[:, 1:], axis=1)
    left = np.stack([below, below + sums[:, :1]], axis=2).astype(np.float64)  # feature, bin, missing right or left, sums
    right = whole - left
    fits = (left[..., 2] >= spec.least_rows) & (right[..., 2] >= spec.least_rows) & (left[..., 1] >= spec.least_hessian * SCALE) & (right[..., 1] >= spec.least_hessian * SCALE)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(fits, left[..., 0] ** 2 / left[..., 1] + right[..., 0] ** 2 / right[..., 1] - whole[0] ** 2 / whole[1], 0.0) / SCALE
    gain = np.where(gain > 1e-12, gain, 0.0)
    at = int(np.argmax(gain)) if gain.size else 0
    feature, bin_, missing = np.unravel_index(at, gain.shape) if gain.size else (0, 0, 0)
    return (float(gain.flat[at]) if gain.size else 0.0), (int(feature), int(bin_) + 1, bool(missing))


def _told(tree: Tree, bounds: list[np.ndarray]) -> list[tuple]:
    number = {node: i for i, node in enumerate(sorted([*tree.split, *tree.value]))}
    out = []
    for node in number:
        if node in tree.split:
            feature, bin_, missing = tree.split[node]
            edge = bounds[feature]
            threshold = float(edge[bin_ - 1]) if bin_ <= len(edge) else float("inf")
            out.append((feature, threshold, missing, number[tree.kids[node][0]], number[tree.kids[node][1]], 0.0))
        else:
            out.append((-1, 0.0, False, 0, 0, tree.value[node]))
    return out
