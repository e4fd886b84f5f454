"""Many linear and logistic models in the same scans.

A table of rows for several models (a cutoff, a mode, a fold each) is fitted at once: one grouped sum per Newton step gives each model its
Gram matrix, gradient and loss, which are the only things the driver sees. Least squares takes one such sum.
"""

from __future__ import annotations

import json
import operator
from collections.abc import Callable, Iterator, Sequence
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class LinearFit:
    """A fitted model: ``coefficients`` of ``inputs`` and an intercept; ``logistic`` ones give probabilities."""

    inputs: tuple[str, ...]
    coefficients: tuple[float, ...]
    intercept: float
    logistic: bool

    def predict(self) -> Column:
        eta = F.lit(self.intercept)
        for name, weight in zip(self.inputs, self.coefficients, strict=True):
            eta = eta + F.col(name).cast("double") * F.lit(weight)
        return 1 / (1 + F.exp(-eta)) if self.logistic else eta

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame([(json.dumps(asdict(self)),)], "model string").coalesce(1).write.mode("overwrite").text(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> LinearFit:
        told = json.loads(spark.read.text(path).first()[0])
        return LinearFit(tuple(told["inputs"]), tuple(told["coefficients"]), told["intercept"], told["logistic"])


@dataclass(frozen=True)
class Linear:
    """Learner: L2 logistic regression (``classify``) or least squares (``regress``), the folds of a cross-validation and the whole in the same scans.

    The logistic loss is the mean over a model's rows plus |coefficients|^2 / (2 ``n``), as MLlib has it with ``regParam`` 1 / n; Newton steps end
    at its minimum, to a gradient of ``tolerance``. The rows are packed into blocks once; a step reads the blocks, least squares read them once.
    """

    kind: str = "classify"
    n: int = 1
    steps: int = 200
    tolerance: float = 1e-9

    def fit(self, df: DataFrame, inputs: Sequence[str], label: str) -> LinearFit:
        return self.fit_folds(df, inputs, label, None, 0)[0]

    def fit_folds(self, df: DataFrame, inputs: Sequence[str], label: str, fold: str | None, k: int, whole: bool = True) -> list[LinearFit]:
        """Models that leave out folds 0..k-1 and, with ``whole``, one of all rows. Rows without a label are left out."""
        number = F.lit(-1) if fold is None else F.coalesce(F.col(fold).cast("int"), F.lit(-1))
        return self._fit(df, inputs, label, number, [*range(k), *([-2] if whole else [])], operator.ne, self.n)

    def fit_each(self, df: DataFrame, inputs: Sequence[str], label: str, by: str, keys: Sequence[int]) -> list[LinearFit]:
        """A model of the rows of each of ``keys``, whole numbers in ``by``, in the same scans; ``n`` is each one's own number of rows."""
        return self._fit(df, inputs, label, F.col(by).cast("int"), list(keys), operator.eq, None)

    def _fit(self, df: DataFrame, inputs: Sequence[str], label: str, number: Column, models: list[int], takes: Callable, n: int | None) -> list[LinearFit]:
        """Models that read the rows whose number they take."""
        inputs, logistic = tuple(inputs), self.kind == "classify"
        p = len(inputs) + 1
        columns = [F.col(c).cast("double").alias(f"__x{i}") for i, c in enumerate(inputs)]
        rows = df.filter(F.col(label).isNotNull()).select(*columns, F.col(label).cast("double").alias("__y"), number.alias("__fold"))
        # bytes of an RDD pass to Python as they are, binary columns take more than twice the time
        blocks = _packed(rows, p).rdd.map(lambda row: bytes(row[0]))
        if not logistic:
            own = _fold_sums(blocks, p, None)  # of each fold; a model has what the other folds hold
            return [_least_squares(inputs, sum((v for f, v in own.items() if takes(f, m)), np.zeros(_width(p)))) for m in models]
        cells = rows.groupBy("__fold").agg(F.sum("__y").alias("s"), F.count(F.lit(1)).alias("n")).collect()  # a row for each fold
        total = {m: tuple(sum(r[c] for r in cells if takes(r["__fold"], m)) for c in ("s", "n")) for m in models}
        if not all(count for _, count in total.values()):
            raise ValueError(f"no rows to fit {label}")
        mixed = [m for m, (s, count) in total.items() if 0 < s < count]
        penalty = {(m,): np.append(np.full(p - 1, 1.0 if n is None else total[m][1] / max(n, 1)), 0.0) for m in mixed}
        start = {(m,): np.append(np.zeros(p - 1), np.log(total[m][0] / (total[m][1] - total[m][0]))) for m in mixed}

        blocks = blocks.persist(StorageLevel.MEMORY_AND_DISK)  # read by every step

        def sums(places: dict[tuple, np.ndarray]) -> dict[tuple, tuple[np.ndarray, np.ndarray, float, float]]:
            return {(m,): _unpacked(v, p) for m, v in _fold_sums(blocks, p, {m: b for (m,), b in places.items()}, takes).items()}

        at = newton(list(start), penalty, sums, self.steps, self.tolerance, start)
        blocks.unpersist()
        # rows of one class: no coefficients, and an intercept that says so
        sure = {(m,): np.append(np.zeros(p - 1), np.inf if s else -np.inf) for m, (s, _) in total.items() if m not in mixed}
        return [LinearFit(inputs, tuple(map(float, b[:-1])), float(b[-1]), True) for b in ({**at, **sure}[m,] for m in models)]


def _width(p: int) -> int:
    return p * (p + 1) // 2 + p + 2


def _unpacked(v: np.ndarray, p: int) -> tuple[np.ndarray, np.ndarray, float, float]:
    gram = np.zeros((p, p))
    gram[np.tril_indices(p)] = v[: -p - 2]
    return gram + np.tril(gram, -1).T, v[-p - 2 : -2], float(v[-2]), float(v[-1])


def _least_squares(inputs: tuple[str, ...], sums: np.ndarray) -> LinearFit:
    gram, against, _, n = _unpacked(sums, len(inputs) + 1)
    if not n:
        raise ValueError("no rows to fit")
    solved = _solve(gram, against)
    return LinearFit(inputs, tuple(map(float, solved[:-1])), float(solved[-1]), False)


def _solve(gram: np.ndarray, against: np.ndarray) -> np.ndarray:
    """Shortest solution; scaled to a unit diagonal, so that columns of different size do not make the matrix look singular."""
    scale = 1 / np.sqrt(np.maximum(np.diag(gram), 1e-300))
    return scale * np.linalg.lstsq(gram * np.outer(scale, scale), against * scale, rcond=1e-12)[0]


def _packed(rows: DataFrame, p: int) -> DataFrame:
    """Rows (``__x0``.., ``__y``, ``__fold``) as one value per Arrow batch: numbers by row, with a 1 after the inputs. A value of a few thousand rows
    passes between Spark and numpy as it is, while single columns are written row by row in every scan."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(p + 1)]
            x = np.column_stack([*columns[: p - 1], np.ones(batch.num_rows), *columns[p - 1 :]]).astype(np.float64)
            if np.isnan(x).any():
                raise ValueError("an input of a linear model is missing: fill the inputs first")
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], type=pa.binary())], names=["block"])

    return rows.mapInArrow(pack, "block binary")


def _fold_sums(blocks: RDD, p: int, places: dict[int, np.ndarray] | None, takes: Callable = operator.ne) -> dict[int, np.ndarray]:
    """One scan of packed rows: lower triangle of the Gram matrix, sums against, loss and rows as one list, per key.

    With ``places``, a key is a model, which ``takes`` the rows of some folds (all but its own number), and its sums are the logistic ones at its place;
    without, a key is a fold and the sums are those of least squares. Tasks add up their blocks; a list of a hundred numbers or so per task and key reaches the driver, with no shuffle.
    """
    low = np.tril_indices(p)

    def of(x: np.ndarray, y: np.ndarray, b: np.ndarray | None) -> np.ndarray:
        if b is None:
            return np.concatenate([(x.T @ x)[low], y @ x, [0.0, len(y)]])
        eta = x @ b
        small = np.exp(-np.abs(eta))
        prob = np.where(eta >= 0, 1.0, small) / (1 + small)
        loss = np.maximum(eta, 0) + np.log1p(small) - y * eta
        return np.concatenate([((x * (small / (1 + small) ** 2)[:, None]).T @ x)[low], (prob - y) @ x, [loss.sum(), len(y)]])

    def add(part: Iterator[bytes]) -> Iterator[dict[int, np.ndarray]]:
        found: dict[int, np.ndarray] = {}
        for value in part:
            block = np.frombuffer(value).reshape(-1, p + 2)
            x, y, fold = block[:, :p], block[:, p], block[:, p + 1].astype(np.int32)
            if places is None:
                parts = {int(f): of(x[fold == f], y[fold == f], None) for f in np.unique(fold)}
            else:
                taken = {m: takes(fold, m) for m in places}
                parts = {m: of(x, y, places[m]) if at.all() else of(x[at], y[at], places[m]) for m, at in taken.items() if at.any()}
            for key, v in parts.items():
                found[key] = found.get(key, 0.0) + v
        yield found

    out: dict[int, np.ndarray] = {}
    for found in blocks.mapPartitions(add).collect():  # a list per task and key, in the order of the tasks
        for key, v in found.items():
            out[key] = out.get(key, 0.0) + v
    return out


def _block_sums(batches: Iterator[pa.RecordBatch], by: Sequence[str], p: int) -> Iterator[pa.RecordBatch]:
    """Per model of a partition: lower triangle of the Gram matrix, sums against, loss and rows, as one list. Columns: ``by``, p inputs, weight, against, loss."""
    found: dict[tuple, list] = {}
    low, width = np.tril_indices(p), p * (p + 1) // 2 + p + 2
    types = None
    for batch in batches:
        types = [batch.schema.field(k).type for k in by]
        code, names = np.zeros(batch.num_rows, dtype=np.int64), [()]
        for k in range(len(by)):
            own = pc.dictionary_encode(batch.column(k), null_encoding="encode")
            code = code * len(own.dictionary) + own.indices.to_numpy()
            names = [(*n, v) for n in names for v in own.dictionary.to_pylist()]
        x = np.column_stack([batch.column(i).to_numpy() for i in range(len(by), len(by) + p)])
        w, a, loss = (batch.column(len(by) + p + i).to_numpy() for i in range(3))
        for c in np.flatnonzero(np.bincount(code, minlength=len(names))):
            at = np.flatnonzero(code == c)
            own = x[at]
            sums = np.concatenate([((own * w[at, None]).T @ own)[low], a[at] @ own, [loss[at].sum(), len(at)]])
            found[names[c]] = found.get(names[c], 0.0) + sums
    if found:
        columns = [pa.array([n[i] for n in found], type=types[i]) for i in range(len(by))]
        values = pa.array(np.concatenate(list(found.values())))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * width), values)
        yield pa.RecordBatch.from_arrays([*columns, lists], names=[*by, "__sums"])


def grouped_sums(df: DataFrame, by: Sequence[str], inputs: Sequence[str], weight: Column, against: Column, loss: Column) -> dict[tuple, tuple[np.ndarray, np.ndarray, float, float]]:
    """Per model: Gram matrix under ``weight``, sums against ``against``, sum of ``loss``, rows. Arrow batches are summed in the tasks, a list
    per model and task; the tasks' lists are added by Spark, and one row per model and sum reaches the driver."""
    by, p = list(by), len(inputs) + 1
    columns = [*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"__x{i}") for i, c in enumerate(inputs)], F.lit(1.0).alias("__one")]
    terms = [F.coalesce(c.cast("double"), F.lit(0.0)).alias(name) for name, c in (("__w", weight), ("__a", against), ("__l", loss))]
    rows = df.select(*by, *columns, *terms)
    types = "".join(f"`{k}` {rows.schema[k].dataType.simpleString()}, " for k in by)
    blocks = rows.mapInArrow(lambda batches: _block_sums(batches, by, p), f"{types}__sums array<double>")
    found = blocks.select(*by, F.posexplode("__sums").alias("__i", "__v")).groupBy(*by, "__i").agg(F.sum("__v").alias("__v")).collect()
    sums: dict[tuple, np.ndarray] = {}
    for r in found:
        sums.setdefault(tuple(r[k] for k in by), np.zeros(p * (p + 1) // 2 + p + 2))[r["__i"]] = r["__v"]
    out = {}
    for key, v in sums.items():
        gram = np.zeros((p, p))
        gram[np.tril_indices(p)] = v[: -p - 2]
        out[key] = gram + np.tril(gram, -1).T, v[-p - 2 : -2], float(v[-2]), int(v[-1])
    return out


def fit_linear_models(df: DataFrame, by: Sequence[str], inputs: Sequence[str], label: str) -> dict[tuple, LinearFit]:
    """Least squares for every value of ``by``; of several solutions the shortest."""
    y = F.col(label).cast("double")
    rows = df.filter(y.isNotNull())
    out = {}
    for key, (gram, against, _, _) in grouped_sums(rows, by, inputs, F.lit(1.0), y, F.lit(0.0)).items():
        solved = _solve(gram, against)
        out[key] = LinearFit(tuple(inputs), tuple(map(float, solved[:-1])), float(solved[-1]), False)
    return out


def fit_logistic_models(
    df: DataFrame, by: Sequence[str], inputs: Sequence[str], label: str, c: float = 1.0, steps: int = 50, tolerance: float = 1e-9
) -> dict[tuple, LinearFit]:
    """L2 logistic regressions for every value of ``by``: loss summed over rows plus |coefficients|^2 / (2 ``c``), intercept free.

    All models take a Newton step per scan; a step that raises a model's loss is halved. A model is done when its gradient is
    small against its rows; the scans end when all are.
    """
    by, inputs = list(by), list(inputs)
    rows = df.filter(F.col(label).isNotNull())
    p = len(inputs) + 1

    def sums(places: dict[tuple, np.ndarray]) -> dict[tuple, tuple[np.ndarray, np.ndarray, float, float]]:
        eta = F.col("__b")[p - 1]
        for i, name in enumerate(inputs):
            eta = eta + F.col(name).cast("double") * F.col("__b")[i]
        y, prob = F.col(label).cast("double"), 1 / (1 + F.exp(-F.col("__eta")))
        scored = place_rows(rows, by, places).withColumn("__eta", eta)
        return grouped_sums(scored, by, inputs, prob * (1 - prob), prob - y, softplus(F.col("__eta")) - y * F.col("__eta"))

    keys = [tuple(r) for r in rows.select(*by).distinct().collect()]  # a row per model
    at = newton(keys, np.append(np.full(p - 1, 1 / c), 0.0), sums, steps, tolerance)
    return {k: LinearFit(tuple(inputs), tuple(map(float, b[:-1])), float(b[-1]), True) for k, b in at.items()}


def softplus(eta: Column) -> Column:
    """log(1 + exp(eta)), without overflow."""
    return F.greatest(eta, F.lit(0.0)) + F.log1p(F.exp(-F.abs(eta)))


def place_rows(df: DataFrame, by: Sequence[str], places: dict[tuple, np.ndarray]) -> DataFrame:
    """Rows of the models in ``places`` with their coefficients as the array ``__b``; the joined table has a row per model."""
    types = "".join(f"`{k}` {df.schema[k].dataType.simpleString()}, " for k in by)
    told = df.sparkSession.createDataFrame([(*k, b.tolist()) for k, b in places.items()], f"{types}__b array<double>")
    return df.join(F.broadcast(told), list(by))


def newton(
    keys: Sequence[tuple], penalty: np.ndarray | dict[tuple, np.ndarray],
    sums: Callable[[dict[tuple, np.ndarray]], dict[tuple, tuple[np.ndarray, np.ndarray, float, float]]],
    steps: int = 50, tolerance: float = 1e-9, start: dict[tuple, np.ndarray] | None = None,
) -> dict[tuple, np.ndarray]:
    """Least places of penalised convex losses, one per key, from ``start`` (0 without it) on. The penalty is one for all keys, or one per key.

    ``sums`` takes the places asked for and gives each one's Hessian, gradient, loss and rows, without the penalty, in one scan.
    """
    penalties = penalty if isinstance(penalty, dict) else dict.fromkeys(keys, penalty)
    at = {k: np.zeros(len(penalties[k])) if start is None else start[k] for k in keys}
    state: dict[tuple, tuple[float, np.ndarray, np.ndarray]] = {}  # loss, place and step of the last accepted place
    open_ = set(keys)
    for _ in range(steps):
        if not open_:
            break
        for key, (gram, against, value, n) in sums({k: at[k] for k in open_}).items():
            b, penalty = at[key], penalties[key]
            value += float(penalty @ (b * b)) / 2
            if key in state and value > state[key][0] + 1e-12 * abs(state[key][0]):
                before, place, step = state[key]
                state[key] = (before, place, step / 2)
                at[key] = place - step / 2
                if np.abs(step).max() < 1e-14:
                    open_.discard(key)
                continue
            gradient = against + penalty * b
            if np.abs(gradient).max() <= tolerance * n:
                open_.discard(key)
                continue
            scale = 1 / np.sqrt(np.maximum(np.diag(gram) + penalty, 1e-300))
            hessian = (gram + np.diag(penalty)) * np.outer(scale, scale)
            step = scale * np.linalg.lstsq(hessian, gradient * scale, rcond=1e-14)[0]
            state[key] = (value, b, step)
            at[key] = b - step
    return at


def predict_models(df: DataFrame, by: Sequence[str], fits: dict[tuple, LinearFit], output: str) -> DataFrame:
    """Rows of ``df`` scored by the model of their ``by``; rows of no model go. The table of models is as long as ``fits``."""
    some = next(iter(fits.values()))
    types = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in by)
    told = df.sparkSession.createDataFrame([(*k, [*f.coefficients, f.intercept]) for k, f in fits.items()], f"{types}, __b array<double>")
    eta = F.col("__b")[len(some.inputs)]
    for i, name in enumerate(some.inputs):
        eta = eta + F.col(name).cast("double") * F.col("__b")[i]
    return df.join(F.broadcast(told), list(by)).withColumn(output, 1 / (1 + F.exp(-eta)) if some.logistic else eta).drop("__b")
