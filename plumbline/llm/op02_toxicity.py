"""Toxicity by compression distance: the same window under two Zstandard dictionaries.

One dictionary is trained on ordinary text. The other is trained on toxic text, on those words of toxic documents that hold a
run of letters which ordinary documents seldom have; what both kinds of text share is common ground and stands in both
compressors. A window's gain is its compressed length under the ordinary dictionary minus that under the ordinary and
toxic ones together. Gains get calibrated log odds, and a document's sum of them a calibrated score.

Zstandard matches three bytes or more and pays several bytes a match, too coarse for a window of a word or two. Each
character is therefore written as four bytes (its code point times an odd constant), so that phrases of any length count.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch_map, cut_lineage, held_out, lookup_join, query, table

LOW, HIGH = -12, 24
GRAM = 5
#: Scores of so many distinct windows are kept by a Python worker.
REMEMBERED = 400_000


def _wide(text: str) -> bytes:
    return (np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32) * np.uint32(2654435761)).tobytes()


def windows(text: str | None, size: int) -> list[str]:
    """Windows of ``size`` words, lower case, without overlap; they cover the whole text."""
    words = (text or "").lower().split()
    return words if size == 1 else [" ".join(words[i : i + size]) for i in range(0, len(words), size)]


def grams(word: str) -> set[str]:
    """Runs of letters that can tell a word: its beginning counts as one; a word too short for a run is one as a whole."""
    word = " " + word
    if len(word) < GRAM:
        return {word + " "}
    return {word[i : i + GRAM] for i in range(len(word) - GRAM + 1)}


@dataclass
class ToxicityModel:
    """Two dictionaries, log odds by gain, and the weights of the document score."""

    ordinary: bytes
    toxic: bytes
    base_rate: float
    size: int = 1
    level: int = 13
    odds: np.ndarray = field(default_factory=lambda: np.zeros(HIGH - LOW + 1))
    weights: np.ndarray | None = None
    _tools: tuple | None = None
    _known: dict[str, int] = field(default_factory=dict)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_tools": None, "_known": {}}

    def _squeezers(self) -> tuple:
        if self._tools is None:
            given = zstandard.ZstdCompressionParameters.from_level(
                self.level, source_size=128, dict_size=len(self.ordinary) + len(self.toxic), write_content_size=False, write_checksum=False, write_dict_id=False
            )
            tools = []
            for content in (self.ordinary, self.ordinary + self.toxic):
                shared = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                shared.precompute_compress(compression_params=given)
                tools.append(zstandard.ZstdCompressor(dict_data=shared, compression_params=given).compress)
            self._tools = tuple(tools)
        return self._tools

    def gain(self, window: str) -> int:
        known = self._known.get(window)
        if known is None:
            without, with_toxic = self._squeezers()
            wide = _wide(f" {window} ")
            known = min(HIGH, max(LOW, len(without(wide)) - len(with_toxic(wide)))) - LOW
            if len(self._known) >= REMEMBERED:
                self._known.clear()
            self._known[window] = known
        return known

    def gains(self, text: str | None) -> np.ndarray:
        """Number of windows of each gain."""
        return np.bincount([self.gain(w) for w in windows(text, self.size)] or [-LOW], minlength=HIGH - LOW + 1) * bool((text or "").strip())

    def features(self, counts: np.ndarray) -> np.ndarray:
        n, total = counts.sum(-1), counts @ self.odds
        strong = counts @ np.maximum(0.0, self.odds - 1.0)
        return np.stack([np.ones_like(total), total / 10, total / np.sqrt(n + 1.0), np.log1p(n), np.log1p(strong), np.log1p(strong) * np.log1p(n) / 10], axis=-1)

    def score(self, text: str | None) -> float:
        if self.weights is None:
            return self.base_rate
        if not (text or "").split():
            return 0.0
        return float(1 / (1 + np.exp(-np.clip(self.features(self.gains(text)) @ self.weights, -30, 30))))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 40) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        bend = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(bend, x.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _trained(samples: list[str], size: int, segment: int) -> bytes:
    wide = [_wide(s) for s in samples]
    try:
        return zstandard.train_dictionary(size, wide, k=segment, d=8, f=20, accel=1).as_bytes()
    except zstandard.ZstdError:  # too little text to train on: the text itself serves
        return b"".join(wide)[-size:]


def learn(
    docs: DataFrame, labels: DataFrame, window_words: int = 1, toxic_docs: int = 6000, ordinary_docs: int = 9000, ordinary_bytes: int = 131_072, toxic_bytes: int = 65_536, level: int = 13,
    most_words: int = 20_000, word_uses: int = 40, passages: int = 12_000,
) -> ToxicityModel:
    """Fit on texts of ``docs`` (doc_id, text) with a label in ``labels`` (doc_id, toxic 0/1); NULL texts and labels are left out.

    About ``toxic_docs`` and ``ordinary_docs`` labels, drawn by a hash, take part, so few that their ids can be sent to all tasks and texts
    without one of them stay where they are. Three fifths of them give the
    dictionaries and the rest the calibration, so that odds are not told by words which a dictionary has from the same text.
    The toxic dictionary is trained on the ``most_words`` most used words with a telling run, each as often as it is used but at most ``word_uses`` times;
    the ordinary one on ``passages`` passages of 200 characters, drawn by a hash: more than dictionaries of ``toxic_bytes`` and ``ordinary_bytes``
    can hold. All telling runs of the drawn texts count. Only these, and a row of counts for each calibration document, reach the driver. An id with
    several labels counts as toxic if one is.
    """
    told = labels.select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("toxic")).filter("id IS NOT NULL AND toxic IN (0, 1)")
    rows = told.groupBy("id").agg(F.max("toxic").alias("toxic"))
    counts = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
    base = counts.get(1, 0) / max(1, sum(counts.values()))
    if len(counts) < 2:
        return ToxicityModel(b"", b"", base, window_words, level)
    draw = F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1 << 20)) / (1 << 20)
    rate = F.when(F.col("toxic") == 1, min(1.0, toxic_docs / counts[1])).otherwise(min(1.0, ordinary_docs / counts[0]))
    ids = cut_lineage(rows.filter(draw < rate).withColumn("fold", F.pmod(F.xxhash64("id", F.lit(12)), F.lit(5))))
    drawn = cut_lineage(lookup_join(docs.select(F.col("doc_id").alias("id"), "text").filter("text IS NOT NULL"), ids, "id", "inner"))
    base_docs = drawn.filter("fold < 3")
    n = {r.toxic: r["count"] for r in base_docs.groupBy("toxic").count().collect()}
    n1, n0 = max(1, n.get(1, 0)), max(1, n.get(0, 0))

    def gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = (Counter(), Counter())
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own: set[str] = set()
                for word in set(windows(text, 1)):
                    own |= grams(word)
                found[toxic].update(own)
            names = list(found[0] | found[1])
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([found[0][g] for g in names], pa.int64()), pa.array([found[1][g] for g in names], pa.int64())], ["gram", "n0", "n1"])

    met = base_docs.select("text", "toxic").mapInArrow(gram_counts, "gram string, n0 long, n1 long").groupBy("gram").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    clear = (F.col("n1") / n1 > 4 * (F.col("n0") + 0.5) / n0) & (F.col("n1") / n1 - F.col("n0") / n0 > 3.5 * F.sqrt(F.col("n0") + 1.0) / n0 + 3 / n1)
    telling = {r.gram for r in met.filter((F.col("n1") >= 3) & clear).collect()}

    def toxic_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = Counter(w for text in batch.column(0).to_pylist() for w in windows(text, 1) if not telling.isdisjoint(grams(w)))
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["word", "n"])

    words = base_docs.filter("toxic = 1").select("text").mapInArrow(toxic_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.col("n").desc(), "word").limit(most_words).collect()
    many = sorted((zlib.crc32(f"{r.word} {i}".encode()), r.word) for r in words for i in range(min(r.n, word_uses)))
    marked = [" " + " ".join(w for _, w in many[i : i + 12]) + " " for i in range(0, len(many), 12)]

    def ordinary_passages(rows: dict[str, list]) -> dict[str, list]:
        lower = [" ".join(windows(t, 1)) for t in rows["text"]]
        return {"passage": [t[i : i + 200] for t in lower for i in range(0, len(t), 200)]}

    spread = batch_map(base_docs.filter("toxic = 0").select("text"), ordinary_passages, "passage string").withColumn("h", F.xxhash64("passage", F.lit(13)))
    common = [r.passage for r in spread.orderBy("h", "passage").limit(passages).collect()]
    model = ToxicityModel(_trained(common, ordinary_bytes, 400), _trained(marked, toxic_bytes, 96) if marked else b"", base, window_words, level)

    shared = drawn.sparkSession.sparkContext.broadcast(model)

    def gain_counts(rows: dict[str, list]) -> dict[str, list]:
        return {"toxic": rows["toxic"], "counts": [shared.value.gains(t).tolist() for t in rows["text"]]}

    seen = batch_map(drawn.filter("fold >= 3").orderBy("id").select("text", "toxic"), gain_counts, "toxic int, counts array<long>", 64).collect()
    y = np.array([r.toxic for r in seen], dtype=float)
    if 0 < y.sum() < len(y):
        x = np.array([r.counts for r in seen], dtype=float)
        per_doc = x / np.sqrt(x.sum(1, keepdims=True) + 1)  # so that a long document does not set the odds alone
        one, zero = per_doc[y == 1].sum(0), per_doc[y == 0].sum(0)
        model.odds = np.log((one + 0.05 * one.sum() / len(one) / 10) / one.sum()) - np.log((zero + 0.05 * zero.sum() / len(zero) / 10) / zero.sum())
        model.weights = _logistic(model.features(x), y)
    return model


def score(docs: DataFrame, model: ToxicityModel, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score, predicted for every whole text. Texts without a word, NULL among them, have no window and score 0.

    Without labels of both kinds every score is the share of toxic labels (0 if there are none).
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries and a few numbers

    def block(rows: dict[str, list]) -> dict[str, list]:
        got = [shared.value.score(t) for t in rows["text"]]
        return {id_col: rows["id"], "score": got, "predicted": [int(s >= threshold) for s in got]}

    return batch_map(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), block, f"`{id_col}` long, score double, predicted int", 64)


def reject(docs: DataFrame, model: ToxicityModel, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """Rows of ``docs``, all columns, whose text scores below ``threshold``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.names.index(text_col)
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                yield part.filter(pa.array([shared.value.score(t) < threshold for t in part.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def training_labels(labels: DataFrame) -> DataFrame:
    """Labels of documents that are not held out."""
    return labels.filter(~held_out(F.col("doc_id"))).select("doc_id", "toxic")


@query("op2_toxicity")
def op2_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = learn(docs, training_labels(table(spark, folder, "labels")))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
