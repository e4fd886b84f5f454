"""Language of a text by bit-sliced Bloom filters of character n-grams.

One table of slots serves all languages: a slot holds a bit for each language, and an n-gram sets its language's bit in a few
slots. The AND of an n-gram's slots are the languages that contain it. For each language the n-grams of a text that hit are
counted, the hits that its filling would give by chance are taken off, and the language with most hits left is told.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch_map, held_out, query, table

_NO_LETTERS = regex.compile(r"\P{L}+")
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], dtype=np.uint64)
_SLOTS_OF = np.array([0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x94D049BB133111EB], dtype=np.uint64)
UNKNOWN = "und"


def ngrams(text: str, orders: tuple[int, ...] = (3, 4)) -> np.ndarray:
    """Hashes of all n-grams of the lower-case letters; other characters count as one blank, also at both ends."""
    letters = np.frombuffer((" " + _NO_LETTERS.sub(" ", text.lower()).strip() + " ").encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    found = []
    for n in orders:
        size = len(letters) - n + 1
        if size > 0:
            h = np.full(size, n, dtype=np.uint64)
            for i in range(n):
                h = (h ^ letters[i : i + size]) * _MULTIPLIERS[i]
                h ^= h >> np.uint64(29)
            found.append(h)
    return np.concatenate(found) if found else np.empty(0, dtype=np.uint64)


@dataclass
class LanguageFilters:
    """``slots[w][i]``: bits of 64 languages (w-th group) in slot i; ``chance``: share of unseen n-grams that hit by language."""

    languages: list[str]
    slots: list[np.ndarray]
    bits: int
    chance: np.ndarray

    @classmethod
    def build(cls, grams: dict[str, np.ndarray], slots_for_each: int = 8) -> LanguageFilters:
        languages = sorted(grams)
        total = max(64, slots_for_each * max((len(np.unique(g)) for g in grams.values()), default=1))
        bits = int(np.ceil(np.log2(total)))
        kind = np.uint8 if len(languages) <= 8 else np.uint64
        width = 8 if kind is np.uint8 else 64
        slots = [np.zeros(1 << bits, dtype=kind) for _ in range(-(-max(1, len(languages)) // width))]
        for i, language in enumerate(languages):
            for place in cls._places(grams[language], bits):
                np.bitwise_or.at(slots[i // width], place, kind(1 << (i % width)))
        full = np.array([np.count_nonzero(slots[i // width] & kind(1 << (i % width))) / (1 << bits) for i in range(len(languages))])
        return cls(languages, slots, bits, full ** len(_SLOTS_OF))

    @staticmethod
    def _places(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
        return [((hashes ^ (hashes >> np.uint64(31))) * m) >> np.uint64(64 - bits) for m in _SLOTS_OF]

    def masks(self, hashes: np.ndarray) -> list[np.ndarray]:
        """For each group of languages, the bits of those that contain each n-gram (or seem to)."""
        places = self._places(hashes, self.bits)
        return [s[places[0]] & s[places[1]] & s[places[2]] for s in self.slots]

    def hits(self, text: str) -> np.ndarray:
        """Number of n-grams of the text in each language, corrected for hits by chance."""
        hashes = ngrams(text)
        out = np.zeros(len(self.languages))
        for w, mask in enumerate(self.masks(hashes)):
            width = 8 if mask.dtype == np.uint8 else 64
            for i in range(w * width, min(len(out), (w + 1) * width)):
                out[i] = np.count_nonzero(mask & mask.dtype.type(1 << (i % width)))
        return np.maximum(0.0, (out - len(hashes) * self.chance) / np.maximum(1e-9, 1 - self.chance))

    def decide(self, text: str | None) -> tuple[str, float]:
        """Language and its share of all corrected hits; ties go to the first by name, no hit at all gives score 0."""
        if text is None or not self.languages or _NO_LETTERS.sub("", text) == "":
            return UNKNOWN, 0.0
        hits = self.hits(text)
        best = int(np.argmax(hits))
        return self.languages[best], float(hits[best] / hits.sum()) if hits.sum() > 0 else 0.0


def learn(docs: DataFrame, docs_for_each: int = 3000, min_rate: float = 2e-5, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> LanguageFilters:
    """Filters from labelled documents: those with a text and a language.

    About ``docs_for_each`` documents of each language, drawn by a hash of the id and text, are counted whole. An n-gram belongs to a
    language if it makes up ``min_rate`` of its n-grams or more, so a language has at most 1 / ``min_rate`` of them and the
    filters' size is bounded by the number of languages.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter("text IS NOT NULL AND lang IS NOT NULL")
    rates = rows.groupBy("lang").agg(F.least(F.lit(1.0), docs_for_each / F.count(F.lit(1))).alias("rate"))
    drawn = rows.join(F.broadcast(rates) if rates.count() <= 100_000 else rates, "lang").filter(F.pmod(F.xxhash64("id", "text"), F.lit(1 << 20)) < F.col("rate") * (1 << 20))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_lang: dict[str, list[np.ndarray]] = {}
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by_lang.setdefault(lang, []).append(ngrams(text))
            for lang, found in by_lang.items():
                keys, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])

    counted = drawn.select("text", "lang").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    totals = counted.groupBy("lang").agg(F.sum("n").alias("total"))
    kept = counted.join(totals, "lang").filter(F.col("n") >= F.greatest(F.lit(2.0), F.col("total") * min_rate)).select("lang", "gram").toPandas()
    return LanguageFilters.build({lang: part["gram"].to_numpy().astype(np.int64).view(np.uint64) for lang, part in kept.groupby("lang")})


def predict(docs: DataFrame, filters: LanguageFilters, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score of every document; NULL texts and texts without a letter get ``und`` and 0."""
    shared = docs.sparkSession.sparkContext.broadcast(filters)  # bounded, see learn()

    def block(rows: dict[str, list]) -> dict[str, list]:
        told = [shared.value.decide(t) for t in rows["text"]]
        return {id_col: rows["id"], "lang_pred": [x for x, _ in told], "score": [s for _, s in told]}

    return batch_map(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), block, f"`{id_col}` long, lang_pred string, score double", 256)


@query("op3_language")
def op3_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    filters = learn(docs.filter(~held_out(F.col("doc_id"))))
    return predict(docs, filters).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
