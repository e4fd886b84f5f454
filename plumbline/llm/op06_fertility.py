"""Quality rules by tokeniser fertility.

A public vocabulary is a yardstick for text: junk needs more tokens for its characters, falls back to bytes more often or
repeats its tokens more (or less) than the other texts of its language. Each measure has a band per language (per script where a language is
missing), set from the quartiles of all documents that pass the plain rules; a document outside of a band is rejected. Entropy falls as
a text grows, so its band follows a line over the logarithm of the number of tokens.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import public_tokenizers
import regex
import sentencepiece
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch_map, cut_lineage, lookup_join, query, table

SYMBOLS = "#*$%&|<>"
_SCRIPTS = ("Latin", "Cyrillic", "Greek", "Arabic", "Hebrew", "Devanagari", "Han", "Hiragana", "Katakana", "Hangul", "Thai")
_LETTERS = [(name, regex.compile(rf"\p{{Script={name}}}")) for name in _SCRIPTS]
MEASURES = ("chars_per_token", "byte_share", "entropy")
#: Quartile ranges count as so much at least.
FLOOR = {"chars_per_token": 0.05, "byte_share": 0.005, "entropy": 0.01}


@lru_cache(maxsize=2)
def _pieces(path: str) -> tuple[sentencepiece.SentencePieceProcessor, np.ndarray]:
    own = sentencepiece.SentencePieceProcessor(model_file=path)
    return own, np.array([own.is_byte(i) for i in range(own.get_piece_size())])


def repeated_words(words: list[bytes], size: int = 3) -> int:
    """Words that lie in a window of ``size`` words which the text has twice or more, the first one included."""
    if len(words) < size + 1:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], dtype=np.int64)
    runs = ids[: len(ids) - size + 1]
    for i in range(1, size):  # number the runs anew after each word, so that numbers stay small
        _, runs = np.unique(runs * len(seen) + ids[i : len(ids) - size + 1 + i], return_inverse=True)
    twice = np.flatnonzero(np.bincount(runs)[runs] > 1)
    covered = np.zeros(len(words), dtype=bool)
    for i in range(size):
        covered[twice + i] = True
    return int(covered.sum())


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words; all 0 for NULL."""
    text = text or ""
    data = text.encode()
    seen: set[bytes] = set()
    again = 0
    for line in data.split(b"\n"):
        if line in seen:
            again += 1
        elif line.split(None, 1):
            seen.add(line)
    words = data.split()
    return len(words), len(text) - sum(map(text.count, " \t\n\v\f\r")), sum(map(text.count, SYMBOLS)), again, repeated_words(words)


def fertility(texts: list[str], path: str) -> list[tuple[int, float, float, float]]:
    """n_tokens, characters per token, share of byte tokens, entropy of tokens over the most that so many can have."""
    own, is_byte = _pieces(path)
    out = []
    for text, ids in zip(texts, own.encode(texts, num_threads=1), strict=True):
        n = len(ids)
        if not n:
            out.append((0, 0.0, 0.0, 0.0))
            continue
        counts = np.bincount(np.array(ids, dtype=np.int64))
        kept = counts[counts > 0]
        share = kept / n
        most = np.log2(min(n, len(is_byte)))
        out.append((n, len(text) / n, float(counts[is_byte[: len(counts)].nonzero()[0]].sum() / n), float(-(share * np.log2(share)).sum() / most) if most else 0.0))
    return out


def script(text: str | None) -> str:
    """The script most letters are of, ``none`` without letters of the known ones."""
    n, name = max((len(p.findall(text or "")), name) for name, p in _LETTERS)
    return name if n else "none"


def measure(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """Base counts, tokeniser measures and ``band`` (language, or script where it is NULL) of every whole text."""

    def block(rows: dict[str, list]) -> dict[str, list]:
        base = [base_counts(t) for t in rows["text"]]
        told = fertility([t or "" for t in rows["text"]], path)
        out = {"doc_id": rows["id"], "band": [g if g is not None else "script " + script(t) for g, t in zip(rows["lang"], rows["text"], strict=True)]}
        out |= {n: [b[i] for b in base] for i, n in enumerate(("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))}
        return out | {n: [x[i] for x in told] for i, n in enumerate(("n_tokens", *MEASURES))}

    schema = "doc_id long, band string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_tokens long, chars_per_token double, byte_share double, entropy double"
    lang = F.lit(None).cast("string") if lang_col is None else F.col(lang_col).cast("string")
    return batch_map(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), lang.alias("lang")), block, schema, 64)


def quality(
    docs: DataFrame,
    path: str,
    widths: tuple[tuple[float | None, float], ...] = ((4.5, 4.5), (None, 8.0), (3.0, 6.0)),
    least: int = 50,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str | None = "lang",
) -> DataFrame:
    """``measure`` with base_failed, kept and, for each measure, whether it lies in its band.

    base_failed: fewer than 50 words, or over half of them in repeated windows of three. A band reaches ``widths`` (below, above) quartile
    ranges (at least FLOOR each) beyond the quartiles of documents that did not fail; None is no end, since no byte token is the best share.
    Quartiles of entropy are those of its distance from the language's line over log2 of the number of tokens (of the vocabulary, if that is
    less); where quartiles lie far apart, or a text is short, an end may lie outside of what is possible. A language of fewer than ``least``
    such documents has no band and rejects nothing. A NULL or short text fails.
    """
    rows = cut_lineage(measure(docs, path, id_col, text_col, lang_col).withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))))
    length = F.log2(F.greatest(F.lit(1), F.least(F.col("n_tokens"), F.lit(len(_pieces(path)[1])))))
    counted = rows.filter("NOT base_failed").groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.regr_slope("entropy", length).alias("slope")).filter(F.col("n") >= least)
    slopes = cut_lineage(counted.select("band", F.round(F.coalesce("slope", F.lit(0.0)), 6).alias("slope")))  # rounded: the order of sums is not fixed
    sloped = lookup_join(rows, slopes, "band").withColumn("bend", F.col("slope") * length)
    value = {m: F.col(m) - F.col("bend") if m == "entropy" else F.col(m) for m in MEASURES}
    spans = sloped.filter("NOT base_failed AND slope IS NOT NULL").groupBy("band").agg(*[F.percentile_approx(value[m], [0.25, 0.75], 2000).alias(m) for m in MEASURES])
    bands = cut_lineage(spans.select("band", *[F.col(m)[i].alias(f"{m}_{q}") for m in MEASURES for i, q in enumerate(("first", "last"))]))
    joined = lookup_join(sloped, bands, "band")

    def within(m: str, below: float | None, above: float) -> Column:
        bend = F.col("bend") if m == "entropy" else F.lit(0.0)
        first, last = F.col(f"{m}_first"), F.col(f"{m}_last")
        span = F.greatest(last - first, F.lit(FLOOR[m]))
        low = F.lit(0.0) if below is None else first + bend - below * span
        return F.coalesce(F.col(m).between(low, last + bend + above * span), F.lit(True))

    inside = {m: within(m, *w) for m, w in zip(MEASURES, widths, strict=True)}
    verdict = ~F.col("base_failed")
    for m in MEASURES:
        verdict = verdict & inside[m]
    return joined.select(*rows.columns, verdict.alias("kept"), *[inside[m].alias(f"{m}_ok") for m in MEASURES])


@query("op6_fertility")
def op6_fertility(spark: SparkSession, folder: str) -> DataFrame:
    done = quality(table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return done.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", *MEASURES)
