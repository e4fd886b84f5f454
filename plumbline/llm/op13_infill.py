"""Fill-in-the-middle by a wavelet matrix over character classes.

Every code point has one of eight classes: white space, line feed, word or sentence mark, each inside a run of its side (space or
not) or at the start of one. A wavelet matrix over the classes of a block of texts answers how often a class occurs before any
place; sums of such ranks count the unit ends before a place, and a bisection on these sums finds both cuts of every
text of the block at once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import query, table

SENTINELS = ("<P>", "<S>", "<M>")
LEVELS = 3
BLANK, FEED, WORD, MARK = 0, 2, 4, 6  # classes inside a run; one more at the start of a run
#: Texts are taken together up to so many code points; a longer one is a block of its own.
BLOCK = 1 << 20


class WaveletMatrix:
    """Ranks of small numbers: a bit plane for each level, each plane a stable partition of the one before."""

    def __init__(self, values: np.ndarray, levels: int = LEVELS) -> None:
        self.levels, self.zeros, self.words, self.before = levels, [], [], []
        for level in range(levels - 1, -1, -1):
            ones = (values >> level) & 1
            packed = np.packbits(ones, bitorder="little")
            words = np.zeros(len(values) // 64 + 1, dtype=np.uint64)
            words.view(np.uint8)[: len(packed)] = packed
            counts = np.bitwise_count(words).astype(np.int64)
            self.words.append(words)
            self.before.append(np.cumsum(counts) - counts)
            self.zeros.append(len(values) - int(counts.sum()))
            values = np.concatenate([values[ones == 0], values[ones == 1]])

    def _ones(self, plane: int, at: np.ndarray) -> np.ndarray:
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        below = self.words[plane][word] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.before[plane][word] + np.bitwise_count(below)

    def rank(self, value: int, at: np.ndarray) -> np.ndarray:
        """How often ``value`` stands before each place of ``at``."""
        start, end = np.zeros(1, dtype=np.int64), at.astype(np.int64)
        for plane in range(self.levels):
            if value >> (self.levels - 1 - plane) & 1:
                start, end = (self.zeros[plane] + self._ones(plane, x) for x in (start, end))
            else:
                start, end = (x - self._ones(plane, x) for x in (start, end))
        return end - start


def classes(texts: Sequence[str]) -> np.ndarray:
    """Classes of all code points of ``texts``, one text after the other; a text starts a run."""
    out = []
    for text in texts:
        side = None  # is the code point before white space?
        for i in range(0, len(text), BLOCK):
            c = np.frombuffer(text[i : i + BLOCK].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
            space = (c == 32) | ((c >= 9) & (c <= 13))
            kind = np.where(space, BLANK, WORD).astype(np.uint8)
            kind[c == 10] = FEED
            kind[(c == 33) | (c == 46) | (c == 63)] = MARK
            first = np.ones(len(c), dtype=bool)
            first[1:] = space[1:] != space[:-1]
            first[0] = side is None or side != space[0]
            side = space[-1]
            out.append(kind + first)
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint8)


class Units:
    """Unit ends in a block of texts. ``tokens``: white space and the word after it; white space at the end is a token. ``lines``: up to
    and with a line feed. ``chars``: every code point."""

    def __init__(self, texts: Sequence[str], unit: str = "tokens") -> None:
        lengths = np.array([len(t) for t in texts], dtype=np.int64)
        self.unit, self.end = unit, np.cumsum(lengths)
        self.start = self.end - lengths
        kinds = classes(texts)
        self.matrix = WaveletMatrix(kinds)
        some = lengths > 0
        first, last = np.zeros(len(lengths), dtype=np.uint8) + WORD, np.zeros(len(lengths), dtype=np.uint8) + WORD
        first[some], last[some] = kinds[self.start[some]], kinds[self.end[some] - 1]
        self.leads, self.trails, self.open = (first < WORD).astype(np.int64), (last < WORD).astype(np.int64), some & (last & 6 != FEED)

    def _between(self, values: Sequence[int], a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return sum(self.matrix.rank(v, b) - self.matrix.rank(v, a) for v in values)

    def count(self) -> np.ndarray:
        """Units of every text."""
        if self.unit == "chars":
            return self.end - self.start
        if self.unit == "lines":
            return self._between((FEED, FEED + 1), self.start, self.end) + self.open
        return self._between((WORD + 1, MARK + 1), self.start, self.end) + self.trails

    def ends(self, at: np.ndarray) -> np.ndarray:
        """Units of every text that end at or before the place ``at`` inside of it (an end of the text does not count here)."""
        if self.unit == "lines":
            return self._between((FEED, FEED + 1), self.start, at)
        # a token ends where white space starts after it
        return self._between((BLANK + 1, FEED + 1), self.start, np.minimum(at + 1, self.end)) - self.leads

    def cut(self, k: np.ndarray) -> np.ndarray:
        """Code points in the first ``k`` units of every text, 0 <= k <= count: the least place with so many ends."""
        if self.unit == "chars":
            return k
        low, high = self.start.copy(), self.end.copy()
        for _ in range(int((high - low).max(initial=0)).bit_length()):
            middle = (low + high) // 2
            enough = self.ends(middle) >= k
            low, high = np.where(enough, low, np.minimum(middle + 1, high)), np.where(enough, middle, high)
        return np.where(k == 0, 0, np.where(k == self.count(), self.end, high) - self.start)


def drawn(seed: int, doc_id: int | None) -> list[int]:
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def joined(form: str, prefix: str, middle: str, suffix: str, sentinels: Sequence[str] = SENTINELS) -> str:
    p, s, m = sentinels
    return f"{p}{prefix}{s}{suffix}{m}{middle}" if form == "psm" else f"{s}{suffix}{p}{prefix}{m}{middle}"


def rebuilt(text: str | None, form: str, sentinels: Sequence[str] = SENTINELS) -> str | None:
    """The text that was taken apart; no sentinel can arise across a border, since none begins inside of another."""
    if form == "plain" or text is None:
        return text
    p, s, m = sentinels
    first, second = (p, s) if form == "psm" else (s, p)
    one, rest = text[len(first) :].split(second, 1)
    two, middle = rest.split(m, 1)
    prefix, suffix = (one, two) if form == "psm" else (two, one)
    return prefix + middle + suffix


def _blocks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, text in enumerate(texts):
        if i > start and size + len(text or "") > BLOCK:
            yield start, i
            start, size = i, 0
        size += len(text or "")
    if texts:
        yield start, len(texts)


def _mapped(docs: DataFrame, text_col: str, inputs: list[str], added: dict[str, pa.DataType], make) -> DataFrame:
    """``docs`` with the text column and the columns ``added`` made by ``make`` from blocks of the ``inputs``; all others pass untouched."""
    from pyspark.sql.pandas.types import from_arrow_type
    from pyspark.sql.types import StructField, StructType

    fields = [f for f in docs.schema.fields if f.name not in added] + [StructField(k, from_arrow_type(t)) for k, t in added.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {f: batch.column(batch.schema.get_field_index(f)) for f in inputs}
            for a, b in _blocks(columns[text_col].to_pylist()):
                got = make(*[columns[f].slice(a, b - a).to_pylist() for f in inputs])
                kept = {f.name: batch.column(batch.schema.get_field_index(f.name)).slice(a, b - a) for f in fields if f.name not in added}
                kept[text_col] = pa.array(got.pop(text_col), kept[text_col].type)
                arrays = kept | {k: pa.array(got[k], t) for k, t in added.items()}
                yield pa.RecordBatch.from_arrays(list(arrays.values()), names=list(arrays))

    return docs.mapInArrow(run, StructType(fields))


def fill_in_middle(
    docs: DataFrame, seed: int = 42, rate: int = 50, spm: int = 80, unit: str = "tokens", sentinels: Sequence[str] = SENTINELS,
    id_col: str = "doc_id", text_col: str = "text", told: Sequence[str] = ("n", "form", "prefix_chars", "middle_chars"),
) -> DataFrame:
    """``docs`` with each text taken apart at two unit borders and put together as its form says, and the columns ``told``: number of units,
    form (plain, spm or psm), code points of prefix and middle (NULL if plain). A column of ``docs`` with such a name gives way.

    The cuts and the form follow from ``seed`` and the id (NULL: no digits) alone, so reruns, ties and repeated rows agree. A text is
    left plain if it is empty or holds a sentinel, or for 100 - ``rate`` of 100 ids; of the rest ``spm`` of 100 are spm. A NULL text stays NULL,
    has no unit and is plain.
    """
    if id_col in told or text_col in told:
        raise ValueError("the columns told need names of their own")

    def make(ids: list, texts: list[str | None]) -> dict[str, list]:
        units = Units([t or "" for t in texts], unit)
        n, chance = units.count(), [drawn(seed, i) for i in ids]
        ends = np.sort(np.array([c[:2] for c in chance], dtype=np.int64).reshape(-1, 2) % (n[:, None] + 1), axis=1)
        cuts = [units.cut(ends[:, k]).tolist() for k in (0, 1)]
        out, forms, sizes = [], [], []
        for text, (_, _, h3, h4), a, b in zip(texts, chance, *cuts, strict=True):
            plain = not text or h3 % 100 >= rate or any(s in text for s in sentinels)
            form = "plain" if plain else "spm" if h4 % 100 < spm else "psm"
            out.append(text if plain else joined(form, text[:a], text[a:b], text[b:], sentinels))
            forms.append(form)
            sizes.append((None, None) if plain else (a, b - a))
        return {text_col: out, told[0]: n.tolist(), told[1]: forms, told[2]: [s[0] for s in sizes], told[3]: [s[1] for s in sizes]}

    return _mapped(docs, text_col, [id_col, text_col], dict(zip(told, (pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)), make)


def restore(docs: DataFrame, sentinels: Sequence[str] = SENTINELS, text_col: str = "text", form_col: str = "form") -> DataFrame:
    """``docs`` with the texts that ``fill_in_middle`` took apart put right again, from text and form alone."""
    return _mapped(docs, text_col, [text_col, form_col], {}, lambda texts, forms: {text_col: [rebuilt(t, f, sentinels) for t, f in zip(texts, forms, strict=True)]})


SQL = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') AS u,
  sha256('42:' || CAST(doc_id AS VARCHAR)) AS s FROM documents),
h AS (SELECT *, len(u) AS n, CAST('0x' || s[1:8] AS UBIGINT) AS h1, CAST('0x' || s[9:16] AS UBIGINT) AS h2, CAST('0x' || s[17:24] AS UBIGINT) AS h3, CAST('0x' || s[25:32] AS UBIGINT) AS h4 FROM t),
c AS (SELECT *, CAST(least(h1 % (n + 1), h2 % (n + 1)) AS BIGINT) AS a, CAST(greatest(h1 % (n + 1), h2 % (n + 1)) AS BIGINT) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, array_to_string(u[1:a], '') AS x, array_to_string(u[a + 1:b], '') AS y, array_to_string(u[b + 1:], '') AS z FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(x) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(y) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || x || '<S>' || z || '<M>' || y ELSE '<S>' || z || '<P>' || x || '<M>' || y END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM p
"""


@query("op13_infill", SQL)
def op13_infill(spark: SparkSession, folder: str) -> DataFrame:
    made = fill_in_middle(table(spark, folder, "documents").select("doc_id", "text"))
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    return restore(made.withColumn("output_sha256", digest)).withColumn("restored_sha256", digest).drop("text")
