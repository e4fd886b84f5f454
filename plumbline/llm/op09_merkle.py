"""Document fingerprints as Merkle trees: passages, paragraphs, sections, document.

A leaf is a passage (a sentence; a long one is cut where its words say so), a paragraph is a line, a section ends at a blank
line, before a heading, or after a paragraph whose digest says so. Cuts depend on nearby text alone, so an edit changes the leaves it touches and the
nodes above them. Equal roots mean equal texts; the branches whose digests differ show where two texts part.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import query, table

_SENTENCE = regex.compile(r"[^.!?\n]*[.!?]+[ \t]*|[^.!?\n]+\n?|\n")
_LINE = regex.compile(r"[^\n]*\n|[^\n]+")
_WORD = regex.compile(r"\S*\s*")
#: Passages above so many characters are cut after words whose checksum is a multiple of CUT.
LONG, CUT = 240, 12
SECTION_CUT = 8
MAX_BLOCKS = 65_536


def _hash(data: bytes, tag: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16, person=tag).digest()


def _passages(paragraph: str) -> list[str]:
    out = []
    for sentence in _SENTENCE.findall(paragraph):
        if len(sentence) <= LONG:
            out.append(sentence)
            continue
        held: list[str] = []
        for word in _WORD.findall(sentence):
            held.append(word)
            if zlib.crc32(word.encode()) % CUT == 0 and word:
                out.append("".join(held))
                held = []
        if rest := "".join(held):
            out.append(rest)
    return out


class Tree:
    """Root, nodes and leaves of one text; ``leaves`` counts (digest, length) pairs."""

    __slots__ = ("leaves", "root", "sections", "size")

    def __init__(self, text: str):
        self.sections: list[tuple[bytes, list[tuple[bytes, list[tuple[str, int]]]]]] = []
        self.leaves: Counter = Counter()
        self.size = len(text)
        paragraphs: list[tuple[bytes, list[tuple[str, int]]]] = []

        def close() -> None:
            if paragraphs:
                self.sections.append((_hash(b"".join(d for d, _ in paragraphs), b"section"), paragraphs.copy()))
                paragraphs.clear()

        for line in _LINE.findall(text):
            if line.startswith("#"):
                close()
            passages = [(_hash(p.encode(), b"passage"), len(p)) for p in _passages(line)]
            digest = _hash(b"".join(d for d, _ in passages), b"paragraph")
            named = [(d[:4].hex(), n) for d, n in passages]
            self.leaves.update(named)
            paragraphs.append((digest, named))
            if not line.strip() or digest[0] % SECTION_CUT == 0:
                close()
        close()
        self.root = _hash(b"".join(d for d, _ in self.sections), b"document").hex()

    def text(self) -> str:
        """root:section[paragraph(leaf.length,leaf.length)paragraph(...)]section[...]"""
        return f"{self.root}:" + "".join(
            s[:4].hex() + "[" + "".join(p[:4].hex() + "(" + ",".join(f"{d}.{n}" for d, n in leaves) + ")" for p, leaves in paragraphs) + "]" for s, paragraphs in self.sections
        )


_SECTION = regex.compile(r"([0-9a-f]{8})\[([^\]]*)\]")
_PARAGRAPH = regex.compile(r"([0-9a-f]{8})\(([^)]*)\)")


def _leaves(fingerprint: str) -> Counter:
    found = (x.split(".") for _, body in _PARAGRAPH.findall(fingerprint) for x in body.split(",") if x)
    return Counter((d, int(n)) for d, n in found)


def _alike(a: Counter, b: Counter) -> float:
    size = sum(n * c for (_, n), c in a.items()) + sum(n * c for (_, n), c in b.items())
    return 2 * sum(k[1] * min(c, b[k]) for k, c in a.items() if k in b) / size if size else 0.0


def likeness(a: str, b: str) -> float:
    """1 for equal roots; else the share of characters that lie in leaves common to both fingerprints."""
    return 1.0 if a.partition(":")[0] == b.partition(":")[0] else _alike(_leaves(a), _leaves(b))


def differing(a: str, b: str) -> list[tuple[int, int]]:
    """(section, paragraph) of every branch of ``a`` that ``b`` does not have; equal sections are not opened."""
    if a.partition(":")[0] == b.partition(":")[0]:
        return []
    other = _SECTION.findall(b)
    sections, paragraphs = {s for s, _ in other}, {p for _, body in other for p, _ in _PARAGRAPH.findall(body)}
    return [(i, k) for i, (s, body) in enumerate(_SECTION.findall(a)) if s not in sections for k, (p, _) in enumerate(_PARAGRAPH.findall(body)) if p not in paragraphs]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fingerprint of every text; NULL counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([Tree(t or "").text() for t in part.column(1).to_pylist()], pa.string())], [id_col, "fingerprint"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).alias("t")).mapInArrow(run, f"`{id_col}` long, fingerprint string")


def _in_blocks(rows: DataFrame, blocks: int) -> DataFrame:
    """``rows`` (k, ...) with ``block``: which of at most ``blocks`` ranges of k; found in two steps among their bounds."""
    shares = [i / blocks for i in range(1, blocks)]
    bounds = rows.agg(F.percentile_approx("k", shares, max(10_000, 10 * blocks))).first()[0] if shares else None
    bounds = sorted(set(bounds or []))
    step = max(1, int(len(bounds) ** 0.5))
    if not bounds:
        return rows.withColumn("block", F.lit(0))
    every = F.array(*[F.lit(b) for b in bounds[step - 1 :: step]])
    parts = F.array(*[F.array(*[F.lit(b) for b in bounds[i : i + step]]) for i in range(0, len(bounds), step)])
    below = lambda xs: F.size(F.filter(xs, lambda b: b <= F.col("k")))
    coarse = rows.withColumn("coarse", below(every))
    fine = F.coalesce(below(F.get(parts, F.col("coarse"))), F.lit(0))
    return coarse.withColumn("block", F.col("coarse") * step + F.greatest(fine, F.lit(0))).drop("coarse")


def with_next(docs: DataFrame, id_col: str, text_col: str, fn, schema: pa.Schema, ddl: str) -> DataFrame:
    """``fn(id, text, next text)`` for every document, in descending order of id; after the last stands the first.

    Texts move once, to one task for each range of ids; the head of each range is also sent to the range above. NULL ids come last; equal ids
    are ordered by text. A task streams its rows and holds two of them.
    """
    spark = docs.sparkSession
    blocks = min(MAX_BLOCKS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    lowest = -(1 << 63)
    rows = _in_blocks(docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(lowest)).alias("k"), F.coalesce(F.col(text_col), F.lit("")).alias("t")), blocks)
    heads = sorted(rows.groupBy("block").agg(F.max("k")).collect(), reverse=True)  # a row for each range
    if not heads:
        return spark.createDataFrame([], ddl)
    goes_to = spark.createDataFrame([(k, heads[i - 1][0]) for i, (_, k) in enumerate(heads)], "head long, above int")
    sent = rows.join(F.broadcast(goes_to), F.col("k") == F.col("head"), "left")
    places = F.filter(F.array(F.struct(F.col("block"), F.lit(0).alias("extra")), F.struct(F.col("above").alias("block"), F.lit(1).alias("extra"))), lambda p: p.block.isNotNull())
    dealt = sent.select("k", "t", F.explode(places).alias("p")).select("k", "t", "p.block", "p.extra")
    ordered = dealt.repartition(len(heads), "block").sortWithinPartitions("block", "extra", F.col("k").desc(), "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, out = None, []
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                for row in zip(*(c.to_pylist() for c in batch.slice(i, 256).columns), strict=True):
                    k, text, block, extra = row
                    if held is not None and held[2] == block:
                        out.append(fn(None if held[0] == lowest else held[0], held[1], text))
                    held = None if extra else (k, text, block)
                if len(out) >= 256:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    return ordered.mapInArrow(run, ddl)


_DDL = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_KINDS = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}


def edit_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness to each other and to the next document's.

    The edited text has its last third (rounded down, in code points) replaced by the first as many of the next document.
    """
    last: list = [None, None]

    def tree(text: str) -> Tree:
        if last[0] != text:
            last[:] = [text, Tree(text)]
        return last[1]

    def one(doc_id, text: str, after: str) -> dict:
        n = len(text)
        cut = n // 3
        edited = text[: n - cut] + after[:cut]
        own = tree(text)
        changed, following = Tree(edited), tree(after)
        near = lambda t: 1.0 if t.root == own.root else _alike(own.leaves, t.leaves)
        return {
            "doc_id": doc_id, "n_chars": n, "edited_sha256": hashlib.sha256(edited.encode()).hexdigest(), "fingerprint": own.text(),
            "edited_fingerprint": changed.text(), "near_edited": near(changed), "near_next": near(following),
        }

    schema = pa.schema([(x.split()[0], _KINDS[x.split()[1]]) for x in _DDL.split(", ")])
    return with_next(docs, id_col, text_col, one, schema, _DDL)


@query("op9_merkle")
def op9_merkle(spark: SparkSession, folder: str) -> DataFrame:
    return edit_report(table(spark, folder, "documents"))
