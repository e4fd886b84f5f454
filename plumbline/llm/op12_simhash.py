"""SimHash near duplicates by a segment-popcount embedding and a grid range-join.

A 64-bit fingerprint is mapped to the bit counts of its 32 two-bit segments. The Manhattan distance of two such vectors is at most
the number of differing bits. Of two fingerprints at 4 bits or fewer, the upper or the lower half differ in 2 bits or fewer, so that
the half vectors are within 2 of each other: both then lie within 1 of a common grid point. Every distinct fingerprint is put into
the grid cells within 1 of its two half vectors (34 to 66, 50 on average at random bits), and what meets in a cell is verified bit by bit.

Equal fingerprints are one node, so copies never meet. Cells are streamed through tasks in order; a cell gives no more links
than members (a spanning forest), and a cell of very many members is split into blocks that tasks compare with each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch_map, cut_lineage, lookup_join, query, table
from .components import components

BITS = 4
#: A cell of more members is compared in blocks of BLOCK members, spread over tasks.
HOT = 2048
BLOCK = 8192


def simhash(text: str | None, words: int = 4, seed: int = 42) -> int:
    """Signed 64-bit fingerprint: a bit is set if more than half of the shingles' XXH64 values have it; 0 without words."""
    found = (text or "").encode().lower().split()  # bytes.lower() folds A-Z only, bytes.split() cuts at ASCII white space only
    if not found:
        return 0
    plain = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    size = min(words, len(found))
    n, counts = len(found) - size + 1, np.zeros(64, dtype=np.int64)
    for i in range(0, n, 65536):
        spans = zip(starts[i : min(i + 65536, n)].tolist(), ends[i + size - 1 : min(i + 65536, n) + size - 1].tolist(), strict=True)
        hashes = np.array([xxhash.xxh64_intdigest(plain[a:b], seed) for a, b in spans], dtype=np.uint64)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.int64)[0])


def cells(fingerprint: Column) -> Column:
    """Grid points within 1 of the vectors of both halves: two bits a segment, the half's number above them."""

    def half(number: int) -> Column:
        bits = F.shiftrightunsigned(fingerprint, 32 * number).bitwiseAND(F.lit(0xFFFFFFFF))
        vector = bits - F.shiftright(bits, 1).bitwiseAND(F.lit(0x55555555))  # each pair of bits becomes their sum
        home = vector.bitwiseOR(F.lit(number << 32))
        steps = F.array(*[F.lit(1 << (2 * s)).cast("long") for s in range(16)])
        up = F.transform(steps, lambda s: F.when(home.bitwiseAND(2 * s) == 0, home + s))
        down = F.transform(steps, lambda s: F.when(home.bitwiseAND(3 * s) != 0, home - s))
        return F.concat(F.array(home), up, down)

    return F.filter(F.concat(half(0), half(1)), lambda c: c.isNotNull())


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1 and links (a, b): the least node of each one's component."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], least)
        np.minimum.at(label, label[b], least)
        label = label[label]
        if np.array_equal(label, before):
            return label


def _linked(cell: np.ndarray, fp: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links inside each run of equal cells."""
    found, at, k = [], np.arange(len(cell)), 0
    while True:
        k += 1
        at = at[at + k < len(cell)]
        at = at[cell[at] == cell[at + k]]
        if not len(at):
            break
        near = at[np.bitwise_count(fp[at] ^ fp[at + k]) <= bits]
        if len(near):
            found.append(np.stack([near, near + k]))
    if not found:
        return fp[:0], fp[:0]
    a, b = np.concatenate(found, axis=1)
    nodes, both = np.unique(np.concatenate([a, b]), return_inverse=True)
    label = _forest(len(nodes), both[: len(a)], both[len(a) :])
    other = label != np.arange(len(nodes))
    return fp[nodes[other]], fp[nodes[label[other]]]


def _stream(bits: int):
    """Links of sorted (cell, fp) batches; the last cell of a batch waits for the next batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(cell: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            a, b = _linked(cell, fp, bits)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        held, held_fp = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)
        for batch in batches:
            cell = np.concatenate([held, batch.column(0).to_numpy()])
            fp = np.concatenate([held_fp, batch.column(1).to_numpy().view(np.uint64)])
            last = np.searchsorted(cell, cell[-1]) if len(cell) else 0
            held, held_fp = cell[last:].copy(), fp[last:].copy()
            yield links(cell[:last], fp[:last])
        yield links(held, held_fp)

    return run


def _block_links(members: DataFrame, sizes: DataFrame, bits: int, block: int) -> DataFrame:
    """Links inside of large cells: members are dealt by hash into blocks, a task compares block i with block j >= i."""
    dealt = lookup_join(members, sizes.select("cell", F.ceil(F.col("n") / block).cast("int").alias("n")), "cell", "inner")
    own = F.pmod(F.xxhash64("fp", F.lit(5)), F.col("n")).cast("int")
    pairs = dealt.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    keyed = pairs.select("cell", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).alias("second"), "fp")

    def compare(part: pd.DataFrame) -> pd.DataFrame:
        every = part["fp"].to_numpy().view(np.uint64)
        right = part["second"].to_numpy() if part["i"].iloc[0] != part["j"].iloc[0] else np.ones(len(every), dtype=bool)
        left = np.nonzero(~right)[0] if not right.all() else np.arange(len(every))
        right, label = np.nonzero(right)[0], np.arange(len(every))
        for start in range(0, len(left), 256):
            rows = left[start : start + 256]
            x, y = np.nonzero(np.bitwise_count(every[rows][:, None] ^ every[right][None, :]) <= bits)
            if len(x):
                a, b = np.concatenate([rows[x], np.arange(len(label))]), np.concatenate([right[y], label])
                label = _forest(len(every), a, b)
        other = label != np.arange(len(every))
        return pd.DataFrame({"a": every[other].view(np.int64), "b": every[label[other]].view(np.int64)})

    return keyed.groupBy("cell", "i", "j").applyInPandas(compare, "a long, b long")


def near_pairs(nodes: DataFrame, bits: int = BITS, hot: int = HOT, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp`` at ``bits`` differing bits or fewer; each linked pair is connected by the links,
    though not each pair is one."""
    if bits > 5:
        raise ValueError("half vectors share a grid point up to 5 bits")
    placed = nodes.select("fp", F.explode(cells(F.col("fp"))).alias("cell"))
    large = cut_lineage(placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hot))
    few = lookup_join(placed, large.select("cell"), "cell", "left_anti").select("cell", "fp")
    small = few.repartition("cell").sortWithinPartitions("cell").mapInArrow(_stream(bits), "a long, b long")
    many = _block_links(lookup_join(placed, large.select("cell"), "cell", "left_semi"), large, bits, block)
    return cut_lineage(small.unionByName(many).distinct())


def near_duplicates(docs: DataFrame, words: int = 4, bits: int = BITS, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row of ``docs``.

    Words are cut at ASCII white space after A-Z are lower-cased; shingles of ``words`` words count as often as they occur, a shorter
    text is one shingle. Texts without a word, NULL too, have fingerprint zero and are linked like any other. The component is named
    by its least id. Rows without an id link nothing and have no component. Rows of equal id are one node with the links of all its texts; each keeps its
    own fingerprint.
    """
    whole = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = cut_lineage(batch_map(whole, lambda r: {"id": r["id"], "fp": [simhash(t, words, seed) for t in r["text"]]}, "id long, fp long", 256))
    known = rows.filter("id IS NOT NULL")
    nodes = cut_lineage(known.groupBy("fp").agg(F.min("id").alias("rep")))
    links = near_pairs(nodes.select("fp"), bits)
    named = links.join(nodes.select(F.col("fp").alias("a"), F.col("rep").alias("rep_a")), "a").join(nodes.select(F.col("fp").alias("b"), F.col("rep").alias("rep_b")), "b")
    edges = named.select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b"))
    # an id with several texts stands for the classes of all of them
    twice = known.groupBy("id").agg(F.min("fp").alias("least"), F.max("fp").alias("most")).filter("least <> most").select("id")
    torn = known.join(twice, "id").distinct().join(nodes, "fp").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    label = components(edges.unionByName(torn))
    told = nodes.join(label.withColumnRenamed("node", "rep"), "rep", "left").select("fp", F.coalesce("label", "rep").alias("component_id"))
    found = rows.join(cut_lineage(told), "fp", "left")
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"))


@query("op12_simhash")
def op12_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"))
