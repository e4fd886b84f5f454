"""Near duplicates by circulant MinHash, banding and exact Jaccard verification.

Two permutations of the 32-bit numbers make all signature coordinates: the first scatters the shingles, the second, shifted by
k places around the circle, gives coordinate k. Bands of equal coordinates are candidate buckets.

Texts with equal shingle sets are one class with its least id as representative. In a bucket, every representative is
compared with the least one, the pivot. That leaves open the members which did not join the pivot's component: these are a query set, compared
with all members of the pivot's buckets in blocks of bounded size, inside tasks that return links only. So links that no
pivot has are found too, and no pairs of a group are formed as rows. Links are confirmed on full sets.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch_map, cut_lineage, lookup_join, query, table
from .components import components
from .shingles import shingle_set

BANDS, ROWS = 30, 5


def _permute(x: np.ndarray, key: int) -> np.ndarray:
    """A permutation of the 32-bit numbers: xor-shifts and odd factors, each of which can be undone."""
    x = x ^ np.uint32(key)
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    x ^= x >> np.uint32(16)
    return x


def signature(shingles: np.ndarray, size: int) -> np.ndarray:
    """``size`` coordinates: the least value of the second permutation, shifted by k, over the scattered shingles."""
    scattered = _permute((shingles ^ (shingles >> np.uint64(32))).astype(np.uint32), 0x51ED270B)
    shifts = np.arange(1, size + 1, dtype=np.uint32)[:, None]
    least = np.full(size, 0xFFFFFFFF, dtype=np.uint32)
    for i in range(0, len(scattered), 512):
        np.minimum(least, _permute(scattered[None, i : i + 512] - shifts, 0x2545F491).min(axis=1), out=least)
    return least


def band_keys(signed: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each band, with the band's number in it."""
    key = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for column in signed[: bands * rows].reshape(bands, rows).T.astype(np.uint64):
        key = (key ^ column) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(32)
    return key.view(np.int64)


def _signed(docs: DataFrame, words: int) -> DataFrame:
    def block(rows: dict[str, list]) -> dict[str, list]:
        sets = [shingle_set(t, words) for t in rows["text"]]
        return {
            "id": rows["id"],
            "n": [len(s) for s in sets],
            "same": [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets],
            "keys": [band_keys(signature(s, BANDS * ROWS), BANDS, ROWS).tolist() if len(s) else [] for s in sets],
        }

    return batch_map(docs, block, "id long, n long, same binary, keys array<long>", 128)


def _confirmed(docs: DataFrame, pairs: DataFrame, words: int, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose full sets meet the threshold. Only texts that a pair names are moved."""
    pairs = cut_lineage(pairs.distinct())
    named = cut_lineage(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    texts = cut_lineage(lookup_join(docs, named, "id", "left_semi"))
    first = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    joined = first.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")

    def block(rows: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"a": [], "b": []}
        held, kept = None, None  # neighbours in a task often share b
        for a, b, x, y in zip(rows["a"], rows["b"], rows["text_a"], rows["text_b"], strict=True):
            if b != held or kept is None or kept[0] != y:
                held, kept = b, (y, shingle_set(y, words))
            one, two = shingle_set(x, words), kept[1]
            met = np.intersect1d(one, two, assume_unique=True).size
            if met and 100 * met >= percent * (len(one) + len(two) - met):
                out["a"].append(a)
                out["b"].append(b)
        return out

    return cut_lineage(batch_map(joined, block, "a long, b long", 128))


def _met(one: list[np.ndarray], two: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of two lists of sets, from products of slices of their incidence matrices."""
    a, b = np.concatenate(one), np.concatenate(two)
    both = np.intersect1d(a, b)
    rows_a, rows_b = np.repeat(np.arange(len(one)), [len(s) for s in one]), np.repeat(np.arange(len(two)), [len(s) for s in two])
    at_a, at_b = np.searchsorted(both, a), np.searchsorted(both, b)
    in_a, in_b = np.isin(a, both), np.isin(b, both)
    out = np.zeros((len(one), len(two)), dtype=np.float32)
    for i in range(0, len(both), 4096):
        x, y = np.zeros((len(one), 4096), dtype=np.float32), np.zeros((len(two), 4096), dtype=np.float32)
        for m, rows, at, here in ((x, rows_a, at_a, in_a & (at_a >= i) & (at_a < i + 4096)), (y, rows_b, at_b, in_b & (at_b >= i) & (at_b < i + 4096))):
            m[rows[here], at[here] - i] = 1
        out += x @ y.T
    return out.astype(np.int64)


def _links_in_blocks(docs: DataFrame, groups: DataFrame, words: int, percent: int, block: int = 512) -> DataFrame:
    """Links (a, b) between components inside groups (pivot, rep, comp, home), of members that are not in the pivot's one.

    Open members and all members are dealt by hash into blocks of about ``block`` documents; a task gets one block of each.
    """
    open_ = F.col("comp") != F.col("home")
    sizes = groups.groupBy("pivot").agg(F.count(F.lit(1)).alias("all"), F.sum(open_.cast("int")).alias("open")).filter("open > 0 AND all > 2")
    blocks = sizes.select("pivot", F.ceil(F.col("open") / block).cast("int").alias("n_open"), F.ceil(F.col("all") / block).cast("int").alias("n_all"))
    members = cut_lineage(groups.filter("rep <> pivot").join(blocks, "pivot"))
    named = cut_lineage(members.select(F.col("rep").alias("id")).distinct())
    texts = lookup_join(docs, named, "id", "left_semi").withColumnRenamed("id", "rep")
    have = members.join(texts, "rep").withColumn("h", F.xxhash64("rep"))
    own = lambda n: F.pmod("h", F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = have.filter(open_).select("pivot", own("n_open").alias("i"), every("n_all").alias("j"), F.lit(True).alias("open"), "rep", "comp", "text")
    right = have.select("pivot", every("n_open").alias("i"), own("n_all").alias("j"), F.lit(False).alias("open"), "rep", "comp", "text")

    def compare(part: pd.DataFrame) -> pd.DataFrame:
        sides = [part[part["open"]], part[~part["open"]]]
        if not len(sides[0]) or not len(sides[1]):
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        one, two = ([shingle_set(t, words) for t in side["text"]] for side in sides)
        met = _met(one, two)
        total = np.array([len(s) for s in one])[:, None] + np.array([len(s) for s in two])[None, :] - met
        linked = (met > 0) & (100 * met >= percent * total) & (sides[0]["comp"].to_numpy()[:, None] != sides[1]["comp"].to_numpy()[None, :])
        x, y = np.nonzero(linked)
        return pd.DataFrame({"a": sides[0]["rep"].to_numpy()[x], "b": sides[1]["rep"].to_numpy()[y]})

    return cut_lineage(left.unionByName(right).groupBy("pivot", "i", "j").applyInPandas(compare, "a long, b long"))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs``.

    Two documents are linked if 100 * intersection >= ``percent`` * union of their sets of distinct shingles of ``words`` words (A-Z lower-cased; a
    shorter text is one shingle). Texts without a word, and rows without an id, are linked with nothing; the latter have no component and are
    kept. Rows of equal id are one node with the links of all its texts; each row keeps its own n_shingles.
    """
    whole = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = cut_lineage(_signed(whole, words))
    sets = rows.filter("n > 0 AND id IS NOT NULL")
    classes = cut_lineage(sets.groupBy("same").agg(F.min("id").alias("rep"), F.min("n").alias("n"), F.first("keys").alias("keys"), (F.min("id") < F.max("id")).alias("several")))
    alike = sets.join(classes.filter("several").select("same", "rep"), "same").filter("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))

    member = classes.select("rep", "n", F.explode("keys").alias("key"))
    shared = member.groupBy("key").agg(F.min("rep").alias("pivot"), F.min(F.struct("rep", "n")).getField("n").alias("pivot_n"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    buckets = cut_lineage(member.join(shared, "key").select("rep", "n", "pivot", "pivot_n"))

    def fits(x: str, y: str):
        return 100 * F.least(x, y) >= percent * F.greatest(x, y)

    nodes = whole.filter("id IS NOT NULL AND text IS NOT NULL")
    star = buckets.filter((F.col("rep") != F.col("pivot")) & fits("n", "pivot_n")).select(F.col("rep").alias("a"), F.col("pivot").alias("b"))
    links = _confirmed(nodes, star, words, percent)
    label = components(links)

    # second step: pivots whose buckets still hold several components
    told = buckets.select("pivot", "rep").distinct().join(label.withColumnRenamed("node", "rep"), "rep", "left").select("pivot", "rep", F.coalesce("label", "rep").alias("comp"))
    home = told.filter("rep = pivot").select("pivot", F.col("comp").alias("home"))
    more = _links_in_blocks(nodes, cut_lineage(told.join(home, "pivot")), words, percent)

    label = components(links.unionByName(more).unionByName(alike))
    found = lookup_join(rows, label.withColumnRenamed("node", "id"), "id")
    return found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("label", "id").alias("component_id"), (F.coalesce("label", "id") == F.col("id")).alias("kept")).withColumn(
        "kept", F.coalesce("kept", F.lit(True))
    )


SQL = """
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) = 1 THEN ws[1] ELSE ws[i] || ' ' || ws[i + 1] END AS g
      FROM w, unnest(range(1, greatest(2, len(ws)))) AS r(i) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
m AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS met FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM m JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * met >= 80 * (x.n + y.n - met)),
both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach AS (SELECT doc_id AS node, doc_id AS other FROM documents UNION SELECT node, b FROM reach JOIN both_ways ON other = a),
c AS (SELECT node, min(other) AS component_id FROM reach GROUP BY node)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, component_id = w.doc_id AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id JOIN c ON c.node = w.doc_id
"""


@query("op8_minhash", SQL)
def op8_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"), words=2)
