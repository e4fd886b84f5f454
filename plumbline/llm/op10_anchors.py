"""Long passages that repeat across documents, by fixed-block anchors.

Documents are cut into reference blocks of 25 words that do not overlap; every rolling window of 25 words of every document
probes them. A run of 50 words holds a whole block wherever it starts, so each repeat of 50 words or more has a hit on both
sides. Runs of 50 words around hits are then compared as a whole, and runs that agree join to maximal repeats.

Both steps are the same join on hashes. Its entries, seven or so bytes each, are packed by numpy into a few long rows for each
bucket of hashes, so Spark moves few rows. A bucket is one group of a sort; the number of buckets follows the number of words.
Before the shuffle, entries of one block of documents that meet there already are settled: later copies of a passage that
stands in a large share of all documents are not sent. Texts that are equal as a whole are settled before all this.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch_map, cut_lineage, lookup_join, query, table, word_count
from .shingles import sequence_hashes, word_hashes

#: Words that a task packs at a time, and entries that a bucket should hold.
PACKED_WORDS, BUCKET_ENTRIES = 1_000_000, 3_000_000
_TOP = np.iinfo(np.int64).max


def _groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the entries whose key (a row of ``keys``) occurs twice or more, and where each group begins in it."""
    order = np.argsort(keys[0], kind="stable")
    same = keys[0][order][1:] == keys[0][order][:-1]
    twice = np.zeros(len(order), dtype=bool)
    twice[1:] |= same
    twice[:-1] |= same
    order = order[twice]
    order = order[np.lexsort(tuple(k[order] for k in keys[::-1]))]
    if not len(order):
        return order, np.empty(0, dtype=np.int64)
    new = np.ones(len(order), dtype=bool)
    new[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
    return order, np.flatnonzero(new)


def _settle(keys: np.ndarray, doc: np.ndarray, block: np.ndarray, both_sides: bool) -> tuple[np.ndarray, np.ndarray]:
    """Two masks over entries: hits (an equal block stands in an earlier document; with ``both_sides`` also the earliest
    block that a later document has) and entries that nothing else needs any more (an earlier document's block is here)."""
    hit, later = np.zeros(len(doc), dtype=bool), np.zeros(len(doc), dtype=bool)
    order, first = _groups(keys)
    if len(order):
        d, b = doc[order], block[order]
        size = np.diff(np.append(first, len(order)))
        least = np.repeat(np.minimum.reduceat(np.where(b, d, _TOP), first), size)
        last = np.repeat(np.maximum.reduceat(d, first), size)
        later[order] = d > least
        hit[order] = (d > least) | (b & (d == least) & (last > least) & both_sides)
    return hit, later


def _pack(hashes: np.ndarray, places: np.ndarray) -> bytes:
    """Entries in order of place: 48 bits of each hash in planes, then the steps between places, byte by byte (mostly 0)."""
    steps = np.diff(places, prepend=0)
    parts = [np.uint32(len(places)).tobytes()]
    for k in hashes:
        for shift in (16, 32, 48):
            parts.append((k >> np.uint64(shift)).astype(np.uint16).tobytes())
    parts += [((steps >> s) & 0xFF).astype(np.uint8).tobytes() for s in (0, 8, 16, 24)]
    return b"".join(parts)


def _unpack(data: bytes, words: int) -> tuple[np.ndarray, np.ndarray]:
    n = int(np.frombuffer(data, np.uint32, 1)[0])
    at, keys = 4, np.zeros((words, n), dtype=np.uint64)
    for w in range(words):
        for shift in (0, 16, 32):
            keys[w] |= np.frombuffer(data, np.uint16, n, at).astype(np.uint64) << np.uint64(shift)
            at += 2 * n
    steps = np.zeros(n, dtype=np.int64)
    for s in (0, 8, 16, 24):
        steps |= np.frombuffer(data, np.uint8, n, at).astype(np.int64) << s
        at += n
    return keys, np.cumsum(steps)


def _meetings(docs: DataFrame, starts: Callable[[np.ndarray, bytes | None], np.ndarray | None], width: int, stride: int, words: int, buckets: int, least: int) -> DataFrame:
    """id, hits: packed places (int32, in order) at which a run of ``width`` words hits, one row for a document that has some.

    Hits leave a bucket packed by slots, as many as buckets, into which documents fall by a hash; each slot is then taken apart.

    ``docs`` has id, text and mark; ``starts(words, mark)`` gives the places that take part (None: all). Places divisible by
    ``stride`` are blocks; if all are, hits are those of later documents alone. ``words`` hashes make a key; 48 bits of each
    and the bucket are compared. Texts of fewer than ``least`` words are passed over.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        sizes: list[int] = []
        keys: list[np.ndarray] = []
        places: list[np.ndarray] = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held
            doc, offset = np.array(ids, dtype=np.int64), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
            key, place = np.concatenate(keys, axis=1), np.concatenate(places)
            which = np.repeat(np.arange(len(ids)), [len(p) for p in places])
            hit, later = _settle(key, doc[which], place % stride == 0, stride > 1)
            rows: dict[str, list] = {"bucket": [], "kind": [], "docs": [], "data": []}
            bucket = ((key[0] & np.uint64(0xFFFF)) * np.uint64(buckets) >> np.uint64(16)).astype(np.int64) if buckets <= 4096 else (key[0] % np.uint64(buckets)).astype(np.int64)
            told = np.concatenate([np.diff(doc, prepend=0), np.diff(offset)]).tobytes()
            for slot, data in _pack_hits(doc[which[hit]], place[hit], buckets):
                rows["bucket"].append(slot)
                rows["kind"].append(0)
                rows["docs"].append(b"")
                rows["data"].append(data)
            rest = np.flatnonzero(~later)
            rest = rest[np.argsort(bucket[rest], kind="stable")]
            cuts = np.flatnonzero(np.diff(bucket[rest])) + 1
            for part in np.split(rest, cuts) if len(rest) else []:
                rows["bucket"].append(int(bucket[part[0]]))
                rows["kind"].append(1)
                rows["docs"].append(told)
                rows["data"].append(_pack(key[:, part], offset[which[part]] + place[part]))
            for x in (ids, sizes, keys, places):
                x.clear()
            held = 0
            for i in range(0, len(rows["bucket"]), 64):
                yield pa.RecordBatch.from_pydict({k: v[i : i + 64] for k, v in rows.items()}, schema=pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("docs", pa.binary()), ("data", pa.binary())]))

        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                for doc_id, text, mark in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    hashed = word_hashes(text)
                    if len(hashed) < least:
                        continue
                    at = starts(hashed, mark)
                    runs = np.stack([sequence_hashes(hashed, width, seed) for seed in range(words)])
                    at = np.arange(runs.shape[1]) if at is None else at
                    ids.append(doc_id)
                    sizes.append(len(hashed))
                    keys.append(runs[:, at])
                    places.append(at)
                    held += len(hashed)
                    if held >= PACKED_WORDS:
                        yield from flush()
        if ids:
            yield from flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("slot", pa.int32()), ("data", pa.binary())])
        now, held = None, []

        def close() -> Iterator[pa.RecordBatch]:
            keys, docs_of, places = [], [], []
            for told, data in held:
                both = np.frombuffer(told, np.int64)
                doc, offset = np.cumsum(both[: len(both) // 2]), np.concatenate([[0], np.cumsum(both[len(both) // 2 :])])
                key, place = _unpack(data, words)
                which = np.searchsorted(offset, place, side="right") - 1
                keys.append(key)
                docs_of.append(doc[which])
                places.append(place - offset[which])
            held.clear()
            if not keys:
                return
            key, doc, place = np.concatenate(keys, axis=1), np.concatenate(docs_of), np.concatenate(places)
            hit, _ = _settle(key, doc, place % stride == 0, stride > 1)
            yield from sent(list(_pack_hits(doc[hit], place[hit], buckets)))

        def sent(found: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
            for i in range(0, len(found), 256):
                part = found[i : i + 256]
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in part], pa.int32()), pa.array([d for _, d in part], pa.binary())], schema=schema)

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            yield from sent([(bucket, data) for bucket, kind, _, data in zip(*columns, strict=True) if kind == 0])
            for bucket, kind, told, data in zip(*columns, strict=True):
                if kind == 0:
                    continue
                if bucket != now:
                    yield from close()
                    now = bucket
                held.append((told, data))
        yield from close()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("id", pa.int64()), ("hits", pa.binary())])
        now, held = None, []

        def close() -> Iterator[pa.RecordBatch]:
            parts = [_unpack_hits(x) for x in held]
            held.clear()
            if not parts:
                return
            found = list(_by(np.concatenate([d for d, _ in parts]), np.concatenate([p for _, p in parts])))
            for i in range(0, len(found), 1024):
                part = found[i : i + 1024]
                yield pa.RecordBatch.from_arrays([pa.array([int(d) for d, _ in part], pa.int64()), pa.array([np.unique(p).astype(np.int32).tobytes() for _, p in part], pa.binary())], schema=schema)

        for batch in batches:
            for slot, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if slot != now:
                    yield from close()
                    now = slot
                held.append(data)
        yield from close()

    packed = docs.select("id", "text", "mark").mapInArrow(pack, "bucket int, kind int, docs binary, data binary")
    met = packed.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(meet, "slot int, data binary")
    return met.repartition(buckets, "slot").sortWithinPartitions("slot").mapInArrow(gather, "id long, hits binary")


def _pack_hits(doc: np.ndarray, place: np.ndarray, slots: int) -> Iterator[tuple[int, bytes]]:
    """(slot, documents, their numbers of hits, places) for each slot that has a hit."""
    slot = ((doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % slots
    order = np.lexsort((place, doc, slot))
    slot, doc, place = slot[order], doc[order], place[order]
    for part in np.split(np.arange(len(slot)), np.flatnonzero(np.diff(slot)) + 1) if len(slot) else []:
        ids, counts = np.unique(doc[part], return_counts=True)
        yield int(slot[part[0]]), np.int64(len(ids)).tobytes() + ids.astype(np.int64).tobytes() + counts.astype(np.int32).tobytes() + place[part].astype(np.int32).tobytes()


def _unpack_hits(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int(np.frombuffer(data, np.int64, 1)[0])
    counts = np.frombuffer(data, np.int32, n, 8 + 8 * n)
    return np.repeat(np.frombuffer(data, np.int64, n, 8), counts), np.frombuffer(data, np.int32, -1, 8 + 12 * n)


def _by(group: np.ndarray, value: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(group, its values in order) for each group."""
    order = np.lexsort((value, group))
    group, value = group[order], value[order]
    cuts = np.flatnonzero(np.diff(group)) + 1
    for g, v in zip(np.split(group, cuts), np.split(value, cuts), strict=True):
        if len(g):
            yield g[0], v


def _places(mark: bytes | None) -> np.ndarray:
    return np.frombuffer(mark or b"", np.int32)


def _spans(starts: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Maximal [start, end) runs of words that windows at ``starts`` cover."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > window) + 1
    return [(int(s[0]), int(s[-1]) + window) for s in np.split(starts, cut)]


def repeated_windows(docs: DataFrame, window: int = 50) -> DataFrame:
    """id, starts (packed int32): places of windows that also start in a document with a smaller id.

    ``docs`` has id and text; rows without an id take no part. Equal texts are to be settled before.
    """
    size = (window + 1) // 2  # a run of 2 * size - 1 words holds a whole block wherever it starts
    named = docs.filter("id IS NOT NULL")
    total = named.agg(F.sum(word_count(F.col("text")))).first()[0] or 0
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // BUCKET_ENTRIES + 1)

    def around(hashed: np.ndarray, mark: bytes | None) -> np.ndarray:
        """Starts of all windows that hold a hit."""
        hits = _places(mark)
        hits = hits[hits <= len(hashed) - size]
        change = np.zeros(len(hashed) + 2, dtype=np.int32)
        np.add.at(change, np.maximum(0, hits - (window - size)), 1)
        np.add.at(change, hits + 1, -1)
        return np.flatnonzero(np.cumsum(change)[: len(hashed) - window + 1] > 0)

    hits = cut_lineage(_meetings(named.withColumn("mark", F.lit(None).cast("binary")), lambda *_: None, size, size, 1, buckets, window).withColumnRenamed("hits", "mark"))
    near = lookup_join(named, hits, "id", "inner")
    return _meetings(near, around, window, 1, 2, buckets, window).withColumnRenamed("hits", "starts")


def remove_repeats(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, spans (maximal repeats, as [start, end) in words), kept (words joined by one blank).

    A word goes if a window of ``window`` words that covers it also starts in a document with a smaller id. NULL and short texts lose
    nothing; rows without an id lose nothing and take nothing. Rows of equal id are one document: none is another's earlier copy,
    and a place that repeats in one of their texts goes in each.
    """
    text = F.col(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.sha2(F.coalesce(text, F.lit("")), 256).alias("same"))
    known = rows.filter("id IS NOT NULL").groupBy("same").agg(F.min("id").alias("first"), F.max("id").alias("last")).filter("first < last")
    copies = cut_lineage(rows.select("id", "same").join(known, "same").filter("id > first").select("id", "same", "first").distinct())
    found = cut_lineage(repeated_windows(lookup_join(rows, copies, ["id", "same"], "left_anti"), window))
    marked = lookup_join(lookup_join(rows, found, "id"), copies, ["id", "same"])

    def block(part: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"doc_id": part["id"], "n_words": [], "n_removed": [], "spans": [], "kept": []}
        for text, starts, copied in zip(part["text"], part["starts"], part["first"], strict=True):
            words = (text or "").encode().split()
            spans = [(0, len(words))] if copied is not None and len(words) >= window else [] if copied is not None else _spans(_places(starts), window)
            kept, at = [], 0
            for a, b in spans:
                kept += words[at:a]
                at = b
            kept += words[at:]
            out["n_words"].append(len(words))
            out["n_removed"].append(len(words) - len(kept))
            out["spans"].append([list(s) for s in spans])
            out["kept"].append(b" ".join(kept).decode())
        return out

    return batch_map(marked.select("id", "text", "starts", "first"), block, "doc_id long, n_words long, n_removed long, spans array<array<int>>, kept string", 128)


SQL = """
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
p AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS h FROM w, unnest(range(1, len(ws) - 48)) AS r(i) WHERE len(ws) >= 50),
f AS (SELECT h, min(doc_id) AS first FROM p GROUP BY h),
gone AS (SELECT DISTINCT p.doc_id, k FROM p JOIN f ON p.h = f.h AND f.first < p.doc_id, unnest(range(i, i + 50)) AS t(k)),
kept AS (SELECT w.doc_id, string_agg(ws[k], ' ' ORDER BY k) AS kept, count(*) AS n
         FROM w, unnest(range(1, len(ws) + 1)) AS t(k) WHERE (w.doc_id, k) NOT IN (SELECT doc_id, k FROM gone) GROUP BY w.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id
"""


@query("op10_anchors", SQL)
def op10_anchors(spark: SparkSession, folder: str) -> DataFrame:
    done = remove_repeats(table(spark, folder, "documents"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
