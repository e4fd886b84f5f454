"""WARC archives with one Zstandard frame per record and a dictionary of their own records.

Every archive starts with a skippable frame that holds its dictionary, trained on records of that archive; each record is
compressed alone, so that any record can be read with the dictionary and its own bytes. Spark's text writer puts the frames
down, which gives task commits and any file system that Spark reaches: its line separator is set to an empty skippable
frame, eight bytes that every Zstandard reader passes over.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import urllib.parse
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import query, shared_folder, table

SKIP_DICTIONARY = 0x184D2A5D
SKIP_FIRST, SKIP_LAST = 0x184D2A50, 0x184D2A5F
FRAME_MAGIC = 0xFD2FB528
#: Written after each frame: magic 0x184D2A50, length 0.
SEPARATOR = "P*M\x18\x00\x00\x00\x00"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def resolve_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 1000) -> DataFrame:
    """One row per page: id, url, payload, refers_to (NULL for a response).

    Among payloads of at least ``min_bytes`` bytes that are equal, those with the largest id are responses and the others
    refer to it. A NULL payload counts as empty. Pages with equal id and payload are all responses; a NULL id is smaller than
    any other, so it refers to a page with an id if there is one. Digests are combined on the map side; payloads below the
    bound get keys of their own, so that many empty pages do not meet in one task.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col), F.lit("")).alias("payload"))
    digest = F.when(F.octet_length("payload") >= min_bytes, F.sha1(F.encode("payload", "UTF-8")))
    groups = rows.select(digest.alias("digest"), "id").filter("digest IS NOT NULL").groupBy("digest").agg(F.max("id").alias("last_id"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    keyed = rows.withColumn("k", F.coalesce(digest, F.xxhash64("id", "url").cast("string")))
    joined = keyed.join(groups.select(F.col("digest").alias("k"), "last_id"), "k", "left")
    return joined.select("id", "url", "payload", F.when(~F.col("id").eqNullSafe(F.col("last_id")), F.col("last_id")).alias("refers_to"))


def uri(url: str) -> str:
    """``url`` with what a URI cannot hold (blanks, control and non-ASCII characters) percent-encoded."""
    return urllib.parse.quote(url, safe="!#$%&'()*+,/:;=?@[]~")


def _record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    revisit = refers_to is not None
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
        ("WARC-Date", date),
        ("WARC-Target-URI", None if url is None else uri(url)),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Refers-To", f"<urn:page:{refers_to}>" if revisit else None),
        ("WARC-Profile", REVISIT_PROFILE if revisit else None),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def _dictionary(samples: list[bytes], size: int) -> zstandard.ZstdCompressionDict | None:
    """A dictionary of at most ``size`` bytes, None where the records are too few to train one."""
    try:
        return zstandard.train_dictionary(min(size, max(1024, sum(map(len, samples)) // 10)), samples, k=200, d=8, f=18, accel=4)
    except zstandard.ZstdError:
        return None


def _frames(records: Iterable[bytes], dict_bytes: int, train_bytes: int, level: int) -> Iterator[bytes]:
    held: list[bytes] = []
    size, squeeze = 0, None

    def start() -> Iterator[bytes]:
        nonlocal squeeze
        trained = _dictionary(held, dict_bytes)
        squeeze = zstandard.ZstdCompressor(level=level, dict_data=trained, write_checksum=True).compress
        if trained is not None:
            data = trained.as_bytes()
            yield struct.pack("<II", SKIP_DICTIONARY, len(data)) + data
        yield from map(squeeze, held)
        held.clear()

    for record in records:
        if squeeze is not None:
            yield squeeze(record)
            continue
        held.append(record)
        size += len(record)
        if size >= train_bytes:
            yield from start()
    if held:
        yield from start()


def write_warc(rows: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z", dict_bytes: int = 112_640, train_bytes: int = 8 << 20, level: int = 3) -> None:
    """Write rows of ``resolve_revisits`` below ``path``, one archive per task.

    A dictionary of at most ``dict_bytes`` bytes is trained on the archive's records up to ``train_bytes``; all records are
    then compressed with it. An archive whose records are too few for training has no dictionary frame. No rows: no records.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records = (
            _record(r["id"], r["url"], (r["payload"] or "").encode(), r["refers_to"], date)
            for batch in batches
            for i in range(0, batch.num_rows, 256)
            for r in batch.slice(i, 256).to_pylist()
        )
        out: list[bytes] = []
        size = 0
        for frame in _frames(records, dict_bytes, train_bytes, level):
            out.append(frame)
            size += len(frame)
            if size > 1 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    frames = rows.select("id", "url", "payload", "refers_to").mapInArrow(run, "value binary")
    frames.select(F.col("value").cast("string")).write.option("lineSep", SEPARATOR).option("compression", "none").option("maxRecordsPerFile", 0).text(path)


def split_frames(data: memoryview) -> Iterator[tuple[int, memoryview]]:
    """(magic, bytes) of each frame of a Zstandard file: skippable ones without their head, others whole."""
    at, end = 0, len(data)
    while at < end:
        (magic,) = struct.unpack_from("<I", data, at)
        if SKIP_FIRST <= magic <= SKIP_LAST:
            (size,) = struct.unpack_from("<I", data, at + 4)
            yield magic, data[at + 8 : at + 8 + size]
            at += 8 + size
            continue
        if magic != FRAME_MAGIC:
            raise ValueError(f"no Zstandard frame at byte {at}")
        flags = data[at + 4]
        single, wide = flags >> 5 & 1, flags >> 6
        here = at + 5 + (0 if single else 1) + (0, 1, 2, 4)[flags & 3] + ((1 if single else 0), 2, 4, 8)[wide]
        last = 0
        while not last:
            head = int.from_bytes(data[here : here + 3], "little")
            last, kind, size = head & 1, head >> 1 & 3, head >> 3
            here += 3 + (1 if kind == 1 else size)
        here += 4 * (flags >> 2 & 1)
        yield magic, data[at:here]
        at = here


def _page(value: str | None) -> int | None:
    number = (value or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def _parse(record: bytes) -> dict:
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    if fields["WARC-Type"] == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    return {
        "page_id": _page(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"), "record_type": fields["WARC-Type"],
        "payload_bytes": size, "payload_digest": digest, "refers_to": _page(fields.get("WARC-Refers-To")), "payload": payload if fields["WARC-Type"] == "response" else None,
    }


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records of the archives below ``path``; the payload of every response is checked against its digest.

    Columns: page_id, url (as a URI), record_type, payload_bytes, payload_digest, refers_to and, with ``payloads``, payload (NULL for
    revisits). An archive is read as one value, so it must stay below two gigabytes; tasks write far smaller ones.
    """
    schema = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long" + ", payload binary" * payloads
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    arrow = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in schema.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                expand = zstandard.ZstdDecompressor().decompress
                rows: list[dict] = []
                size = 0
                for magic, frame in split_frames(memoryview(batch.column(0)[i].as_buffer())):
                    if magic == SKIP_DICTIONARY:
                        expand = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(bytes(frame))).decompress
                    if magic != FRAME_MAGIC:
                        continue
                    record = expand(frame)
                    rows.append(_parse(record))
                    size += len(record) if payloads else 256
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist([{n: r[n] for n in names} for r in rows], arrow)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist([{n: r[n] for n in names} for r in rows], arrow)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInArrow(run, schema)


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest FROM p),
g AS (SELECT payload_digest, max(page_id) AS last_id FROM d WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT d.page_id, payload_bytes, d.payload_digest, CASE WHEN last_id <> d.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN last_id <> d.page_id THEN last_id END AS refers_to
FROM d LEFT JOIN g ON d.payload_digest = g.payload_digest AND payload_bytes >= 1000
"""


@query("op1_warc", SQL)
def op1_warc(spark: SparkSession, folder: str) -> DataFrame:
    path = f"{shared_folder(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    write_warc(resolve_revisits(table(spark, folder, "pages")), path)
    return read_warc(spark, path, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
