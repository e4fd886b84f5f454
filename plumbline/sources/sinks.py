"""Writers. A table is a folder of immutable Parquet files; a pointer file, claimed once per version number, commits a version.

A version is either one folder or, for upserts, one folder for each bucket of the keys' hash, as Spark's partitioned writer leaves
them: an upsert writes new folders for the buckets it touches and names the old ones for all others.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

POINTER = "_pointer"
BUCKET = "__bucket"
#: Buckets of a new upsert table. A batch rewrites the buckets of its keys, so more of them make a small batch cheaper.
BUCKETS = 256


class ConcurrentWrite(RuntimeError):
    """Another writer committed a version after the one that this write was made from."""


@dataclass(frozen=True)
class Version:
    """A committed state: ``parts`` has the folder of each bucket, or one folder under ""; ``batches`` the last batch of each stream."""

    number: int = 0
    parts: dict[str, str] = field(default_factory=dict)
    batches: dict[str, int] = field(default_factory=dict)
    schema: str | None = None
    keys: tuple[str, ...] = ()
    buckets: int = 0

    def read(self, spark: SparkSession, buckets: Sequence[int] | None = None) -> DataFrame:
        """All rows, or those of ``buckets``."""
        schema = T.StructType.fromJson(json.loads(self.schema))
        paths = [path for b, path in self.parts.items() if buckets is None or int(b) in buckets]
        return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def _folder(spark: SparkSession, path: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def current(spark: SparkSession, table: str) -> Version:
    """The newest committed version; number 0 for a table without one."""
    fs, folder = _folder(spark, f"{table}/{POINTER}")
    if not fs.exists(folder):
        return Version()
    names = sorted(n for x in fs.listStatus(folder) if (n := x.getPath().getName()).endswith(".json") and n[0].isdigit())
    if not names:
        return Version()
    fs, path = _folder(spark, f"{table}/{POINTER}/{names[-1]}")
    stream = fs.open(path)
    try:
        told = json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()
    return Version(**told | {"keys": tuple(told["keys"])})


def latest_version(spark: SparkSession, table: str) -> tuple[int, str | None, dict[str, int]]:
    """Version number, folder (None for a bucketed table or one without a version) and the streams' last batch ids."""
    found = current(spark, table)
    return found.number, found.parts.get(""), found.batches


def _claim(spark: SparkSession, aside: str, pointer: str) -> bool:
    """Give the finished file ``aside`` the name ``pointer``; False if that name is taken."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(path(pointer).toUri(), spark._jsc.hadoopConfiguration())
    options = spark._sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
    try:
        files.rename(path(aside), path(pointer), options)
    except Py4JJavaError as error:
        if "AlreadyExists" not in str(error.java_exception):
            raise
        return False
    return True


def _commit(spark: SparkSession, table: str, base: Version, after: dict, pinned: bool) -> int:
    """Commit ``after`` as the version after ``base``. The pointer is written whole under another name and then renamed, so that
    nobody sees a part of it; a number that is taken means that another writer was first: a conflict if ``pinned``, else the next number is tried."""
    while True:
        told = after | {"number": base.number + 1, "batches": base.batches | after["batches"]}
        aside = f"{table}/{POINTER}/_{uuid.uuid4().hex}"
        fs, path = _folder(spark, aside)
        out = fs.create(path, False)
        try:
            out.write(bytearray(json.dumps(told).encode()))
        finally:
            out.close()
        if _claim(spark, aside, f"{table}/{POINTER}/{told['number']:012d}.json"):
            return told["number"]
        fs.delete(path, False)
        if pinned:
            raise ConcurrentWrite(f"{table}: version {told['number']} was committed by another writer")
        base = current(spark, table)


def write_table(df: DataFrame, table: str, batch: tuple[str, int] | None = None, base: int | None = None) -> int:
    """Write ``df`` as a new version and commit it; the version being read is never touched.

    With ``base``, the version that ``df`` was made from, a write fails with ``ConcurrentWrite`` if another version was committed
    since; without it, it takes the next free number. ``batch`` (stream, batch id) is remembered; what other streams have
    written is carried over.
    """
    spark = df.sparkSession
    path = f"{table}/v-{uuid.uuid4().hex}"
    df.write.parquet(path)
    found = current(spark, table)
    if base is not None and found.number != base:
        raise ConcurrentWrite(f"{table}: version {found.number} was committed after {base}")
    after = {"parts": {"": path}, "schema": df.schema.json(), "keys": [], "buckets": 0, "batches": {batch[0]: batch[1]} if batch else {}}
    return _commit(spark, table, found, after, base is not None)


def bucket_of(keys: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]), F.lit(buckets)).cast("int")


def upsert_table(rows: DataFrame, table: str, keys: Sequence[str], base: Version, batch: tuple[str, int] | None = None, buckets: int = BUCKETS) -> int:
    """Upsert ``rows`` (one per key, written before, since they are read twice) by ``keys`` as the version after ``base``; fails with
    ``ConcurrentWrite`` if there is one.

    Only the buckets with a key of ``rows`` are read and written. A table of ``buckets`` buckets is made by the first upsert; a plain version, or one
    bucketed by other keys, is dealt into buckets then.
    """
    from ..operators.assembly import upsert

    spark, keys = rows.sparkSession, tuple(keys)
    own = base.keys == keys
    buckets = base.buckets if own else buckets
    touched = sorted(r[0] for r in rows.select(bucket_of(keys, buckets)).distinct().collect())  # no more than there are buckets
    if not base.number:
        merged = rows.withColumns({k: F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys})
    else:
        existing = base.read(spark, touched if own else None)
        merged = upsert(existing, rows, keys).select(*existing.columns)
    parts = dict(base.parts) if own else {}
    if touched or not own:
        path = f"{table}/v-{uuid.uuid4().hex}"
        # one writer per bucket, and several for a bucket that outgrows a task
        merged.withColumn(BUCKET, bucket_of(keys, buckets)).hint("rebalance", BUCKET).write.partitionBy(BUCKET).parquet(path)
        fs, folder = _folder(spark, path)
        written = [x.getPath().getName() for x in fs.listStatus(folder) if x.isDirectory() and "=" in x.getPath().getName()]
        parts |= {name.split("=")[1]: f"{path}/{name}" for name in written}
    after = {"parts": parts, "schema": merged.schema.json(), "keys": list(keys), "buckets": buckets, "batches": {batch[0]: batch[1]} if batch else {}}
    return _commit(spark, table, base, after, True)


def read_table(spark: SparkSession, table: str) -> DataFrame:
    found = current(spark, table)
    if not found.number:
        raise FileNotFoundError(f"no committed version in {table}")
    return found.read(spark)


METRICS_SCHEMA = T.StructType(
    [
        T.StructField("experiment", T.StringType()),
        T.StructField("cutoff", T.IntegerType()),
        T.StructField("task", T.StringType()),
        T.StructField("metric", T.StringType()),
        T.StructField("value", T.DoubleType()),
    ]
)


def write_metrics(df: DataFrame, path: str) -> None:
    """Append one row per experiment, cutoff, task and metric."""
    df.select(*[F.col(f.name).cast(f.dataType) for f in METRICS_SCHEMA.fields]).write.mode("append").parquet(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path)
