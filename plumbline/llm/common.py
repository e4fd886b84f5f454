"""Helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage, shared_folder

__all__ = ["LLM_ORACLES", "LLM_QUERIES", "batch_map", "cut_lineage", "held_out", "lookup_join", "query", "shared_folder", "table", "word_count"]

LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
LLM_ORACLES: dict[str, str] = {}

#: White space between words, as a regular expression; bytes.split() cuts at the same six characters.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: A table of at most so many short rows (ids, flags, small packed arrays) may be broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 64 << 20


def query(name: str, sql: str | None = None):
    """Register a query of this package with its SQL, where SQL can say it."""

    def register(fn):
        LLM_QUERIES[name] = fn
        if sql is not None:
            LLM_ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Number of words; 0 for NULL."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def held_out(doc_id: Column) -> Column:
    """Rows kept away from all learning: crc32 of the id as text, mod 4, is 2. A NULL id is not held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2, F.lit(False))


def batch_map(df: DataFrame, fn: Callable[[dict[str, list]], Iterable[dict[str, list]] | dict[str, list]], schema: str, rows: int = 1024) -> DataFrame:
    """Apply ``fn`` to blocks of at most ``rows`` rows, given and returned as a dict of column lists."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                got = fn(batch.slice(start, rows).to_pydict())
                for part in [got] if isinstance(got, dict) else got:
                    yield pa.RecordBatch.from_arrays([pa.array(part[f.name], f.type) for f in out], schema=out)

    return df.mapInArrow(run, schema)


_FIXED = {"boolean", "tinyint", "smallint", "int", "bigint", "float", "double", "date", "timestamp"}


def _bytes(name: str, kind: str) -> Column | None:
    """Bytes of a column's value; None for a type that is not sized here."""
    c = F.col(f"`{name}`")
    if kind in _FIXED:
        return F.lit(8).cast("long")
    if kind in ("binary", "string"):
        return F.coalesce(F.octet_length(c), F.lit(0)).cast("long")
    item = kind.removeprefix("array<").removesuffix(">")
    if item == kind or item not in _FIXED | {"binary", "string"}:
        return None
    n = F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)).cast("long") * 8
    if item in _FIXED:
        return n
    return n + F.coalesce(F.aggregate(c, F.lit(0).cast("long"), lambda sum_, x: sum_ + F.coalesce(F.octet_length(x), F.lit(0))), F.lit(0))


def lookup_join(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "left") -> DataFrame:
    """Join with a table written before (so that counting it is cheap): broadcast if its counted rows and size
    in memory, arrays by their elements, stay under fixed bounds, by a shuffle otherwise and for columns that cannot be
    sized. The result is the same either way."""
    sizes = [_bytes(c, t) for c, t in right.dtypes]
    if any(s is None for s in sizes):
        return left.join(right, on, how)
    total = sizes[0]
    for s in sizes[1:]:
        total = total + s
    n, size = right.agg(F.count(F.lit(1)), F.coalesce(F.sum(total), F.lit(0))).first()
    small = n <= BROADCAST_ROWS and size <= BROADCAST_BYTES
    return left.join(F.broadcast(right) if small else right, on, how)
