"""Session helpers."""

from __future__ import annotations

import os
import re
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
#: Folders of local sessions without that setting, which cannot be set on a running session.
_OWN: dict[str, str] = {}
#: Folders that ``cut_lineage`` wrote, per open ``passing`` block of a thread.
_OPEN = threading.local()


def build_session(app: str = "plumbline", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """Session with adaptive execution and UTC; cluster settings win over the defaults here."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        # the per-call stack capture costs more than planning does for long column expressions
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", os.environ.get("PLUMBLINE_DRIVER_MEMORY", "8g"))
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The shared folder named by the session; without one, a temporary folder on a local master only."""
    folder = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if folder:
        return folder
    context = spark.sparkContext
    if not re.match(r"local(\[|$)", context.master):  # "local-cluster" has executors of its own
        raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder every executor can reach")
    return _OWN.setdefault(context.applicationId, os.path.join(tempfile.gettempdir(), f"plumbline-{uuid.uuid4().hex}"))


def sized(lookup: DataFrame, keep: bool = False) -> DataFrame:
    """A lookup table written, so that the planner knows its size; with ``keep`` it outlives a ``passing`` block.

    An aggregate has no usable estimate, so both sides of a join with one are shuffled before its size is seen. A written one
    below the broadcast threshold is sent to the rows at once; a larger one is joined by a shuffle.
    """
    return cut_lineage(lookup, keep) if keep else cut_lineage(lookup)


def cut_lineage(df: DataFrame, keep: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so lost executors cost no recomputation."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/cut-{uuid.uuid4().hex}"
    if not keep and getattr(_OPEN, "blocks", None):
        _OPEN.blocks[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Tables that ``cut_lineage`` writes inside are deleted at the end. What leaves the block must not read them."""
    _OPEN.blocks = [*getattr(_OPEN, "blocks", []), []]
    try:
        yield
    finally:
        for folder in _OPEN.blocks.pop():
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
