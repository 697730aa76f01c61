"""Written tables that cut lineage, so no result depends on one executor's memory.

The folder is the one the cluster names in ``spark.checkpoint.dir``; every
executor must see it. Only a local session may go without that setting.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession, functions as F


def scratch_root(spark: SparkSession) -> str:
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if spark.sparkContext.master.startswith("local"):
        root = tempfile.mkdtemp(prefix="qaloom-")
        spark.conf.set("spark.checkpoint.dir", root)
        return root
    raise ValueError("set spark.checkpoint.dir to a folder that all executors share")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused folder for one written table."""
    return f"{scratch_root(spark)}/qaloom/{name}-{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether the store that Spark means by ``path`` has something there."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def finished(spark: SparkSession, path: str) -> bool:
    """Whether a table written to ``path`` was committed as a whole."""
    return exists(spark, f"{path}/_SUCCESS")


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Spark drops the shuffle files of the queries inside as each ends, not when the driver next collects garbage.

    For queries that run once: the files would not be read again.
    """
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


# Folders of the tables that are written inside each ``tables_dropped`` around the caller.
_passing: ContextVar[list[str] | None] = ContextVar("passing", default=None)


@contextmanager
def tables_dropped(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that ``written`` makes inside go at the end, but for those that are handed to what this yields.

    For steps whose result is itself a written table, or several: the others are not read again.
    Tables with a path of their own stay. What is kept goes at the end of the next such step around this.
    """
    mine: list[str] = []
    outer = _passing.get()
    kept: list[str] = []

    def keep(df: DataFrame) -> DataFrame:
        kept.extend(path for path in mine if any(f"/{path.rsplit('/', 1)[1]}/" in f for f in df.inputFiles()))
        return df

    token = _passing.set(mine)
    try:
        yield keep
    finally:
        _passing.reset(token)
        for path in mine:
            if path not in kept:
                place = spark._jvm.org.apache.hadoop.fs.Path(path)
                place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
            elif outer is not None:
                outer.append(path)


def written(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` once and read it back: later steps start from the files."""
    spark = df.sparkSession
    target = path or scratch_path(spark, name)
    passing = _passing.get()
    if path is None and passing is not None:
        passing.append(target)
    with shuffles_dropped(spark):
        df.write.mode("overwrite").parquet(target)
    return spark.read.schema(df.schema).parquet(target)


# A side of join rows this short (ids, offsets, paths: some 200 bytes each) may be
# sent to every executor.
BROADCAST_ROWS = 1_000_000


def written_side(df: DataFrame, name: str) -> DataFrame:
    """A narrow join side, written and counted: broadcast if short enough, else left to Spark."""
    side = written(df, name)
    return F.broadcast(side) if side.count() <= BROADCAST_ROWS else side
