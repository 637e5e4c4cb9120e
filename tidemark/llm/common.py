"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes in an Arrow batch.
ARROW_BYTES = 2 << 20
#: A key is hot with more than one in so many of all rows, and more rows than this.
HOT_KEYS, HOT_ROWS = 500, 64


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or the checkpoint folder that the session was given.

    A session of one machine without either gets a temporary folder; on a cluster that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def free_names(taken: list[str], *wanted: str) -> list[str]:
    """The names wanted, each with as many underscores in front as it takes to differ from all that are taken, in any case."""
    used, out = {c.lower() for c in taken}, []
    for name in wanted:
        while name.lower() in used:
            name = "_" + name
        used.add(name.lower())
        out.append(name)
    return out


def free_prefix(taken: list[str], *names: str) -> str:
    """As many underscores as set all of ``names`` apart from the names taken, one at least."""
    used, prefix = {c.lower() for c in taken}, "_"
    while used & {prefix + n for n in names}:
        prefix += "_"
    return prefix


def no_clash(taken: list[str], names: list[str]) -> None:
    """An error if a name to be added is taken, in any case: Spark would overwrite that column."""
    if clash := sorted({c.lower() for c in taken} & {n.lower() for n in names}):
        raise ValueError(f"columns {clash} exist already; choose a prefix")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, and a lost executor costs nothing."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Bound the bytes of an Arrow batch, unless the session already asks for fewer: texts may be very long."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, None)
    if now is None or not now.isdigit() or int(now) > ARROW_BYTES:
        spark.conf.set(key, str(ARROW_BYTES))


def give_back() -> None:
    """Return what a worker has freed to the machine: workers live on, and their next task may be of another stage."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def anti_by_id(df: DataFrame, gone: DataFrame, keys: list[str], most: int = 1_000_000) -> DataFrame:
    """``df`` without the rows whose keys are in ``gone``.

    ``gone`` is broadcast only when it was counted to hold at most ``most`` rows;
    otherwise both sides are shuffled.
    """
    ids = gone.select(*keys)
    if ids.count() <= most:
        ids = F.broadcast(ids)
    return df.join(ids, keys, "left_anti")


def hot_keys(rows: DataFrame, key: str, hot: int = HOT_KEYS) -> list:
    """The keys with more than one in ``hot`` of all rows and more than ``HOT_ROWS``: fewer than ``hot``, whatever the table holds."""
    counts = rows.groupBy(key).agg(F.count("*").alias("n"))
    total = rows.count()
    return [r[0] for r in counts.where(F.col("n") > max(HOT_ROWS, total // hot)).where(F.col(key).isNotNull()).collect()]


def join_hot(rows: DataFrame, table: DataFrame, key: str, hot: list, how: str = "inner") -> DataFrame:
    """``rows`` with the row of ``table`` of the same key, of which there is one at most.

    Keys in ``hot`` (see :func:`hot_keys`) meet theirs by broadcast, so that no task gathers
    the rows of such a key; all others are shuffled.
    """
    if not hot:
        return rows.join(table, key, how)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    few = rows.where(is_hot).join(F.broadcast(table.where(is_hot)), key, how)
    return rows.where(~is_hot).join(table.where(~is_hot), key, how).unionByName(few)


def running_base(rows: DataFrame, group: list[str], cell: str, value: Column, name: str) -> DataFrame:
    """Per group and cell the sum of ``value`` over the group's smaller cells, as ``name``.

    Together with a window inside each cell this numbers or sums rows in order without
    ever bringing a group into one task: the window here runs over one row per cell.
    """
    sums = rows.groupBy(*group, cell).agg(F.sum(value).alias("_of_cell"))
    before = Window.partitionBy(*group).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(*group, cell, F.coalesce(F.sum("_of_cell").over(before), F.lit(0)).cast("long").alias(name))
