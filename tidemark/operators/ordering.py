"""Positions in a sorted table without a task that sees more than its range of it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.staging import written


def counted_before(rows: DataFrame, order: list, counted: str, name: str) -> DataFrame:
    """Append ``name``: of the rows before it in ``order``, over the whole table, how many have a true ``counted``.

    Rows are dealt to ranges of the order and sorted there, streaming by with a running
    count; each range then adds what the ranges before it have in all. The order should
    tell rows apart, so that equal ones do not pile up in one range.
    """
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            is_one = batch.column(batch.schema.get_field_index(counted)).to_numpy(zero_copy_only=False).astype(np.int64)
            at = before + np.cumsum(is_one) - is_one
            before += int(is_one.sum())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at), pa.array(np.full(len(at), part, np.int32))], [*batch.schema.names, "_at", "_part"])

    schema = T.StructType([*rows.schema.fields, T.StructField("_at", T.LongType()), T.StructField("_part", T.IntegerType())])
    placed = written(ranged.mapInArrow(run, schema), "ranges")
    sizes = placed.groupBy("_part").agg(F.sum(F.col(counted).cast("long")).alias("_n"))  # one row for each range
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    return placed.join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + F.col("_at")).drop("_part", "_at", "_start")


def order_statistics(rows: DataFrame, by: list[str], value: str, shares: list[float]) -> DataFrame:
    """Per group the values of ``value`` at the given shares of its rows, between two neighbours in proportion, as an array ``quantiles``.

    The two rows that a share lies between are found by their positions in the sorted
    table, so memory does not grow with a group. Nulls count for nothing; a group without a value has nulls.
    """
    own = rows.select(*by, F.col(value).cast("double").alias("_v")).where("_v is not null")
    own = own.withColumn("_row", F.monotonically_increasing_id()).withColumn("_one", F.lit(True))
    placed = counted_before(own, [F.col(c) for c in by] + [F.col("_v"), F.col("_row")], "_one", "_g")
    groups = placed.groupBy(*by).agg(F.min("_g").alias("_first"), F.count("*").alias("_n"))
    wanted = groups.select(*by, "_first", F.posexplode(F.array(*[F.struct(F.lit(float(s)).alias("s"), (F.lit(float(s)) * (F.col("_n") - 1)).alias("at")) for s in shares])).alias("_k", "_p"))
    ends = wanted.select(*by, "_k", (F.col("_p.at") - F.floor("_p.at")).alias("_share"), F.explode(F.array(F.struct(F.lit(0).alias("e"), (F.col("_first") + F.floor("_p.at")).alias("g")), F.struct(F.lit(1).alias("e"), (F.col("_first") + F.ceil("_p.at")).alias("g")))).alias("_e"))
    found = ends.join(placed.select("_g", "_v"), F.col("_e.g") == F.col("_g")).groupBy(*by, "_k", "_share")
    found = found.agg(F.max(F.when(F.col("_e.e") == 0, F.col("_v"))).alias("_low"), F.max(F.when(F.col("_e.e") == 1, F.col("_v"))).alias("_high"))
    found = found.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_k", (F.col("_low") + (F.col("_high") - F.col("_low")) * F.col("_share")).alias("q")))).alias("_q"))
    return found.select(*by, F.transform("_q", lambda q: q["q"]).alias("quantiles"))


def reached(steps: DataFrame, roots: DataFrame) -> DataFrame:
    """``g`` of all rows that the roots reach by following ``steps`` ``(g, following)``, the roots included.

    Pointer doubling: a round doubles the reach of every row and of the set, so there are
    as many rounds as the longest way has binary digits, each of joins by row.
    """
    steps, found = written(steps.where("following is not null"), "steps"), written(roots.select("g").distinct(), "reached")
    known = found.count()
    while True:
        found = written(found.unionByName(found.join(steps, "g").select(F.col("following").alias("g"))).distinct(), "reached")
        now = found.count()
        if now == known:
            return found
        known = now
        further = steps.select(F.col("g").alias("following"), F.col("following").alias("far"))
        steps = written(steps.join(further, "following").select("g", F.col("far").alias("following")), "steps")
