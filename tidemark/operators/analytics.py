"""Cache, log and event analytics in batch."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.ordering import counted_before, order_statistics, reached
from tidemark.staging import written


def cache_key(prefix: str, query: Column, company: Column, quarter: Column, doc_type: Column, size: int = 16) -> Column:
    """Prefix and the first hex digits of the hash of normalized coordinates."""
    raw = F.concat_ws("::", F.lower(F.trim(query)), F.upper(company), F.upper(quarter), F.lower(F.coalesce(F.nullif(doc_type, F.lit("")), F.lit("all"))))
    return F.concat(F.lit(prefix + "::"), F.substring(F.sha2(raw, 256), 1, size))


def run_key(query: Column, company: Column, quarter: Column, labels: Column) -> Column:
    raw = F.concat_ws("::", F.lower(F.trim(query)), F.upper(company), F.upper(quarter), F.array_join(F.array_sort(labels), ","))
    return F.concat(F.lit("run::"), F.substring(F.sha2(raw, 256), 1, 16))


def ttl_hits(requests: DataFrame, key: str, ts: str, order: str, seconds: int, hot: int = 1_000_000) -> DataFrame:
    """Replay of requests against a cache: append ``hit``.

    A request hits if an entry lives; a miss sets one, which expires a fixed time after
    it was set, whatever hits it. Rows without a key are left out, and one without a time
    never hits.

    Sorted rows stream by, and a task holds no more than one key and the time its entry
    was set. Keys with more than ``hot`` requests, which would be one task each, split
    over tasks (see :func:`_split_hits`).
    """
    at, heat = (next(n for n in (f"{'_' * i}{name}" for i in range(1, 99)) if n not in requests.columns) for name in ("at", "requests"))
    rows = requests.where(F.col(key).isNotNull()).withColumn(at, F.unix_micros(F.col(ts).cast("timestamp")))
    many = rows.groupBy(key).agg(F.count("*").alias(heat)).where(F.col(heat) > hot).select(key)
    lifetime = seconds * 1_000_000
    if many.isEmpty():
        return _streamed_hits(rows, key, at, order, lifetime)
    many = F.broadcast(written(many, "hot-keys"))  # fewer than all rows divided by hot
    return _streamed_hits(rows.join(many, key, "left_anti"), key, at, order, lifetime).unionByName(_split_hits(rows.join(many, key, "left_semi"), key, at, order, lifetime))


def _streamed_hits(rows: DataFrame, key: str, at: str, order: str, lifetime: int) -> DataFrame:
    sorted_rows = rows.repartition(key).sortWithinPartitions(key, at, order)
    fields = [f for f in rows.schema.fields if f.name != at]
    names = [f.name for f in fields]

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, set_at = None, None
        for batch in batches:
            hits = []
            for k, t in zip(batch.column(key).to_pylist(), batch.column(at).to_pylist()):
                if k != now:
                    now, set_at = k, None
                hit = set_at is not None and t is not None and t - set_at < lifetime
                if not hit and t is not None:
                    set_at = t
                hits.append(hit)
            kept = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(hits, pa.bool_())], [*names, "hit"])

    return sorted_rows.mapInArrow(replay, T.StructType([*fields, T.StructField("hit", T.BooleanType())]))


def _split_hits(rows: DataFrame, key: str, at: str, order: str, lifetime: int) -> DataFrame:
    """The same without a task that holds a key.

    Were a request to set an entry, the next one to set it would be the first at or after
    its expiry: that one's position is the number of requests before the expiry, counted
    in one sorted table of requests and expiries. The misses are what a key's first
    request reaches by these steps. A step beyond a key's last request leads to the next
    key's first, which misses anyway.
    """
    timed = written(rows.where(F.col(at).isNotNull()).withColumn("_row", F.monotonically_increasing_id()), "timed")
    both = timed.select(key, F.col(at).alias("_when"), F.lit(True).alias("_asks"), F.col(order).alias("_order"), "_row")
    both = both.unionByName(both.withColumns({"_when": F.col("_when") + lifetime, "_asks": F.lit(False)}))
    placed = counted_before(both, [F.col(key), F.col("_when"), F.col("_asks"), F.col("_order"), F.col("_row")], "_asks", "_g")
    asks = written(placed.where("_asks").select(key, "_row", F.col("_g").alias("g")), "asks")
    steps = placed.where(~F.col("_asks")).select("_row", F.col("_g").alias("following")).join(asks, "_row").select("g", "following")
    misses = reached(steps, asks.groupBy(key).agg(F.min("g").alias("g")))
    hits = asks.join(misses.withColumn("_missed", F.lit(True)), "g", "left").select("_row", F.col("_missed").isNull().alias("hit"))
    columns = [c for c in rows.columns if c != at]
    untimed = rows.where(F.col(at).isNull()).select(*columns, F.lit(False).alias("hit"))
    return timed.join(hits, "_row").select(*columns, "hit").unionByName(untimed)


def cache_stats(hits: DataFrame, level: str) -> DataFrame:
    """Hits, misses and hit rate per level and over all (level ``all``)."""
    rows = hits.rollup(level).agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"))
    rate = F.round(F.coalesce(F.try_divide(F.col("hits"), F.col("hits") + F.col("misses")), F.lit(0.0)), 4)
    return rows.select(F.coalesce(level, F.lit("all")).alias("level"), "hits", "misses", rate.alias("hit_rate"))


def stage_durations(events: DataFrame, keys: list[str], ts: str, start: Column, end: Column, order: str) -> DataFrame:
    """Each start with the next end of the same run and stage: seconds between them; starts without an end have null."""
    w = Window.partitionBy(*keys).orderBy(ts, order)
    rows = events.where(start | end).withColumn("_is_start", start)
    rows = rows.withColumn("_next", F.lead(ts).over(w)).withColumn("_next_start", F.lead("_is_start").over(w))
    ended = F.when(~F.col("_next_start"), F.col("_next"))
    seconds = (F.unix_micros(ended.cast("timestamp")) - F.unix_micros(F.col(ts).cast("timestamp"))) / 1e6
    return rows.where("_is_start").select(*keys, F.col(order).alias("start_id"), F.round(seconds, 3).alias("seconds"))


def latency_percentiles(rows: DataFrame, value: str, failed: Column, by: list[str] = []) -> DataFrame:
    """Per group the number of rows, the 50th, 90th, 95th and 99th percentile of a value, its mean and the share of failures; exact, by positions in the sorted values."""
    marks = (50, 90, 95, 99)
    counted = rows.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.avg(value), 6).alias("mean"), F.round(F.count_if(failed) / F.count("*"), 6).alias("error_rate"))
    found = order_statistics(rows, by, value, [p / 100 for p in marks])
    same = F.lit(True)
    for c in by:
        same = same & counted[c].eqNullSafe(found[c])
    met = counted.join(found, same, "left")
    return met.select(*[counted[c] for c in by], "n", *[F.round(F.get("quantiles", F.lit(i)), 6).alias(f"p{p}") for i, p in enumerate(marks)], "mean", "error_rate")


def draft_fold(events: DataFrame, run: str, order: list[str], kind: str, piece: str) -> DataFrame:
    """``run, draft, done``: what came after the last ``draft_reset``, or the last ``final``; nothing counts after ``done``."""
    w = Window.partitionBy(run).orderBy(*order)
    rows = events.withColumn("_over", F.coalesce(F.max((F.col(kind) == "done").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).where("_over = 0")
    rows = rows.withColumn("_resets", F.sum(F.col(kind).isin("draft_reset", "final").cast("int")).over(w)).withColumn("_n", F.row_number().over(w))
    last = F.max("_resets").over(Window.partitionBy(run))
    rows = rows.withColumn("_last", last)
    kept = (F.col("_resets") == F.col("_last")) & F.col(kind).isin("token", "final")
    parts = F.array_sort(F.collect_list(F.when(kept, F.struct("_n", piece))))
    out = rows.groupBy(run).agg(parts.alias("c"), F.bool_or(F.col(kind) == "done").alias("done"))
    return out.select(run, F.array_join(F.transform("c", lambda c: c[piece]), "").alias("draft"), "done")


def run_log_summary(log: DataFrame, by: str = "agent") -> DataFrame:
    return log.groupBy(by).agg(F.count("*").alias("calls"), F.countDistinct("run_id").alias("runs"), F.round(F.sum("latency_ms"), 4).alias("latency"), F.round(F.avg("latency_ms"), 6).alias("mean_latency"), F.round(F.max("latency_ms"), 6).alias("max_latency"))


def merge_logs(*logs: DataFrame) -> DataFrame:
    """All entries of parallel branches, none lost, with their place in each run."""
    rows = logs[0]
    for other in logs[1:]:
        rows = rows.unionByName(other)
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("run_id").orderBy("ts", "event_id")))


def dedup_requests(requests: DataFrame, key: str, ts: str, order: str, ok: Column) -> DataFrame:
    """Append ``served_by``: of equal requests, the first one before it that succeeded; null for those that had to run."""
    w = Window.partitionBy(key).orderBy(ts, order).rowsBetween(Window.unboundedPreceding, -1)
    return requests.withColumn("served_by", F.first(F.when(ok, F.col(order)), True).over(w))
