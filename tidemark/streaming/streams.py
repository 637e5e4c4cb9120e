"""The streaming forms of cache replay, stage pairing, draft folding and ingestion."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stream_ttl_hits(requests: DataFrame, key: str, ts: str, order: str, seconds: int, delay: str = "1 day", buckets: int = 1_024) -> DataFrame:
    """``key, order, hit`` of a stream of requests: state holds for each key the time its entry was set; it goes when the watermark passes the expiry.

    A request without a time never hits. Keys share state by ``buckets`` of their hash, as a call and a state row
    for each key cost more than its requests; a task holds a batch's requests of one bucket and the
    entries that live in it. The number must stay the same as long as the checkpoint does.
    """
    kinds, lifetime = dict(requests.dtypes), seconds * 1_000_000

    def replay(bucket: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        set_at = dict(zip(*state.get)) if state.exists else {}
        if not state.hasTimedOut:
            rows = pd.concat(list(batches)).sort_values(["_at", order], kind="stable")
            keys = [None] * len(rows) if bucket[0] < 0 else rows[key].tolist()
            hits = []
            for k, t in zip(keys, rows["_at"].tolist()):
                since = set_at.get(k)
                hit = since is not None and t - since < lifetime
                if not hit and t == t:  # a missing time is NaN
                    set_at[k] = int(t)
                hits.append(hit)
            yield pd.DataFrame({key: keys, order: rows[order], "hit": hits})
        now = state.getCurrentWatermarkMs()
        set_at = {k: t for k, t in set_at.items() if t + lifetime > now * 1000}
        if set_at:
            state.update((list(set_at), list(set_at.values())))
            state.setTimeoutTimestamp(-(-(min(set_at.values()) + lifetime) // 1000))
        elif state.exists:
            state.remove()

    marked = requests.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    bucket = F.when(F.col(key).isNull(), -1).otherwise(F.pmod(F.xxhash64(key), F.lit(buckets))).cast("int")  # in a bucket of their own, nulls change no type
    rows = marked.select(bucket.alias("_bucket"), key, ts, order, F.unix_micros(ts).alias("_at"))
    return rows.groupBy("_bucket").applyInPandasWithState(replay, f"{key} {kinds[key]}, {order} {kinds[order]}, hit boolean", f"keys array<{kinds[key]}>, set_at array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def stream_stage_durations(events: DataFrame, keys: list[str], ts: str, start: Column, end: Column, most: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Each start with the ends of the same keys within ``most`` after it, as an interval join of the stream with itself."""
    rows = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    a = rows.where(start).select(*[F.col(k).alias(f"s_{k}") for k in keys], F.col(ts).alias("s_ts"))
    b = rows.where(end).select(*keys, F.col(ts).alias("e_ts"))
    on = [F.col(f"s_{k}") == F.col(k) for k in keys] + [F.col("e_ts") > F.col("s_ts"), F.col("e_ts") <= F.col("s_ts") + F.expr(f"interval {most}")]
    met = a.join(b, on)
    return met.select(*keys, "s_ts", "e_ts", ((F.unix_micros("e_ts") - F.unix_micros("s_ts")) / 1e6).alias("seconds"))


def stream_drafts(events: DataFrame, run: str, order: str, kind: str, piece: str) -> DataFrame:
    """Current draft per run after each batch: tokens since the last reset; ``final`` replaces it, ``done`` ends it."""
    kinds = dict(events.dtypes)

    def fold(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        draft, done = state.get if state.exists else ("", False)
        rows = pd.concat(list(batches)).sort_values(order)
        for what, text in zip(rows[kind], rows[piece]):
            if done:
                break
            if what == "token":
                draft += text or ""
            elif what == "draft_reset":
                draft = ""
            elif what == "final":
                draft = text or ""
            elif what == "done":
                done = True
        state.update((draft, done))
        yield pd.DataFrame({run: [k[0]], "draft": [draft], "done": [done]})

    return events.select(run, order, kind, piece).groupBy(run).applyInPandasWithState(fold, f"{run} {kinds[run]}, draft string, done boolean", "draft string, done boolean", "update", GroupStateTimeout.NoTimeout)


def event_counts(events: DataFrame, ts: str, by: str, window: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Counts per window and kind, for a stream or a table."""
    rows = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    return rows.groupBy(F.window(ts, window), by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), by, "n")


def ingest(stream: DataFrame, transform: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, trigger: dict | None = None):
    """Incremental ingestion: each batch of new filings is transformed and stored under its number; see :func:`ingested`.

    A batch that runs again overwrites itself, so that nothing is stored twice.
    """

    def load(batch: DataFrame, number: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def ingested(rows: DataFrame, accession: str) -> DataFrame:
    """Of what :func:`ingest` stored, each accession's rows of the last batch that has any: a later filing replaces an earlier one, whatever else its batch holds."""
    last = rows.groupBy(accession).agg(F.max("batch").alias("batch"))
    return rows.join(last, [accession, "batch"], "left_semi")


def ingest_tables(stream: DataFrame, make: Callable[[DataFrame], dict[str, DataFrame]], key: str, path: str, checkpoint: str, compact_every: int = 8, trigger: dict | None = None):
    """Incremental ingestion into several tables that readers see change together.

    ``make`` turns a batch of filings into tables that all have ``key``. A batch writes each
    table's rows and the keys that it brought, and last a commit record that names the
    parts that count; what a batch without a record has written is not seen, and the batch
    overwrites it when it runs again. Beyond ``compact_every`` parts some become one, of each
    key's last batch there only, so what a reader opens does not grow with the number of batches;
    which ones, see :func:`_merged_from`.
    """

    def load(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = _commit(spark, path, number)
        part = f"b{number}"
        batch.select(key).distinct().withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/keys/part={part}")
        names = []
        for name, rows in make(batch).items():
            rows.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/{name}/part={part}")
            names.append(name)
        parts = (before["parts"] if before else []) + [part]
        if len(parts) > compact_every:
            start = _merged_from(parts)
            whole = f"c{_batches_of(parts[start])[0]}-{number}"
            for name in [*names, "keys"]:
                _last_of(spark, path, name, parts[start:], key).write.mode("overwrite").parquet(f"{path}/{name}/part={whole}")
            parts = [*parts[:start], whole]
        spark.createDataFrame([(number, key, parts)], "number long, key string, parts array<string>").coalesce(1).write.mode("overwrite").json(f"{path}/commits/slot={number % 2}")

    return stream.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def _batches_of(part: str) -> tuple[int, int]:
    """First and last batch of a part: ``b7`` is of one batch, ``c3-7`` of five, ``c7`` of all up to it."""
    first, _, last = part[1:].rpartition("-")
    return int(first or (last if part[0] == "b" else 0)), int(last)


def _merged_from(parts: list[str]) -> int:
    """From which part on the parts become one: the newest that are of one batch each, so that older rows are not written again;
    if there is only one such, what follows the parts that are as large as all after them."""
    sizes = [last - first + 1 for first, last in map(_batches_of, parts)]
    start = len(sizes)
    while start and sizes[start - 1] == 1:
        start -= 1
    if len(sizes) - start >= 2:
        return start
    start = 0
    while start < len(sizes) - 2 and sizes[start] >= sum(sizes[start + 1 :]):
        start += 1
    return start


def _commit(spark, path: str, below: int | None = None):
    """The last commit record (of a batch before ``below``), None if there is none. Two slots take turns, so one stays whole while the other is written."""
    try:
        found = spark.read.schema("number long, key string, parts array<string>").json(f"{path}/commits").where("number is not null").collect()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return max((r for r in found if below is None or r["number"] < below), key=lambda r: r["number"], default=None)


def _last_of(spark, path: str, name: str, parts: list[str], key: str) -> DataFrame:
    """Of the parts, the rows of each key's last batch."""
    read = lambda n: spark.read.parquet(*[f"{path}/{n}/part={p}" for p in parts])
    last = read("keys").groupBy(key).agg(F.max("batch").alias("batch"))
    return read(name).join(last, [key, "batch"], "left_semi")


def committed(spark, path: str, name: str) -> DataFrame:
    """A table that :func:`ingest_tables` keeps, as of its last commit record: each key's rows of the last batch that brought it."""
    record = _commit(spark, path)
    if record is None:
        raise ValueError(f"nothing is committed at {path}")
    return _last_of(spark, path, name, record["parts"], record["key"]).drop("batch")


def run_to_end(stream: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """All output of a stream over the data that is there now, written as Parquet beside its checkpoint and read back."""
    out = f"{checkpoint}/{name}-rows"
    if mode == "append":
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{checkpoint}/{name}").trigger(availableNow=True).start()
    else:

        def keep(batch: DataFrame, number: int) -> None:
            batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/n={number}")

        query = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{checkpoint}/{name}").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.parquet(out)
