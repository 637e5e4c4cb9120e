"""Keyed tables: idempotent loads, upserts, logs and report listings."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.staging import written

NATURAL_KEY = ("accession", "concept", "period_start", "period_end")


def flatten_index_docs(chunks: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """All chunks with a default for each optional field that is missing or null."""
    return chunks.withColumns({c: F.coalesce(F.col(c), d) if c in chunks.columns else d for c, d in defaults.items()})


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The table after rows with known keys were replaced and others added."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def replace_accessions(old: DataFrame, new: DataFrame, natural_key: tuple[str, ...] = NATURAL_KEY, accession: str = "accession") -> DataFrame:
    """Facts after all rows of the new rows' accessions were replaced; loading twice is loading once. A repeated natural key is an error."""
    if not new.groupBy(*natural_key).count().where("count > 1").isEmpty():
        raise ValueError("a natural key occurs twice in the load")
    return old.join(new.select(accession).distinct(), accession, "left_anti").unionByName(new)


def replace_into(path: str, new: DataFrame, by: list[str], unique: list[str], buckets: int = 64) -> dict[str, int]:
    """Load rows into the table at ``path``: they take the place of all its rows with the same ``by``. Returns what was acknowledged.

    The table lies in buckets by a hash of ``by``. Only buckets that the load touches are read
    and written again, so the bytes rewritten follow the load. The new buckets are
    complete in the shared folder before the first one is put in place, and loading
    again gives the same table, so a load that was cut off is repeated. Equal rows of a
    load are one; different rows with the same ``unique`` are an error, and nothing is written.

    ``uploaded``: rows of the load; ``acknowledged``: those that the table has afterwards; ``replaced``: rows that went; ``buckets``: how many were rewritten.
    """
    spark = new.sparkSession
    bucket = F.pmod(F.xxhash64(*by), F.lit(buckets)).cast("int")
    rows = written(new.distinct().withColumn("_bucket", bucket), "load")
    if not rows.groupBy(*unique).count().where("count > 1").isEmpty():
        raise ValueError("a natural key occurs twice in the load")
    touched = sorted(r[0] for r in rows.select("_bucket").distinct().collect())  # no more than there are buckets
    if not touched:
        return {"uploaded": 0, "acknowledged": 0, "replaced": 0, "buckets": 0}
    keys = rows.select(*by).distinct()
    try:
        old = spark.read.schema(rows.schema).parquet(path).where(F.col("_bucket").isin(touched))
        same = F.lit(True)
        for c in by:
            same = same & old[c].eqNullSafe(keys[c])
        kept = old.join(keys, same, "left_anti")
        replaced = old.join(keys, same, "left_semi").count()
        merged = written(kept.select(*rows.columns).unionByName(rows), "buckets")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        merged, replaced = rows, 0
    merged.repartition("_bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_bucket").parquet(path)
    there = spark.read.schema(rows.schema).parquet(path).where(F.col("_bucket").isin(touched))
    same = F.lit(True)
    for c in unique:
        same = same & there[c].eqNullSafe(rows[c])
    return {"uploaded": rows.count(), "acknowledged": there.join(rows.select(*unique), same, "left_semi").count(), "replaced": replaced, "buckets": len(touched)}


def upsert_index(path: str, chunks: DataFrame, key: str = "chunk_id", buckets: int = 64) -> dict[str, int]:
    """Chunks into the index table at ``path``, known ones in place of what was there; see :func:`replace_into`."""
    return replace_into(path, chunks, [key], [key], buckets)


def load_facts(path: str, facts: DataFrame, buckets: int = 64) -> dict[str, int]:
    """Facts into the table at ``path``: all former facts of their accessions go; see :func:`replace_into`."""
    return replace_into(path, facts, ["accession"], list(NATURAL_KEY), buckets)


def table(spark, path: str) -> DataFrame:
    """All rows of a table that :func:`replace_into` wrote."""
    return spark.read.parquet(path).drop("_bucket")


def fetch_facts(facts: DataFrame, cik: str | None = None, label: str | None = None, concept: str | None = None) -> DataFrame:
    for column, value in (("cik", cik), ("fiscal_label", label), ("concept", concept)):
        if value is not None:
            facts = facts.where(F.col(column) == value)
    return facts


def append_log(entries: DataFrame, path: str) -> None:
    entries.write.mode("append").partitionBy("agent").parquet(path)


def run_log(log: DataFrame, run_id: str) -> DataFrame:
    return log.where(F.col("run_id") == run_id).orderBy("ts", "event_id")


def list_reports(reports: DataFrame, offset: int = 0, limit: int = 20, company: str | None = None, quarter: str | None = None) -> DataFrame:
    """A page of completed reports, newest first, with the first 200 characters (null if empty)."""
    rows = reports.where("status = 'completed'")
    for column, value in (("company", company), ("quarter", quarter)):
        if value is not None:
            rows = rows.where(F.col(column) == value)
    rows = rows.withColumn("snippet", F.nullif(F.substring("report", 1, 200), F.lit("")))
    return rows.orderBy(F.desc("created_at"), "run_id").offset(offset).limit(limit)


def soft_delete(reports: DataFrame, gone: DataFrame, key: str = "run_id") -> DataFrame:
    """All rows, those with a key in ``gone`` with the status ``deleted``."""
    mark = gone.select(key).distinct().withColumn("_gone", F.lit(True))
    rows = reports.join(mark, key, "left")
    return rows.withColumn("status", F.when(F.col("_gone"), "deleted").otherwise(F.col("status"))).drop("_gone")


def list_by_prefix(names: DataFrame, prefix: str, column: str = "name") -> DataFrame:
    return names.where(F.col(column).startswith(prefix))
