"""Tables that loads change: buckets touched and acknowledged counts, and several tables published by one record."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidemark.sources import tables
from tidemark.streaming import streams


def files(path):
    return {p: p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}


def test_upsert_rewrites_the_touched_buckets_only(spark, tmp_path):
    path = f"{tmp_path}/index"
    first = spark.range(2000).select(F.concat(F.lit("c"), "id").alias("chunk_id"), (F.col("id") * 2).alias("v"))
    assert tables.upsert_index(path, first, buckets=16) == {"uploaded": 2000, "acknowledged": 2000, "replaced": 0, "buckets": 16}
    before = files(path)
    new = spark.createDataFrame([("c5", -1), ("c5", -1), ("new", 7)], "chunk_id string, v long")
    done = tables.upsert_index(path, new, buckets=16)
    assert done == {"uploaded": 2, "acknowledged": 2, "replaced": 1, "buckets": done["buckets"]} and done["buckets"] <= 2
    after = files(path)
    same = [p for p in before if after.get(p) == before[p]]
    assert len(same) == len(before) - done["buckets"]
    wanted = {f"c{i}": 2 * i for i in range(2000)} | {"c5": -1, "new": 7}
    assert {r["chunk_id"]: r["v"] for r in tables.table(spark, path).collect()} == wanted
    assert tables.upsert_index(path, new, buckets=16)["replaced"] == 2 and tables.table(spark, path).count() == 2001
    assert tables.upsert_index(path, new.limit(0))["uploaded"] == 0
    with pytest.raises(ValueError, match="twice"):
        tables.upsert_index(path, spark.createDataFrame([("x", 1), ("x", 2)], "chunk_id string, v long"), buckets=16)
    assert tables.table(spark, path).count() == 2001


def test_facts_of_an_accession_are_replaced_whole(spark, tmp_path):
    path, schema = f"{tmp_path}/facts", "accession string, concept string, period_start date, period_end string, value double"
    load = lambda rows: tables.load_facts(path, spark.createDataFrame(rows, schema), buckets=4)
    load([("a", "R", None, "x", 1.0), ("a", "S", None, "x", 2.0), ("b", "R", None, "x", 3.0), (None, "R", None, "x", 4.0)])
    assert load([("a", "R", None, "x", 9.0), (None, "T", None, "y", 5.0)]) == {"uploaded": 2, "acknowledged": 2, "replaced": 3, "buckets": 2}
    assert {(r["accession"], r["concept"], r["value"]) for r in tables.table(spark, path).collect()} == {("a", "R", 9.0), ("b", "R", 3.0), (None, "T", 5.0)}
    with pytest.raises(ValueError, match="twice"):
        load([("c", "R", None, "x", 1.0), ("c", "R", None, "x", 2.0)])


def arrivals(spark, folder, n, filings):
    """Each file brings filings of which some came before, with as many lines and numbers as its number says."""
    for k in range(n):
        rows = [(f"f{f}", k, f"line {k}") for f in filings(k)]
        spark.createDataFrame(rows, "accession string, version int, body string").coalesce(1).write.mode("append").json(folder)


def stream_of(spark, folder):
    return spark.readStream.schema("accession string, version int, body string").option("maxFilesPerTrigger", 1).json(folder)


def made(batch):
    lines = batch.select("accession", "version", F.explode(F.sequence(F.lit(0), F.col("version") % 3)).alias("i"))
    return {"sections": batch.select("accession", "version"), "chunks": lines, "facts": batch.where("version % 2 = 0").select("accession", "version")}


def last_versions(spark, path):
    keys = spark.read.parquet(f"{path}/sections").groupBy("accession").agg(F.max(F.struct("batch", "version")).alias("m"))
    return {r["accession"]: r["m"]["version"] for r in keys.collect()}


def test_tables_change_together_and_parts_stay_few(spark, tmp_path):
    folder, path = f"{tmp_path}/in", f"{tmp_path}/tables"
    arrivals(spark, folder, 7, lambda k: (k % 3, 10 + k))
    streams.ingest_tables(stream_of(spark, folder), made, "accession", path, f"{tmp_path}/state", compact_every=2).awaitTermination()
    record = streams._commit(spark, path)
    assert record["number"] == 6 and len(record["parts"]) <= 2
    got = {n: streams.committed(spark, path, n).collect() for n in ("sections", "chunks", "facts")}
    version = {r["accession"]: r["version"] for r in got["sections"]}
    assert len(got["sections"]) == len(version) == 10 and set(version) == {"f0", "f1", "f2", *(f"f{10 + k}" for k in range(7))}
    assert sorted((r["accession"], r["version"]) for r in got["chunks"]) == sorted((a, v) for a, v in version.items() for _ in range(v % 3 + 1))
    assert sorted(r["accession"] for r in got["facts"]) == sorted(a for a, v in version.items() if v % 2 == 0)


def test_a_killed_batch_is_not_seen(spark, tmp_path):
    folder, path = f"{tmp_path}/in", f"{tmp_path}/tables"
    with pytest.raises(ValueError, match="nothing is committed"):
        streams.committed(spark, path, "sections")
    arrivals(spark, folder, 3, lambda k: (0, k))
    runs = []

    def broken(batch):
        runs.append(1)
        tables_of = made(batch)
        if len(runs) == 2:
            tables_of["facts"] = tables_of["facts"].withColumn("version", F.raise_error(F.lit("killed")).cast("int"))
        return tables_of

    with pytest.raises(Exception, match="killed"):
        streams.ingest_tables(stream_of(spark, folder), lambda b: broken(b.withColumn("version", F.lit(2))), "accession", path, f"{tmp_path}/state").awaitTermination()
    assert len(runs) == 2 and streams._commit(spark, path)["number"] == 0
    seen = {n: {r["batch"] for r in spark.read.parquet(f"{path}/{n}").select("batch").distinct().collect()} for n in ("sections", "chunks")}
    assert seen["sections"] == {0, 1}  # rows of the killed batch are there, but no reader sees them
    before = {n: streams.committed(spark, path, n).count() for n in ("sections", "chunks", "facts")}
    assert before["sections"] in (1, 2) and before["facts"] == before["sections"]  # one file of the three is that of one filing or two
    streams.ingest_tables(stream_of(spark, folder), made, "accession", path, f"{tmp_path}/state").awaitTermination()
    assert streams._commit(spark, path)["number"] == 2
    assert {r["accession"] for r in streams.committed(spark, path, "sections").collect()} == {"f0", "f1", "f2"}
    assert streams.committed(spark, path, "sections").count() == 3
