"""Streams with state, over several batches."""

from datetime import datetime, timedelta

from tidemark.streaming import streams


def test_cache_replay_keeps_few_states_of_many_keys(spark, tmp_path):
    """keys share state by buckets, over batches and expiry; requests without a key are a key, those without a time never hit."""
    began, schema = datetime(2024, 3, 30, 12), "k string, ts timestamp, n long"
    batches = []
    for b in range(4):
        rows = [(f"k{i % 97}" if i % 101 else None, began + timedelta(hours=30 * b + i * 7 % 29, microseconds=i * 311 % 1000), 1000 * b + i) for i in range(600)]
        batches.append([(k, None if n % 97 == 5 else t, n) for k, t, n in rows])
        spark.createDataFrame(batches[-1], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out = streams.stream_ttl_hits(stream, "k", "ts", "n", 5 * 3600, buckets=8)
    query = out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    set_at, wanted = {}, {}
    for rows in batches:
        for k, t, n in sorted(rows, key=lambda r: (r[1] is None, r[1] or began, r[2])):
            hit = t is not None and k in set_at and t - set_at[k] < timedelta(hours=5)
            if t is not None and not hit:
                set_at[k] = t
            wanted[n] = (k, hit)
    got = {r["n"]: (r["k"], r["hit"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == wanted and {h for _, h in got.values()} == {True, False}
    states = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress]
    assert 0 < max(states) <= 9


def test_older_parts_are_not_written_again_and_again():
    """over many batches, compaction writes each batch a few times, and parts stay few; a part is of batches that follow each other."""
    for most in (1, 2, 8):
        parts, wrote, batches = [], 0, 300
        for number in range(batches):
            parts.append(f"b{number}")
            if len(parts) > most:
                start = streams._merged_from(parts)
                first = streams._batches_of(parts[start])[0]
                assert start < len(parts) - 1
                parts = [*parts[:start], f"c{first}-{number}"]
                wrote += number - first + 1
            ranges = [streams._batches_of(p) for p in parts]
            assert len(parts) <= most and [n for a, b in ranges for n in range(a, b + 1)] == list(range(number + 1))
        if most == 8:
            assert wrote < 4 * batches  # all parts at every eighth batch: 19 times
    assert streams._batches_of("c7") == (0, 7)
