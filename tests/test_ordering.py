"""Positions, quantiles and cache replay of keys that split over tasks, against plain folds."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import analytics, ordering


def test_counts_before_each_row(spark):
    rng = random.Random(1)
    rows = [(i, rng.randrange(50), rng.random() < 0.4) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, v long, yes boolean").repartition(7)
    got = {r["id"]: r["n"] for r in ordering.counted_before(df, [F.col("v"), F.col("id")], "yes", "n").collect()}
    before, wanted = 0, {}
    for i, _, yes in sorted(rows, key=lambda r: (r[1], r[0])):
        wanted[i] = before
        before += yes
    assert got == wanted


def test_quantiles_equal_sorted_values(spark):
    rng = random.Random(2)
    rows = [(k, rng.choice([None, 1.0, rng.random()]) if k else 5.0) for k in (0, 1, 2, None) for _ in range(rng.choice([3, 400]))] + [(9, None), (8, 2.5)]
    got = {r["k"]: r["quantiles"] for r in ordering.order_statistics(spark.createDataFrame(rows, "k int, v double"), ["k"], "v", [0.0, 0.5, 0.9, 1.0]).collect()}
    groups = defaultdict(list)
    for k, v in rows:
        if v is not None:
            groups[k].append(v)
    assert got.keys() == groups.keys()
    for k, own in groups.items():
        assert got[k] == pytest.approx(list(np.quantile(own, [0.0, 0.5, 0.9, 1.0])))
    one = analytics.latency_percentiles(spark.createDataFrame(rows, "k int, v double"), "v", F.col("v") > 0.5).collect()
    assert len(one) == 1 and one[0]["n"] == len(rows) and one[0]["p50"] == pytest.approx(np.quantile([v for _, v in rows if v is not None], 0.5), abs=1e-6)
    by = {r["k"]: r for r in analytics.latency_percentiles(spark.createDataFrame(rows, "k int, v double"), "v", F.col("v") > 0.5, ["k"]).collect()}
    assert by[9]["p50"] is None and by[8]["p99"] == 2.5 and by[None]["n"] == sum(k is None for k, _ in rows)


@pytest.mark.parametrize("hot", [0, 100, 10**6])
def test_cache_replay_split_and_streamed(spark, hot):
    """All keys split, one hot key split, none: the fold's hits in each case."""
    rng = random.Random(3)
    rows = [(n, k, rng.choice([None, *range(0, 4000)]) if rng.random() < 0.02 else rng.randrange(4000)) for n, k in enumerate(rng.choices(["a", "b", "c", None], [60, 5, 1, 1], k=1500))]
    df = spark.createDataFrame(rows, "id long, k string, s long").withColumn("ts", F.timestamp_seconds("s"))
    got = {r["id"]: r["hit"] for r in analytics.ttl_hits(df, "k", "ts", "id", 17, hot=hot).collect()}
    wanted = {}
    for key in ("a", "b", "c"):
        set_at = None
        for n, _, s in sorted((r for r in rows if r[1] == key), key=lambda r: (r[2] is not None, r[2], r[0])):
            hit = s is not None and set_at is not None and s - set_at < 17
            wanted[n] = hit
            if s is not None and not hit:
                set_at = s
    assert got == wanted and 0 < sum(wanted.values()) < len(wanted)
