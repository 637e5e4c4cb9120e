"""Quality scores, whitening and resampling against plain versions, held-out labels and odd tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import quality, queries, resampling, whitening

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, score string, ID string"


def odd_rows():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6)))
    long = " ".join(word() for _ in range(60_000))
    some = " ".join(word() for _ in range(40))
    texts = [None, "", " \n\t", "One", "x" * 70_000, long, some, some, some.upper(), "日本 Ünï \U0001f600 12-34", "a\x00b\x7fc", "!!! ???", "the " * 500]
    rows = [(i, t, "s", "i") for i, t in enumerate(texts)]
    return rows + [rows[6], (None, some, None, None), (None, None, None, None)]


@pytest.fixture(scope="module")
def odd(spark):
    rows = odd_rows()
    return rows, spark.createDataFrame(rows, SCHEMA)


# quality


def test_quality_held_out(spark):
    """Labels that were not learnt from: nearly all good texts stay, nearly all others go."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = queries.op11_quality(spark, SF)
    assert [t for _, t in got.dtypes] == ["bigint", "boolean", "double", "int"]
    rows = got.join(labels, "doc_id").where("held_out").collect()
    assert got.count() == docs.count() and len(rows) > 50
    good, bad = [r["score"] for r in rows if r["quality"] == 1], [r["score"] for r in rows if r["quality"] == 0]
    assert np.mean([[g > b for b in bad] for g in good]) > 0.97
    assert np.mean([s >= queries.GOOD for s in good]) > 0.97 and np.mean([s < queries.GOOD for s in bad]) > 0.9
    assert all(r["predicted"] == (r["score"] >= queries.GOOD) and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)


def test_quality_equals_plain_version(spark):
    """Moments, shrunk covariances, curve and densities from one matrix in memory."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    label = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    x = np.array([quality.statistics(r["text"]) for r in docs])
    learn = np.array([zlib.crc32(str(r["doc_id"]).encode()) % 5 != 0 and r["doc_id"] in label for r in docs])
    y = np.array([label.get(r["doc_id"], -1) for r in docs])
    side = []
    scale = np.sqrt(sum(x[learn & (y == c)].var(0) * (learn & (y == c)).sum() for c in (0, 1)) / learn.sum())
    bounds = [(a.mean(0) - 3.5 * a.std(0), a.mean(0) + 3.5 * a.std(0)) for a in (x[learn & (y == c)] for c in (0, 1))]
    z = np.clip(x, np.minimum(bounds[0][0], bounds[1][0]), np.maximum(bounds[0][1], bounds[1][1]))
    for c in (0, 1):
        a = x[learn & (y == c)]
        cov = quality.shrunk(np.cov(a.T, bias=True) / np.outer(scale, scale), len(a)) * np.outer(scale, scale)
        d = z - a.mean(0)
        side.append(-0.5 * (d * np.linalg.solve(cov, d.T).T).sum(1) - 0.5 * np.linalg.slogdet(cov)[1])
    wanted = np.clip(side[1] - side[0], -quality.LIMIT, quality.LIMIT)
    described = quality.describe(spark.createDataFrame(docs))
    model = quality.fit(described, spark.read.parquet(f"{SF}/labels.parquet"), F.crc32(F.col("id").cast("string")) % 5 != 0)
    assert np.allclose(model.difference(x), wanted, atol=1e-5)
    got = {r["id"]: r["score"] for r in quality.score(described, model).collect()}
    assert np.allclose([got[r["doc_id"]] for r in docs], 1 / (1 + np.exp(-(model.curve[0] + model.curve[1] * wanted))), atol=1e-6)
    a = np.stack([np.ones(learn.sum()), wanted[learn]], 1)
    gradient = a.T @ (1 / (1 + np.exp(-(a @ model.curve))) - y[learn]) + (np.array(model.curve) - [0, 1])
    assert np.abs(gradient).max() < 1.5  # the curve is fitted on a histogram of the differences


def test_quality_odd(spark, odd):
    rows, docs = odd
    described = quality.describe(docs)
    labels = spark.createDataFrame([(5, 1), (6, 1), (9, 1), (4, 0), (11, 0), (12, 0), (3, None), (2, 1), (2, 0), (10, 7), (None, 1), (5, 1)], "doc_id long, quality int")
    model = quality.fit(described, labels, F.lit(True))
    got = quality.score(described, model).collect()
    assert Counter(r["id"] for r in got) == Counter(r[0] for r in rows)
    assert all(0 <= r["score"] <= 1 for r in got)
    by = {r["id"]: r["score"] for r in got}
    assert by[0] == by[1] and by[6] == by[7] and by[6] > by[12]
    assert quality.fit(described, labels.where("quality = 1"), F.lit(True)) is None
    assert {r["score"] for r in quality.score(described, None).collect()} == {0.5}
    empty = quality.describe(docs.limit(0))
    assert quality.fit(empty, labels, F.lit(True)) is None and quality.score(empty, model).count() == 0


# whitening


def plain_whitening(vectors, k=16):
    """x, n, deviations, whitened and explained from a dense matrix."""
    x = np.array([[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in vectors], object)
    fit = np.array(sorted({tuple(r) for r in x}), object)
    n, sums = len(fit), fit.sum(0)
    centred = ((fit * n - sums) / n).astype(float)
    e, u = np.linalg.eigh(centred.T @ centred / n)
    e, u = e[::-1], u[:, ::-1]
    k = min(k, int((e > 1e-9 * e[0]).sum()))
    deviation = [int(((r * n - sums) ** 2).sum()) for r in x]
    return n, deviation, ((x * n - sums) / n).astype(float) @ u[:, :k] / np.sqrt(e[:k]), e[:k] / e.sum()


def held(spark, vectors):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    return whitening.whiten(df)


def same(got, vectors, alike=1e-7):
    n, deviation, white, explained = plain_whitening(vectors)
    k = white.shape[1]
    assert len(got) == len(vectors) * k
    table = np.zeros((len(vectors), k))
    for r in got:
        table[r["vec_id"], r["component"] - 1] = r["whitened"]
        assert r["n"] == n and int(r["deviation"]) == deviation[r["vec_id"]] and r["identity_error"] < 1e-9
        assert abs(r["explained"] / explained[r["component"] - 1] - 1) < 1e-9
    for j in range(k):
        sign = np.sign((table[:, j] * white[:, j]).sum())
        assert np.abs(sign * table[:, j] - white[:, j]).max() < alike * max(1, np.abs(white[:, j]).max())


def test_whitening_equals_dense(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(300, 24)) * np.linspace(2, 0.4, 24)
    vectors = [list(map(float, v)) for v in base] + [list(map(float, base[0]))] * 40 + [list(map(float, base[1] + 1e-9))]
    same(held(spark, vectors).collect(), vectors)


def test_whitening_of_the_table(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    vectors = [r["embedding"] for r in rows]
    assert [r["vec_id"] for r in rows] == list(range(len(rows)))
    got = queries.op12_whitening(spark, SF)
    assert dict(got.dtypes)["deviation"] == "bigint"
    same(got.collect(), vectors, 1e-6)


def test_whitening_converges_to_the_last_place():
    rng = np.random.default_rng(3)
    for d, n, decay in ((64, 4000, False), (300, 2000, True), (5, 50, False), (64, 20, False)):
        x = rng.normal(size=(n, d)) * (1 / np.arange(1, d + 1) if decay else 1)
        c = x - x.mean(0)
        v = c.T @ c / n
        value, vector, residual = whitening.jacobi_davidson(lambda b: c.T @ (c @ b) / n, d, 16, np.trace(v))
        wanted = np.linalg.eigvalsh(v)[::-1][: len(value)]
        assert np.abs(value - wanted).max() < 1e-14 * 8 * wanted[0] and residual.max() < 1e-13 * wanted[0]
        assert np.abs(v @ vector - vector * value).max() < 1e-13 * wanted[0] and np.abs(vector.T @ vector - np.eye(len(value))).max() < 1e-13


def test_inner_solver():
    rng = np.random.default_rng(1)
    a = rng.normal(size=(30, 30))
    a, b = a + a.T, rng.normal(size=(30, 3))
    b[:, 1] = 0
    x = whitening._minres(lambda v: a @ v, b, 60, 1e-13)
    assert np.abs(a @ x - b).max() < 1e-10


def test_whitening_odd(spark):
    good = [[1.0, 2.0, 3.0], [2.0, 1.0, 0.5], [0.0, 0.0, 0.0], [-1.0, 4.0, 2.5]]
    bad = [None, [], [1.0, None, 2.0], [float("nan"), 1.0, 1.0], [float("inf"), 1.0, 1.0], [1.0, 2.0], [float("-inf"), 0.0, 0.0]]
    rows = [(i, v, "c") for i, v in enumerate(good + bad)] + [(0, good[0], "c"), (None, good[1], "c")]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>, Component string")).collect()
    assert Counter(r["vec_id"] for r in got) == {0: 6, 1: 3, 2: 3, 3: 3, None: 3} and {r["n"] for r in got} == {4}
    same(list({(r["vec_id"], r["component"]): r for r in got if r["vec_id"] is not None}.values()), good)
    wide = [[1e30, 0.0], [0.0, 1.0], [1.0, -1e30]]
    got = held(spark, wide).collect()
    assert len(got) == 6 and all(math.isfinite(r["whitened"]) for r in got)
    for few in ([], [[1.0, 2.0]], [[1.0, 2.0]] * 5, [None]):
        assert held(spark, few).count() == 0


# resampling


def plain_resampling(rows, target, longest=1, buckets=10_000, percent=10):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

    def features(text):
        found = word.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        return len(found), [" ".join(found[i : i + k]) for k in range(1, longest + 1) for i in range(len(found) - k + 1)]

    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(map(bucket, features(text)[1]))
    for text in target:
        t.update(map(bucket, features(text)[1]))
    s_all, t_all = sum(s.values()), sum(t.values())
    out = []
    for doc_id, text in rows:
        n, found = features(text)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets)))) for b in map(bucket, found))
        h = int(hashlib.sha256(f"2024:{'null' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append((doc_id, n, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    may = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0]))
    drawn = len(may) * percent // 100
    ranked = [(*r, i + 1 if i < drawn else None) for i, r in enumerate(may)]
    return Counter(ranked + [(*r, None) for r in out if r[1] < 20])


def test_resampling_equals_plain_version(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    target = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    wanted = Counter((r[0], r[2], r[3], r[4], r[5]) for r in plain_resampling(docs, target).elements())
    got = queries.op13_resampling(spark, SF)
    assert set(t for _, t in got.dtypes) == {"bigint"}
    assert Counter(tuple(r) for r in got.collect()) == wanted


@pytest.mark.parametrize("longest", [1, 3])
def test_resampling_odd(spark, odd, longest):
    rows, docs = odd
    target = [None, "", "a b c abc", "a b"]
    wanted = plain_resampling([r[:2] for r in rows], target, longest, percent=70, buckets=500)
    got = resampling.resample(docs, spark.createDataFrame([(t,) for t in target], "text string"), percent=70, longest=longest, buckets=500)
    assert Counter(tuple(r) for r in got.collect()) == wanted
    nothing = docs.limit(0)
    assert resampling.resample(nothing, docs.select("text")).count() == 0
    assert resampling.resample(docs, nothing.select("text")).count() == len(rows)


def test_pieces_lose_no_word():
    rng = random.Random(9)
    text = resampling.lowered("".join(rng.choice("abAB é日.-\n") for _ in range(200_000)) + "z" * 100_000 + " end")
    assert resampling.offsets(text) == [m.span() for m in re.finditer(resampling.WORD, text)]
    assert resampling.lowered("AZaz[Éßİ") == "azaz[Éßİ"
