"""The training-data operators against plain versions, and on nulls, empty, long, tied and repeated rows and clashing names."""

import hashlib
import math
import random
import re
import tarfile
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from tidemark.llm import language_id, license_scan, media, mixture, ngram_join, piece_codec, queries, secret_scan, sharding, url_filter, vector_search

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty, blank, very long, equal, near equal, repeated and unnumbered rows."""
    rng = random.Random(3)
    base = words(rng, 120)
    near = base.replace(base.split()[60], "zzz", 1)
    long = words(rng, 30_000)
    texts = [None, "", " \n\t ", "one", "one two", base, base, near, long, long + " more", "12 34 !?", "straße Ünïcode 日本 \U0001f600 fin", base.upper(), words(rng, 300)]
    rows = [(i, t, ("en", "fr", None)[i % 3], ("a", "b", None, "z")[i % 4], 0) for i, t in enumerate(texts)]
    rows += [rows[5], (99, words(rng, 40), "fr", None, None)]
    return rows, spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def multiset(rows):
    return Counter(tuple(r) for r in rows)


@pytest.fixture(scope="module")
def sp():
    return sentencepiece.SentencePieceProcessor(model_file=queries.piece_model())


def test_codec_equals_library(sp):
    codec, rng = piece_codec.codec(queries.piece_model()), random.Random(1)
    pieces = [p.replace("▁", " ") for p in codec.ids]
    alphabet = "abcdehinorst.,-_(){}<>/0129éñß▁ \t\r\n\x00日\U0001f600"
    texts = ["", " ", "▁", "  x  ", "<s></s><0x0A>", "a" * 5000, " " * 300, "é" * 400]
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    texts += ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 8))) for _ in range(3000)]
    for t in texts:
        assert codec.encode(t)[0] == sp.encode(t, add_eos=True), t


def test_codec_frame(spark, odd, empty, sp):
    rows, docs = odd
    got = piece_codec.encode_decode(docs, queries.piece_model(), tokens=True)
    wanted = Counter()
    for r in rows:
        ids = sp.encode(r[1] or "", add_eos=True)
        back = sp.decode(ids)
        wanted[(r[0], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest(), tuple(ids), back)] += 1
    assert Counter((*tuple(r)[:4], tuple(r["ids"]), r["decoded"]) for r in got.collect()) == wanted
    assert piece_codec.encode_decode(empty, queries.piece_model()).count() == 0


def test_codewords_are_apart():
    for n in (2, 3, 6, 7, 30):
        code = language_id.codewords(n)
        assert len(np.unique(code, axis=0)) == n and (np.abs(code.sum(0)) < n).all()


def test_language_accuracy_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = queries.op2_language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    n, right = found.selectExpr("count(*)", "count_if(lang = lang_pred)").first()
    assert n > 200 and right / n > 0.95


def test_language_odd(spark, odd, empty):
    rows, docs = odd
    model = language_id.fit(docs, F.lit(True))
    got = language_id.predict(docs.withColumn("score", F.lit(1)), model, prefix="p_").select("doc_id", "text", "p_lang_pred", "p_score", "p_ambiguous").collect()
    assert len(got) == len(rows)
    for r in got:
        lettered = bool(r["text"]) and any(c.isalpha() for c in r["text"])
        assert (r["p_lang_pred"] == "und") == (not lettered) and 0 <= r["p_score"] <= 1
    with pytest.raises(ValueError):
        language_id.predict(docs.withColumn("score", F.lit(1)), model)
    assert language_id.fit(empty, F.lit(True)) is None
    assert {r["lang_pred"] for r in language_id.predict(docs, None).collect()} == {"und"}
    assert language_id.predict(empty, model).count() == 0


def plain_spans(text):
    out = []
    assign = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    for k, pattern, ok in ((0, assign, lambda m: len(m[2]) >= 6), (1, re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20), (2, re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24)):
        out += [(m.start(), k, m.end()) for m in pattern.finditer(text or "") if ok(m)]
    return sorted(out)


def test_secrets_against_plain_scan(spark):
    rng = random.Random(5)
    parts = ["token", "TOKEN = ", "password", ": ", "'", '"', "=", "api_key", "AKIA", "ABCDEFGH12345678", "deadbeef", "0123456789abcdef", " ", "é", "\U0001f600", "secret=", "x", "ab", "\n", "passwd:", "aB3dE5gH7jK9mN1pQ3sT5vW7"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(1500)] + [None, "", 'secret=token:"abcdefgh"']
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in secret_scan.scan(docs).collect():
        base = [(s["start"], s["kind"], s["end"]) for s in r["base_spans"]]
        assert base == plain_spans(r["text"])
        assert set(base) <= {(s["start"], s["kind"], s["end"]) for s in r["spans"]}


def test_window_entropy(spark):
    rng = random.Random(2)
    runs = ["".join(rng.choice(secret_scan.ALPHABET) for _ in range(rng.randint(20, 60))) for _ in range(60)] + ["a" * 40, "ab" * 15]

    def plain(run):
        best = 0.0
        for i in range(len(run) - 19):
            n = Counter(run[i : i + 20])
            best = max(best, -sum(c / 20 * math.log2(c / 20) for c in n.values()))
        return best

    got = spark.createDataFrame([(r,) for r in runs], "run string").select("run", secret_scan.window_entropy(F.col("run")).alias("h")).collect()
    assert all(abs(r["h"] - plain(r["run"])) < 1e-9 for r in got)


def test_secrets_added_allowed_and_redacted(spark, odd, empty):
    docs = spark.createDataFrame([(1, "key aB3dE5gH7jK9mN1pQ3sT5vW7 end"), (2, "id 123e4567-e89b-42d3-a456-426614174000 n 12345678901234567890123"), (3, "example-aB3dE5gH7jK9mN1pQ3sT")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in secret_scan.scan(docs).withColumn("clean", secret_scan.redact(F.col("text"), F.col("spans"))).collect()}
    assert got[1]["clean"] == "key [SECRET] end" and not got[2]["spans"] and not got[3]["spans"]
    rows, all_docs = odd
    assert secret_scan.scan(all_docs).count() == len(rows) and secret_scan.scan(empty).count() == 0
    with pytest.raises(ValueError):
        secret_scan.scan(docs.withColumn("spans", F.lit(1)))


def test_vectors_recall_and_exact_scores(spark):
    x = duckdb.sql("select vec_id, embedding from '/root/testdata/sf0.01/embeddings.parquet' order by vec_id").fetchnumpy()
    v = np.array(x["embedding"].tolist(), float)
    hit = total = 0
    got = defaultdict(list)
    for r in queries.op4_vector_search(spark, "/root/testdata/sf0.01").orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    for q in range(0, len(v), 100):
        d = np.sqrt(((v - v[q]) ** 2).sum(1))
        assert all(abs(s - d[i]) < 1e-12 for i, s in got[q])
        d[q] = np.inf
        hit += len({i for i, _ in got[q]} & set(np.lexsort((np.arange(len(v)), d))[:10].tolist()))
        total += 10
    assert hit / total >= 0.9


@pytest.mark.parametrize("kind,most", [("derived", 0.25), ("normal", 1.0)])
def test_vectors_recall_with_pruning(spark, kind, most):
    """20,000 vectors in 200 lists: recall against brute force, copies of boundary vectors, and the share of vectors that a query reads."""
    rng = np.random.default_rng(1)
    if kind == "normal":
        v = rng.normal(size=(20_000, 64))
    else:
        x = duckdb.sql("select embedding from '/root/testdata/sf0.1/embeddings.parquet' order by vec_id").fetchnumpy()["embedding"]
        x = np.array(x.tolist(), float)
        v = x[rng.integers(0, len(x), 20_000)]
        v = v + rng.normal(size=v.shape) * 0.5 * x.std()
    frame = spark.createDataFrame(pa.table({"vec_id": np.arange(len(v)), "embedding": pa.FixedSizeListArray.from_arrays(v.ravel(), 64).cast(pa.list_(pa.float64()))}))
    got = defaultdict(set)
    for r in vector_search.nearest(frame, F.col("vec_id") % 100 == 0).collect():
        got[r["query_id"]].add(r["vec_id"])
        assert abs(r["score"] - np.sqrt(((v[r["vec_id"]] - v[r["query_id"]]) ** 2).sum())) < 1e-12
    hit = 0
    for q in range(0, len(v), 100):
        d = ((v - v[q]) ** 2).sum(1)
        d[q] = np.inf
        hit += len(got[q] & set(np.argsort(d)[:10].tolist()))
    assert len(got) == 200 and hit / (10 * len(got)) >= 0.9

    s = vector_search.Settings()
    graph = vector_search.CentroidGraph(vector_search.balanced_centroids(v[:4800], 200), s)
    near = [(i, v[j]) for i in range(64) for j in np.argsort(((v - v[4800 + i]) ** 2).sum(1))[1:11]]
    lists = graph.lists_for(v[::100], vector_search.measured_ratio(v[4800:4864], near, graph, s))
    homes, held = graph.homes(v)
    assert held.sum() > 1.2 * len(v)
    read = [(np.isin(homes, one) & held).any(1).mean() for one in lists]
    assert np.mean(read) <= most


def test_graph_finds_the_nearest_centroids():
    rng = np.random.default_rng(5)
    c, x = rng.normal(size=(300, 16)), rng.normal(size=(400, 16))
    at, d = vector_search.CentroidGraph(c, vector_search.Settings()).search(x, 32)
    every = np.sqrt(((x[:, None] - c[None]) ** 2).sum(2))
    assert (np.diff(d) >= -1e-6).all() and np.allclose(d, np.take_along_axis(every, at, 1))
    assert (at[:, 0] == every.argmin(1)).mean() > 0.97 and all(len(set(r)) == 32 for r in at.tolist())


@pytest.mark.parametrize("lists", [1, 5])
def test_block_against_brute_force(lists):
    """With clusters of its own (one list) and with several lists of which a query reads some; repeated ids and equal vectors too."""
    rng, s = np.random.default_rng(7), vector_search.Settings()
    centres = rng.normal(size=(8, 6)) * 5
    x = centres[rng.integers(0, 8, 900)] + rng.normal(size=(900, 6))
    x[:20] = x[20]
    for ids in (np.arange(900), rng.integers(0, 300, 900)):
        at = rng.integers(0, lists, 900)
        q, asking = x[::30], ids[::30]
        reads = [set(rng.choice(lists, rng.integers(1, lists + 1), replace=False).tolist()) for _ in q]
        block = vector_search.Block(ids, x, at, s)
        assert (block.clusters is not None) == (lists == 1)
        got = {}
        for k, (i, found, d) in enumerate(block.nearest(asking, q, reads, 10)):
            own = {}
            for f, g in sorted(zip(found.tolist(), d.tolist()), key=lambda p: p[1]):
                own.setdefault(f, g)
            got[k] = sorted((g, f) for f, g in own.items())[:10]
        for k in range(len(q)):
            every = {}
            for f, v, a in zip(ids.tolist(), x, at.tolist()):
                if a in reads[k] and f != asking[k]:
                    every[f] = min(every.get(f, np.inf), float(np.sqrt(((v - q[k]) ** 2).sum())))
            assert got.get(k, []) == sorted((g, f) for f, g in every.items())[:10]


def test_vectors_of_odd_sizes(spark):
    """Squares beyond the range of doubles, tiny vectors, and other dimensions: all take part."""
    rows = [(0, [1e200, 0.0]), (1, [-1e200, 0.0]), (2, [1e200, 1e200]), (3, [1e-200, 0.0]), (4, [3e-200, 0.0]), (100, [1.0, 2.0, 3.0]), (5, [1.0, 2.0, 5.0])]
    found = vector_search.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id").isin(0, 3, 100)).collect()
    got = {(r["query_id"], r["vec_id"]): r["score"] for r in found}
    assert len(got) == 9 and got[100, 5] == 2.0
    assert got[0, 2] == pytest.approx(1e200) and got[0, 1] == pytest.approx(2e200) and got[3, 4] == pytest.approx(2e-200)
    assert [r["vec_id"] for r in sorted(found, key=lambda r: r["rank"]) if r["query_id"] == 3][0] == 4


def test_vectors_repeated_ids_take_no_places(spark):
    rows = [(0, [1.0, 0.0])] + [(1, [1.0, 0.01])] * 12 + [(i, [1.0, 0.1 * i]) for i in range(2, 6)]
    got = vector_search.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0, 3).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [1, 2, 3]


def test_vectors_odd(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [1.0, None]), (7, [float("inf"), 1.0]), (8, [1.0, 2.0, 3.0]), (9, [1.0, 0.0]), (9, [1.0, 0.0]), (None, [1.0, 1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit("clash"))
    got = vector_search.nearest(frame, F.col("vec_id") == 0).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in got] == [(1, 0.0), (9, 0.0), (2, math.sqrt(2))]
    assert vector_search.nearest(frame.limit(0), F.lit(True)).count() == 0
    assert vector_search.nearest(frame.where("vec_id = 4"), F.lit(True)).count() == 0


def plain_components(rows, n=5, percent=75):
    sets = {}
    for i, text, *_ in rows:
        w = (text or "").encode().lower().split()
        sets.setdefault(i, frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset())
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in sets}


def test_join_odd(spark, odd, empty):
    rows, docs = odd
    wanted = plain_components(rows)
    got = ngram_join.near_duplicates(docs.withColumn("component", F.lit("clash"))).collect()
    assert multiset(got) == Counter((r[0], *wanted[r[0]]) for r in rows)
    assert ngram_join.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("hot", [2, 64])
def test_join_against_all_pairs(spark, hot):
    """Edited copies at all distances around the threshold, a shared passage, a large group of copies; also with almost every signature hot."""
    rng, texts = random.Random(9), []
    passage = words(rng, 60)
    for size in (6, 8, 12, 20, 45, 90, 200):
        base = words(rng, size).split()
        for edits in range(0, max(2, size // 12) + 1):
            for _ in range(4):
                w = list(base)
                for _ in range(edits):
                    w[rng.randrange(len(w))] = "q%d" % rng.randrange(10**6)
                texts.append(" ".join(w[: len(w) - rng.randint(0, 2)]))
    texts += [words(rng, 15) + " " + passage + " " + words(rng, 15) for _ in range(60)]
    group = words(rng, 100).split()
    for _ in range(80):
        w = list(group)
        w[rng.randrange(len(w))] = "r%d" % rng.randrange(10**6)
        texts.append(" ".join(w))
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    wanted = plain_components(rows)
    got = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), hot=hot).collect()
    assert multiset(got) == Counter((i, *wanted[i]) for i, _ in rows)


def test_signatures_of_similar_sets_meet():
    """The scheme's promise: similar sets share a signature, for many sizes."""
    rng = np.random.default_rng(4)
    for _ in range(2500):
        m = int(rng.integers(1, 400))
        s = np.unique(rng.integers(0, 2**63, m).astype(np.uint64))
        gone = int(rng.integers(0, max(1, len(s) // 4) + 1))
        r = np.unique(np.concatenate([s[gone:], rng.integers(0, 2**63, int(rng.integers(0, gone + 2))).astype(np.uint64)]))
        common = len(np.intersect1d(s, r))
        if len(r) and 100 * common >= 75 * (len(s) + len(r) - common):
            a, kinds_a, spare_a = ngram_join.signatures(s)
            b, kinds_b, spare_b = ngram_join.signatures(r)
            both = set(zip(a.tolist(), kinds_a.tolist())) & set(zip(b.tolist(), kinds_b.tolist()))
            assert len(both)
            kinds = Counter(k for _, k in both)
            assert any(kinds[k] >= max(spare_a[k], spare_b[k], 0) + 1 for k in kinds)


def test_subsets_are_signed():
    """Sets that differ in one element of a first-level part share the signature of its two other parts."""
    rng = np.random.default_rng(6)
    s = np.unique(rng.integers(0, 2**63, 300).astype(np.uint64) << np.uint64(1))
    n = ngram_join.first_level(ngram_join.bands(len(s), 75)[1], 75)
    for gone in range(0, len(s), 17):
        r = np.delete(s, gone)
        if ngram_join.bands(len(r), 75) != ngram_join.bands(len(s), 75):
            continue
        a, b = (set(ngram_join.signatures(x)[0].tolist()) for x in (s, r))
        # of each instance, two of the three subsets of one first-level part change
        assert len(a - b) <= 4 and len(a & b) >= 2 * n


def test_packs():
    rng = np.random.default_rng(1)
    for n in (1, 2, 1000):
        values = np.sort(rng.integers(0, 2**50, n))
        ids, counts = rng.integers(-(2**62), 2**62, n), np.where(rng.random(n) < 0.1, rng.integers(2, 90, n), 1)
        got = ngram_join.unpacked(ngram_join.packed(values, ids, counts))
        assert all((x == y).all() for x, y in zip(got, (values, ids, counts)))


@pytest.mark.parametrize("few", [0, 10_000])
def test_smallest_reachable(spark, few):
    rng = random.Random(3)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(230)] + [(1000 + k, 1001 + k) for k in range(40)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    got = dict(ngram_join.smallest_reachable(spark.createDataFrame(edges, "a long, b long"), few).collect())
    assert all(got.get(x, x) == root(x) for x in parent)
    assert ngram_join.smallest_reachable(spark.createDataFrame([], "a long, b long"), few).count() == 0


def test_least_capacity():
    rng = random.Random(7)
    for _ in range(200):
        sizes = [rng.randint(1, 30) for _ in range(rng.randint(1, 9))]
        k = rng.randint(1, 4)

        def best(at, left):
            if left == 1:
                return sum(sizes[at:])
            return min(max(sum(sizes[at:e]), best(e, left - 1)) for e in range(at, len(sizes) + 1))

        assert sharding.least_capacity(sizes, k) == best(0, k)


def test_cuts_are_minimax(spark):
    rng = random.Random(8)
    groups = [(rng.randrange(-(2**63), 2**63), rng.choice([1, 5, 40, 4000])) for _ in range(3000)]
    frame = spark.createDataFrame(groups, "o long, bytes long")
    for shards in (1, 3, 8):
        starts = sharding.cuts(frame, shards)
        load = Counter(sum(o >= s for s in starts) for o, _ in groups for _ in [0])
        load = Counter()
        for o, n in groups:
            load[sum(o >= s for s in starts)] += n
        assert max(load.values()) == sharding.least_capacity([n for _, n in sorted(groups)], shards)


def test_sharding_odd(spark, odd, empty):
    rows, docs = odd
    got = sharding.shard_documents(docs.withColumn("slot", F.lit("clash")), 3).collect()
    texts = {i: t for i, t, *_ in rows}
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in rows)
    for r in got:
        raw = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 1, zlib.crc32(raw))
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    where = defaultdict(set)
    for r in got:
        where[texts[r["doc_id"]]].add(r["shard"])
    assert all(len(s) == 1 for s in where.values())
    assert sharding.shard_documents(empty).count() == 0


LICENSE_CASES = [
    ("Released under the MIT License.", ["MIT"]),
    ("Licensed under the Apache License, Version 2.0.", ["Apache-2.0"]),
    ("Licensed under CC BY-NC 4.0.", ["CC-BY-NC"]),
    ("This work is licensed under the GNU General Public License, version 3.", ["GPL"]),
    ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License version 2.1.", ["LGPL"]),
    ("Licensed under the GNU Affero General Public License v3.", ["AGPL"]),
    ("Dual licensed under the MIT license and the Apache License 2.0.", ["Apache-2.0", "MIT"]),
    ("SPDX-License-Identifier: Apache-2.0", ["Apache-2.0"]),
    ("# SPDX-License-Identifier: GPL-2.0-only", ["GPL"]),
    ("SPDX-License-Identifier: LGPL-2.1-or-later", ["LGPL"]),
    ("SPDX-License-Identifier: MIT", ["MIT"]),
    ("This file is subject to the Common Development and Distribution License.", ["CDDL-1.0"]),
    ("Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met:", ["BSD"]),
    ("This work is licensed under CC BY-SA 4.0.", ["CC-BY-SA"]),
    ("Released under the ISC license.", ["ISC"]),
    ("This is free and unencumbered software released into the public domain.", ["Unlicense"]),
    ("The general rule was free of charge.", []),
    ("She lost her license in the spring.", []),
    ("Licensed under the zlib License.", []),
    ("Microsoft Reciprocal License", []),
    ("GNU Free Documentation License", []),
    ("Ruby License", []),
]


def test_licenses(spark, odd, empty):
    rows = [(k, f"First line of words.\n{said}\n\nlast") for k, (said, _) in enumerate(LICENSE_CASES)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = license_scan.fit(docs)
    got = {r["doc_id"]: r["licenses"] for r in license_scan.scan(docs, model).collect()}
    for k, (said, families) in enumerate(LICENSE_CASES):
        assert [(x["paragraph"], x["family"], x["confirmed"]) for x in got[k]] == [(1, f, True) for f in families], said
    odd_rows, odd_docs = odd
    assert license_scan.scan(odd_docs, model).where(F.size("licenses") > 0).count() == 0
    assert license_scan.scan(empty, license_scan.fit(empty)).count() == 0


def test_single_words_confirm_no_license(spark):
    docs = spark.createDataFrame([(1, "He studied at MIT and published widely."), (2, "The Apache tribe lived in the west."), (3, "The Eclipse of the sun.")], "doc_id long, text string")
    for r in license_scan.scan(docs, license_scan.fit(docs)).collect():
        assert not any(x["confirmed"] for x in r["licenses"])


def test_license_figures_on_held_out_rows(spark):
    """A form of notice, whole other licences and corpus lines that the first fit has not seen."""
    held = license_scan.fit(spark.read.parquet(f"{SF}/documents.parquet")).held
    assert held["rows"] > 500 and held["notices with exactly their families"] > 0.85 and held["rows of no family left unknown"] > 0.8 and held["calibration error"] < 0.06
    seen = {v.lower() for text, _, _ in license_scan.training_rows() for v in license_scan.variants(text)}
    assert not seen & {said.lower() for said, _ in LICENSE_CASES[:4]}


def plain_paragraphs(text):
    out, now = [], ""
    for line in (text or "").split("\n"):
        wrapped = now and re.search(r"[^\s.!?:;]\s*$", now) and line.strip()
        if wrapped:
            now = now.rstrip() + " " + line.lstrip(" \t")
        else:
            out.append(now)
            now = line
    return [p for p in [*out, now] if p.strip()]


def test_license_cues_lose_nothing(spark):
    """Scores by plain Python of every paragraph: none that reaches the least probability lacks a cue."""
    wrapped = spark.createDataFrame([(10_000 + k, "Some words\n" + said.replace(" the ", " the\n") + "\nmore words") for k, (said, _) in enumerate(LICENSE_CASES)], "doc_id long, text string")
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(wrapped)
    model = license_scan.fit(docs)
    found = {(r["doc_id"], x["paragraph"], x["family"]): x["probability"] for r in license_scan.scan(docs, model).collect() for x in r["licenses"]}
    wanted = {}
    for r in docs.collect():
        for k, paragraph in enumerate(plain_paragraphs(r["text"])):
            z = np.array(model.bias) + sum((np.array(model.weights[g]) for g in license_scan.grams(paragraph) if g in model.weights), np.zeros(len(model.bias)))
            for c, p in zip(model.classes, 1 / (1 + np.exp(-z / model.temperature))):
                if round(float(p), 6) >= model.least:
                    wanted[r["doc_id"], k, c] = round(float(p), 6)
    assert found.keys() == wanted.keys() and len(found) > 15 and all(abs(found[k] - wanted[k]) < 1e-5 for k in wanted)


def test_targets():
    assert mixture.targets([100, 100, 100], [5, 2, 1]) == pytest.approx([200, 500 / 3, 250 / 3])
    assert mixture.targets([10, 0, 1000], [5, 2, 1]) == pytest.approx([20, 0, 1495])


@pytest.mark.parametrize("size", [1, 2, 5, 64, 1000])
def test_permutation(size):
    assert sorted(mixture.permuted(np.arange(size), size, 12345).tolist()) == list(range(size))


def test_mixing(spark, odd, empty):
    rows, docs = odd
    got = mixture.mix(docs).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in rows)
    size = {i: len((t or "").encode().split()) for i, t, *_ in rows}
    source = {i: s for i, _, _, s, _ in rows}
    assert all(r["size"] == size[r["doc_id"]] and r["taken"] <= 2 * r["size"] for r in got)
    for s in {"a", "b", None, "z"}:
        own = [r for r in got if source[r["doc_id"]] == s]
        total = sum(r["size"] for r in own)
        assert {r["source_size"] for r in own} == {total}
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= max(130, 0.02 * total)
    assert multiset(mixture.mix(docs.repartition(3)).collect()) == multiset(got)
    assert mixture.mix(empty).count() == 0


def test_mixed_documents_hold_the_words_taken(spark, odd):
    rows, docs = odd
    taken = Counter()
    for r in mixture.mix(docs).collect():
        taken[r["doc_id"]] += r["taken"]
    out = mixture.mixed_documents(docs)
    assert out.columns == docs.columns
    found, texts = Counter(), {i: t for i, t, *_ in rows}
    for r in out.collect():
        found[r["doc_id"]] += len(r["text"].encode().split())
        assert all(part in texts[r["doc_id"]] for part in r["text"].split("\n") if "\n" not in texts[r["doc_id"]])
    assert +found == +taken


def test_media(spark, odd, empty):
    rows, docs = odd
    got = media.media_columns(docs.withColumn("digest", F.lit("clash"))).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in rows)
    texts = {i: t for i, t, *_ in rows}
    for r in got:
        raw = (texts[r["doc_id"]] or "").encode()
        payload = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert r["tail_crc32"] == zlib.crc32(payload[-32:]) and r["height"] * r["width"] == len(payload)
        assert r["feature"] == media.feature_of(np.frombuffer(payload, np.uint8))
    assert media.media_columns(empty).count() == 0


def archives(folder):
    return sorted(Path(folder.removeprefix("file://")).glob("*.tar"))


def test_archives_are_tar(spark, tmp_path):
    folder = f"file://{tmp_path}/media"
    payloads = spark.createDataFrame([(f"{k:064x}", bytes([k % 256]) * 576) for k in range(50)], "digest string, payload binary")
    members = {(r["shard"], r["digest"]): r for r in media.pack(payloads, folder).collect()}
    seen = 0
    for shard in archives(folder):
        with tarfile.open(shard) as tar:
            for m in tar.getmembers():
                image = tar.extractfile(m).read()
                at = members[shard.stem, m.name.removesuffix(".png")]
                assert (m.offset_data, m.size) == (at["offset"], at["length"])
                assert media.from_png(image).tobytes() == bytes([int(at["digest"], 16) % 256]) * 576
                seen += 1
    assert seen == len(members) == 50 and all(hashlib.sha256(a.read_bytes()).hexdigest() == a.stem for a in archives(folder))


def test_headers_are_read_by_ranges(spark, tmp_path):
    """33 bytes of each member, however large the members are."""
    folder = f"file://{tmp_path}/media"
    rng = random.Random(2)
    payloads = spark.createDataFrame([(f"{k:064x}", rng.randbytes(576 * 200)) for k in range(30)], "digest string, payload binary")
    members = media.pack(payloads, folder).collect()
    ranges = media.Ranges(folder)
    for m in members:
        assert media.header_of(ranges.read(m["shard"], m["offset"], media.HEADER)) == (576, 200, 8)
    assert ranges.bytes == 33 * len(members) and sum(a.stat().st_size for a in archives(folder)) > 100_000 * len(members)
    found = media.header_columns(spark.createDataFrame(members), folder).collect()
    assert {(r["width"], r["height"], r["bits"]) for r in found} == {(576, 200, 8)}


def test_each_payload_is_stored_once(spark, tmp_path):
    """Also with equal rows, null ids and a group of copies that is most of the table."""
    folder = f"file://{tmp_path}/media"
    rows = [(1, "equal rows")] * 20 + [(k, "a copy") for k in range(300)] + [(None, "no id")] * 5 + [(None, "a copy"), (7, None), (8, ""), (9, None)] + [(k, f"text {k}") for k in range(400)]
    got = media.media_columns(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), folder=folder).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in rows)
    names = []
    for a in archives(folder):
        with tarfile.open(a) as tar:
            names += tar.getnames()
    assert len(names) == len(set(names)) == len({t or "" for _, t in rows}) == len({(r["shard"], r["offset"]) for r in got})


def plain_glob(glob):
    out, k = "", 0
    while k < len(glob):
        if glob[k] == "*":
            n = len(glob[k:]) - len(glob[k:].lstrip("*"))
            out, k = out + (".*" if n > 1 else "[^/]*"), k + n
        elif glob[k] == "\\" and k + 1 < len(glob):
            out, k = out + re.escape(glob[k + 1]), k + 2
        else:
            out, k = out + ("." if glob[k] == "?" else re.escape(glob[k])), k + 1
    return re.compile(out, re.S)


def test_automaton_against_patterns():
    rng = random.Random(6)
    globs = ["".join(rng.choice(["a", "b", "/", ".", "?", "*", "**", "\\*", "\\?", "\\\\"]) for _ in range(rng.randint(0, 9))) for _ in range(60)]
    texts = ["", "a" * 3000, "é/a", "*", "?"] + ["".join(rng.choice("ab/.*?") for _ in range(rng.randint(0, 12))) for _ in range(400)]
    got = url_filter.Automaton(globs).run(texts)
    for i, t in enumerate(texts):
        for j, g in enumerate(globs):
            assert bool(got[i, j]) == bool(plain_glob(g).fullmatch(t)), (g, t)


def test_canonical_urls():
    wanted = {
        ("user:pw@Example.com:8080", "/a"): ".example.com/a",
        ("example.com.:443", ""): ".example.com",
        ("ex%61mple.com..", "/%7euser/%2e%2E/x%2f%3F"): ".example.com/x%2F%3F",
        ("h.org", "/a/./b/../c/."): ".h.org/a/c/",
        ("h.org", "/../../a/.."): ".h.org/",
        ("h.org", "//a//../b"): ".h.org//a/b",
        ("h.org", "/%%34%31%zz"): ".h.org/%41%zz",
        ("", ""): ".",
    }
    for (host, path), url in wanted.items():
        assert url_filter.canonical(host, path) == url


def test_url_sql_on_odd_urls(spark, tmp_path):
    """The query and its SQL over URLs with users, ports, percent forms and dot segments."""
    rng = random.Random(2)
    hosts = ["h.org", "u@h.org", "H.org.", "h.org:80", "example.com", "u:p@x.net", "a%2Eorg", "%61.org", ""]
    parts = ["login", "%6cogin", "x", ".", "..", "%2e%2E", "", "cart", "a.zip", "a%2Ezip", "es", "search", "%3f"]
    urls = [f"http://{rng.choice(hosts)}" + "".join("/" + rng.choice(parts) for _ in range(rng.randint(0, 5))) + rng.choice(["", "?q=/login", "#x"]) for _ in range(1500)] + [None, "", "no"]
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = [tuple(r) for r in queries.op10_url_filter(spark, str(tmp_path)).collect()]
    con = duckdb.connect()
    con.sql(f"create view pages as select * from read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    assert sorted(got, key=lambda r: r[0]) == sorted(con.sql(queries.ORACLE_SQL["op10_url_filter"]).fetchall())
    assert {r[4] for r in got} == {"allow", "block"}


def test_urls(spark):
    urls = [None, "", "no scheme", "HTTP://WWW.Example.COM/en/1?x#y", "http://example.com", "http://a.example.com/en/2", "http://x.net/es/3", "http://x.net/fr", "http://notexample.com/en/", "ftp://h.org/login/x", "x://y://z/p", "http://x.org/" + "a" * 9000 + "/wp-admin/"]
    frame = spark.createDataFrame(list(enumerate(urls)) + [(5, urls[5])], "page_id long, url string")
    rules = [url_filter.host_rule(v, n) for v, n in queries.URL_RULES]
    got = {r["page_id"]: tuple(r)[2:] for r in url_filter.judge(frame, rules).collect()}
    assert got[0] == got[1] == got[2] == ("", "", None, "allow")
    assert got[3] == ("www.example.com", "/en/1", "www.example.com/en/", "allow")
    assert got[4] == ("example.com", "", None, "allow")
    assert got[5][2:] == ("example.com/en/", "block") and got[6][2:] == ("net/es/", "block") and got[7][2:] == (None, "allow")
    assert got[8][2:] == ("com/", "allow") and got[9][3] == "block" and got[10][:2] == ("y:", "//z/p") and got[11][3] == "block"
    assert url_filter.judge(frame.limit(0), rules).count() == 0
    with pytest.raises(ValueError):
        url_filter.judge(frame.withColumn("rule", F.lit(1)), rules)


def test_pipeline_with_clashing_names(spark, odd):
    import corpus_pipeline

    rows, docs = odd
    names = ["_lang_pred", "_score", "spans", "_spans", "_h", "h", "row_h", "parts", "words", "scanned", "t", "_t"]
    docs = docs.where("text is not null").withColumns({c: F.lit(k) for k, c in enumerate(names)})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        kept = docs.collect()
        assert kept and all(r[c] == k for r in kept for k, c in enumerate(names))


def test_mix_of_rows_without_ids_agrees(spark):
    """Rows that repeat id, text and source and differ elsewhere, and rows without an id: the same mix in any order of the input."""
    rng = random.Random(4)
    rows = [(1, "one two three four", "en", "a", k) for k in range(40)] + [(None, words(rng, 30), "en", "b", k) for k in range(60)]
    docs = spark.createDataFrame(rows, SCHEMA)
    first = multiset(mixture.mixed_documents(docs, chars_col="").collect())
    assert first == multiset(mixture.mixed_documents(docs.orderBy(F.desc("n_chars")).repartition(5), chars_col="").collect())
    assert multiset(mixture.mix(docs).collect()) == multiset(mixture.mix(docs.repartition(7)).collect())


def test_pipeline_stages_against_plain_versions(spark, sp):
    import corpus_pipeline

    rng = random.Random(12)
    base = words(rng, 150)
    secret = 'api_key = "abcdef123456"'
    texts = [base, base, base.replace(base.split()[5], "w", 1), words(rng, 80) + " " + secret, "123 456", None, words(rng, 200), words(rng, 500)]
    rows = [(k, t, "en", f"s{k % 2}", len(t or "")) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, SCHEMA)
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["language ID"](spark, docs, "")
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [0, 1, 2, 3, 6, 7]
    single = stages["n-gram Jaccard join"](spark, kept, "")
    assert single.columns == docs.columns and sorted(r["doc_id"] for r in single.collect()) == [0, 3, 6, 7]
    clean = stages["secret scans"](spark, single, "")
    assert clean.columns == docs.columns
    text = {r["doc_id"]: r for r in clean.collect()}
    assert "abcdef123456" not in text[3]["text"] and text[3]["n_chars"] == len(text[3]["text"]) and text[0]["text"] == base
    mixed = stages["mixing sources to target weights"](spark, clean, "")
    assert mixed.columns == docs.columns
    taken = Counter()
    for r in mixture.mix(clean).collect():
        taken[r["doc_id"]] += r["taken"]
    found = Counter()
    for r in mixed.collect():
        found[r["doc_id"]] += len(r["text"].encode().split())
    assert +found == +taken
    ids = stages["SentencePiece encoding"](spark, mixed, "")
    wanted = Counter((r["doc_id"], len(sp.encode(r["text"], add_eos=True))) for r in mixed.collect())
    assert Counter((r["doc_id"], r["n_tokens"]) for r in ids.collect()) == wanted


def plain_mix(placed, mix, seed=11):
    """Taken words, first shard and slot, and last shard of each row: every shard fills its slots source by source, each slot takes the permutation's next block."""
    of_source = defaultdict(list)
    for r in placed:
        of_source[r["s"]].append(r)
    filled, out = Counter(), {tuple(r["key"]): [0, None, None] for r in placed}
    for shard, drawn in enumerate(mix.draws.tolist()):
        slot = 0
        for s, n in enumerate(drawn):
            for _ in range(n):
                turn, place = divmod(filled[s], int(mix.blocks[s]))
                block = int(mixture.permuted(np.array([place]), int(mix.blocks[s]), seed + 1_000_003 * s + 7919 * turn)[0])
                for r in of_source[s]:
                    words = min(r["start"] + r["size"], (block + 1) * mixture.BLOCK) - max(r["start"], block * mixture.BLOCK)
                    if words > 0:
                        own = out[tuple(r["key"])]
                        own[0] += words
                        own[1], own[2] = own[1] or (shard, slot), max(own[2] or 0, shard)
                filled[s] += 1
                slot += 1
    return Counter((r["doc_id"], out[tuple(r["key"])][0], *(out[tuple(r["key"])][1] or (None, None)), out[tuple(r["key"])][2]) for r in placed)


def test_mixing_against_plain_draws_and_permutations(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    placed, _ = mixture.mix_pieces(docs, id_col="doc_id", text_col="text", source_col="source", weights=(5, 2, 1))
    placed = placed.collect()
    sizes = {}
    for s, own in {s: sorted((r for r in placed if r["s"] == s and r["size"]), key=lambda r: r["start"]) for s in {r["s"] for r in placed}}.items():
        at = 0
        for r in own:  # the rows of a source lie one after the other, with all their words
            assert r["start"] == at and r["size"] == len(re.findall(mixture.WORD, docs.where(F.col("doc_id") == r["doc_id"]).first()["text"] or "")) if s == 0 else r["start"] == at
            at += r["size"]
        sizes[next(r["source"] for r in placed if r["s"] == s)] = at
    mix = mixture.decide(sizes, (5, 2, 1))
    got = Counter((r["doc_id"], r["taken"], r["first_shard"], r["first_slot"], r["last_shard"]) for r in mixture.mix(docs).collect())
    assert got == plain_mix(placed, mix)
    per_source = Counter()
    for r in mixture.mix(docs).collect():
        per_source[r["target"], r["source_size"]] += r["taken"]
    assert all(abs(n - target) < 0.06 * target for (target, _), n in per_source.items())


def test_draws_decide_the_mix(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    taken = {r["doc_id"]: r["taken"] for r in mixture.mix(docs).collect()}
    draw = mixture.draw
    monkeypatch.setattr(mixture, "draw", lambda quota, most, shards, seed: draw(quota, most, shards, seed + 1))
    other = {r["doc_id"]: r["taken"] for r in mixture.mix(docs).collect()}
    assert taken != other and abs(sum(taken.values()) - sum(other.values())) < 0.02 * sum(taken.values())


def test_draws_stay_within_bounds():
    for quota, most in (([10, 0, 300], [10, 4, 400]), ([3, 1, 2], [2, 2, 9]), ([1000] * 20, [1300] * 20), ([0, 0], [0, 0])):
        out = mixture.draw(np.array(quota), np.array(most), max(1, sum(quota) // 64), 3)
        assert (out.sum(0) <= most).all() and out.sum() == sum(quota) and np.ptp(out.sum(1)) <= 1
    drawn = mixture.draw(np.array([5000, 2000, 1000, 90]), np.array([9000] * 4), 63, 3).sum(0)
    assert (np.abs(drawn - [5000, 2000, 1000, 90]) < 30).all()


def test_near_duplicates_of_repeated_ids(spark):
    """Different texts under one id are judged one by one; the same row twice is one row."""
    import corpus_pipeline

    rng = random.Random(14)
    v, w, x = words(rng, 60), words(rng, 60), words(rng, 60)
    rows = [(1, w, "en", "a", 5), (1, w, "en", "a", 5), (1, v, "en", "b", 5), (2, v + " more", "en", "a", 5), (3, x, "en", "a", 1), (3, None, "en", "a", 1), (None, w, "en", "a", 5), (4, x, "fr", "a", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = corpus_pipeline.near_duplicates(spark, docs, "")
    assert got.columns == docs.columns
    kept = Counter((r["doc_id"], r["text"]) for r in got.collect())
    assert kept - Counter([(2, v + " more"), (1, v)]) == Counter([(1, w), (3, x), (3, None), (None, w)]) and sum(kept.values()) == 5
    assert multiset(corpus_pipeline.near_duplicates(spark, docs.repartition(5), "").collect()) == multiset(got.collect())


def test_names_clash_in_any_case(spark):
    docs = spark.createDataFrame([(1, "x", "y", "z", "w")], "doc_id long, text string, Spans string, LICENSES string, Lang_Pred string")
    for add in (lambda: secret_scan.scan(docs), lambda: license_scan.scan(docs, license_scan.fit(docs)), lambda: language_id.predict(docs, None), lambda: url_filter.judge(docs.withColumnsRenamed({"text": "url", "Spans": "Host"}), [])):
        with pytest.raises(ValueError, match="exist already"):
            add()
