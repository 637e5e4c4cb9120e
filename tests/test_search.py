"""The blocked index, filtered hybrid search and the whole retrieval chain against plain versions."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tidemark.operators import lexical, retrieval


def tokens(text):
    return re.findall("[a-z0-9]+", (text or "").lower())


def plain_bm25(chunks, queries, k, allowed=lambda q, c: True):
    """Score every chunk for every query; ``chunks`` are dicts with id and text, ``queries`` with id and query."""
    split = {c["id"]: Counter(tokens(c["text"])) for c in chunks}
    length = {i: sum(w.values()) for i, w in split.items()}
    told = [length[c["id"]] for c in chunks if c["text"] is not None]
    mean = sum(told) / len(told) if told else 1.0
    df = Counter(t for w in split.values() for t in w)
    out = {}
    for q in queries:
        scores = []
        for c in chunks:
            if not allowed(q, c):
                continue
            s = 0.0
            for t in sorted(set(tokens(q["query"]))):
                if n := split[c["id"]][t]:
                    s += math.log(1 + (len(chunks) - df[t] + 0.5) / (df[t] + 0.5)) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * length[c["id"]] / mean))
            if round(s, 6) > 0:
                scores.append((-round(s, 6), c["id"]))
        out[q["id"]] = [(i, -s) for s, i in sorted(scores)[:k]]
    return out


def made(seed=1, n=700):
    rng = random.Random(seed)
    word = lambda: "w%d" % min(int(rng.paretovariate(0.6)), 3000)
    chunks = [{"id": i, "text": None if i % 97 == 5 else "" if i % 89 == 7 else " ".join(word() for _ in range(rng.randint(1, 60))), "form": ("10-Q", "10-K", None)[i % 3 if i % 50 else 2], "ticker": "T%d" % (i % 7), "label": "L%d" % (i % 5)} for i in range(n)]
    queries = [{"id": 1000 + i, "query": " ".join(word() for _ in range(rng.randint(0, 8))), "q_form": rng.choice([None, "10-Q", "10-K", "none"]), "q_ticker": rng.choice([None, "T1", "T2"]), "q_label": rng.choice([None, None, "L3"])} for i in range(60)]
    return chunks, queries


CLAUSES = {"form": "q_form", "ticker": "q_ticker", "label": "q_label"}


def fits(q, c):
    return all(q[name] is None or q[name] == c[key] for key, name in CLAUSES.items())


def frames(spark, chunks, queries):
    c = spark.createDataFrame([(x["id"], x["text"], x["form"], x["ticker"], x["label"]) for x in chunks], "chunk_id long, content string, form string, ticker string, label string")
    q = spark.createDataFrame([(x["id"], x["query"], x["q_form"], x["q_ticker"], x["q_label"]) for x in queries], "query_id long, query string, q_form string, q_ticker string, q_label string")
    return c, q


def listed(rows):
    out = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        out[r["query_id"]].append((r["id"], round(r["score"], 6)))
    return dict(out)


@pytest.mark.parametrize("blocks", [(16, 500_000), (4096, 40), (4096, 500_000)])
def test_index_search_against_all_scores(spark, monkeypatch, blocks):
    """Small blocks, so that pruning decides, and one large one; nulls, empty texts and queries without terms."""
    monkeypatch.setattr(lexical, "BLOCK_CHUNKS", blocks[0])
    monkeypatch.setattr(lexical, "BLOCK_POSTINGS", blocks[1])
    chunks, queries = made()
    c, q = frames(spark, chunks, queries)
    index = lexical.index_texts(c)
    wanted = {i: found for i, found in plain_bm25(chunks, queries, 10).items() if found}
    assert listed(lexical.search(index, q, 10).collect()) == wanted
    assert listed(lexical.search(index, q, 10, block_queries=7).collect()) == wanted
    assert lexical.search(index, q.where("query = ''"), 10).count() == 0


def test_filtered_search_against_all_scores(spark, monkeypatch):
    """Each query with its own clauses; frequencies stay those of the whole index."""
    monkeypatch.setattr(lexical, "BLOCK_CHUNKS", 8)
    chunks, queries = made(2)
    c, q = frames(spark, chunks, queries)
    index = lexical.index_texts(c, keys=tuple(CLAUSES))
    wanted = {i: found for i, found in plain_bm25(chunks, queries, 6, fits).items() if found}
    assert listed(lexical.search(index, q, 6, clauses=CLAUSES).collect()) == wanted
    some = q.where("q_ticker = 'T1'")
    asked = {r["query_id"] for r in some.collect()}
    assert listed(lexical.search(index, some, 6, clauses=CLAUSES).collect()) == {i: f for i, f in wanted.items() if i in asked}
    nothing = lexical.index_texts(c.limit(0))
    assert lexical.search(nothing, q, 5).count() == 0


def test_rare_terms_read_few_postings(spark, tmp_path, monkeypatch):
    """Row groups whose range of terms holds a rare term, and blocks that it is in, are a small part of the index."""
    monkeypatch.setattr(lexical, "GROUP_BYTES", 1 << 16)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    index = lexical.index_texts(docs, id_col="doc_id", text_col="text", path=f"{tmp_path}/index")
    df = {r["term"]: r["n"] for r in index.table.where("term <> ''").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    rare = sorted(t for t, n in df.items() if n == 1)[::4000][:2]
    read = total = 0
    for file in sorted(tmp_path.glob("index/*.parquet")):
        meta = pq.ParquetFile(file).metadata
        for g in range(meta.num_row_groups):
            term = next(meta.row_group(g).column(c) for c in range(meta.num_columns) if meta.row_group(g).column(c).path_in_schema == "term").statistics
            total += meta.row_group(g).num_rows
            read += meta.row_group(g).num_rows * any(term.min <= t <= term.max for t in rare)
    assert total > 20_000 and read < 0.1 * total
    plan = lexical._with_terms(index.table, rare)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and f"In(term, [{rare[0]}" in plan
    found = lexical.search(index, spark.createDataFrame([(i, t) for i, t in enumerate(rare)], "query_id long, query string"), 10).collect()
    assert len(found) == len(rare)


def test_selective_filters_reach_the_files(spark, tmp_path):
    chunks, _ = made(3)
    c, _ = frames(spark, chunks, [])
    table = lexical.index_texts(c, keys=("ticker",), path=f"{tmp_path}/index").table
    plan = lexical._with_keys(table, {"ticker": {"T1"}})._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(ticker,T1)" in plan.replace(" ", "")


def vector_of(i):
    rng = np.random.default_rng(i)
    return [float(x) for x in rng.normal(size=6)]


def cosine(a, b):
    a, b = np.array(a), np.array(b)
    return float(np.round(a @ b / (np.linalg.norm(a) * np.linalg.norm(b)), 9))


def plain_near(chunks, queries, k, allowed):
    return {q["id"]: [i for _, i in sorted((-cosine(c["v"], q["v"]), c["id"]) for c in chunks if allowed(q, c))[:k]] for q in queries}


def plain_hybrid(chunks, queries, k, pool, allowed):
    lex, near = plain_bm25(chunks, queries, pool, allowed), plain_near(chunks, queries, pool, allowed)
    out = {}
    for q in queries:
        score = defaultdict(float)
        for ids in ([i for i, _ in lex[q["id"]]], near[q["id"]]):
            for rank, i in enumerate(ids, 1):
                score[i] += 1 / (60 + rank)
        out[q["id"]] = [i for _, i in sorted((-round(s, 9), i) for i, s in score.items())[:k]]
    return out


@pytest.mark.parametrize("rows", [50, 32_768])
def test_filtered_vectors_against_all_pairs(spark, rows):
    chunks, queries = made(4, 300)
    c, q = frames(spark, chunks, queries)
    for x in [*chunks, *queries]:
        x["v"] = vector_of(x["id"])
    vecs = c.join(spark.createDataFrame([(x["id"], x["v"]) for x in chunks], "chunk_id long, embedding array<double>"), "chunk_id")
    asked = q.join(spark.createDataFrame([(x["id"], x["v"]) for x in queries], "query_id long, vector array<double>"), "query_id")
    got = retrieval.vector_top_k(vecs, asked, 5, id_col="chunk_id", clauses=CLAUSES, block_rows=rows, block_queries=20).collect()
    wanted = {i: ids for i, ids in plain_near(chunks, queries, 5, fits).items() if ids}
    assert {i: [x for x, _ in found] for i, found in listed(got).items()} == wanted
    fused = retrieval.hybrid_search(vecs, asked, 8, 20, clauses=CLAUSES).collect()
    assert {i: [x for x, _ in found] for i, found in listed(fused).items()} == {i: ids for i, ids in plain_hybrid(chunks, queries, 8, 20, fits).items() if ids}


def plain_chain(chunks, queries):
    """Retrieval for one query after the other."""
    by = {c["id"]: c for c in chunks}
    every = plain_hybrid(chunks, queries, 12, 50, lambda q, c: q["q_ticker"] is None or q["q_ticker"] == c["ticker"])
    said = plain_hybrid(chunks, queries, 12, 50, lambda q, c: c["kind"] == "transcript" and (q["q_ticker"] is None or q["q_ticker"] == c["ticker"]))
    out = {}
    for q in queries:
        pool = every[q["id"]] + [i for i in said[q["id"]] if i not in every[q["id"]]]
        chosen: list[int] = []
        while len(chosen) < min(10, len(pool)):
            value = {i: round(0.5 * cosine(by[i]["v"], q["v"]) - 0.5 * max((cosine(by[i]["v"], by[j]["v"]) for j in chosen), default=0), 7) for i in pool if i not in chosen}
            chosen.append(max(value, key=lambda i: (value[i], -pool.index(i))))
        words = set(tokens(q["query"]))
        joint = {i: round(len(words & set(tokens(by[i]["text"]))) / len(words) if words else 0.0, 6) for i in chosen}
        ranked = sorted(chosen, key=lambda i: (-joint[i], chosen.index(i)))
        topic = {w for w in words if w not in retrieval.text.STOPWORDS}

        def dull(c):
            early = c["kind"] == "transcript" and c["at"] <= 3 and q["query"] and (len(topic & set(tokens(c["text"]))) / len(topic) if topic else 1) < 0.25
            return early or c["at"] == 0 and c["kind"] == "transcript" and c["text"].strip().lower().startswith("operator:")

        last = sorted(ranked, key=lambda i: (-(joint[i] - (10 if dull(by[i]) else 0)), ranked.index(i)))[:5]
        families = defaultdict(list)
        for c in chunks:
            families[c["parent"]].append(c)
        full = {p: "".join(c["text"] for c in sorted(own, key=lambda c: c["at"])) for p, own in families.items()}
        out[q["id"]] = [(i, n, full[by[i]["parent"]]) for n, i in enumerate(last, 1)]
    return {i: rows for i, rows in out.items() if rows}


def test_the_whole_chain_against_a_plain_one(spark):
    rng = random.Random(5)
    word = lambda: "w%d" % min(int(rng.paretovariate(0.7)), 400)
    chunks = [{"id": f"c{i:03d}", "text": ("Operator: " if i % 11 == 0 else "") + " ".join(word() for _ in range(rng.randint(2, 30))), "kind": ("transcript", "filing")[i % 2], "ticker": f"T{i % 3}", "at": i // 2 % 6, "parent": f"p{i % 2}-{i // 12}", "v": vector_of(i)} for i in range(240)]
    queries = [{"id": 7000 + i, "query": " ".join(word() for _ in range(5)), "q_ticker": (None, "T1")[i % 2], "v": vector_of(900 + i)} for i in range(14)]
    c = spark.createDataFrame([(x["id"], x["text"], x["v"], x["kind"], "mda", "a", x["at"], x["parent"], x["ticker"]) for x in chunks], "chunk_id string, content string, embedding array<double>, doc_type string, section string, accession string, chunk_index int, parent_id string, ticker string")
    q = spark.createDataFrame([(x["id"], x["query"], x["v"], x["q_ticker"]) for x in queries], "query_id long, query string, vector array<double>, q_ticker string")
    got = defaultdict(list)
    for r in sorted(retrieval.retrieve(c, q, clauses={"ticker": "q_ticker"}).collect(), key=lambda r: (r["query_id"], r["capped_rank"])):
        got[r["query_id"]].append((r["chunk_id"], r["capped_rank"], r["parent_content"]))
    assert dict(got) == plain_chain(chunks, queries)


def test_prior_quarters_against_a_plain_search(spark):
    """Each run's labels by arithmetic, by place where they cannot be read; its company's chunks of that label only; the budget skips what does not fit."""
    from tidemark.operators import comparison

    rng = random.Random(11)
    word = lambda: "w%d" % min(int(rng.paretovariate(0.7)), 300)
    chunks = [{"id": f"c{i:03d}", "text": " ".join(word() for _ in range(rng.choice([0, 5, 60, 400]))), "ticker": f"T{i % 3}", "label": f"FY{2022 + i % 8 // 4}-Q{i % 4 + 1}", "v": vector_of(i)} for i in range(200)]
    runs = [{"id": f"r{i}", "company": ("T0", "T1", "T9", None)[i % 4], "label": ("FY2023-Q4", "Q2_FY2023", "nonsense")[i % 3], "query": " ".join(word() for _ in range(4)), "v": vector_of(500 + i), "labels": [["FY2023-Q1", "FY2022-Q4"], ["soon", "FY2022-Q3"], [], ["FY2024-Q1"]][i % 4]} for i in range(24)]
    quarter = lambda s: (int(re.search(r"FY(\d{4})", s)[1]) * 4 + int(re.search(r"Q(\d)", s)[1]) - 1) if re.fullmatch(r"FY\d{4}-Q[1-4]|Q[1-4]_FY\d{4}", s) else None
    wanted = {}
    for r in runs:
        for n, label in enumerate(r["labels"], 1):
            if quarter(r["label"]) is None or r["company"] is None:
                continue
            gap = quarter(r["label"]) - quarter(label) if quarter(label) is not None else 0
            at = quarter(r["label"]) - (gap if gap >= 1 else n)
            target = f"FY{at // 4}-Q{at % 4 + 1}"
            found = plain_hybrid(chunks, [r | {"id": 0}], 5, 50, lambda q, c: c["ticker"] == r["company"] and c["label"] == target)[0]
            parts, used = [], 0
            for t in (next(c["text"] for c in chunks if c["id"] == i) for i in found):
                if t and used + len(t) <= 2000:
                    parts, used = [*parts, t], used + len(t)
            if parts:
                wanted[r["id"], label] = (target, "\n\n".join(parts))
    c = spark.createDataFrame([(x["id"], x["text"], x["v"], x["ticker"], x["label"]) for x in chunks], "chunk_id string, content string, embedding array<double>, ticker string, fiscal_label string")
    q = spark.createDataFrame([(x["id"], x["company"], x["label"], x["query"], x["v"], x["labels"]) for x in runs], "run_id string, company string, fiscal_label string, query string, vector array<double>, comparison array<string>")
    got = {(r["run_id"], r["label"]): (r["target"], r["context"]) for r in comparison.prior_quarter_contexts(q, c).collect()}
    assert got == wanted and len(wanted) > 8


def test_terms_by_bytes_and_index_rows(spark):
    """F9, F16: a block's rows, built without a loop over terms, are those of a plain count; texts are cut as the pattern says."""
    texts = ["ab 1c-ab", None, "", "é", "x", "xé y\x00z", "ab", "ünï 9"]
    for part in (pa.array(texts), pa.array(["q", *texts, "q"]).slice(1, len(texts)), pa.array(texts, pa.large_string()), pa.array(["", None])):
        terms, counts = lexical._split(part)
        plain = [re.findall(lexical.TERM, t or "") for t in part.to_pylist()]
        assert terms.to_pylist() == [w for p in plain for w in p] and counts.tolist() == [len(p) for p in plain]
    ids = pa.array([7, 3, None, 5, 1, 2, 9, 8], pa.int64())
    rows = lexical._block(4, ("k",), ["key"], ids, pa.array(texts)).to_pylist()
    of = dict(zip(ids.to_pylist(), texts))
    order = sorted(of, key=lambda i: (i is None, i))
    counted = {i: Counter(re.findall(lexical.TERM, of[i] or "")) for i in order}
    assert (rows[0]["term"], rows[0]["ids"], rows[0]["n"], rows[0]["most"], rows[0]["shortest"], rows[0]["docs"]) == ("", order, 8, sum(c.total() for c in counted.values()), 7, None)
    assert [r["term"] for r in rows[1:]] == sorted({w for c in counted.values() for w in c})
    for r in rows[1:]:
        mine = [(at, counted[i][r["term"]], counted[i].total()) for at, i in enumerate(order) if counted[i][r["term"]]]
        packed = (np.frombuffer(r[c], k).tolist() for c, k in (("docs", np.uint16), ("counts", np.int32), ("lengths", np.int32)))
        assert list(zip(*packed)) == mine and (r["n"], r["most"], r["shortest"]) == (len(mine), max(m[1] for m in mine), min(m[2] for m in mine))
        assert r["ids"] is None and r["key"] == "k" and r["block"] == 4


def test_few_queries_are_sent_to_the_rows(spark):
    """for few queries, chunks and vectors are searched where they are, without an index or a grid, with the same results; copies tie by id over many small batches."""
    chunks, queries = made(6, 400)
    for x in chunks:
        x["v"] = vector_of(x["id"])
        if x["id"] % 9 < 3:
            x["text"], x["v"] = "w1 w2 w1", vector_of(9)
    for x in queries:
        x["v"] = vector_of(x["id"])
    chunks[77]["text"] = "w1 Ünï-w2_W3 " * 3000
    c, q = frames(spark, chunks, queries)
    vecs = c.join(spark.createDataFrame([(x["id"], x["v"]) for x in chunks], "chunk_id long, embedding array<double>"), "chunk_id")
    asked = q.join(spark.createDataFrame([(x["id"], x["v"]) for x in queries], "query_id long, vector array<double>"), "query_id")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 16)
    try:
        assert listed(lexical.search_few(c, q, 7).collect()) == {i: r for i, r in plain_bm25(chunks, queries, 7).items() if r}
        assert listed(lexical.search_few(c, q, 7, clauses=CLAUSES).collect()) == {i: r for i, r in plain_bm25(chunks, queries, 7, fits).items() if r}
        found = retrieval.vector_top_k(vecs, asked, 5, id_col="chunk_id", clauses=CLAUSES)
        assert {i: [x for x, _ in own] for i, own in listed(found.collect()).items()} == {i: ids for i, ids in plain_near(chunks, queries, 5, fits).items() if ids}
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("MapInArrow") == 1 and "CoGroup" not in plan
        assert lexical.search_few(c.limit(0), q, 3).count() == 0 == lexical.search_few(c, q.where("query = ''"), 3).count() == lexical.search_few(c, q.limit(0), 3).count()
        assert retrieval.vector_top_k(vecs, asked.limit(0), 3, id_col="chunk_id").count() == 0
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
