"""Queries without SQL against plain Python over the same tables."""

import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.operators import chunking, comparison, sentiment
from tidemark.plans import QUERIES, analysis, evaluation

SF = "/root/testdata/sf0.001"


def words(said):
    return re.findall("[a-z0-9]+", said.lower(), re.ASCII)


def plain_sentences(said):
    """Sentences by a walk over the text: a stop, white space, then a capital, a quote or a bracket; no stop after an abbreviation."""
    out, start = [], 0
    for m in re.finditer(r"[.!?]\s+(?=[A-Z\"(])", said, re.ASCII):
        if said[m.start()] == "." and any(re.search(rf"\b{a}$", said[start : m.start()]) for a in text.ABBREVIATIONS):
            continue
        out.append(said[start : m.start() + 1])
        start = m.end()
    return [s for s in (x.strip(" \t\n\r\x0b\x0c") for x in [*out, said[start:]]) if s]


def overlap(asked, said, longer_than=0):
    wanted = {w for w in words(asked) if len(w) > longer_than}
    return round(len(wanted & set(words(said))) / len(wanted), 6) if wanted else 0.0


def units_of(said):
    cut = re.split(chunking.MACRO.replace("(^|", "(?:^|"), said, flags=re.ASCII)
    return [u for u in (x.strip(" \t\n\r\x0b\x0c") for part in cut for x in part.split("•")) if u]


def tokens(said):
    return len(re.findall(r"\w+|[^\w\s]", said, re.ASCII))


MADE = [
    "We grew. RESULTS OF OPERATIONS We sold more • one thing • two things. LIQUIDITY AND CAPITAL We have cash. " + "It is enough for all needs. " * 60,
    "OVERVIEW The year was good. " + "All of it was fine and nothing went wrong. " * 300,
    "no unit at all", "", "• only • bullets •", "Revenue grew. Gross margin fell.", "gross margin rose", "Intelligent Cloud did well", "RISK FACTORS ARE MANY and long", "AB c", "Three months ended",
]


def plain_blocks(section, said, target, least):
    units = units_of(said)
    if section == "mda" and len(units) > 1:
        groups, used = [], 0
        for u in units:
            n = tokens(u)
            if groups and used < least and used + n <= target:
                groups[-1].append(u)
                used += n
            else:
                groups.append([u])
                used = n
    else:
        groups, used = [], 0
        for s in plain_sentences(said):
            n = tokens(s)
            if groups and used + n <= target:
                groups[-1].append(s)
                used += n
            else:
                groups.append([s])
                used = n
    return [(k, n, " ".join(g)) for k, g in enumerate(groups) if (n := sum(map(tokens, g))) >= least]


def test_units_blocks_and_subsections(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    rows = [(r["doc_id"], r["text"]) for r in docs] + [(10_000 + i, t) for i, t in enumerate(MADE)]
    rows = [(i, ("mda", "business", "risk_factors", "properties")[i % 4] if i < 10_000 else "mda", t) for i, t in rows]
    df = spark.createDataFrame(rows, "doc_id long, section string, text string")
    got = {r["doc_id"]: r["u"] for r in df.select("doc_id", chunking.macro_units(F.col("text")).alias("u")).collect()}
    assert got == {i: units_of(t) for i, _, t in rows}
    blocks = defaultdict(list)
    for r in sorted(chunking.parent_blocks(df, 200, 20).collect(), key=lambda r: r["block"]):
        blocks[r["doc_id"]].append((r["block"], r["n_tokens"], r["body"]))
    assert dict(blocks) == {i: b for i, s, t in rows if (b := plain_blocks(s, t, 200, 20))}

    def subsection(section, said):
        plain = said.strip(" ")
        if section not in ("mda", "risk_factors", "business"):
            return ""
        header = (m[0] if (m := re.search(chunking.HEADER, plain, re.ASCII)) else "").strip(" ")
        if len(header) >= 3:
            return header.lower().replace(" ", "_")
        return next((t.replace(" ", "_") for t in sorted(chunking.TOPICS, key=len, reverse=True) if plain.lower().startswith(t)), "")

    found = {r["doc_id"]: r["s"] for r in df.select("doc_id", chunking.detect_subsection(F.col("text"), F.col("section")).alias("s")).collect()}
    assert found == {i: subsection(s, t) for i, s, t in rows} and sum(v != "" for v in found.values()) >= 5


def test_sentences_are_those_of_a_walk(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()] + [(9999, 'Dr. Who met Mr. X. "Yes!" said Inc. It ended vs. B. (No) etc. And so on.')]
    got = {r["id"]: r["s"] for r in spark.createDataFrame(rows, "id long, t string").select("id", text.sentences(F.col("t")).alias("s")).collect()}
    assert got == {i: plain_sentences(t) for i, t in rows}


@pytest.fixture(scope="module")
def pool(spark):
    documents, benchmark = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    return documents, benchmark, analysis._retrieved(documents, benchmark).collect()


def test_passages_of_the_pool(spark, pool):
    documents, benchmark, _ = pool
    english = analysis._retrieved(documents.where("lang = 'en'"), benchmark).collect()
    by = defaultdict(list)
    for r in english:
        by[r["query_id"]].append(r)
    wanted = {}
    for q, rows in by.items():
        best = sorted(rows, key=lambda r: (-overlap(r["query"], r["content"]), r["rank"]))[:8]
        said = [(-overlap(r["query"], s), r["rank"], k, s[:1200]) for r in best for k, s in enumerate(plain_sentences(r["content"]))]
        wanted[q] = [(round(-o, 6), s) for o, _, _, s in sorted(said)[:6]]
    found = sentiment.sentence_passages(sentiment.sentiment_candidates(analysis._typed(spark.createDataFrame(english)))).collect()
    got = defaultdict(list)
    for r in sorted(found, key=lambda r: r["n"]):
        got[r["query_id"]].append((r["overlap"], r["sentence"]))
    assert dict(got) == wanted and len(QUERIES["j2_sentence_passages"](spark, SF).collect()) == sum(map(len, wanted.values()))


def test_best_statements_of_the_pool(spark, pool):
    documents, benchmark, rows = pool
    best_of = {}
    for r in rows:
        for s in plain_sentences(r["content"]):
            key = (r["query_id"], s)
            if key not in best_of or r["rank"] < best_of[key][0]:
                best_of[key] = (r["rank"], r["doc_id"], r["query"])
    wanted = {}
    for (q, s), (_, doc, query) in best_of.items():
        score, grounded = overlap(query, s, 2), overlap(s, s, 2)
        if score >= 0.3 and grounded >= 0.3:
            wanted[q] = min(wanted.get(q, (0, "~", 0)), (-score, s, doc)) if q in wanted else (-score, s, doc)
    got = {r["query_id"]: (r["doc_id"], r["score"]) for r in analysis.k5_select_finding(documents, benchmark).collect()}
    assert got == {q: (doc, -score) for q, (score, _, doc) in wanted.items()} and got
    assert got == {r["query_id"]: (r["doc_id"], r["score"]) for r in evaluation.p6_typed_answer(documents, benchmark).collect()}


def test_statements_meet_their_earlier_ones(spark):
    rows = spark.read.parquet(f"{SF}/conversations.parquet").collect()
    said = defaultdict(list)
    for r in rows:
        said[r["conv_id"]] += [((r["turn"], p), s) for p, s in enumerate(plain_sentences(r["text"]))]
    said = {c: sorted(x) for c, x in said.items()}
    wanted = Counter()
    content = lambda s: {w for w in words(s) if w not in text.STOPWORDS}
    for conv, own in said.items():
        for place, s in own:
            mine, best = content(s), None
            for at, p in said.get(conv - 1, []):
                share = len(mine & content(p)) / len(mine) if mine else 0
                if mine & content(p) and share >= 0.3 and (best is None or share > best[0]):
                    best = (share, at)
            wanted[conv, *place, *(best[1] if best else (None, None)), round(best[0], 6) if best else None] += 1
    got = QUERIES["k2_align_statements"](spark, SF).collect()
    assert Counter((r["conv_id"], r["place_t"], r["place_p"], r["prior_place_t"], r["prior_place_p"], r["overlap"]) for r in got) == wanted


def test_a_model_is_loaded_once_a_task(spark):
    loads = spark.sparkContext.accumulator(0)

    def load():
        loads.add(1)
        return lambda texts: [[len(t), t.count("a")] for t in texts]

    said = [None, "", "banana", *("x" * i for i in range(3000))]
    docs = spark.createDataFrame([(t,) for t in said], "t string").repartition(3)
    got = chunking.embed_with(load, batch=7)(docs, "t").collect()
    assert Counter((r["t"], tuple(r["embedding"])) for r in got) == Counter((t, (float(len(t or "")), float((t or "").count("a")))) for t in said)
    assert loads.value == 3


def test_default_embedding_is_a_hashed_bag(spark):
    got = QUERIES["f1_embed_table"](spark, SF).collect()
    said = {(r["conv_id"], r["turn"]): r["text"] for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()}
    all_words = sorted({w for t in said.values() for w in words(t)})
    place = {r["w"]: r["p"] for r in spark.createDataFrame([(w,) for w in all_words], "w string").select("w", F.pmod(F.xxhash64("w"), F.lit(64)).alias("p")).collect()}
    for r in got[::7]:
        n = Counter(place[w] for w in words(said[r["conv_id"], r["turn"]]))
        size = sum(v * v for v in n.values()) ** 0.5
        assert all(abs(v - n[i] / max(size, 1e-12)) < 1e-6 for i, v in enumerate(r["embedding"]))


def test_greedy_parts_of_long_texts(spark):
    """Parts within the limit, cut at word starts as late as possible."""
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()] + [(9998, "a\x01b c\x02 " * 50), (9999, " lead  two \n\n three")]

    def parts(said, most):
        if tokens(said) <= most:
            return [said]
        out, used = [], 0
        for piece in filter(None, re.split(r"(?<=\s)(?=\S)", said, flags=re.ASCII)):
            n = tokens(piece)
            if out and used + n <= most:
                out[-1] += piece
                used += n
            else:
                out.append(piece)
                used = n
        return out

    got = defaultdict(list)
    for r in sorted(chunking.enforce_max(spark.createDataFrame(rows, "doc_id long, text string"), 40, id_col="doc_id").collect(), key=lambda r: r["part"]):
        got[r["doc_id"]].append(r["body"])
    assert dict(got) == {i: parts(t, 40) for i, t in rows if t}


def test_packing_within_rows_shuffles_nothing(spark):
    """items of a text are not dealt out and gathered again; parts join to the text, null and empty texts included."""
    rows = [(1, "a b  c\nd" * 30), (2, None), (3, ""), (4, "x|y\n" + "w " * 40 + "|\n \nz|\n" + "v|" * 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    cut, blocks = chunking.enforce_max(df, 7, id_col="doc_id"), chunking.split_oversized(df, 30, 1, size=F.length)
    for out in (cut, blocks):
        assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    parts: dict = {}
    for r in sorted(cut.collect(), key=lambda r: (r["doc_id"], r["part"])):
        assert (r["n_tokens"] <= 7 or not re.search(r"\s\S", r["body"])) and r["part"] == len(parts.setdefault(r["doc_id"], []))
        parts[r["doc_id"]].append(r["body"])
    assert {i: "".join(p) for i, p in parts.items()} == {i: t for i, t in rows if t is not None}
    found = [(r["block"], r["n_items"], r["n_tokens"], r["body"]) for r in sorted(blocks.where("doc_id = 4").collect(), key=lambda r: r["block"])]
    long = [("w " * k).strip() for k in (30, 10)]
    assert found == [(0, 1, 3, "x|y"), (1, 30, 30, long[0]), (2, 11, 11, long[1] + " |"), (3, 2, 12, "z|\n" + "v|" * 5)]


def test_titles_and_shifts_are_read_once(spark):
    """F7, F8: one CASE over the plain title, which is computed once; what is compared of a line is told once."""
    from tidemark.operators import parsing

    df = spark.createDataFrame([("10-Q", "RISK Factors – MANAGEMENT’S discussion and analysis"), ("10-K", "Risk factors"), ("10-K", "none"), ("10-Q", None)], "form string, title string")
    assert [r[0] for r in df.select(parsing.title_item(F.col("form"), F.col("title"))).collect()] == ["I/2", "1A", None, None]
    plan = spark.range(2).select(parsing.title_item(F.lit("10-K"), F.col("id").cast("string")).alias("t"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("CASE WHEN") == 1
    pairs = [("Sales grew 5%", None), ("Sales grew", "grew sales"), ("Sales grew", "Sales declined"), ("Sales 105", "Sales 100"), ("Sales 120", "Sales 100"), ("a", "b")]
    shifts = spark.createDataFrame(pairs, "a string, b string").select(comparison.detect_shift(F.col("a"), F.col("b")), comparison.shift_of(comparison.told(F.col("a")), comparison.told(F.col("b"))))
    assert [tuple(r) for r in shifts.collect()] == [(s, s) for s in (True, False, True, False, True, True)]


def test_embedding_of_a_batch(spark):
    """texts embedded in one array operation have the vectors that each has alone; null texts and such without words have zeros."""
    import numpy as np

    texts = ["Sales grew, sales fell", None, "", "é", "one two three two"]
    got = [r[0] for r in chunking.embed(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").coalesce(1).orderBy("i"), "t").select("embedding").collect()]
    places = spark.createDataFrame([(w,) for w in ("sales", "grew", "fell", "one", "two", "three")], "w string").select("w", F.pmod(F.xxhash64("w"), F.lit(64)).cast("int")).collect()
    at = dict((r[0], r[1]) for r in places)
    for text_, vector in zip(texts, got):
        n = np.bincount([at[w] for w in re.findall("[a-z0-9]+", (text_ or "").lower())], minlength=64).astype(float) if text_ and text_ != "é" else np.zeros(64)
        assert vector == (n / max(np.sqrt((n * n).sum()), 1e-12)).astype(np.float32).tolist()
