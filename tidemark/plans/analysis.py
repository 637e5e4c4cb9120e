"""Queries of vectors, retrieval, facts, numeric checks, sentiment, comparison, guardrails and evidence."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import folds, text, vectors
from tidemark.operators import chunking, comparison, evidence, facts as reported, guardrails, numeric, retrieval, sentiment
from tidemark.plans.registry import query

_COS = "CAST(list_cosine_similarity(CAST({0} AS DOUBLE[]), CAST({1} AS DOUBLE[])) AS DOUBLE)"
_ASKING = "vec_id % 50 = 0"


@query(None, "conversations")
def f1_embed_table(conversations):
    return chunking.embed(conversations.select("conv_id", "turn", "text"), "text").drop("text")


@query("SELECT d.doc_id, sha256(trim(d.text)) AS text_key FROM documents d", "documents")
def f2_embed_distinct(documents):
    """Each distinct text is embedded once; every document gets its vector."""
    known = chunking.embed(documents.where("lang = 'es'").dropDuplicates(["text"]).select("text"), "text")
    known = known.select(F.sha2(F.trim("text"), 256).alias("text_key"), "embedding").dropDuplicates(["text_key"])
    out = chunking.embed_distinct(documents.select("doc_id", "text"), known, "text", lambda rows: chunking.embed(rows, "text"))
    return out.where(F.size("embedding") == 64).select("doc_id", "text_key")


@query(f"SELECT a.vec_id AS a, b.vec_id AS b, round({_COS.format('a.embedding', 'b.embedding')}, 6) AS cosine FROM embeddings a JOIN embeddings b ON a.label = b.label AND b.vec_id = a.vec_id + 10", "embeddings")
def f3_cosine(embeddings):
    b = embeddings.select((F.col("vec_id") - 10).alias("key"), F.col("vec_id").alias("b"), F.col("embedding").alias("eb"), F.col("label").alias("lb"))
    rows = embeddings.join(b, (F.col("vec_id") == F.col("key")) & (F.col("label") == F.col("lb")))
    return rows.select(F.col("vec_id").alias("a"), "b", F.round(vectors.cosine(F.col("embedding"), F.col("eb")), 6).alias("cosine"))


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))), 6) AS norm, CAST(1 AS DOUBLE) AS unit_norm FROM embeddings", "embeddings")
def f4_l2_normalize(embeddings):
    v = F.col("embedding")
    return embeddings.select("vec_id", F.round(vectors.norm(v), 6).alias("norm"), F.round(vectors.norm(vectors.unit(v)), 6).alias("unit_norm"))


@query(
    f"""SELECT query_id, id, rank, score FROM (SELECT query_id, id, round(s, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, id) AS INT) AS rank
FROM (SELECT a.vec_id AS query_id, b.vec_id AS id, {_COS.format('a.embedding', 'b.embedding')} AS s FROM embeddings a, embeddings b WHERE a.{_ASKING})) WHERE rank <= 5""",
    "embeddings",
)
def f5_vector_topk(embeddings):
    asked = embeddings.where(_ASKING).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return retrieval.vector_top_k(embeddings, asked, 5).withColumn("score", F.round("score", 6))


@query("SELECT label, count(*) AS n, CAST(max(len(embedding)) AS INT) AS dims FROM embeddings GROUP BY label", "embeddings")
def f6_embedding_manifest(embeddings):
    return embeddings.groupBy("label").agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("dims"))


def _asked(benchmark):
    """Whole benchmark texts as queries."""
    return benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


_Q = "(SELECT item_id AS query_id, text AS query FROM benchmark)"
_BM25 = f"""WITH q AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(lower(query), '[a-z0-9]+')) AS term FROM {_Q}),
w AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents),
t AS (SELECT count(*) AS n, avg(len(w)) AS m FROM w),
p AS (SELECT id, len(w) AS l, unnest(w) AS term FROM w),
f AS (SELECT term, id, l, count(*) AS tf FROM p WHERE term IN (SELECT term FROM q) GROUP BY term, id, l),
d AS (SELECT term, count(*) AS df FROM f GROUP BY term),
s AS (SELECT query_id, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / m))), 6) AS score
 FROM f JOIN d USING (term) JOIN q USING (term), t GROUP BY query_id, id),
ranked AS (SELECT query_id, id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INT) AS rank FROM s)"""


@query(f"{_BM25} SELECT query_id, id, rank, score FROM ranked WHERE rank <= 10", "documents", "benchmark")
def g1_bm25_topk(documents, benchmark):
    return retrieval.bm25(documents, _asked(benchmark), 10, id_col="doc_id", text_col="text")


@query(
    """WITH a AS (SELECT user_id AS query_id, event_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events),
b AS (SELECT user_id AS query_id, event_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rank FROM events),
f AS (SELECT query_id, id, round(sum(1.0 / (60 + rank)), 9) AS score FROM (SELECT * FROM a WHERE rank <= 20 UNION ALL SELECT * FROM b WHERE rank <= 20) GROUP BY query_id, id)
SELECT query_id, id, round(CAST(score AS DOUBLE), 6) AS score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INT) AS rank FROM f) WHERE rank <= 10""",
    "events",
)
def g2_rrf_fuse(events):
    rows = events.select(F.col("user_id").alias("query_id"), F.col("event_id").alias("id"), "value", "ts")
    a = retrieval.top_k(rows, 20, F.desc("value"), F.col("id"))
    b = retrieval.top_k(rows, 20, F.col("ts"), F.col("id"))
    return retrieval.rrf_fuse(a, b, k=10).withColumn("score", F.round("score", 6))


_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_LETTER_SQL = "[" + ", ".join(f"CAST(length({{0}}) - length(replace({{0}}, '{c}', '')) AS DOUBLE)" for c in _LETTERS) + "]"
_CLAUSES = "CASE WHEN item_id % 2 = 1 THEN 'en' END AS q_lang, CASE WHEN item_id % 4 > 1 THEN 'src' || CAST(item_id % 20 AS STRING) END AS q_source"


def _letter_counts(column: str):
    """A model that SQL has too: how often each letter occurs."""
    return F.array(*[(F.length(column) - F.length(F.replace(F.col(column), F.lit(c), F.lit("")))).cast("double") for c in _LETTERS])


@query(
    f"""{_BM25},
asked AS (SELECT item_id AS query_id, {_CLAUSES}, {_LETTER_SQL.format('text')} AS q FROM benchmark),
docs AS (SELECT doc_id, lang, source, {_LETTER_SQL.format('text')} AS v FROM documents),
lexical AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s JOIN asked USING (query_id) JOIN docs ON doc_id = id
 WHERE (q_lang IS NULL OR lang = q_lang) AND (q_source IS NULL OR source = q_source)),
near AS (SELECT query_id, doc_id AS id, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN list_max(v) > 0 AND list_max(q) > 0 THEN round({_COS.format('v', 'q')}, 9) ELSE 0 END DESC, doc_id) AS rank FROM asked, docs
 WHERE (q_lang IS NULL OR lang = q_lang) AND (q_source IS NULL OR source = q_source)),
fused AS (SELECT query_id, id, round(sum(CAST(1.0 AS DOUBLE) / (60 + rank)), 9) AS score FROM (SELECT * FROM lexical WHERE rank <= 50 UNION ALL SELECT * FROM near WHERE rank <= 50) GROUP BY query_id, id)
SELECT query_id, id, round(score, 6) AS score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INT) AS rank FROM fused) WHERE rank <= 12""",
    "documents",
    "benchmark",
)
def g3_hybrid_search(documents, benchmark):
    """Lexical and vector search fused, each query with a language, a source, both or neither as its filter."""
    chunks = documents.select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"), "lang", "source", _letter_counts("text").alias("embedding"))
    asked = benchmark.selectExpr("item_id AS query_id", "text AS query", *_CLAUSES.replace("CASE WHEN item_id % 4", "|CASE WHEN item_id % 4").split(", |")).withColumn("vector", _letter_counts("query"))
    found = retrieval.hybrid_search(chunks, asked, 12, clauses={"lang": "q_lang", "source": "q_source"})
    return found.select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query("SELECT lang, source, doc_id, rank FROM (SELECT lang, source, doc_id, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS INT) AS rank FROM documents WHERE lang <> 'en') WHERE rank <= 3", "documents")
def g4_filter_search(documents):
    wanted = documents.where("lang <> 'en'").select("lang", "source").distinct()
    return retrieval.filter_search(documents.select("lang", "source", "doc_id"), wanted, ["lang", "source"], 3, "doc_id")


_HITS = "(SELECT user_id AS query_id, event_id, CAST(floor(value) AS BIGINT) % 40 AS chunk, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rank, event_type FROM events)"


def _hits(events):
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    return events.select(F.col("user_id").alias("query_id"), "event_id", (F.floor("value") % 40).alias("chunk"), rank.alias("rank"), "event_type")


@query(f"SELECT query_id, chunk, event_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, chunk ORDER BY rank) AS n FROM {_HITS}) WHERE n = 1", "events")
def g5_dedup_within(events):
    return retrieval.dedup_within(_hits(events), "chunk").select("query_id", "chunk", "event_id", "rank")


@query(
    f"""SELECT query_id, chunk, event_id, row_number() OVER (PARTITION BY query_id ORDER BY so, rank) AS place FROM (
SELECT *, row_number() OVER (PARTITION BY query_id, chunk ORDER BY so, rank) AS n FROM (SELECT *, CASE WHEN event_type = 'view' THEN 0 ELSE 1 END AS so FROM {_HITS})) WHERE n = 1""",
    "events",
)
def g6_dedup_across_merge(events):
    rows = _hits(events)
    out = retrieval.dedup_across(rows.where("event_type = 'view'"), rows.where("event_type <> 'view'"), "chunk")
    return out.select("query_id", "chunk", "event_id", F.col("place").cast("long").alias("place"))


@query(f"SELECT query_id, chunk, event_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id, chunk ORDER BY rank) AS n FROM {_HITS} WHERE event_type = 'click') WHERE n = 1", "events")
def g7_transcript_pool(events):
    return retrieval.dedup_within(_hits(events).where("event_type = 'click'"), "chunk").select("query_id", "chunk", "event_id")


_POOL = f"""(SELECT query_id, id, rank, v, q FROM (SELECT a.vec_id AS query_id, b.vec_id AS id, b.embedding AS v, a.embedding AS q,
row_number() OVER (PARTITION BY a.vec_id ORDER BY round({_COS.format('a.embedding', 'b.embedding')}, 9) DESC, b.vec_id) AS rank FROM embeddings a, embeddings b WHERE a.{_ASKING} AND a.vec_id <> b.vec_id) WHERE rank <= 24)"""


@query(
    f"""WITH RECURSIVE p AS (SELECT *, {_COS.format('v', 'q')} AS rel FROM {_POOL}),
pairs AS (SELECT a.query_id, a.rank, list({_COS.format('a.v', 'b.v')} ORDER BY b.rank) AS alike FROM p a JOIN p b ON a.query_id = b.query_id GROUP BY a.query_id, a.rank),
pool AS (SELECT query_id, list(id ORDER BY rank) AS ids, list(rel ORDER BY rank) AS rel, list(alike ORDER BY rank) AS alike FROM p JOIN pairs USING (query_id, rank) GROUP BY query_id),
step AS (SELECT query_id, 0 AS n, CAST([] AS BIGINT[]) AS chosen, ids, rel, alike FROM pool
 UNION ALL SELECT query_id, n + 1, list_append(chosen, list_position(value, list_max(value))), ids, rel, alike FROM (
 SELECT *, list_transform(range(1, len(ids) + 1), lambda i: CASE WHEN list_contains(chosen, i) THEN -9.0 ELSE round(0.5 * rel[i] - 0.5 * coalesce(list_max(list_transform(chosen, lambda j: alike[i][j])), 0), 9) END) AS value FROM step WHERE n < least(10, len(ids))) s)
SELECT query_id, ids[chosen[i]] AS id, CAST(i AS INT) AS mmr_rank FROM (SELECT query_id, ids, chosen, unnest(range(1, len(chosen) + 1)) AS i FROM step WHERE n = least(10, len(ids)))""",
    "embeddings",
)
def g8_mmr_rerank(embeddings):
    """Ten of each pool of 24 by maximal marginal relevance."""
    asked = embeddings.where(_ASKING).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    near = retrieval.vector_top_k(embeddings, asked, 25).where("query_id <> id")
    near = near.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).where("rank <= 24")
    pool = near.join(embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), "id").join(asked.withColumnRenamed("vector", "q"), "query_id")
    return retrieval.mmr_rerank(pool.select("query_id", "id", "rank", "v", "q"), 10)


_TOK = "list_distinct(regexp_extract_all(lower({0}), '[a-z0-9]+'))"
_STOP = "[" + ", ".join(f"'{w}'" for w in text.STOPWORDS) + "]"
_PLAIN = f"CASE WHEN len({_TOK.format('{0}')}) = 0 THEN 0 ELSE len(list_intersect({_TOK.format('{0}')}, {_TOK.format('{1}')})) / len({_TOK.format('{0}')}) END"
def _pool(documents: str = "documents", k: int = 50) -> str:
    """SQL for :func:`_retrieved`."""
    return f"({_BM25.replace('FROM documents', f'FROM {documents}')} SELECT query_id, query, doc_id, lang, text, rank, score FROM (SELECT query_id, id AS doc_id, rank, score FROM ranked WHERE rank <= {k}) JOIN documents USING (doc_id) JOIN {_Q} USING (query_id))"


_PAIRS = _pool()
_ENGLISH = "(SELECT * FROM documents WHERE lang = 'en')"


def _retrieved(documents, benchmark, k: int = 50):
    """The pool of each query: its best documents of all by BM25, ids and scores first, texts joined to the k kept ones."""
    asked = _asked(benchmark)
    hits = retrieval.bm25(documents, asked, k, id_col="doc_id", text_col="text").withColumnRenamed("id", "doc_id")
    texts = documents.select("doc_id", "lang", F.col("text").alias("content"))
    return hits.join(texts, "doc_id").join(asked, "query_id").select("query_id", "query", "doc_id", "lang", "content", "rank", "score")


@query(f"SELECT query_id, doc_id, s AS rerank_score, rerank_rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY s DESC, rank) AS INT) AS rerank_rank FROM (SELECT *, round(CAST({_PLAIN.format('query', 'text')} AS DOUBLE), 6) AS s FROM {_PAIRS})) WHERE rerank_rank <= 5", "documents", "benchmark")
def g9_pair_rerank(documents, benchmark):
    return retrieval.pair_rerank(_retrieved(documents, benchmark), 5).select("query_id", "doc_id", "rerank_score", "rerank_rank")


def _overlaps(pairs):
    q, t = F.col("query"), F.col("content")
    return pairs.select("query_id", "doc_id", F.round(text.overlap(q, t), 6).alias("overlap"), F.round(text.overlap(q, t, stopwords=False, empty=0.0), 6).alias("plain"))


@query(
    f"""SELECT query_id, doc_id, round(CAST(CASE WHEN len(q) = 0 THEN 1 ELSE len(list_intersect(q, t)) / len(q) END AS DOUBLE), 6) AS overlap, round(CAST({_PLAIN.format('query', 'text')} AS DOUBLE), 6) AS plain
FROM (SELECT *, list_filter({_TOK.format('query')}, lambda w: NOT list_contains({_STOP}, w)) AS q, {_TOK.format('text')} AS t FROM {_PAIRS})""",
    "documents",
    "benchmark",
)
def g10_topic_overlap(documents, benchmark):
    return _overlaps(_retrieved(documents, benchmark))


_BOILER = f"(lang = 'en' AND rank - 1 BETWEEN 0 AND 3 AND CASE WHEN len(q) = 0 THEN 1 ELSE len(list_intersect(q, t)) / len(q) END < 0.25)"
_FLAGGED = f"(SELECT *, {_BOILER} AS flag FROM (SELECT p.*, list_filter({_TOK.format('query')}, lambda w: NOT list_contains({_STOP}, w)) AS q, {_TOK.format('p.text')} AS t FROM {_PAIRS} p))"


def _flagged(pairs):
    kind = F.when(F.col("lang") == "en", "transcript").otherwise("filing")
    flag = retrieval.is_boilerplate(F.col("query"), F.col("rank") - 1, kind, F.lit("mda"), F.col("content"))
    return pairs.withColumn("flag", flag)


@query(f"SELECT query_id, doc_id, flag FROM {_FLAGGED}", "documents", "benchmark")
def g11_is_boilerplate(documents, benchmark):
    return _flagged(_retrieved(documents, benchmark)).select("query_id", "doc_id", "flag")


def _demoted(flagged):
    ranked = retrieval.pair_rerank(flagged, None)
    out = retrieval.demote_boilerplate(ranked, F.col("flag")).withColumn("rerank_score", F.round("rerank_score", 6))
    return out.select("query_id", "doc_id", "rerank_score", "demoted_rank")


@query(
    f"""SELECT query_id, doc_id, round(rs, 6) AS rerank_score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(rs, 6) DESC, rr) AS INT) AS demoted_rank FROM (
SELECT *, s - CASE WHEN flag THEN 10 ELSE 0 END AS rs, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, rank) AS rr FROM (SELECT *, round(CAST({_PLAIN.format('query', 'text')} AS DOUBLE), 6) AS s FROM {_FLAGGED}))""",
    "documents",
    "benchmark",
)
def g12_demote_boilerplate(documents, benchmark):
    return _demoted(_flagged(_retrieved(documents, benchmark)))


@query(
    """SELECT query_id, event_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rank) AS INT) AS capped_rank FROM (
SELECT *, row_number() OVER (PARTITION BY query_id, chunk, event_type ORDER BY rank) AS n FROM """ + _HITS + """) WHERE n <= 2 QUALIFY capped_rank <= 10""",
    "events",
)
def g13_diversity_cap(events):
    rows = _hits(events).withColumns({"accession": F.col("chunk").cast("string"), "section": F.upper("event_type")})
    return retrieval.diversity_cap(rows, 2, 10).select("query_id", "event_id", "capped_rank")


_HIT_PARENTS = "(SELECT DISTINCT parent_id FROM {chunks} WHERE content LIKE '%|%')"


@query(f"SELECT parent_id, chunk_id, place FROM (SELECT parent_id, chunk_id, CAST(row_number() OVER (PARTITION BY parent_id ORDER BY chunk_index) AS INT) AS place FROM {{chunks}} WHERE parent_id IN {_HIT_PARENTS}) WHERE place <= 50", "chunks")
def g14_parent_siblings(chunks):
    return retrieval.parent_siblings(chunks.where("content like '%|%'"), chunks).select("parent_id", "chunk_id", "place")


@query(
    """SELECT c.chunk_id, md5(CASE WHEN p.n > 1 THEN p.full_text ELSE c.content END) AS digest FROM {chunks} c
JOIN (SELECT parent_id, string_agg(content, '' ORDER BY chunk_index) AS full_text, count(*) AS n FROM {chunks} GROUP BY parent_id) p ON p.parent_id = c.parent_id""",
    "chunks",
)
def g15_expand_parents(chunks):
    return retrieval.expand_parents(chunks, chunks).select("chunk_id", F.md5("parent_content").alias("digest"))


@query(None, "chunks", "benchmark")
def g15_retrieved_parents(chunks, benchmark):
    """Parents of the chunks that a search of all sections finds."""
    found = retrieval.bm25(chunks, _asked(benchmark), 10).withColumnRenamed("id", "chunk_id")
    hits = found.join(chunks.select("chunk_id", "parent_id", "content"), "chunk_id")
    return retrieval.expand_parents(hits, chunks).select("query_id", "chunk_id", "rank", F.md5("parent_content").alias("digest"))


@query("SELECT f.accession, g.accession AS prior_accession, g.n_orders FROM {filings} f JOIN {filings} g ON f.ticker = g.ticker AND g.fy * 4 + g.fq = f.fy * 4 + f.fq - 4", "filings")
def g16_prior_period_search(filings):
    table = filings.select("ticker", "fiscal_label", F.col("accession").alias("prior_accession"), "n_orders")
    asked = filings.select("ticker", "fiscal_label", "accession")
    return retrieval.prior_period_search(asked, 4, lambda r: r.join(table, ["ticker", "fiscal_label"])).select("accession", "prior_accession", "n_orders")


_BUDGET = """WITH RECURSIVE s AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, text FROM conversations),
w AS (SELECT conv_id, i, CASE WHEN length(text) <= 900 THEN length(text) ELSE 0 END AS used, length(text) <= 900 AS kept, text FROM s WHERE i = 1
 UNION ALL SELECT s.conv_id, s.i, CASE WHEN w.used + length(s.text) <= 900 THEN w.used + length(s.text) ELSE w.used END, w.used + length(s.text) <= 900, s.text FROM w JOIN s ON s.conv_id = w.conv_id AND s.i = w.i + 1)
SELECT conv_id, md5(coalesce(string_agg(CASE WHEN kept THEN text END, chr(10) || chr(10) ORDER BY i), '')) AS digest FROM w GROUP BY conv_id"""


@query(_BUDGET, "conversations")
def g17_budget_concat(conversations):
    rows = conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("c"))
    return rows.select("conv_id", F.md5(folds.budget_concat(F.transform("c", lambda c: c["text"]), 900)).alias("digest"))


@query(None, "chunks", "benchmark")
def g18_retrieve(chunks, benchmark):
    """The whole chain for each benchmark text: two hybrid passes, merged pool, diversity, joint scores, demotion, cap, parents."""
    found = retrieval.retrieve(chunking.embed(chunks, "content"), chunking.embed(_asked(benchmark), "query").withColumnRenamed("embedding", "vector"))
    return found.select("query_id", "chunk_id", "mmr_rank", "capped_rank", "rerank_score", F.md5("parent_content").alias("parent_digest"))


_TAGS = ", ".join(f"('{c}', '{t}', {k}, '{kind}', '{unit}')" for c, tags, kind, unit, _ in reported.CONCEPTS for k, t in enumerate(tags))
_SELECTED = f"""(SELECT accession, form, concept, tag, value, unit, start_day AS period_start, end_day AS period_end FROM (
SELECT e.*, t.concept, row_number() OVER (PARTITION BY accession, t.concept ORDER BY priority, end_day DESC, position) AS n
FROM {{fact_entries}} e JOIN (VALUES {_TAGS}) t(concept, tag, priority, kind, unit) ON e.tag = t.tag AND e.unit = t.unit
WHERE CASE WHEN kind = 'instant' THEN start_day IS NULL WHEN form LIKE '10-Q%' THEN date_diff('day', start_day, end_day) BETWEEN 80 AND 100 ELSE date_diff('day', start_day, end_day) BETWEEN 350 AND 380 END) WHERE n = 1)"""


@query(f"SELECT accession, concept, tag, value, period_end FROM {_SELECTED}", "fact_entries")
def h1_h2_select_facts(fact_entries):
    return reported.select_facts(fact_entries).select("accession", "concept", "tag", "value", "period_end")


_NEED = ", ".join(f"('{c}', {str(r).lower()})" for c, _, _, _, r in reported.CONCEPTS)


@query(
    f"""SELECT f.accession, coalesce(string_agg(CASE WHEN s.concept IS NULL AND c.required THEN c.concept END, ',' ORDER BY c.concept), '') AS missing_required,
coalesce(string_agg(CASE WHEN s.concept IS NULL AND NOT c.required THEN c.concept END, ',' ORDER BY c.concept), '') AS missing_optional,
NOT bool_or(s.concept IS NULL AND c.required) AS complete
FROM {{filings}} f CROSS JOIN (VALUES {_NEED}) c(concept, required) LEFT JOIN (SELECT DISTINCT accession, concept FROM {_SELECTED}) s ON s.accession = f.accession AND s.concept = c.concept GROUP BY f.accession""",
    "filings",
    "fact_entries",
)
def h3_coverage_report(filings, fact_entries):
    return reported.coverage_report(filings, reported.select_facts(fact_entries))


_LATEST = "(SELECT ticker, fiscal_label, concept, arg_max(value, period_end) AS value, arg_max(unit, period_end) AS unit FROM {facts} GROUP BY ticker, fiscal_label, concept)"


@query(f"SELECT ticker, fiscal_label, concept, value, unit FROM {_LATEST}", "facts")
def h4_latest_fact(facts):
    return reported.latest_facts(facts).drop("period_end")


_NAMES = ("Gross Margin", "Revenue Growth (CC)", "Operating-Margin", "net income", "Gross Margin % Change", "gross_margin_qoq_change", "iPhone Revenue", "Free Cash Flow", "revenue growth QoQ", "EBITDA", "revenue_growth_yoy", "Net Margin")
_NORMAL = ("gross_margin", "revenue_growth_cc", "operating_margin", "net_income", "gross_margin_pct_change", "gross_margin_qoq_change", "iphone_revenue", "free_cash_flow", "revenue_growth_qoq", "ebitda", "revenue_growth_yoy", "net_margin")
_CATEGORY = {"iphone_revenue": "product_kpi", "free_cash_flow": "derived_financial", "gross_margin_pct_change": "derived_financial", "ebitda": "unknown"}


def _requests(filings):
    n = (F.col("fy") * 4 + F.col("fq")) % len(_NAMES)
    from tidemark.functions import fiscal

    prior = fiscal.prior_label(F.col("fiscal_label"), 4)
    return filings.select("ticker", "fiscal_label", F.get(F.array(*[F.lit(m) for m in _NAMES]), n).alias("metric"), prior.alias("prior_label"))


_NORMAL_SQL = "[" + ", ".join(f"'{m}'" for m in _NORMAL) + "][(fy * 4 + fq) % 12 + 1]"


_FIRST_LINES = "(SELECT doc_id, split_part(text, chr(10), 1) || ' (CC) %' AS m FROM documents)"


@query(
    f"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(trim(lower(m)), '(cc)', 'cc'), '(c.c.)', 'cc'), '%', 'pct'), '[^\\pL\\pM\\pN_\\s]', ' ', 'g'), '\\s+', '_', 'g'), '_+', '_', 'g'), '^_+|_+$', '', 'g') AS normalized FROM {_FIRST_LINES}""",
    "documents",
)
def h5_normalize_metric(documents):
    """The first line of each document as a metric's name."""
    return documents.select("doc_id", text.normalize_metric(F.concat(F.substring_index("text", "\n", 1), F.lit(" (CC) %"))).alias("normalized"))


@query(f"SELECT accession, {_NORMAL_SQL} AS normalized FROM {{filings}}", "filings")
def h5_known_names(filings):
    n = (F.col("fy") * 4 + F.col("fq")) % len(_NAMES)
    return filings.select("accession", text.normalize_metric(F.get(F.array(*[F.lit(m) for m in _NAMES]), n)).alias("normalized"))


_CAT_SQL = "CASE m " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _CATEGORY.items()) + " END"


@query(f"SELECT ticker, fiscal_label, m AS normalized, {_CAT_SQL} AS category FROM (SELECT *, {_NORMAL_SQL} AS m FROM {{filings}})", "filings")
def h6_classify_metric(filings):
    return reported.classify_metrics(_requests(filings)).select("ticker", "fiscal_label", "normalized", "category")


_METRICS = f"""(SELECT r.ticker, r.fiscal_label, m AS normalized, f, CASE
 WHEN f = 'margin' THEN CASE WHEN rev.value <> 0 THEN cur.value / rev.value * 100 END
 WHEN f = 'margin_change' THEN cur.value / rev.value * 100 - prior.value / prev.value * 100
 WHEN f = 'growth' THEN CASE WHEN prior.value <> 0 THEN (cur.value - prior.value) / abs(prior.value) * 100 END
 WHEN f = 'value' THEN cur.value END AS raw, cur.unit AS fact_unit
FROM (SELECT *, CASE WHEN m LIKE '%margin' THEN 'margin' WHEN m = 'gross_margin_qoq_change' THEN 'margin_change' WHEN m LIKE '%growth%' THEN 'growth' WHEN m = 'net_income' THEN 'value' END AS f,
 CASE WHEN m LIKE 'gross_margin%' AND m <> 'gross_margin_pct_change' THEN 'GrossProfit' WHEN m LIKE 'revenue%' THEN 'Revenues' WHEN m = 'operating_margin' THEN 'OperatingIncomeLoss' WHEN m LIKE 'net%' THEN 'NetIncomeLoss' END AS c
 FROM (SELECT *, {_NORMAL_SQL} AS m, 'FY' || CAST(fy - 1 AS STRING) || '-Q' || CAST(fq AS STRING) AS pl FROM {{filings}})) r
LEFT JOIN {_LATEST} cur ON cur.ticker = r.ticker AND cur.fiscal_label = r.fiscal_label AND cur.concept = r.c
LEFT JOIN {_LATEST} rev ON rev.ticker = r.ticker AND rev.fiscal_label = r.fiscal_label AND rev.concept = 'Revenues'
LEFT JOIN {_LATEST} prior ON prior.ticker = r.ticker AND prior.fiscal_label = r.pl AND prior.concept = r.c
LEFT JOIN {_LATEST} prev ON prev.ticker = r.ticker AND prev.fiscal_label = r.pl AND prev.concept = 'Revenues')"""


@query(f"SELECT ticker, fiscal_label, normalized, round(raw, 4) AS value, CASE WHEN raw IS NOT NULL THEN CASE f WHEN 'margin_change' THEN 'pp' WHEN 'value' THEN fact_unit ELSE '%' END END AS unit FROM {_METRICS}", "filings", "facts")
def h13_calculate_metrics(filings, facts):
    return reported.calculate_metrics(_requests(filings), facts).select("ticker", "fiscal_label", "normalized", "value", "unit")


def _only(formula, filings, facts):
    out = reported.calculate_metrics(_requests(filings), facts).where(F.col("formula").isin(*formula))
    return out.select("ticker", "fiscal_label", "normalized", "value")


for _name, _formulas, _where in (
    ("h7_metric_margin", ("margin",), "f = 'margin'"),
    ("h8_metric_margin_change", ("margin_change",), "f = 'margin_change'"),
    ("h9_metric_yoy", ("yoy",), "normalized IN ('revenue_growth_yoy', 'revenue_growth_cc')"),
    ("h10_metric_cc", ("yoy", "cc"), "normalized IN ('revenue_growth_cc', 'revenue_growth_yoy')"),
    ("h11_metric_qoq", ("qoq",), "normalized = 'revenue_growth_qoq'"),
    ("h12_metric_value", ("value",), "f = 'value'"),
):

    def _run(filings, facts, formulas=_formulas):
        return _only(formulas, filings, facts)

    _run.__name__ = _name
    query(f"SELECT ticker, fiscal_label, normalized, round(raw, 4) AS value FROM {_METRICS} WHERE {_where}", "filings", "facts")(_run)


_SAYING = "(SELECT doc_id, 'Total revenue was $' || CAST(n_chars AS STRING) || ' million and gross margin of ' || CAST(doc_id % 90 AS STRING) || '.5% held.' AS sentence FROM documents)"


@query(
    """SELECT doc_id, 'revenue' AS metric, CAST(n_chars AS DOUBLE) AS claimed_value, 'usd_millions' AS claimed_unit, 'absolute' AS value_type FROM documents
UNION ALL SELECT doc_id, 'gross_margin', doc_id % 90 + 0.5, 'percent', 'percentage' FROM documents""",
    "documents",
)
def i1_extract_numeric_claims(documents):
    said = F.concat(F.lit("Total revenue was $"), F.col("n_chars"), F.lit(" million and gross margin of "), F.col("doc_id") % 90, F.lit(".5% held."))
    return numeric.extract_claims(documents.select("doc_id", said.alias("sentence"))).drop("sentence")


_CLAIMS = """(SELECT accession, fy, fq, value, lower(unit) AS unit, CASE WHEN concept = 'Assets' THEN 'usd' ELSE ['usd', 'usd_thousands', 'usd_millions', 'usd_billions'][fq] END AS claimed_unit,
 CASE WHEN concept = 'Assets' THEN CAST(1 AS DOUBLE) ELSE CAST([1, 1000, 1000000, 1000000000][fq] AS DOUBLE) END AS factor,
 value * (1 + CAST((fy + fq) % 5 - 2 AS DOUBLE) / CAST(200 AS DOUBLE)) / CASE WHEN concept = 'Assets' THEN CAST(1 AS DOUBLE) ELSE CAST([1, 1000, 1000000, 1000000000][fq] AS DOUBLE) END AS claimed_value, concept, CASE WHEN fq = 3 THEN 'percentage' ELSE 'absolute' END AS value_type FROM {facts})"""


def _claims(facts):
    scale = F.when(F.col("concept") == "Assets", 1.0).otherwise(F.get(F.array(*[F.lit(x) for x in (1.0, 1e3, 1e6, 1e9)]), F.col("fq") - 1))
    unit = F.when(F.col("concept") == "Assets", "usd").otherwise(F.get(F.array(*[F.lit(u) for u in ("usd", "usd_thousands", "usd_millions", "usd_billions")]), F.col("fq") - 1))
    stated = F.col("value") * (1 + ((F.col("fy") + F.col("fq")) % 5 - 2) / 200.0) / scale
    kind = F.when(F.col("fq") == 3, "percentage").otherwise("absolute")
    return facts.withColumns({"claimed_unit": unit, "claimed_value": F.when(F.col("fy") != 1999, stated), "value_type": kind, "unit": F.lower("unit")})


@query(f"SELECT accession, concept, round(1 + ((fy + fq) % 5 - 2) / 200.0, 6) AS ratio FROM {_CLAIMS} WHERE fy <> 1999 AND value <> 0 AND concept NOT LIKE 'Weighted%'", "facts")
def i2_rescale_claim(facts):
    rows = _claims(facts).where("fy <> 1999 and value <> 0 and unit = 'usd'")
    scaled = numeric.rescale(F.col("claimed_value"), F.col("claimed_unit"), F.col("unit"))
    return rows.select("accession", "concept", F.round(scaled / F.col("value"), 6).alias("ratio"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_discount = 0 THEN l_tax = 0 ELSE abs(l_tax - l_discount) / abs(l_discount) * 100 <= 1.0 END AS match, CASE WHEN l_discount <> 0 THEN round(abs(l_tax - l_discount) / abs(l_discount) * 100, 4) END AS delta_pct FROM lineitem", "lineitem")
def i3_compare_values(lineitem):
    match, delta = numeric.compare(F.col("l_tax"), F.col("l_discount"), F.lit("absolute"))
    return lineitem.select("l_orderkey", "l_linenumber", match.alias("match"), delta.alias("delta_pct"))


@query(
    f"""SELECT accession, concept, reason, CASE WHEN reason IS NULL THEN CASE WHEN value = 0 THEN scaled = 0 ELSE abs(scaled - value) / abs(value) * CAST(100 AS DOUBLE) <= most END END AS match FROM (
SELECT *, CASE WHEN fy = 1999 THEN 'no claimed value' WHEN value IS NULL OR unit IS NULL THEN 'not calculated' END AS reason,
 CASE WHEN fy <> 1999 THEN claimed_value END * CASE WHEN starts_with(unit, 'usd') THEN factor ELSE 1 END AS scaled, CASE WHEN fq = 3 THEN CAST(0.5 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS most FROM {_CLAIMS})""",
    "facts",
)
def i4_validate_claims(facts):
    """All claims, those at the very edge of the tolerance, filed zeros and shares included: both engines take the same steps in doubles."""
    return numeric.validate_claims(_claims(facts)).select("accession", "concept", "reason", "match")


@query("SELECT l_returnflag AS run, count(CASE WHEN l_discount > 0 THEN 1 END) AS checked, CAST(sum(CASE WHEN l_discount > 0 AND l_tax <> l_discount THEN 1 ELSE 0 END) AS BIGINT) AS mismatches, count(CASE WHEN l_discount = 0 THEN 1 END) AS unverifiable, round(1 - sum(CASE WHEN l_discount > 0 AND l_tax <> l_discount THEN 1 ELSE 0 END) / count(CASE WHEN l_discount > 0 THEN 1 END), 2) AS confidence FROM lineitem GROUP BY l_returnflag", "lineitem")
def i5_validation_summary(lineitem):
    rows = lineitem.select(F.col("l_returnflag").alias("run"), F.when(F.col("l_discount") > 0, F.col("l_tax") == F.col("l_discount")).alias("match"), F.when(F.col("l_discount") == 0, "zero").alias("reason"))
    return numeric.validation_summary(rows, "run")


_NUMS = "list_transform(regexp_extract_all({0}, '\\d[\\d,]*\\.?\\d*'), lambda n: regexp_replace(replace(n, ',', ''), '\\.$', ''))"


@query(f"SELECT doc_id, array_to_string({_NUMS.format('text')}, ' ') AS numbers FROM documents", "documents")
def i6_numeric_tokens(documents):
    return documents.select("doc_id", F.array_join(text.numeric_tokens(F.col("text")), " ").alias("numbers"))


@query(
    f"""SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'recommendation' WHEN doc_id % 10 = 1 THEN 'precision' WHEN len(d) = 0 THEN 'no numbers'
WHEN len(list_filter(d, lambda n: NOT list_contains(e, n))) > 0 THEN 'unsupported' ELSE 'clean' END AS reason FROM (SELECT doc_id, {_NUMS.format('text')} AS d, {_NUMS.format("substr(text, CAST(instr(text, chr(10)) + 1 AS BIGINT))")} AS e FROM documents)""",
    "documents",
)
def i7_unsupported_numbers(documents):
    """Each text against all of it but its first line."""
    asked = F.when(F.col("doc_id") % 10 == 0, "Should I buy this?").when(F.col("doc_id") % 10 == 1, "What is it exactly?").otherwise("What was revenue?")
    return documents.select("doc_id", numeric.verify_reason(F.col("text"), F.substr("text", F.instr("text", F.lit("\n")) + 1), asked).alias("reason"))


def _typed(pairs):
    return pairs.withColumn("doc_type", F.when(F.col("lang") == "en", "transcript").otherwise("filing"))


@query(f"SELECT query_id, doc_id, place FROM (SELECT query_id, doc_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(CAST({_PLAIN.format('query', 'p.text')} AS DOUBLE), 6) DESC, rank) AS INT) AS place FROM {_pool(_ENGLISH)} p) WHERE place <= 8", "documents", "benchmark")
def j1_sentiment_candidates(documents, benchmark):
    rows = _retrieved(documents.where("lang = 'en'"), benchmark)
    return sentiment.sentiment_candidates(_typed(rows)).select("query_id", "doc_id", "place")


@query(None, "documents", "benchmark")
def j2_sentence_passages(documents, benchmark):
    rows = _retrieved(documents.where("lang = 'en'"), benchmark)
    return sentiment.sentence_passages(sentiment.sentiment_candidates(_typed(rows))).select("query_id", "n", "overlap", F.md5("sentence").alias("digest"))


@query(
    """WITH RECURSIVE t AS (SELECT conv_id, turn, list_filter(string_split(regexp_replace(trim(text), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: s <> '') AS l FROM conversations),
s AS (SELECT conv_id, turn, generate_subscripts(l, 1) AS i, len(regexp_extract_all(regexp_replace(unnest(l), '[^\\x00-\\x7F]', 'a', 'g'), '\\S+')) AS n FROM t),
w AS (SELECT conv_id, turn, i, n, n AS used, 0 AS g FROM s WHERE i = 1
 UNION ALL SELECT s.conv_id, s.turn, s.i, s.n, CASE WHEN w.used + s.n > 60 THEN s.n ELSE w.used + s.n END, w.g + CASE WHEN w.used + s.n > 60 THEN 1 ELSE 0 END FROM w JOIN s ON s.conv_id = w.conv_id AND s.turn = w.turn AND s.i = w.i + 1)
SELECT conv_id, turn, max(g) + 1 AS n_windows FROM w GROUP BY conv_id, turn""",
    "conversations",
)
def j3_build_windows(conversations):
    rows = sentiment.build_windows(conversations, 84)
    return rows.where(F.size("windows") > 0).select("conv_id", "turn", (F.array_max(F.transform("windows", lambda w: w["g"])) + 1).alias("n_windows"))


def _count(words):
    return "len(list_filter(w, lambda x: list_contains([" + ", ".join(f"'{x}'" for x in words) + "], x)))"


_SCORES = f"""(SELECT *, round(1 - positive - negative, 4) AS neutral FROM (SELECT conv_id, turn, role, round({_count(sentiment.POSITIVE)} / greatest(len(w), 1), 4) AS positive,
 round({_count(sentiment.NEGATIVE)} / greatest(len(w), 1), 4) AS negative FROM (SELECT conv_id, turn, role, regexp_extract_all(lower(text), '[a-z]+') AS w FROM conversations)))"""
_LABEL_COUNTS = "CAST(count_if(positive > negative) AS BIGINT) AS positive, CAST(count_if(negative > positive) AS BIGINT) AS negative, CAST(count_if(positive = negative) AS BIGINT) AS neutral"


@query(f"SELECT conv_id, turn, positive, negative, neutral FROM {_SCORES}", "conversations")
def j4_score_sentiment(conversations):
    return conversations.select("conv_id", "turn", sentiment.lexicon_scores(F.col("text")).alias("s")).select("conv_id", "turn", "s.*")


@query(f"SELECT conv_id, CASE WHEN p >= greatest(n, u) THEN 'positive' WHEN n >= greatest(p, u) THEN 'negative' ELSE 'neutral' END AS label FROM (SELECT conv_id, sum(positive * (turn + 1)) AS p, sum(negative * (turn + 1)) AS n, sum(neutral * (turn + 1)) AS u FROM {_SCORES} GROUP BY conv_id)", "conversations")
def j5_aggregate_sentiment(conversations):
    rows = conversations.select("conv_id", sentiment.lexicon_scores(F.col("text")).alias("s"), (F.col("turn") + 1).alias("weight")).select("conv_id", "weight", "s.*")
    return sentiment.aggregate_sentiment(rows, "conv_id").select("conv_id", "label")


def _labelled(conversations, by: str):
    """Each turn by which of the scorer's two scores is higher."""
    rows = conversations.select(by, sentiment.lexicon_scores(F.col("text")).alias("s"))
    return rows.select(by, F.when(F.col("s.positive") > F.col("s.negative"), "positive").when(F.col("s.negative") > F.col("s.positive"), "negative").otherwise("neutral").alias("label"))


@query(f"SELECT role, {_LABEL_COUNTS} FROM {_SCORES} GROUP BY role", "conversations")
def j6_sentiment_counts(conversations):
    return sentiment.sentiment_counts(_labelled(conversations, "role"), "role")


@query(None, "conversations")
def k2_align_statements(conversations):
    """Each conversation's statements against those of the conversation before it."""
    rows = conversations.select("conv_id", F.col("turn").alias("t"), F.posexplode(text.sentences(F.col("text"))).alias("p", "sentence"))
    rows = rows.withColumn("place", F.struct("t", "p"))
    out = comparison.align_statements(rows, rows.withColumn("conv_id", F.col("conv_id") + 1), "conv_id")
    place = [F.col(f"{c}.{k}").alias(f"{c}_{k}") for c in ("place", "prior_place") for k in ("t", "p")]
    return out.select("conv_id", *place, "overlap", comparison.detect_shift(F.col("current"), F.col("prior")).alias("shift"))


_LINES = ("Revenue grew 10% this year.", "revenue grew 10% this year", "This year, revenue grew 10%.", "Revenue grew 10.5% this year.", "Revenue declined 10% this year.", "Revenue grew 90% this year.")


@query("SELECT o_orderkey, CASE o_orderkey % 7 WHEN 4 THEN true WHEN 5 THEN true WHEN 6 THEN true ELSE false END AS shift FROM orders", "orders")
def k3_known_shifts(orders):
    """Pairs of statements with known answers."""
    prior = F.when(F.col("o_orderkey") % 7 < 6, F.get(F.array(*[F.lit(x) for x in _LINES]), (F.col("o_orderkey") % 7).cast("int")))
    return orders.select("o_orderkey", comparison.detect_shift(F.lit(_LINES[0]), prior).alias("shift"))


_DIRECTIONS = {k: "[" + ", ".join(f"'{w}'" for w in words) + "]" for k, words in (("up", comparison.UP), ("down", comparison.DOWN))}
_FIRST_NUMBER = "TRY_CAST((list_transform(regexp_extract_all({0}, '\\d[\\d,]*\\.?\\d*'), lambda n: regexp_replace(replace(n, ',', ''), '\\.$', '')))[1] AS DOUBLE)"


@query(
    f"""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
e AS (SELECT doc_id, generate_subscripts(l, 1) - 1 AS i, unnest(l) AS line FROM l),
p AS (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY i) AS prior FROM e),
w AS (SELECT *, trim(regexp_replace(lower(line), '[^a-z0-9.%]+', ' ', 'g')) AS pa, trim(regexp_replace(lower(prior), '[^a-z0-9.%]+', ' ', 'g')) AS pb,
 list_sort(regexp_extract_all(lower(line), '[a-z0-9]+')) AS wa, list_sort(regexp_extract_all(lower(prior), '[a-z0-9]+')) AS wb,
 list_sort(regexp_extract_all(lower(line), '[a-z]+')) AS la, list_sort(regexp_extract_all(lower(prior), '[a-z]+')) AS lb, {_FIRST_NUMBER.format('line')} AS na, {_FIRST_NUMBER.format('prior')} AS nb FROM p),
h AS (SELECT *, list_has_any(la, {_DIRECTIONS['up']}) AS ua, list_has_any(la, {_DIRECTIONS['down']}) AS da, list_has_any(lb, {_DIRECTIONS['up']}) AS ub, list_has_any(lb, {_DIRECTIONS['down']}) AS db, nb <> 0 AND abs(na - nb) / abs(nb) <= CAST(0.1 AS DOUBLE) AS small FROM w)
SELECT doc_id, CAST(i AS INT) AS i, CASE WHEN prior IS NULL THEN true WHEN pa = pb OR wa = wb THEN false WHEN (ua AND db AND NOT ub) OR (da AND ub AND NOT ua) THEN true
 WHEN la = lb AND coalesce(small, false) THEN false ELSE la <> lb OR NOT coalesce(small, true) END AS shift FROM h""",
    "documents",
)
def k3_detect_shift(documents):
    """Each line of each document against the line before it."""
    lines = documents.select("doc_id", F.transform(F.split("text", "\n"), comparison.told).alias("l"))
    shifts = F.transform("l", lambda now, i: comparison.shift_of(now, F.get(F.col("l"), i - 1)))
    return lines.select("doc_id", F.posexplode(shifts).alias("i", "shift"))


@query("SELECT conv_id, string_agg(CAST(turn AS STRING) || '=' || role, ',' ORDER BY CAST(turn AS STRING)) AS language FROM conversations GROUP BY conv_id", "conversations")
def k4_findings_to_map(conversations):
    rows = comparison.findings_to_map(conversations.withColumn("label", F.col("turn").cast("string")), "conv_id", "label", "role")
    pairs = F.transform(F.array_sort(F.map_entries("prior_language")), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return rows.select("conv_id", F.array_join(pairs, ",").alias("language"))


def _statements(documents, benchmark):
    """Every sentence of each query's pool as ``statement``, one that occurs in several documents in the best of them."""
    rows = _retrieved(documents, benchmark)
    said = rows.select("query_id", "doc_id", "rank", F.explode(text.sentences(F.col("content"))).alias("statement"))
    said = said.groupBy("query_id", "statement").agg(F.min_by("doc_id", "rank").alias("doc_id")).join(_asked(benchmark), "query_id")
    # a sentence of a document is grounded in it, so it is its own context
    return said.withColumn("content", F.col("statement"))


@query(None, "documents", "benchmark")
def k5_select_finding(documents, benchmark):
    return comparison.select_finding(_statements(documents, benchmark), "query_id", F.col("query"), F.col("content"), "statement").select("query_id", "doc_id", "score", "grounded")


_PERIOD = "'FY' || CAST(2020 + CAST(substr(source, 4) AS INT) // 4 AS STRING) || '-Q' || CAST(CAST(substr(source, 4) AS INT) % 4 + 1 AS STRING)"


@query(
    f"""{_BM25},
runs AS (SELECT item_id, lang, item_id || ':' || lang AS run_id, {_LETTER_SQL.format('b.text')} AS q FROM benchmark b, (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL)),
asked AS (SELECT *, unnest(['FY2024-Q3', 'FY2023-Q4', 'last year']) AS label, unnest(['FY2024-Q3', 'FY2023-Q4', 'FY2024-Q1']) AS target, unnest([1, 4, 3]) AS back FROM runs),
docs AS (SELECT doc_id, text, lang, {_PERIOD} AS period, {_LETTER_SQL.format('text')} AS v FROM documents),
lexical AS (SELECT run_id, label, id, row_number() OVER (PARTITION BY run_id, label ORDER BY score DESC, id) AS rank FROM asked a JOIN s ON s.query_id = item_id JOIN docs d ON doc_id = id AND d.lang = a.lang AND period = target),
near AS (SELECT run_id, label, doc_id AS id, row_number() OVER (PARTITION BY run_id, label ORDER BY CASE WHEN list_max(v) > 0 AND list_max(q) > 0 THEN round({_COS.format('v', 'q')}, 9) ELSE 0 END DESC, doc_id) AS rank
 FROM asked a JOIN docs d ON d.lang = a.lang AND period = target),
fused AS (SELECT run_id, label, id, round(sum(CAST(1.0 AS DOUBLE) / (60 + rank)), 9) AS score FROM (SELECT * FROM lexical WHERE rank <= 50 UNION ALL SELECT * FROM near WHERE rank <= 50) GROUP BY run_id, label, id),
hits AS (SELECT run_id, label, list({{'used': length(text), 'out': text}} ORDER BY rank) AS c FROM (SELECT *, row_number() OVER (PARTITION BY run_id, label ORDER BY score DESC, id) AS rank FROM fused) JOIN docs ON doc_id = id WHERE rank <= 5 AND text <> '' GROUP BY run_id, label),
said AS (SELECT run_id, label, list_reduce(c, lambda a, t: CASE WHEN a.used + t.used <= 2000 THEN {{'used': a.used + t.used, 'out': CASE WHEN a.out = '' THEN t.out ELSE a.out || chr(10) || chr(10) || t.out END}} ELSE a END, {{'used': CAST(0 AS BIGINT), 'out': ''}}).out AS context FROM hits)
SELECT run_id, label, target, CAST(back AS INT) AS back, md5(context) AS digest FROM asked JOIN said USING (run_id, label) WHERE context <> ''""",
    "documents",
    "benchmark",
)
def k1_prior_contexts(documents, benchmark):
    """What each language said of each benchmark text in three earlier quarters; a source is a quarter, a label that cannot be read goes by its place."""
    period = F.concat(F.lit("FY"), (2020 + F.floor(F.substring("source", 4, 9).cast("int") / 4)).cast("string"), F.lit("-Q"), (F.substring("source", 4, 9).cast("int") % 4 + 1).cast("string"))
    chunks = documents.select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"), _letter_counts("text").alias("embedding"), F.col("lang").alias("ticker"), period.alias("fiscal_label"))
    companies = documents.select(F.col("lang").alias("company")).where("company is not null").distinct()
    asked = benchmark.select("item_id", F.col("text").alias("query")).withColumn("vector", _letter_counts("query"))
    runs = asked.join(F.broadcast(companies.groupBy().agg(F.collect_set("company").alias("all"))), F.lit(True)).withColumn("company", F.explode("all")).drop("all")
    runs = runs.select(F.concat_ws(":", "item_id", "company").alias("run_id"), "company", F.lit("FY2024-Q4").alias("fiscal_label"), "query", "vector", F.array(F.lit("FY2024-Q3"), F.lit("FY2023-Q4"), F.lit("last year")).alias("comparison"))
    found = comparison.prior_quarter_contexts(runs, chunks)
    return found.select("run_id", "label", "target", F.col("back").cast("int").alias("back"), F.md5("context").alias("digest"))


def _re(patterns):
    return "|".join(patterns).replace("'", "''")


_ANY = lambda terms: _re(t.replace(".", r"\.").replace("&", "&") for t in terms)
_GUARD = rf"""CASE WHEN regexp_matches(text, '{_re(p for _, p in guardrails.PII)}') THEN 'pii'
 WHEN regexp_matches(text, '{_re(f"(?:{p})" for p in guardrails.INJECTION)}') THEN 'prompt_injection'
 WHEN regexp_matches(lower(text), '{_ANY(guardrails.HARMFUL)}') THEN 'harmful_content'
 WHEN NOT regexp_matches(lower(text), '{_ANY(guardrails.DOMAIN)}') THEN 'off_topic' END"""


@query(f"SELECT conv_id, turn, {_GUARD} AS category FROM conversations", "conversations")
def l1_guardrail_check(conversations):
    return conversations.select("conv_id", "turn", guardrails.violation(F.col("text")).alias("category"))


@query(f"SELECT conv_id, turn, CASE WHEN trim(text) = '' OR regexp_matches(text, '{guardrails.PRIMARY}') THEN 'primary' WHEN regexp_matches(text, '{guardrails.STANDARD}') THEN 'standard' ELSE 'primary' END AS tier FROM conversations", "conversations")
def l2_classify_query(conversations):
    return conversations.select("conv_id", "turn", guardrails.query_tier(F.col("text")).alias("tier"))


@query(
    """SELECT query_id, md5(string_agg('[' || upper(lang) || '] ' || body, chr(10) || chr(10) ORDER BY rank)) AS digest FROM (
SELECT *, row_number() OVER (PARTITION BY query_id, body ORDER BY rank) AS n FROM (SELECT query_id, rank, lang, text AS body FROM """ + _pool(k=8) + """)) WHERE n = 1 GROUP BY query_id""",
    "documents",
    "benchmark",
)
def m1_evidence_text(documents, benchmark):
    """Whole texts of the best hits."""
    rows = _retrieved(documents, benchmark, 8).withColumns({"parent_content": F.lit(""), "doc_type": F.col("lang")})
    return evidence.evidence_text(rows).select("query_id", F.md5("evidence").alias("digest"))


@query(f"SELECT conv_id, 'positive=' || CAST(positive AS STRING) || ' negative=' || CAST(negative AS STRING) || ' neutral=' || CAST(neutral AS STRING) || ' across ' || CAST(n AS STRING) || ' passages' AS line FROM (SELECT conv_id, {_LABEL_COUNTS}, count(*) AS n FROM {_SCORES} GROUP BY conv_id)", "conversations")
def m2_extra_evidence(conversations):
    rows = sentiment.sentiment_counts(_labelled(conversations, "conv_id"), "conv_id")
    return rows.select("conv_id", evidence.sentiment_line(F.col("positive"), F.col("negative"), F.col("neutral")).alias("line"))


@query("SELECT query_id, md5(string_agg('[' || lang || '] ' || substr(text, 1, 300), chr(10) ORDER BY rank)) AS digest FROM " + _pool(k=10) + " WHERE rank <= 10 GROUP BY query_id", "documents", "benchmark")
def m3_debate_evidence(documents, benchmark):
    return evidence.debate_evidence(_retrieved(documents, benchmark, 10).withColumn("doc_type", F.col("lang"))).select("query_id", F.md5("evidence").alias("digest"))


@query(
    """SELECT o_orderkey AS run_id, md5('Company: ' || CAST(o_custkey AS STRING) || chr(10) || 'Run ID: ' || CAST(o_orderkey AS STRING) || chr(10) || repeat('=', 60) || chr(10)
 || coalesce(nullif(o_orderpriority, ''), '(No report generated)') || chr(10) || repeat('=', 60) || chr(10) || 'NUMERIC VALIDATIONS' || chr(10) || coalesce(lines, '')) AS digest
FROM orders LEFT JOIN (SELECT l_orderkey, string_agg(line, chr(10) ORDER BY claim, line) AS lines FROM (SELECT l_orderkey, 'line ' || CAST(l_linenumber AS STRING) AS claim,
 CASE WHEN l_tax = l_discount THEN '✓' ELSE '✗' END || '  line ' || CAST(l_linenumber AS STRING) || '  —  stated: ' || CAST(l_tax AS STRING) || '  filing-derived: ' || CAST(l_discount AS STRING) AS line FROM lineitem) GROUP BY l_orderkey) ON l_orderkey = o_orderkey""",
    "orders",
    "lineitem",
)
def m4_report_lines(orders, lineitem):
    runs = orders.select(F.col("o_orderkey").alias("run_id"), F.col("o_custkey").cast("string").alias("company"), F.nullif("o_orderpriority", F.lit("")).alias("report"))
    checks = lineitem.select(F.col("l_orderkey").alias("run_id"), (F.col("l_tax") == F.col("l_discount")).alias("match"), F.concat(F.lit("line "), F.col("l_linenumber")).alias("claim"), F.col("l_tax").alias("claimed_value"), F.col("l_discount").alias("value"))
    return evidence.report_lines(runs, checks).select("run_id", F.md5("export").alias("digest"))


@query("SELECT o_orderkey AS run_id, CASE WHEN o_orderstatus = 'P' THEN 'failed' ELSE 'completed' END AS status, coalesce(n, 0) AS n_lines FROM orders LEFT JOIN (SELECT l_orderkey, CAST(count(*) AS INT) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey", "orders", "lineitem")
def m5_assemble_run(orders, lineitem):
    runs = orders.select(F.col("o_orderkey").alias("run_id"), F.when(F.col("o_orderstatus") == "P", "stopped").alias("error"))
    lines = lineitem.select(F.col("l_orderkey").alias("run_id"), "l_linenumber", "l_quantity")
    out = evidence.assemble_runs(runs, "run_id", lines=lines)
    return out.select("run_id", "status", F.coalesce(F.size("lines"), F.lit(0)).alias("n_lines"))
