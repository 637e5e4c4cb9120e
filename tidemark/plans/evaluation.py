"""Queries of evaluation, golden data, and cache, log and event analytics, in batch and as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.operators import analytics, evaluation, parsing
from tidemark.plans import analysis, ingestion
from tidemark.plans.registry import ORACLE_SQL, QUERIES, query
from tidemark.plans.views import view
from tidemark.staging import shared_path
from tidemark.streaming import streams

_TYPES = ("numeric", "retrieval", "comparison", "out_of_scope", "sentiment")
_TYPE = "['numeric', 'retrieval', 'comparison', 'out_of_scope', 'sentiment'][CAST({0} % 5 + 1 AS INT)]"


def _type(key):
    return F.get(F.array(*[F.lit(t) for t in _TYPES]), (key % 5).cast("int"))


_HITS = "(SELECT user_id AS claim_id, event_type AS section, CAST(event_id % 7 AS STRING) AS accession, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events)"
_ANCHORS = "(SELECT DISTINCT user_id AS claim_id, CAST(event_id % 7 AS STRING) AS accession, event_type AS section FROM events WHERE value > 250)"
_PR = f"""(SELECT claim_id, round(coalesce(h, 0) / 5, 4) AS precision, round(least(1.0, coalesce(h, 0) / a), 4) AS recall FROM
(SELECT claim_id, count(*) AS a FROM {_ANCHORS} GROUP BY claim_id) LEFT JOIN
(SELECT h.claim_id, count(*) AS h FROM {_HITS} h JOIN {_ANCHORS} a ON a.claim_id = h.claim_id AND a.accession = h.accession AND a.section = h.section WHERE rank <= 5 GROUP BY h.claim_id) USING (claim_id))"""


def _precision(events):
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id"))
    rows = events.select(F.col("user_id").alias("claim_id"), F.upper("event_type").alias("section"), (F.col("event_id") % 7).cast("string").alias("accession"), rank.alias("rank"), "value")
    anchors = rows.where("value > 250").select("claim_id", "accession", "section")
    return evaluation.precision_recall_at_k(rows, anchors, 5).join(anchors.select("claim_id").distinct(), "claim_id", "left_semi")


@query(f"SELECT claim_id, precision, CAST(recall AS DOUBLE) AS recall FROM {_PR}", "events")
def p1_precision_recall_at_k(events):
    return _precision(events)


@query(f"SELECT round(avg(precision), 4) AS precision, round(avg(CAST(recall AS DOUBLE)), 4) AS recall FROM {_PR}", "events")
def p2_mean_retrieval_metrics(events):
    return evaluation.mean_metrics(_precision(events), "precision", "recall")


@query(
    f"""WITH c AS (SELECT item_id AS claim_id, {_TYPE.format('item_id')} AS claim_type FROM benchmark),
a AS (SELECT claim_type, greatest(1, round_even(20 * CASE claim_type WHEN 'numeric' THEN 0.35 WHEN 'retrieval' THEN 0.20 WHEN 'comparison' THEN 0.17 WHEN 'sentiment' THEN 0.15 ELSE 0.13 END, 0)) AS slots FROM c GROUP BY claim_type),
b AS (SELECT *, 20 - sum(slots) OVER () AS off, row_number() OVER (ORDER BY slots DESC, claim_type) AS place FROM a),
p AS (SELECT c.*, row_number() OVER (PARTITION BY c.claim_type ORDER BY md5('42|' || CAST(claim_id AS STRING)), claim_id) AS pick FROM c)
SELECT p.claim_id, p.claim_type FROM p JOIN b ON b.claim_type = p.claim_type WHERE pick <= slots + CASE WHEN place = 1 THEN off ELSE 0 END""",
    "benchmark",
)
def p3_stratified_sample(benchmark):
    claims = benchmark.select(F.col("item_id").alias("claim_id"), _type(F.col("item_id")).alias("claim_type"))
    return evaluation.stratified_sample(claims, 20).select("claim_id", "claim_type")


@query(
    f"""SELECT item_id, CASE {_TYPE.format('item_id')} WHEN 'comparison' THEN 'Did this language shift from the prior quarter? ' || text
WHEN 'sentiment' THEN 'What is the sentiment of this statement by CEO: "' || text || '"' ELSE text END AS question FROM benchmark""",
    "benchmark",
)
def p4_build_eval_query(benchmark):
    return benchmark.select("item_id", evaluation.eval_query(_type(F.col("item_id")), F.col("text"), F.lit("CEO")).alias("question"))


@query("SELECT f.accession AS claim_id, g.accession, 'mda' AS section FROM {filings} f JOIN {filings} g ON g.cik = f.cik AND (g.fy * 4 + g.fq = f.fy * 4 + f.fq OR f.fq <> 3 AND g.fy * 4 + g.fq = f.fy * 4 + f.fq - 1)", "filings")
def p5_ground_truth_anchors(filings):
    prior = filings.select("cik", (F.col("fy") * 4 + F.col("fq") + 1).alias("i"), F.col("accession").alias("p_accession"), F.col("fiscal_label").alias("p_label"))
    rows = filings.withColumn("i", F.col("fy") * 4 + F.col("fq")).join(prior, ["cik", "i"], "left")
    anchor = lambda label, acc: F.struct(label.alias("fiscal_label"), acc.alias("accession"), F.lit("mda").alias("section"))
    kind = F.when(F.col("fq") == 3, "comparison").otherwise("retrieval")
    claims = rows.select(F.col("accession").alias("claim_id"), kind.alias("claim_type"), "fiscal_label", F.array(anchor(F.col("fiscal_label"), F.col("accession")), anchor(F.col("p_label"), F.col("p_accession"))).alias("anchors"))
    return evaluation.ground_truth_anchors(claims)


@query("SELECT doc_id, md5('kept' || chr(10) || 'tail ' || source) AS digest FROM documents", "documents")
def p7_strip_absence(documents):
    answer = F.concat(F.lit("## Key numbers\nkept\nNo verified data available. [FILING]\ntail "), F.col("source"))
    return documents.select("doc_id", F.md5(text.strip_absence(answer)).alias("digest"))


@query("SELECT source, count(*) AS items, round(CAST(sum(quality) AS DOUBLE) / count(*), 4) AS ratio FROM {labelled} GROUP BY source", "labelled")
def p8_ratio_metrics(labelled):
    return evaluation.ratio_metrics(labelled.withColumn("ok", F.col("quality") == 1), "source", "ok", F.lit("an answer"))


@query("SELECT round(avg(CAST(quality AS DOUBLE)), 4) AS quality, round(avg(CAST(quality AS DOUBLE)), 4) AS recall, round(avg(CASE WHEN toxic = 0 THEN CAST(quality AS DOUBLE) END), 4) AS recall_in_scope FROM {labelled}", "labelled")
def p9_mean_scores(labelled):
    rows = labelled.select(F.col("quality").cast("double").alias("quality"), F.col("quality").cast("double").alias("recall"), "toxic")
    return evaluation.mean_scores(rows, "quality", "recall", out_of_scope=F.col("toxic") == 1)


@query(
    f"""SELECT p_partkey, round((least(5, greatest(1, p_size % 7)) * wa + least(5, greatest(1, p_size % 6)) * wg + least(5, greatest(1, p_size % 5)) * wr), 1) AS overall
FROM (SELECT *, {_TYPE.format('p_partkey')} AS t FROM part) JOIN (VALUES ('numeric', 0.6, 0.3, 0.1), ('out_of_scope', 0.7, 0.1, 0.2), ('comparison', 0.4, 0.3, 0.3), ('retrieval', 0.3, 0.4, 0.3), ('sentiment', 0.5, 0.3, 0.2)) w(t, wa, wg, wr) USING (t)""".replace("SELECT p_partkey, round((", "SELECT p_partkey, CAST(round((").replace(", 1) AS overall", ", 2) AS DOUBLE) AS overall"),
    "part",
)
def p10_weighted_judge(part):
    s = F.col("p_size")
    rows = part.select("p_partkey", _type(F.col("p_partkey")).alias("claim_type"), (s % 7).alias("accuracy"), (s % 6).alias("grounding"), (s % 5).alias("relevancy"))
    return evaluation.weighted_judge(rows).select("p_partkey", "overall")


@query("SELECT d.doc_id, d.n_chars, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id", "documents", "labels")
def p11_merge_per_claim(documents, labels):
    return documents.select("doc_id", "n_chars").join(labels, "doc_id", "left")


@query(
    """SELECT metric, floor, value, coalesce(value >= floor, false) AS passed, false AS all_passed FROM (VALUES ('ragas_faithfulness', 0.80), ('ragas_answer_relevancy', 0.80), ('ragas_context_precision', 0.65),
('ragas_context_recall_excl_oos', 0.65), ('precision_at_5', 0.55), ('recall_at_5', 0.90), ('llm_judge_mean', 3.30)) f(metric, floor) LEFT JOIN (SELECT 'recall_at_5' AS metric, round(avg(CAST(quality AS DOUBLE)), 4) AS value FROM labels) USING (metric)""".replace("SELECT metric, floor,", "SELECT metric, CAST(floor AS DOUBLE) AS floor,"),
    "labels",
)
def p12_gate_check(labels):
    metrics = labels.agg(F.round(F.avg(F.col("quality").cast("double")), 4).alias("value")).select(F.lit("recall_at_5").alias("metric"), "value")
    return evaluation.gate_check(metrics)


@query("SELECT l_orderkey, 'no discount' AS rule FROM lineitem WHERE l_discount = 0 UNION ALL SELECT l_orderkey, 'taxed return' FROM lineitem WHERE l_returnflag = 'R' AND l_tax > 0.07 UNION ALL SELECT l_orderkey, 'too many' FROM lineitem WHERE l_quantity > 48", "lineitem")
def p13_validate_claims_schema(lineitem):
    rules = {"no discount": F.col("l_discount") == 0, "taxed return": (F.col("l_returnflag") == "R") & (F.col("l_tax") > 0.07), "too many": F.col("l_quantity") > 48}
    return evaluation.violations(lineitem, "l_orderkey", rules)


@query("SELECT o_orderkey AS claim_id, 'no such customer filing' AS error FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) UNION ALL SELECT o_orderkey, 'no such period' FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber > 2)", "orders", "customer", "lineitem")
def p14_check_anchor_integrity(orders, customer, lineitem):
    a = orders.join(customer.where("c_acctbal > 0"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select(F.col("o_orderkey").alias("claim_id"), F.lit("no such customer filing").alias("error"))
    b = orders.join(lineitem.where("l_linenumber > 2"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select(F.col("o_orderkey").alias("claim_id"), F.lit("no such period").alias("error"))
    return a.unionByName(b)


@query("SELECT f.accession AS current, g.accession AS prior FROM {filings} f JOIN {filings} g ON g.fiscal_label = f.fiscal_label AND g.fq = f.fq AND CAST(g.cik AS INT) % 5 = CAST(f.cik AS INT) % 5 WHERE g.cik <> f.cik OR g.report_date >= f.report_date", "filings")
def p15_check_prior_adjacency(filings):
    k = filings.select("fiscal_label", (F.col("cik").cast("int") % 5).alias("k"), "accession")
    pairs = k.withColumnRenamed("accession", "current").join(k.withColumnRenamed("accession", "prior"), ["fiscal_label", "k"]).select("current", "prior")
    return evaluation.prior_adjacency(pairs, filings)


@query("SELECT text_key, n FROM (SELECT md5(text) AS text_key, count(*) AS n FROM documents GROUP BY text) WHERE n > 1", "documents")
def p16_duplicate_ids(documents):
    return evaluation.duplicate_ids(documents.select(F.md5("text").alias("text_key")), "text_key")


@query(
    """SELECT claim_type, edge_case, count(*) AS n, CASE WHEN claim_type IS NULL THEN 'total' WHEN edge_case IS NULL THEN 'type' ELSE 'edge' END AS level FROM {golden} GROUP BY ROLLUP (claim_type, edge_case)""",
    "golden",
)
def p17_coverage_report(golden):
    return evaluation.coverage(golden)


@query(None, "documents", "benchmark")
def p6_typed_answer(documents, benchmark):
    """Per claim the document sentence that answers it best, the first in order of text of equal overlap."""
    from tidemark.operators import comparison
    from tidemark.plans.analysis import _statements

    return comparison.select_finding(_statements(documents, benchmark), "query_id", F.col("query"), F.col("content"), "statement").select("query_id", "doc_id", "score")


@query("SELECT event_id, 'search::' || substr(sha256(lower(trim(event_type)) || '::' || upper(CAST(user_id AS STRING)) || '::Q1::all'), 1, 16) AS cache_key FROM events", "events")
def q1_cache_keys(events):
    return events.select("event_id", analytics.cache_key("search", F.col("event_type"), F.col("user_id").cast("string"), F.lit("q1"), F.lit("")).alias("cache_key"))


_TTL = """WITH RECURSIVE s AS (SELECT user_id, event_type, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS i FROM events),
w AS (SELECT user_id, event_type, event_id, i, t AS set_at, false AS hit FROM s WHERE i = 1
UNION ALL SELECT s.user_id, s.event_type, s.event_id, s.i, CASE WHEN s.t - w.set_at < 86400000000 THEN w.set_at ELSE s.t END, s.t - w.set_at < 86400000000 FROM w JOIN s ON s.user_id = w.user_id AND s.event_type = w.event_type AND s.i = w.i + 1)"""


@query(f"{_TTL} SELECT event_id, hit FROM w", "requests")
def q2_ttl_hits(requests):
    return analytics.ttl_hits(requests, "request_key", "ts", "event_id", 86_400).select("event_id", "hit")


@query(
    f"{_TTL} SELECT coalesce(event_type, 'all') AS level, CAST(count_if(hit) AS BIGINT) AS hits, CAST(count_if(NOT hit) AS BIGINT) AS misses, round(CAST(count_if(hit) AS DOUBLE) / count(*), 4) AS hit_rate FROM w GROUP BY ROLLUP (event_type)",
    "requests",
)
def q3_cache_stats(requests):
    return analytics.cache_stats(analytics.ttl_hits(requests, "request_key", "ts", "event_id", 86_400), "event_type")


@query(
    """SELECT user_id, event_id AS start_id, round(CASE WHEN next_type = 'purchase' THEN (epoch_us(next_ts) - epoch_us(ts)) / 1000000.0 END, 3) AS seconds FROM (
SELECT *, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_type, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_ts FROM events WHERE event_type IN ('view', 'purchase')) WHERE event_type = 'view'""",
    "events",
)
def q4_stage_durations(events):
    return analytics.stage_durations(events, ["user_id"], "ts", F.col("event_type") == "view", F.col("event_type") == "purchase", "event_id")


@query(
    "SELECT event_type, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, round(avg(value), 6) AS mean, round(CAST(count_if(value > 300) AS DOUBLE) / count(*), 6) AS error_rate FROM events GROUP BY event_type",
    "events",
)
def q5_latency_percentiles(events):
    return analytics.latency_percentiles(events, "value", F.col("value") > 300, ["event_type"])


_KIND = "CASE event_type WHEN 'error' THEN 'draft_reset' WHEN 'signup' THEN 'final' ELSE 'token' END"
_DRAFT = f"""WITH e AS (SELECT user_id, event_id, {_KIND} AS kind, CAST(event_id AS STRING) || ' ' AS piece FROM events),
r AS (SELECT *, sum(CASE WHEN kind <> 'token' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS g FROM e),
l AS (SELECT *, max(g) OVER (PARTITION BY user_id) AS last FROM r)
SELECT user_id, coalesce(string_agg(CASE WHEN g = last AND kind <> 'draft_reset' THEN piece END, '' ORDER BY event_id), '') AS draft, false AS done FROM l GROUP BY user_id"""


def _drafts(events):
    kind = F.when(F.col("event_type") == "error", "draft_reset").when(F.col("event_type") == "signup", "final").otherwise("token")
    return events.select("user_id", "event_id", kind.alias("kind"), F.concat(F.col("event_id").cast("string"), F.lit(" ")).alias("piece"))


@query(_DRAFT, "events")
def q6_draft_fold(events):
    return analytics.draft_fold(_drafts(events), "user_id", ["event_id"], "kind", "piece")


@query("SELECT run_id, event_id, CAST(row_number() OVER (PARTITION BY run_id ORDER BY ts, event_id) AS INT) AS place FROM {decision_log}", "decision_log")
def q7_merge_logs(log):
    a, b = log.where("agent = 'view'"), log.where("agent <> 'view'")
    return analytics.merge_logs(a, b).select("run_id", "event_id", "place")


@query("SELECT agent, count(*) AS calls, count(DISTINCT run_id) AS runs, round(sum(latency_ms), 2) AS latency, round(avg(latency_ms), 4) AS mean_latency, round(max(latency_ms), 6) AS max_latency FROM {decision_log} GROUP BY agent", "decision_log")
def q8_run_log_summary(log):
    return analytics.run_log_summary(log).withColumns({"latency": F.round("latency", 2), "mean_latency": F.round("mean_latency", 4)})


@query(
    """SELECT event_id, first_value(CASE WHEN value > 100 THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS served_by FROM events""",
    "requests",
)
def q9_dedup_requests(requests):
    return analytics.dedup_requests(requests, "request_key", "ts", "event_id", F.col("value") > 100).select("event_id", "served_by")


def _checkpoint(spark) -> str:
    return shared_path(spark, "stream")


def _event_stream(spark, sf_dir) -> DataFrame:
    schema = view(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")


def q2_stream_ttl_hits(spark, sf_dir):
    """The cache replay as a stream over the same events."""
    key = F.concat(F.col("user_id").cast("string"), F.lit("::"), F.col("event_type"))
    rows = _event_stream(spark, sf_dir).withColumn("request_key", key)
    out = streams.stream_ttl_hits(rows, "request_key", "ts", "event_id", 86_400)
    return streams.run_to_end(out, "ttl", "append", _checkpoint(spark)).select("event_id", "hit")


def q4_stream_stage_durations(spark, sf_dir):
    """All ends within a day after each start of the same user, by a stream-stream interval join."""
    out = streams.stream_stage_durations(_event_stream(spark, sf_dir), ["user_id"], "ts", F.col("event_type") == "signup", F.col("event_type") == "purchase", "1 day")
    return streams.run_to_end(out, "stages", "append", _checkpoint(spark)).groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.sum("seconds"), 1).alias("seconds"))


def q6_stream_drafts(spark, sf_dir):
    """Draft folding with keyed state, over the same events."""
    out = streams.stream_drafts(_drafts(_event_stream(spark, sf_dir)), "user_id", "event_id", "kind", "piece")
    rows = streams.run_to_end(out, "drafts", "update", _checkpoint(spark))
    last = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("batch")))
    return rows.withColumn("_n", last).where("_n = 1").select("user_id", "draft", "done")


def _filing_tables(batch):
    """Sections of a batch's pages, their sentences as chunks, and the numbers that the documents state."""
    sections = parsing.parse_filings(ingestion._whole_pages(batch, True)).withColumnRenamed("id", "doc_id")
    chunks = sections.select("doc_id", "section", F.posexplode(text.sentences(F.col("body"))).alias("place", "content"))
    facts = batch.select("doc_id", F.posexplode(text.numeric_tokens(F.col("text"))).alias("place", "number"))
    return {"sections": sections, "chunks": chunks, "facts": facts}


def q10_incremental_ingest(spark, sf_dir):
    """Documents arrive as files, one or more to a batch, and are parsed, chunked and searched for numbers; three tables are read as of the last commit."""
    folder = _checkpoint(spark)
    schema = view(spark, sf_dir, "documents").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 8).parquet(f"{sf_dir}/documents.parquet*")
    streams.ingest_tables(stream, _filing_tables, "doc_id", f"{folder}/tables", f"{folder}/state").awaitTermination()
    counted = None
    for name in ("sections", "chunks", "facts"):
        rows = streams.committed(spark, f"{folder}/tables", name).groupBy("doc_id").agg(F.count("*").alias("n")).withColumn("kept", F.lit(name))
        counted = rows if counted is None else counted.unionByName(rows)
    return counted


QUERIES |= {f.__name__: f for f in (q2_stream_ttl_hits, q4_stream_stage_durations, q6_stream_drafts, q10_incremental_ingest)}


_INGESTED = f"""WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
e AS (SELECT doc_id, generate_subscripts(l, 1) - 1 AS i, trim(regexp_replace(unnest(l), '\\s+', ' ', 'g')) AS line FROM l),
b AS (SELECT doc_id, i % 3 AS k, string_agg(line, ' ' ORDER BY i) AS said FROM e WHERE line <> '' GROUP BY doc_id, i % 3),
p AS (SELECT d.doc_id, 'Item ' || CAST(k + 2 AS STRING) || '. Section' || coalesce(' ' || said, '') AS body FROM documents d CROSS JOIN (VALUES (0), (1), (2)) v(k) LEFT JOIN b USING (doc_id, k))
SELECT doc_id, 'sections' AS kept, count(*) AS n FROM p GROUP BY doc_id
UNION ALL SELECT doc_id, 'chunks', CAST(sum(len({ingestion._SENTENCES.format("body")})) AS BIGINT) FROM p GROUP BY doc_id
UNION ALL SELECT doc_id, 'facts', CAST(len({analysis._NUMS.format("text")}) AS BIGINT) FROM documents WHERE len({analysis._NUMS.format("text")}) > 0"""


def _oracles() -> dict[str, str]:
    joined = "SELECT s.user_id, (epoch_us(e.ts) - epoch_us(s.ts)) / 1000000.0 AS seconds FROM events s JOIN events e ON e.user_id = s.user_id AND e.ts > s.ts AND e.ts <= s.ts + INTERVAL 1 DAY WHERE s.event_type = 'signup' AND e.event_type = 'purchase'"
    return {
        "q2_stream_ttl_hits": f"{_TTL} SELECT event_id, hit FROM w",
        "q4_stream_stage_durations": f"SELECT user_id, count(*) AS n, round(sum(seconds), 1) AS seconds FROM ({joined}) GROUP BY user_id",
        "q6_stream_drafts": _DRAFT,
        "q10_incremental_ingest": _INGESTED,
    }


ORACLE_SQL |= _oracles()
