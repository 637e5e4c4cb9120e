"""Retrieval for a table of queries: lexical, vector and fused search, deduplication, reranking, expansion.

Rank first on narrow columns, join texts afterwards; a query's pool is small, the corpus is not.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.operators.lexical import SENT_QUERIES, Best, TextIndex, allowed, bm25, clause_groups, index_texts, search, search_few  # noqa: F401
from tidemark.staging import written

#: Published default of reciprocal rank fusion, and the penalty of boilerplate.
RRF_K, PENALTY = 60, 10.0
EARLY_TURNS, EARLY_OVERLAP = 3, 0.25
#: Openings of risk sections that say nothing.
PREAMBLES = ("other than the risk factors listed below", "item 1a. risk factors", "item 1a risk factors")


def top_k(scored: DataFrame, k: int | None, *order: Column, by: str = "query_id", rank: str = "rank") -> DataFrame:
    ranked = scored.withColumn(rank, F.row_number().over(Window.partitionBy(by).orderBy(*order)))
    return ranked if k is None else ranked.where(F.col(rank) <= k)


def _unit_rows(arrays: list[pa.Array]) -> np.ndarray:
    x = np.concatenate([a.flatten().to_numpy(zero_copy_only=False) for a in arrays]).reshape(sum(map(len, arrays)), -1)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _nearest(id_kind: str, query_kind: str, k: int):
    """The k best rows of a block for each query of a block, by matrix products of 256 queries; ties go to the smaller id."""

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        types = (right.schema.field("query_id").type, left.schema.field("id").type, pa.float64())
        out: list[tuple] = []
        if len(left) and len(right):
            x, q, ids, asking = _unit_rows(left.column("v").chunks), _unit_rows(right.column("q").chunks), left.column("id").to_pylist(), right.column("query_id").to_pylist()
            order = np.empty(len(ids), np.int64)
            order[sorted(range(len(ids)), key=ids.__getitem__)] = np.arange(len(ids))
            for start in range(0, len(q), 256):
                for query_id, s in zip(asking[start : start + 256], (q[start : start + 256] @ x.T).round(9)):
                    near = np.flatnonzero(s >= np.partition(s, -k)[-k]) if len(s) > k else np.arange(len(s))
                    out += [(query_id, ids[i], float(s[i])) for i in near[np.lexsort((order[near], -s[near]))[:k]]]
        return pa.table([pa.array([o[i] for o in out], t) for i, t in enumerate(types)], ["query_id", "id", "score"])

    return compare, f"query_id {query_kind}, id {id_kind}, score double"


def _nearest_of_few(rows: DataFrame, queries: DataFrame, k: int, clauses: dict[str, str], kinds: tuple[str, str]) -> DataFrame:
    """Each task's k best rows for each query: the queries go to the tasks, and no row is shuffled. A query meets only the rows that its clauses allow."""
    asked = queries.select("query_id", F.col("vector").cast("array<double>").alias("q"), F.array(*[F.col(c) for c in clauses.values()]).cast("array<string>").alias("named")).toArrow()
    vectors = _unit_rows(asked.column("q").chunks) if len(asked) else None
    shared = rows.sparkSession.sparkContext.broadcast((asked.column("query_id").combine_chunks(), vectors, clause_groups(asked.column("named").to_pylist())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, q, alike = shared.value
        best, id_type = Best(len(names), k), None
        for batch in batches:
            batch = batch.take(pa.compute.sort_indices(batch.column(0)))
            ids, x, id_type = batch.column(0), _unit_rows([batch.column(1)]), batch.schema.types[0]
            for named, members in alike.items():
                fits = allowed(batch.columns[2:], named)
                at = np.arange(len(x)) if fits is None else np.flatnonzero(fits)
                own = x if fits is None else x[at]
                for start in range(0, len(members) if len(at) else 0, 256):
                    some = np.array(members[start : start + 256])
                    scores = q[some] @ own.T
                    near = scores >= best.least[some, None] - 1e-9  # what rounding can still bring to the k-th
                    for i in np.flatnonzero(near.any(axis=1)):
                        best.add(some[i], at[near[i]], scores[i, near[i]].round(9), ids)
        if id_type is not None:
            yield best.table(names, id_type)

    return rows.mapInArrow(run, f"query_id {kinds[1]}, id {kinds[0]}, score double")


def vector_top_k(vecs: DataFrame, queries: DataFrame, k: int, *, id_col: str = "vec_id", vector_col: str = "embedding", clauses: dict[str, str] | None = None, block_rows: int = 32_768, block_queries: int = 8_192) -> DataFrame:
    """``query_id, id, score, rank``: exact nearest by cosine, all queries against all rows in blocks of about the given sizes.

    ``queries`` holds ``query_id`` and ``vector``. Rows and queries go to a grid of blocks,
    each block pair takes matrix products of 256 queries and keeps the k best, and these are merged.
    Up to :data:`SENT_QUERIES` queries (and no more than a block's) are sent to the rows instead.

    ``clauses`` names for some columns of ``vecs`` the query column with the value that a row
    must have; a null value asks for nothing. A query with a value meets only the blocks of
    rows that have it.
    """
    kinds = (vecs.schema[id_col].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString())
    if queries.count() <= min(block_queries, SENT_QUERIES):
        rows = vecs.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"), *[F.col(c).cast("string").alias(c) for c in clauses or {}])
        return top_k(_nearest_of_few(rows, queries, k, clauses or {}, kinds), k, F.desc("score"), F.col("id"))
    compare, schema = _nearest(*kinds, k)
    keys, open_to_all = list(clauses or {}), F.lit(True)
    for c in (clauses or {}).values():
        open_to_all = open_to_all & F.col(c).isNull()
    blocks = max(1, -(-vecs.count() // block_rows))
    free = queries.where(open_to_all) if keys else queries
    asking = free.count()
    dealt = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    rows = vecs.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"), dealt(id_col, blocks).alias("block"), *[F.col(c).cast("string").alias(c) for c in keys])
    found = []
    if asking or not keys:
        turns = max(1, -(-asking // block_queries))
        asked = free.select("query_id", F.col("vector").cast("array<double>").alias("q"), every(blocks).alias("q_block"), dealt("query_id", turns).alias("q_turn"))
        grid = rows.drop(*keys).withColumn("turn", every(turns))
        found.append(grid.groupBy("block", "turn").cogroup(asked.groupBy("q_block", "q_turn")).applyInArrow(compare, schema))
    if keys:
        own_name = {c: f"_of_{c}" for c in [*keys, "block"]}
        groups = rows.select(*[F.col(c).alias(n) for c, n in own_name.items()]).distinct()
        asked = None
        for mask in range(1, 1 << len(keys)):  # queries by which clauses they have: each kind meets the groups by equality
            named = [c for i, c in enumerate(keys) if mask >> i & 1]
            own = queries
            for c in keys:
                own = own.where(F.col(clauses[c]).isNotNull() if c in named else F.col(clauses[c]).isNull())
            own = own.select("query_id", F.col("vector").cast("array<double>").alias("q"), *[F.col(clauses[c]).cast("string").alias(own_name[c]) for c in named])
            own = own.join(groups, [own_name[c] for c in named]).select("query_id", "q", *own_name.values())
            asked = own if asked is None else asked.unionByName(own)
        found.append(rows.groupBy(*keys, "block").cogroup(asked.groupBy(*own_name.values())).applyInArrow(compare, schema))
    merged = found[0] if len(found) == 1 else found[0].unionByName(found[1])
    return top_k(merged, k, F.desc("score"), F.col("id"))


def rrf_fuse(*lists: DataFrame, k: int) -> DataFrame:
    """``query_id, id, score, rank`` by the sum of 1 / (60 + rank) over ranked lists ``(query_id, id, rank)``."""
    rows = lists[0].select("query_id", "id", "rank")
    for other in lists[1:]:
        rows = rows.unionByName(other.select("query_id", "id", "rank"))
    fused = rows.groupBy("query_id", "id").agg(F.round(F.sum(1.0 / (RRF_K + F.col("rank"))), 9).alias("score"))
    return top_k(fused, k, F.desc("score"), F.col("id"))


def hybrid_search(chunks: DataFrame, queries: DataFrame, k: int, pool: int = 50, *, index: TextIndex | None = None, id_col: str = "chunk_id", text_col: str = "content", vector_col: str = "embedding", clauses: dict[str, str] | None = None) -> DataFrame:
    """``query_id, id, score, rank``: lexical and vector lists of ``pool`` each, fused to k.

    ``queries`` has ``query`` and ``vector``, chunks have text and vector. ``clauses`` names for some
    columns of the chunks the query column with the value asked for (null: any); both
    lists hold only chunks that satisfy them. ``index`` may be one written before with these keys;
    without it, one is written if the queries are too many to be sent to the chunks.
    """
    if index is None and queries.count() <= SENT_QUERIES:
        lexical = search_few(chunks, queries, pool, id_col=id_col, text_col=text_col, clauses=clauses)
    else:
        lexical = search(index or index_texts(chunks, id_col=id_col, text_col=text_col, keys=tuple(clauses or ())), queries, pool, clauses=clauses)
    near = vector_top_k(chunks.where(F.col(vector_col).isNotNull()), queries, pool, id_col=id_col, vector_col=vector_col, clauses=clauses)
    return rrf_fuse(lexical, near, k=k)


def filter_search(chunks: DataFrame, wanted: DataFrame, keys: list[str], n: int, order: str = "chunk_id") -> DataFrame:
    """The first n chunks of each filter row, without any query."""
    rows = chunks.join(wanted, keys)
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where(F.col("rank") <= n)


def dedup_within(hits: DataFrame, key: str = "chunk_id", order: str = "rank") -> DataFrame:
    """The first hit of each chunk per query; hits without an id all stay."""
    n = F.row_number().over(Window.partitionBy("query_id", key).orderBy(order))
    return hits.withColumn("_n", n).where((F.col("_n") == 1) | (F.coalesce(F.col(key).cast("string"), F.lit("")) == "")).drop("_n")


def dedup_across(first: DataFrame, second: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Both lists one after the other; a chunk of the first list is left out of the second. Appends ``place``."""
    rows = first.withColumn("source_order", F.lit(0)).unionByName(second.withColumn("source_order", F.lit(1)))
    n = F.row_number().over(Window.partitionBy("query_id", key).orderBy("source_order", "rank"))
    kept = rows.withColumn("_n", n).where((F.col("_n") == 1) | (F.coalesce(F.col(key).cast("string"), F.lit("")) == "")).drop("_n")
    return kept.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("source_order", "rank")))


def mmr_rerank(pool: DataFrame, k: int, lam: float = 0.5) -> DataFrame:
    """Up to k of each query's pool by maximal marginal relevance; ties go to the earlier rank.

    Pool: ``query_id, id, rank, v`` (candidate) and ``q`` (query vector). A pool is what one query retrieved.
    """

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rank")
        x, q = np.stack(rows["v"].to_numpy()).astype(float), np.asarray(rows["q"].iloc[0], float)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        relevance, among = x @ (q / max(np.linalg.norm(q), 1e-12)), x @ x.T
        chosen: list[int] = []
        while len(chosen) < min(k, len(rows)):
            worst = among[:, chosen].max(1) if chosen else np.zeros(len(rows))
            value = (lam * relevance - (1 - lam) * worst).round(9)
            value[chosen] = -np.inf
            chosen.append(int(value.argmax()))
        return pd.DataFrame({"query_id": rows["query_id"].iloc[chosen], "id": rows["id"].iloc[chosen], "mmr_rank": range(1, len(chosen) + 1)})

    kind = lambda c: pool.schema[c].dataType.simpleString()
    return pool.groupBy("query_id").applyInPandas(pick, f"query_id {kind('query_id')}, id {kind('id')}, mmr_rank int")


def pair_rerank(pairs: DataFrame, k: int | None, score: Column | None = None) -> DataFrame:
    """Top k of each query (all of them with None) by a joint score of query and passage with six decimals; the default is the share of query words that occur.

    ``score`` may be any expression, such as a pandas UDF around a model.
    """
    value = score if score is not None else text.overlap(F.col("query"), F.col("content"), stopwords=False, empty=0.0)
    scored = pairs.withColumn("rerank_score", F.round(value, 6))
    return top_k(scored, k, F.desc("rerank_score"), F.col("rank"), rank="rerank_rank")


def is_boilerplate(query: Column, index: Column, doc_type: Column, section: Column, content: Column) -> Column:
    """Operator introductions, empty risk preambles, and early turns of a transcript that miss the topic."""
    body = F.trim(content)
    opening = F.lower(F.substring(body, 1, 200))
    empty = (index == 0) & F.when(doc_type == "transcript", body.rlike(r"(?i)^\s*operator\s*:")).otherwise(F.lower(section).isin("risk_factors", "business") & opening.rlike("|".join(p.replace(".", r"\.") for p in PREAMBLES)))
    early = (doc_type == "transcript") & index.between(0, EARLY_TURNS) & (F.coalesce(query, F.lit("")) != "") & (text.overlap(query, body) < EARLY_OVERLAP)
    return F.coalesce(empty | early, F.lit(False))


def demote_boilerplate(ranked: DataFrame, flag: Column) -> DataFrame:
    """Lower the score of flagged candidates by a fixed penalty and rank again; former ranks break ties."""
    rows = ranked.withColumn("rerank_score", F.col("rerank_score") - F.when(flag, PENALTY).otherwise(0.0))
    return rows.withColumn("demoted_rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), "rerank_rank")))


def diversity_cap(ranked: DataFrame, per_section: int, k: int, order: str = "rank") -> DataFrame:
    """At most ``per_section`` (0: any number) of each accession and section in rank order, then the first k."""
    rows = ranked
    if per_section > 0:
        n = F.row_number().over(Window.partitionBy("query_id", "accession", F.lower("section")).orderBy(order))
        rows = rows.withColumn("_n", n).where(F.col("_n") <= per_section).drop("_n")
    return top_k(rows, k, F.col(order), rank="capped_rank")


def parent_siblings(hits: DataFrame, chunks: DataFrame, n: int = 50) -> DataFrame:
    """The first n children of each parent that was hit, in order."""
    rows = chunks.join(hits.select("parent_id").distinct(), "parent_id", "left_semi")
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("parent_id").orderBy("chunk_index"))).where(F.col("place") <= n)


def expand_parents(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Append ``parent_content``: the texts of all children of the hit's parent in order, or its own text if it has none or a single one."""
    full = chunks.join(hits.select("parent_id").distinct(), "parent_id", "left_semi").groupBy("parent_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "content"))).alias("c"))
    full = full.select("parent_id", F.array_join(F.transform("c", lambda c: c["content"]), "").alias("_full"), F.size("c").alias("_n"))
    rows = hits.join(full, "parent_id", "left")
    return rows.withColumn("parent_content", F.when(F.col("_n") > 1, F.col("_full")).otherwise(F.col("content"))).drop("_full", "_n")


def retrieve(chunks: DataFrame, queries: DataFrame, *, clauses: dict[str, str] | None = None, pool: int = 12, spoken: str = "transcript", diverse: int = 10, per_section: int = 0, k: int = 5, lam: float = 0.5, score: Column | None = None) -> DataFrame:
    """The k passages that a query's answer is written from, with their parents' texts.

    Two hybrid searches, of all chunks and of those whose ``doc_type`` is ``spoken``, run as one
    with each query asked twice, and are merged without repeats; of the merged pool, which carries its vectors, ``diverse``
    are chosen by maximal marginal relevance, scored jointly with the query, boilerplate
    is demoted, sections are capped (0: not at all), and the first k are expanded to their parents.

    Chunks: ``chunk_id, content, embedding, doc_type, section, accession, chunk_index, parent_id`` and the
    columns of the clauses. Queries: ``query_id, query, vector`` and the clauses' values. Returns one row per
    passage: query and chunk columns, ``mmr_rank``, ``rerank_score``, ``capped_rank``, ``parent_content``.
    """
    clauses = dict(clauses or {})
    twice = queries.withColumn("_spoken", F.explode(F.array(F.lit(None).cast("string"), F.lit(spoken))))
    twice = twice.withColumn("_ask", F.concat(F.when(F.col("_spoken").isNull(), "every:").otherwise("said:"), F.col("query_id").cast("string")))
    asked = twice.drop("query_id").withColumnRenamed("_ask", "query_id")
    found = hybrid_search(chunks, asked, pool, clauses=clauses | {"doc_type": "_spoken"})
    found = written(found.withColumnRenamed("query_id", "_ask").join(twice.select("_ask", "query_id", F.col("_spoken").isNotNull().alias("_said")), "_ask"), "found")
    every, said = (found.where(c).select("query_id", "id", "score", "rank") for c in (~F.col("_said"), F.col("_said")))
    merged = written(dedup_across(every, said, "id").select("query_id", "id", F.col("place").alias("rank")), "pool")
    wanted = chunks.withColumnRenamed("chunk_id", "id").join(merged.select("id"), "id", "left_semi")  # before the embedding, if that is computed
    full = merged.join(wanted, "id").join(queries.select("query_id", "query", "vector"), "query_id")
    full = written(full, "pool-texts")
    chosen = mmr_rerank(full.select("query_id", "id", "rank", F.col("embedding").alias("v"), F.col("vector").alias("q")), diverse, lam)
    picked = full.drop("rank", "embedding", "vector").join(chosen, ["query_id", "id"]).withColumn("rank", F.col("mmr_rank")).withColumnRenamed("id", "chunk_id")
    ranked = pair_rerank(picked, None, score)
    flag = is_boilerplate(F.col("query"), F.col("chunk_index"), F.col("doc_type"), F.col("section"), F.col("content"))
    capped = diversity_cap(demote_boilerplate(ranked, flag), per_section, k, "demoted_rank")
    return expand_parents(written(capped, "passages"), chunks.select("chunk_id", "parent_id", "chunk_index", "content"))


def prior_period_search(requests: DataFrame, back: int, search) -> DataFrame:
    """Search with each request's label moved back by quarters; ``search`` takes the requests."""
    from tidemark.functions import fiscal

    return search(requests.withColumn("fiscal_label", fiscal.prior_label(F.col("fiscal_label"), back)))


