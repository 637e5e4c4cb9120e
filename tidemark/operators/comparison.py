"""Language of a period against earlier ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import fiscal, text
from tidemark.functions.folds import budget_concat
from tidemark.operators import lexical, retrieval
from tidemark.staging import written

#: Words of direction.
UP = ("increase", "increased", "grew", "growth", "higher", "up", "improved", "strong", "accelerated")
DOWN = ("decrease", "decreased", "declined", "decline", "lower", "down", "weakened", "weak", "slowed")


def prior_contexts(runs: DataFrame, hits: DataFrame, budget: int = 2000) -> DataFrame:
    """Per run and earlier label the retrieved texts in rank order within a budget of characters; empty ones are left out.

    A group brings as many rows together as can fit by their lengths, whatever its size.
    """
    keys = ["company", "fiscal_label"]
    rows = hits.join(runs.select(*keys).distinct(), keys, "left_semi").withColumn("_l", F.length("content")).where(F.col("_l").between(1, budget))
    # what is used only grows, so of one length the first ones fit, at most budget / length: first within parts of a group, then over them
    for part in ([F.pmod(F.xxhash64("rank", "content"), F.lit(64))], []):
        n = F.row_number().over(Window.partitionBy(*keys, "_l", *part).orderBy("rank", "content"))
        rows = rows.withColumn("_n", n).where(F.col("_n") * F.col("_l") <= budget).drop("_n")
    rows = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("rank", "content"))).alias("c"))
    rows = rows.select(*keys, budget_concat(F.transform("c", lambda c: c["content"]), budget).alias("context")).where("context <> ''")
    return runs.join(rows, keys).select("run_id", "fiscal_label", "context")


def prior_requests(runs: DataFrame) -> DataFrame:
    """A row for each run and label it compares with: ``query_id`` (run and place in the list), ``label``, ``back`` and ``target``, the label that is searched.

    ``back`` is the distance of the labels, or the place in the list where that cannot be told; labels whose target cannot be told are left out.
    """
    rows = runs.select("*", F.posexplode("comparison").alias("_i", "label"))
    rows = rows.withColumn("back", fiscal.quarters_back(F.col("fiscal_label"), F.col("label"), F.col("_i") + 1))
    rows = rows.withColumn("target", fiscal.prior_label(F.col("fiscal_label"), F.col("back"))).where("target is not null and company is not null")
    return rows.withColumn("query_id", F.concat_ws("|", F.col("run_id").cast("string"), F.col("_i").cast("string"))).drop("_i")


def prior_quarter_contexts(runs: DataFrame, chunks: DataFrame, top: int = 5, budget: int = 2000) -> DataFrame:
    """``run_id, label, target, back, context`` for every run and earlier label that retrieval finds anything for.

    All requests are searched at once: hybrid, within the run's company and the label told
    by arithmetic on the run's own. The first ``top`` texts are put together in the order
    found, each only if it still fits into ``budget`` characters.

    Runs: ``run_id, company, fiscal_label, query, vector, comparison`` (labels). Chunks: ``chunk_id,
    content, embedding, ticker, fiscal_label``.
    """
    asked = written(prior_requests(runs), "prior-requests")
    index = lexical.index_texts(chunks, keys=("ticker", "fiscal_label"))
    found = retrieval.hybrid_search(chunks, asked, top, index=index, clauses={"ticker": "company", "fiscal_label": "target"})
    said = found.join(chunks.select(F.col("chunk_id").alias("id"), "content"), "id").where("content <> ''")
    own = said.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "content"))).alias("c"))  # at most top texts
    own = own.select("query_id", budget_concat(F.transform("c", lambda c: c["content"]), budget).alias("context")).where("context <> ''")
    return asked.select("query_id", "run_id", "label", "target", "back").join(own, "query_id").drop("query_id")


def align_statements(current: DataFrame, prior: DataFrame, by: str, floor: float = 0.3) -> DataFrame:
    """For each current sentence of a run the earlier one of the same run that shares most of its words, if it shares enough.

    Candidates meet by shared words of each run, not by all pairs.
    """
    a = current.select(by, F.col("place").alias("place"), F.col("sentence").alias("current"), text.tokens(F.col("sentence")).alias("ct"))
    b = prior.select(by, F.col("place").alias("prior_place"), F.col("sentence").alias("prior"), text.tokens(F.col("sentence")).alias("pt"))
    shared = a.select(by, "place", F.size("ct").alias("n"), F.explode("ct").alias("w")).join(b.select(by, "prior_place", F.explode("pt").alias("w")), [by, "w"])
    score = shared.groupBy(by, "place", "prior_place", "n").agg((F.count("*") / F.col("n")).alias("overlap")).where(F.col("overlap") >= floor)
    best = F.row_number().over(Window.partitionBy(by, "place").orderBy(F.desc("overlap"), "prior_place"))
    top = score.withColumn("_n", best).where("_n = 1").select(by, "place", "prior_place", F.round("overlap", 6).alias("overlap"))
    return a.drop("ct").join(top, [by, "place"], "left").join(b.drop("pt"), [by, "prior_place"], "left")


def detect_shift(current: Column, prior: Column, tolerance: float = 0.1) -> Column:
    """Whether the language shifted: no counterpart or a flipped direction is a shift; equal or reordered words and small changes of numbers are not."""
    row = F.transform(F.array(F.struct(told(current).alias("a"), told(prior).alias("b"))), lambda s: shift_of(s["a"], s["b"], tolerance))
    return F.get(row, F.lit(0))


def told(sentence: Column) -> Column:
    """What :func:`shift_of` compares of a sentence: its plain text, its words and its letters-only words sorted, its first number, its directions. Null of a null sentence."""
    low = F.lower(sentence)
    letters = F.array_sort(F.regexp_extract_all(low, F.lit("[a-z]+"), F.lit(0)))
    fields = F.struct(
        F.trim(F.regexp_replace(low, r"[^a-z0-9.%]+", " ")).alias("plain"),
        F.array_sort(F.regexp_extract_all(low, F.lit("[a-z0-9]+"), F.lit(0))).alias("words"),
        letters.alias("letters"),
        F.get(text.numeric_tokens(sentence), F.lit(0)).cast("double").alias("number"),
    )
    has = lambda s, names: F.arrays_overlap(s["letters"], F.array(*[F.lit(n) for n in names]))
    whole = F.transform(F.array(fields), lambda s: F.struct(*[s[c].alias(c) for c in ("plain", "words", "letters", "number")], has(s, UP).alias("up"), has(s, DOWN).alias("down")))
    return F.when(sentence.isNotNull(), F.get(whole, F.lit(0)))


def shift_of(now: Column, before: Column, tolerance: float = 0.1) -> Column:
    """:func:`detect_shift` of what :func:`told` gives of the two sentences."""
    flip = (now["up"] & before["down"] & ~before["up"]) | (now["down"] & before["up"] & ~now["up"])
    a, b = now["number"], before["number"]
    small = (b != 0) & (F.abs(a - b) / F.abs(b) <= tolerance)
    same_words = now["letters"] == before["letters"]
    return (
        F.when(before.isNull(), True)
        .when(now["plain"] == before["plain"], False)
        .when(now["words"] == before["words"], False)
        .when(flip, True)
        .when(same_words & F.coalesce(small, F.lit(False)), False)
        .otherwise(~same_words | ~F.coalesce(small, F.lit(True)))
    )


def findings_to_map(findings: DataFrame, by: str, label: str, statement: str) -> DataFrame:
    """Per run a map of label to statement, in order of the labels."""
    return findings.groupBy(by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(label, statement)))).alias("prior_language"))


def select_finding(findings: DataFrame, by: str, target: Column, context: Column, statement: str, floor: float = 0.3) -> DataFrame:
    """The finding of each run with the best overlap with the target, if it and the overlap with the context reach the floor."""
    rows = findings.withColumn("score", F.round(text.overlap(target, F.col(statement), stopwords=False, empty=0.0, longer_than=2), 6))
    rows = rows.withColumn("grounded", F.round(text.overlap(F.col(statement), context, stopwords=False, empty=0.0, longer_than=2), 6))
    rows = rows.where((F.col("score") >= floor) & (F.col("grounded") >= floor))
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), statement))).where("_n = 1").drop("_n")
