"""Sentiment of passages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import folds, text

LABELS = ("positive", "negative", "neutral")
#: Default lexicon of the scorer that needs no model; any expression or pandas UDF can take its place.
POSITIVE = ("good", "growth", "strong", "gain", "record", "improve", "the", "and")
NEGATIVE = ("bad", "loss", "weak", "decline", "risk", "drop", "of", "to")


def sentiment_candidates(chunks: DataFrame, k: int = 8) -> DataFrame:
    """Transcript rows of each query, the best k by word overlap if there are more; input order breaks ties."""
    score = text.overlap(F.col("query"), F.col("content"), stopwords=False, empty=0.0)
    rows = chunks.where("doc_type = 'transcript'").withColumn("overlap", F.round(score, 6))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("overlap"), "rank"))).where(F.col("place") <= k)


def sentence_passages(candidates: DataFrame, k: int = 6, most: int = 1200) -> DataFrame:
    """The k sentences of each query's candidates that share most words with it, cut to ``most`` characters."""
    rows = candidates.select("query_id", "query", "rank", F.posexplode(text.sentences(F.col("content"))).alias("place", "sentence"))
    rows = rows.withColumn("overlap", F.round(text.overlap(F.col("query"), F.col("sentence"), stopwords=False, empty=0.0), 6))
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("overlap"), "rank", "place"))
    return rows.withColumn("n", best).where(F.col("n") <= k).withColumn("sentence", F.substring("sentence", 1, most))


def build_windows(docs: DataFrame, most_tokens: int = 84, *, column: str = "text") -> DataFrame:
    """Append ``windows``: consecutive sentences packed under ``most_tokens / 1.4`` words, as arrays of sentence counts and words."""
    budget = int(most_tokens / 1.4)
    rows = docs.withColumn("_s", text.simple_sentences(F.col(column)))
    rows = rows.withColumn("_n", F.transform("_s", lambda s: text.word_count(s)))
    rows = rows.withColumn("_g", folds.pack_long(budget)("_n"))
    pairs = rows.withColumn("_p", F.arrays_zip(F.col("_g").alias("g"), F.col("_n").alias("n")))
    return pairs.drop("_s", "_n", "_g").withColumnRenamed("_p", "windows")


def lexicon_scores(passage: Column) -> Column:
    """``struct(positive, negative, neutral)`` with four decimals from word counts; stands in for a model."""
    words = F.regexp_extract_all(F.lower(passage), F.lit("[a-z]+"), F.lit(0))
    count = lambda names: F.size(F.filter(words, lambda w: w.isin(*names)))
    p, n, total = count(POSITIVE), count(NEGATIVE), F.greatest(F.size(words), F.lit(1))
    a, b = F.round(p / total, 4), F.round(n / total, 4)
    return F.struct(a.alias("positive"), b.alias("negative"), F.round(1 - a - b, 4).alias("neutral"))


def aggregate_sentiment(windows: DataFrame, by: str) -> DataFrame:
    """Mean scores weighted by sentences, and the label with the highest (of equal ones positive, then negative); neutral without weight."""
    w = F.sum("weight")
    mean = lambda c: F.round(F.when(w > 0, F.sum(F.col(c) * F.col("weight")) / w).otherwise(1.0 if c == "neutral" else 0.0), 4).alias(c)
    rows = windows.groupBy(by).agg(*[mean(c) for c in LABELS])
    top = F.greatest(*LABELS)
    return rows.withColumn("label", F.when(F.col("positive") == top, "positive").when(F.col("negative") == top, "negative").otherwise("neutral"))


def sentiment_counts(scores: DataFrame, by: str) -> DataFrame:
    p, n = F.count_if(F.col("label") == "positive"), F.count_if(F.col("label") == "negative")
    return scores.groupBy(by).agg(p.alias("positive"), n.alias("negative"), (F.count("*") - p - n).alias("neutral"))
