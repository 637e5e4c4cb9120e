"""Retrieval and answer evaluation against golden claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text

#: Shares of claim types in a sample, weights of judged dimensions, floors of the gate and of coverage.
TYPE_SHARES = {"numeric": 0.35, "retrieval": 0.20, "comparison": 0.17, "sentiment": 0.15, "out_of_scope": 0.13}
JUDGE_WEIGHTS = {
    "numeric": (0.6, 0.3, 0.1), "out_of_scope": (0.7, 0.1, 0.2), "comparison": (0.4, 0.3, 0.3), "retrieval": (0.3, 0.4, 0.3),
    "sentiment": (0.5, 0.3, 0.2),
}
DEFAULT_WEIGHTS = (0.4, 0.3, 0.3)
FLOORS = {
    "ragas_faithfulness": 0.80, "ragas_answer_relevancy": 0.80, "ragas_context_precision": 0.65, "ragas_context_recall_excl_oos": 0.65,
    "precision_at_5": 0.55, "recall_at_5": 0.90, "llm_judge_mean": 3.30,
}
COVERAGE_FLOORS = {"numeric": 15, "comparison": 15, "retrieval": 12, "out_of_scope": 10, "sentiment": 8}


def anchor_key(accession: Column, section: Column) -> Column:
    return F.concat_ws("::", accession, F.lower(section))


def precision_recall_at_k(hits: DataFrame, anchors: DataFrame, k: int, by: str = "claim_id") -> DataFrame:
    """Per claim: hits of its first k chunks by k, and by its anchors (at most 1); a claim without anchors has 0 for both.

    Hits: ``claim_id, rank, accession, section``; anchors: ``claim_id, accession, section``.
    Two chunks of one anchored section count twice.
    """
    a = anchors.select(by, anchor_key(F.col("accession"), F.col("section")).alias("key")).distinct()
    n = a.groupBy(by).agg(F.count("*").alias("n_anchors"))
    h = hits.where(F.col("rank") <= k).select(by, anchor_key(F.col("accession"), F.col("section")).alias("key")).join(a, [by, "key"]).groupBy(by).agg(F.count("*").alias("n_hits"))
    claims = hits.select(by).union(anchors.select(by)).distinct()
    rows = claims.join(n, by, "left").join(h, by, "left").fillna(0, ["n_anchors", "n_hits"])
    recall = F.when(F.col("n_anchors") == 0, 0.0).otherwise(F.least(F.lit(1.0), F.col("n_hits") / F.col("n_anchors")))
    return rows.select(by, F.round(F.when(F.col("n_anchors") == 0, 0.0).otherwise(F.col("n_hits") / k), 4).alias("precision"), F.round(recall, 4).alias("recall"))


def mean_metrics(scores: DataFrame, *metrics: str, by: list[str] = []) -> DataFrame:
    return scores.groupBy(*by).agg(*[F.round(F.avg(m), 4).alias(m) for m in metrics])


def stratified_sample(claims: DataFrame, n: int, seed: int = 42, id_col: str = "claim_id", type_col: str = "claim_type") -> DataFrame:
    """n claims by type shares, at least one of each type, the difference to n from the largest; within a type by a keyed hash."""
    share = F.lit(None).cast("double")
    for name, value in TYPE_SHARES.items():
        share = F.when(F.col(type_col) == name, value).otherwise(share)
    types = claims.groupBy(type_col).count()
    total = types.agg(F.count("*").alias("n_types"))
    alloc = types.crossJoin(total).withColumn("slots", F.greatest(F.lit(1), F.bround(n * F.coalesce(share, 1 / F.col("n_types")))).cast("int"))  # one row per type
    every, top = Window.partitionBy(), Window.orderBy(F.desc("slots"), type_col)
    alloc = alloc.withColumn("off", n - F.sum("slots").over(every)).withColumn("place", F.row_number().over(top))
    alloc = alloc.select(type_col, (F.col("slots") + F.when(F.col("place") == 1, F.col("off")).otherwise(0)).alias("slots"))
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(id_col).cast("string")))
    rows = claims.join(alloc, type_col).withColumn("pick", F.row_number().over(Window.partitionBy(type_col).orderBy(order, id_col)))
    return rows.where("pick <= slots")


def eval_query(kind: Column, body: Column, speaker: Column) -> Column:
    """Question of a claim by its type."""
    return (
        F.when(F.coalesce(body, F.lit("")) == "", "")
        .when(kind == "comparison", F.concat(F.lit("Did this language shift from the prior quarter? "), body))
        .when(kind == "sentiment", F.concat(F.lit("What is the sentiment of this statement by "), speaker, F.lit(': "'), body, F.lit('"')))
        .when(kind.isin("numeric", "retrieval", "out_of_scope"), body)
        .otherwise("")
    )


def ground_truth_anchors(claims: DataFrame) -> DataFrame:
    """Anchors ``accession, section`` with both fields; of comparison claims only those of the claim's own label."""
    rows = claims.select("claim_id", "claim_type", "fiscal_label", F.explode("anchors").alias("a"))
    own = (F.col("claim_type") != "comparison") | (F.col("a.fiscal_label") == F.col("fiscal_label"))
    filled = (F.coalesce("a.accession", F.lit("")) != "") & (F.coalesce("a.section", F.lit("")) != "")
    return rows.where(own & filled).select("claim_id", "a.accession", "a.section")


def ratio_metrics(verdicts: DataFrame, by: str, supported: str, answer: Column | None = None) -> DataFrame:
    """Share of supported items per answer; an empty answer has 0, one that is empty only once absence lines are gone 1, one without items 1; a missing verdict counts as not supported."""
    rows = verdicts.groupBy(by).agg(F.count("*").alias("items"), F.count_if(F.coalesce(F.col(supported), F.lit(False))).alias("ok"), *([F.first(answer).alias("answer")] if answer is not None else []))
    value = F.when(F.col("items") == 0, 1.0).otherwise(F.round(F.col("ok") / F.col("items"), 4))
    if answer is not None:
        value = F.when(F.trim(F.coalesce("answer", F.lit(""))) == "", 0.0).when(F.trim(text.strip_absence(F.col("answer"))) == "", 1.0).otherwise(value)
    return rows.select(by, "items", value.alias("ratio"))


def mean_scores(scores: DataFrame, *metrics: str, out_of_scope: Column) -> DataFrame:
    """Means that ignore NaN, and the mean recall without claims that are out of scope."""
    clean = lambda m: F.when(~F.isnan(m), F.col(m))
    more = [F.round(F.avg(F.when(~out_of_scope, clean("recall"))), 4).alias("recall_in_scope")] if "recall" in metrics else []
    return scores.agg(*[F.round(F.avg(clean(m)), 4).alias(m) for m in metrics], *more)


def weighted_judge(scores: DataFrame, kind: str = "claim_type") -> DataFrame:
    """Append ``overall``: accuracy, grounding and relevancy, each from 1 to 5, by the type's weights, with two decimals."""
    names = ("accuracy", "grounding", "relevancy")
    clamp = {c: F.greatest(F.lit(1), F.least(F.lit(5), F.col(c))) for c in names}

    def weight(k: int) -> Column:
        out = F.lit(DEFAULT_WEIGHTS[k])
        for name, w in JUDGE_WEIGHTS.items():
            out = F.when(F.col(kind) == name, w[k]).otherwise(out)
        return out

    return scores.withColumn("overall", F.round(sum((clamp[c] * weight(k) for k, c in enumerate(names)), F.lit(0.0)), 2))


def gate_check(metrics: DataFrame) -> DataFrame:
    """``metric, floor, value, passed, all_passed`` for every floor; a missing metric fails."""
    floors = metrics.sparkSession.createDataFrame(list(FLOORS.items()), "metric string, floor double")
    rows = floors.join(metrics, "metric", "left").withColumn("passed", F.coalesce(F.col("value") >= F.col("floor"), F.lit(False)))
    return rows.withColumn("all_passed", F.bool_and("passed").over(Window.partitionBy()))


def violations(rows: DataFrame, id_col: str, rules: dict[str, Column]) -> DataFrame:
    """One row per broken rule; ``rules`` gives for each name the condition that breaks it."""
    found = F.array(*[F.when(F.coalesce(broken, F.lit(False)), F.lit(name)) for name, broken in rules.items()])
    return rows.select(id_col, F.explode(F.filter(found, lambda r: r.isNotNull())).alias("rule"))


def duplicate_ids(rows: DataFrame, id_col: str) -> DataFrame:
    return rows.groupBy(id_col).agg(F.count("*").alias("n")).where("n > 1")


def prior_adjacency(pairs: DataFrame, filings: DataFrame) -> DataFrame:
    """Pairs of accessions ``current, prior`` that are not the same company's or not in order of time."""
    f = filings.select("accession", "cik", "report_date")
    c = f.toDF("current", "c_cik", "c_date")
    p = f.toDF("prior", "p_cik", "p_date")
    return pairs.join(c, "current").join(p, "prior").where("c_cik <> p_cik or p_date >= c_date").select("current", "prior")


def coverage(claims: DataFrame) -> DataFrame:
    """Counts per type, per type and edge case, and in all."""
    return claims.rollup("claim_type", "edge_case").agg(F.count("*").alias("n")).withColumn("level", F.when(F.col("claim_type").isNull(), "total").when(F.col("edge_case").isNull(), "type").otherwise("edge"))
