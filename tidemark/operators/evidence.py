"""Evidence and report tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def in_order(rows: DataFrame, by: str, order: str, value: str, separator: str, name: str) -> DataFrame:
    """Per group the values in order, joined."""
    c = rows.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(order, value))).alias("_c"))
    return c.select(by, F.array_join(F.transform("_c", lambda x: x[value]), separator).alias(name))


def evidence_text(hits: DataFrame, by: str = "query_id", k: int = 8) -> DataFrame:
    """Per query the distinct texts of its first k hits, each after its type."""
    body = F.coalesce(F.nullif("parent_content", F.lit("")), F.col("content"))
    rows = hits.where(F.col("rank") <= k).withColumn("body", body)
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy(by, "body").orderBy("rank"))).where("_n = 1")
    return in_order(rows.withColumn("line", F.concat(F.lit("["), F.upper("doc_type"), F.lit("] "), F.col("body"))), by, "rank", "line", "\n\n", "evidence")


def sentiment_line(positive: Column, negative: Column, neutral: Column) -> Column:
    total = positive + negative + neutral
    return F.when(total == 0, "Not available.").otherwise(F.format_string("positive=%d negative=%d neutral=%d across %d passages", positive, negative, neutral, total))


def finding_line(topic: Column, shift: Column, description: Column) -> Column:
    return F.concat(F.lit("- "), topic, F.lit(": shift="), F.when(shift, "YES").otherwise("no"), F.lit(" — "), F.coalesce(F.nullif(description, F.lit("")), F.lit("no change")))


def validation_line(metric: Column, claimed: Column, calculated: Column, match: Column, delta: Column) -> Column:
    difference = F.coalesce(F.concat(F.lit(" (Δ"), F.format_string("%.2f", delta), F.lit("%)")), F.lit(""))
    return F.concat(F.lit("- "), metric, F.lit(": claimed="), claimed.cast("string"), F.lit(" calculated="), calculated.cast("string"), F.when(match, " ✓").otherwise(" ✗ MISMATCH"), difference)


def debate_evidence(hits: DataFrame, by: str = "query_id", k: int = 10, most: int = 300) -> DataFrame:
    """Per query the openings of its first k hits."""
    rows = hits.where(F.col("rank") <= k).withColumn("line", F.concat(F.lit("["), F.col("doc_type"), F.lit("] "), F.substring("content", 1, most)))
    return in_order(rows, by, "rank", "line", "\n", "evidence")


def report_lines(runs: DataFrame, validations: DataFrame, by: str = "run_id") -> DataFrame:
    """Per run its plain-text export with a line for each validation."""
    line = F.concat(F.when(F.col("match"), "✓").otherwise("✗"), F.lit("  "), F.col("claim"), F.lit("  —  stated: "), F.col("claimed_value").cast("string"), F.lit("  filing-derived: "), F.coalesce(F.col("value").cast("string"), F.lit("None")))
    lines = in_order(validations.withColumn("line", line), by, "claim", "line", "\n", "_lines")
    rows = runs.join(lines, by, "left")
    rule = F.lit("=" * 60)
    body = F.concat_ws("\n", F.concat(F.lit("Company: "), F.col("company")), F.concat(F.lit("Run ID: "), F.col(by).cast("string")), rule, F.coalesce("report", F.lit("(No report generated)")), rule, F.lit("NUMERIC VALIDATIONS"), F.coalesce("_lines", F.lit("")))
    return rows.select(by, body.alias("export"))


def assemble_runs(runs: DataFrame, by: str = "run_id", **children: DataFrame) -> DataFrame:
    """One row per run with a list of structs for each child table, and the status ``failed`` where there is an error."""
    out = runs.withColumn("status", F.when(F.col("error").isNotNull(), "failed").otherwise("completed"))
    for name, child in children.items():
        fields = [c for c in child.columns if c != by]
        out = out.join(child.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name)), by, "left")
    return out
