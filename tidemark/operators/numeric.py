"""Stated numbers against filed ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text

#: Factors to percentage points and to dollars.
POINTS = {"percent": 1.0, "basis_points": 0.01, "ratio": 100.0}
DOLLARS = {"usd": 1.0, "usd_thousands": 1e3, "usd_millions": 1e6, "usd_billions": 1e9}
#: Questions that always need a second look.
RECOMMENDATION = r"(?i)\b(should i|recommend|buy|sell|invest|overweight|underweight|good stock|worth buying)\b"
PRECISION = r"(?i)\b10-?[qk]\b|\bexact(ly)?\b|\bprecisely\b|\bin (the )?(exact )?(millions?|thousands?)\b"
#: Phrases that name a metric, and units after a number.
PHRASES = {"revenue": r"(?:total |net )?revenues?", "gross_margin": r"gross margin", "operating_income": r"operating income", "net_income": r"net income", "eps_diluted": r"(?:diluted )?(?:eps|earnings per share)"}
NUMBER = r"\$?(\d[\d,]*(?:\.\d+)?)\s*(%|percent|basis points|bps|billion|million|thousand)?"


def rescale(claimed: Column, claimed_unit: Column, calculated_unit: Column) -> Column:
    """The claimed value on the scale of the calculated one; unknown units count as they are."""

    def factor(table: dict[str, float]) -> Column:
        out = F.lit(1.0)
        for unit, f in table.items():
            out = F.when(F.lower(F.trim(claimed_unit)) == unit, f).otherwise(out)
        return out

    to = F.coalesce(F.lower(F.trim(calculated_unit)), F.lit(""))
    return claimed * F.when(to.startswith("%") | to.startswith("pp"), factor(POINTS)).when(to.startswith("usd"), factor(DOLLARS)).otherwise(1.0)


def compare(claimed: Column, calculated: Column, value_type: Column) -> tuple[Column, Column]:
    """Whether the values match, within 0.5 % for percentages and 1 % else, and the difference in percent (null for a filed 0)."""
    delta = F.when(calculated != 0, F.abs(claimed - calculated) / F.abs(calculated) * 100)
    most = F.when(value_type == "percentage", 0.5).otherwise(1.0)
    match = F.when(claimed.isNull() | calculated.isNull(), False).when(calculated == 0, claimed == 0).otherwise(delta <= most)
    return match, F.round(delta, 4)


def extract_claims(sentences: DataFrame, column: str = "sentence") -> DataFrame:
    """One row per metric that a sentence names and the number that follows it: ``metric, claimed_value, claimed_unit, value_type``.

    Sentences about guidance or expectations are left out.
    """
    rows = sentences.where(~F.lower(column).rlike(r"\b(guidance|expect|outlook|forecast|anticipate)"))
    found = F.filter(
        F.array(*[F.struct(F.lit(m).alias("metric"), F.regexp_extract(column, rf"(?i)\b{p}\b[^.\d]{{0,40}}?{NUMBER}", 1).alias("number"), F.lower(F.regexp_extract(column, rf"(?i)\b{p}\b[^.\d]{{0,40}}?{NUMBER}", 2)).alias("unit")) for m, p in PHRASES.items()]),
        lambda s: s["number"] != "",
    )
    rows = rows.select("*", F.explode(found).alias("_f"))
    unit = F.when(F.col("_f.unit").isin("%", "percent"), "percent").when(F.col("_f.unit").isin("basis points", "bps"), "basis_points")
    for word in ("billion", "million", "thousand"):
        unit = unit.when(F.col("_f.unit") == word, f"usd_{word}s")
    unit = unit.otherwise("usd")
    kind = F.when(unit.isin("percent", "basis_points"), "percentage").otherwise("absolute")
    return rows.select(*sentences.columns, F.col("_f.metric").alias("metric"), F.translate("_f.number", ",", "").cast("double").alias("claimed_value"), unit.alias("claimed_unit"), kind.alias("value_type"))


def skip_reason(claimed: Column, calculated_unit: Column, claimed_unit: Column, value: Column) -> Column:
    """Why a claim is not checked, null if it is: no claimed value, nothing calculated, basis points against a level."""
    level = (claimed_unit == "basis_points") & calculated_unit.startswith("%")
    return F.when(claimed.isNull(), "no claimed value").when(value.isNull() | calculated_unit.isNull(), "not calculated").when(level, "basis points against a level")


def validate_claims(claims: DataFrame) -> DataFrame:
    """Claims with ``value`` and ``unit`` of the calculated metric: append ``reason``, ``scaled``, ``match`` and ``delta_pct``; the last two are null where a reason says why."""
    reason = skip_reason(F.col("claimed_value"), F.col("unit"), F.col("claimed_unit"), F.col("value"))
    rows = claims.withColumn("reason", reason).withColumn("scaled", rescale(F.col("claimed_value"), F.col("claimed_unit"), F.col("unit")))
    match, delta = compare(F.col("scaled"), F.col("value"), F.col("value_type"))
    return rows.withColumns({"match": F.when(F.col("reason").isNull(), match), "delta_pct": F.when(F.col("reason").isNull(), delta)})


def validation_summary(validated: DataFrame, by: str) -> DataFrame:
    """Per run: checked, mismatches, unverifiable and confidence (1, or less the share of mismatches)."""
    n, wrong = F.count("match"), F.count_if(~F.col("match"))
    share = F.when(n == 0, 1.0).otherwise(F.round(1 - wrong / n, 2))
    return validated.groupBy(by).agg(n.alias("checked"), wrong.alias("mismatches"), F.count("reason").alias("unverifiable"), share.alias("confidence"))


def verify_reason(draft: Column, evidence: Column, query: Column) -> Column:
    """Why a draft needs a second look, in order: recommendation, precision, no numbers, unsupported; else ``clean``."""
    numbers = text.numeric_tokens(F.coalesce(draft, F.lit("")))
    known = text.numeric_tokens(F.coalesce(evidence, F.lit("")))
    missing = F.filter(numbers, lambda n: ~F.array_contains(known, n))
    return F.when(query.rlike(RECOMMENDATION), "recommendation").when(query.rlike(PRECISION), "precision").when(F.size(numbers) == 0, "no numbers").when(F.size(missing) > 0, "unsupported").otherwise("clean")
