"""Filters and projections of retrieval requests and candidates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sections without narrative worth keeping.
DROPPED_SECTIONS = ("financial_statements", "exhibits", "reserved", "mine_safety", "unregistered_sales", "defaults_senior_securities")


def equality_filter(rows: DataFrame, **wanted: str | None) -> DataFrame:
    """Rows that equal every given value; no value, no filter."""
    clauses = [F.col(c) == v for c, v in wanted.items() if v is not None]
    return rows.where(reduce(Column.__and__, clauses)) if clauses else rows


def to_candidates(hits: DataFrame, fields: dict[str, Column]) -> DataFrame:
    """The fields of a candidate, each with its default where the hit has none."""
    return hits.select(*[(F.coalesce(F.col(c), d) if c in hits.columns else d).alias(c) for c, d in fields.items()])


def require_fields(requests: DataFrame, *fields: str) -> tuple[DataFrame, DataFrame]:
    """Requests with all fields filled, and the others with an ``error`` that names the missing ones."""
    missing = F.filter(F.array(*[F.when(F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == "", F.lit(c)) for c in fields]), lambda c: c.isNotNull())
    rows = requests.withColumn("_missing", missing)
    bad = rows.where(F.size("_missing") > 0).withColumn("error", F.concat(F.lit("missing: "), F.array_join("_missing", ", ")))
    return rows.where(F.size("_missing") == 0).drop("_missing"), bad.drop("_missing")


def drop_canonical_sections(sections: DataFrame, column: str = "section") -> DataFrame:
    return sections.where(~F.lower(column).isin(*DROPPED_SECTIONS))
