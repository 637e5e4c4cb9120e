"""Fiscal calendar arithmetic on columns. A label is ``FY2025-Q2``; its index is ``fy * 4 + q``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Days that a reported period may span.
QUARTER_DAYS = (80, 100)
YEAR_DAYS = (350, 380)
LABEL = r"^FY(\d{4})-Q([1-4])$"
LEGACY = r"^Q([1-4])_(?:FY)?(\d{4})$"


def make_label(fy: Column, quarter: Column) -> Column:
    return F.concat(F.lit("FY"), fy.cast("string"), F.lit("-Q"), quarter.cast("string"))


def derive_label(day: Column, year_end_month: Column) -> Column:
    """The fiscal quarter that a date belongs to, for a fiscal year that ends with a month."""
    month = F.month(day)
    quarter = F.floor(F.pmod(month - year_end_month - 1, F.lit(12)) / 3).cast("int") + 1
    return make_label(F.year(day) + F.when(month > year_end_month, 1).otherwise(0), quarter)


def fiscal_year(label: Column) -> Column:
    """Year of a canonical or legacy label, null for anything else."""
    text = F.trim(label)
    year = F.when(text.rlike(LABEL), F.regexp_extract(text, LABEL, 1)).when(text.rlike(LEGACY), F.regexp_extract(text, LEGACY, 2))
    return year.cast("int")


def fiscal_quarter(label: Column) -> Column:
    text = F.trim(label)
    quarter = F.when(text.rlike(LABEL), F.regexp_extract(text, LABEL, 2)).when(text.rlike(LEGACY), F.regexp_extract(text, LEGACY, 1))
    return quarter.cast("int")


def label_index(label: Column) -> Column:
    return fiscal_year(label) * 4 + fiscal_quarter(label)


def from_index(index: Column) -> Column:
    return make_label(F.floor((index - 1) / 4).cast("int"), (F.pmod(index - 1, F.lit(4)) + 1).cast("int"))


def strict_label(label: Column) -> Column:
    """The canonical label; an error for what is none."""
    return F.when(fiscal_year(label).isNull(), F.raise_error(F.concat(F.lit("no fiscal label: "), F.coalesce(label, F.lit("null"))))).otherwise(make_label(fiscal_year(label), fiscal_quarter(label)))


def normalize_label(label: Column) -> Column:
    """The canonical label, or the input as it is where it cannot be read."""
    return F.coalesce(make_label(fiscal_year(label), fiscal_quarter(label)), label)


def prior_label(label: Column, back: Column | int = 1) -> Column:
    """The label so many quarters back (at least one), across years; null where it cannot be read."""
    back = back if isinstance(back, Column) else F.lit(back)
    return F.when(back >= 1, from_index(label_index(label) - back))


def quarters_back(current: Column, prior: Column, position: Column) -> Column:
    """Distance of two labels; the position in the list (from 1) where one is unreadable or the distance is below 1."""
    gap = label_index(current) - label_index(prior)
    return F.when(gap >= 1, gap).otherwise(position)


def duration_fits(form: Column, start: Column, end: Column) -> Column:
    """Whether the days from start to end suit the form: a quarter for 10-Q, else a year."""
    days = F.datediff(end, start)
    quarterly = F.upper(form).startswith("10-Q")
    return F.when(quarterly, days.between(*QUARTER_DAYS)).otherwise(days.between(*YEAR_DAYS))
