"""Greedy packing of the items of an array: a fold that is sequential within a row."""

from __future__ import annotations

from itertools import accumulate

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _groups(rule):
    """A vectorized function of an array of sizes that gives each item's group: ``rule`` walks one array. Appending within a native fold would be quadratic."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def grouped(sizes: pd.Series) -> pd.Series:
        return sizes.map(lambda row: rule([int(n) for n in row]) if row is not None else [])

    return grouped


def pack_groups(sizes: Column, budget: int) -> Column:
    """Group number of each item: a new group starts where an item would exceed the budget of one that is not empty."""
    return pack_long(budget)(sizes)


def pack_long(budget: int):
    """Group number of each item: a new group starts where an item would exceed the budget of one that is not empty."""

    def rule(sizes: list[int]) -> list[int]:
        out, group, used = [], 0, 0
        for n in sizes:
            if out and used + n > budget:
                group, used = group + 1, 0
            used += n
            out.append(group)
        return out

    return _groups(rule)


def packed_runs(budget: int | None):
    """The groups of :func:`pack_long` as a struct of arrays: ``starts``, ``counts`` and ``totals`` of each. An item that ``fresh`` marks begins a group whatever its size; without a budget only such an item does.

    With them a row's groups are slices of its own array, so items need not be dealt out and gathered again.
    """

    def rule(sizes: list[int], fresh: list[bool]) -> tuple[list[int], list[int], list[int]]:
        starts, totals = [], []
        for i, (n, new) in enumerate(zip(sizes, fresh)):
            if not starts or new or budget is not None and totals[-1] + n > budget:
                starts.append(i)
                totals.append(0)
            totals[-1] += n
        return starts, [b - a for a, b in zip(starts, [*starts[1:], len(sizes)])], totals

    @F.pandas_udf("starts array<int>, counts array<int>, totals array<long>")
    def grouped(sizes: pd.Series, fresh: pd.Series) -> pd.DataFrame:
        found = [([], [], []) if n is None else rule([int(x) for x in n], list(new)) for n, new in zip(sizes, fresh)]
        return pd.DataFrame(found, columns=["starts", "counts", "totals"])

    def of(sizes: Column, fresh: Column | None = None) -> Column:
        return grouped(sizes, F.transform(sizes, lambda n: F.lit(False)) if fresh is None else fresh)

    return of


def runs_of(groups: str, make) -> Column:
    """An array of structs: ``make(start, count, total, number)`` of each group that :func:`packed_runs` has put into the column ``groups``; starts count from 1."""
    zipped = F.arrays_zip(F.col(f"{groups}.starts"), F.col(f"{groups}.counts"), F.col(f"{groups}.totals"))
    return F.transform(zipped, lambda x, i: make(x["starts"] + 1, x["counts"], x["totals"], i))


def join_while_small(least: int, most: int):
    """Group number of each item: one joins the group before while that is below ``least`` and both stay within ``most``."""

    def rule(sizes: list[int]) -> list[int]:
        out, group, used = [], -1, 0
        for n in sizes:
            if group >= 0 and used < least and used + n <= most:
                used += n
            else:
                group, used = group + 1, n
            out.append(group)
        return out

    return _groups(rule)


def grow_to(least: int):
    """Group number of each item: a group grows until it has ``least``; what is left at the end joins the last full group."""

    def rule(sizes: list[int]) -> list[int]:
        out, group, used = [], 0, 0
        for n in sizes:
            if used >= least:
                group, used = group + 1, 0
            used += n
            out.append(group)
        return [min(g, group - 1) for g in out] if used < least and group > 0 else out

    return _groups(rule)


def pack_counted(budget: int, most_items: int):
    """Group number of each item: a new group starts where an item would exceed the budget, or after ``most_items``."""

    def rule(sizes: list[int]) -> list[int]:
        out, group, used, items = [], -1, 0, 0
        for n in sizes:
            if group < 0 or items >= most_items or used + n > budget:
                group, used, items = group + 1, 0, 0
            used, items = used + n, items + 1
            out.append(group)
        return out

    return _groups(rule)


def running_spans(lengths: Column) -> Column:
    """Half-open spans ``(s, e)`` of consecutive items of the given lengths, without empty ones."""

    def rule(sizes: list[int]) -> list[int]:
        return list(accumulate(sizes))

    spans = F.zip_with(lengths, _groups(rule)(lengths), lambda n, end: F.struct((end - n).cast("int").alias("s"), end.cast("int").alias("e")))
    return F.filter(spans, lambda x: x["e"] > x["s"])


def budget_concat(texts: Column, budget: int, separator: str = "\n\n") -> Column:
    """Texts in order within a budget of characters; one that would exceed it is skipped, later ones may still fit. Separators do not count."""
    start = F.struct(F.lit(0).alias("used"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, text: Column) -> Column:
        fits = acc["used"] + F.length(text) <= budget
        return F.struct(F.when(fits, acc["used"] + F.length(text)).otherwise(acc["used"]).alias("used"), F.when(fits, F.concat(acc["out"], F.array(text))).otherwise(acc["out"]).alias("out"))

    return F.aggregate(texts, start, step, lambda acc: F.array_join(acc["out"], separator))
