"""Mixing sources to target weights by blocks.

The words of a source's documents, in a hashed order, are packed into blocks of one
length (a source's last block may be shorter). Every output shard draws how many of its
slots each source fills from a multinomial over what the sources' targets still lack;
what the shards draw is what the mix takes. The slots of a source are numbered over all
shards; a keyed permutation of the block numbers, a new one for each pass over the
source, maps a slot to its block, so a pass takes each block once. Blocks then meet the
documents they were cut from by their number.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import free_names, give_back, materialize, running_base

WORD = r"[^\x20\x09-\x0D]+"
#: Words in a block, rows whose words are summed together, slots of an output shard (more with over ``MOST_SHARDS`` shards), and bounds of what the driver holds.
BLOCK, CELL_ROWS, SHARD_SLOTS, MOST_SHARDS, MOST_SOURCES = 32, 500, 128, 4_096, 10_000
#: A block is taken so many times at most.
PASSES = 2
M64 = 0xFFFFFFFFFFFFFFFF


def targets(sizes: Sequence[int], weights: Sequence[float], share: float = 1.5, most: float = 2.0) -> list[float]:
    """Shares of ``share`` times all sizes by weight; none above ``most`` times its size, the excess shared again by weight."""
    left, out, free = share * sum(sizes), [0.0] * len(sizes), {i for i, s in enumerate(sizes) if s}
    while free:
        by = left / sum(weights[i] for i in free)
        full = {i for i in free if weights[i] * by > most * sizes[i]}
        for i in full or free:
            out[i] = most * sizes[i] if full else weights[i] * by
            left -= out[i]
        free -= full or free
    return out


def permuted(index: np.ndarray, size: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of ``range(size)`` at ``index``: a four-round Feistel network, walked until inside."""
    half = np.uint64(max(1, (max(2, size) - 1).bit_length() + 1 >> 1))
    low = np.uint64((1 << int(half)) - 1)
    x, todo = index.astype(np.uint64), np.ones(len(index), bool)
    while todo.any():
        left, right = x[todo] >> half, x[todo] & low
        for r in range(4):
            mixed = (right + np.uint64((key * 4 + r) * 0x9E3779B97F4A7C15 & M64)) * np.uint64(0xBF58476D1CE4E5B9)
            mixed = (mixed ^ mixed >> np.uint64(31)) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ (mixed >> np.uint64(29) & low)
        x[todo] = left << half | right
        todo = x >= size
    return x.astype(np.int64)


@dataclass
class Mix:
    """What the driver decides: per source its target and number of blocks; the draws per shard."""

    sources: list[str | None]
    sizes: list[int]
    targets: list[float]
    blocks: np.ndarray
    draws: np.ndarray

    @property
    def slots(self) -> int:
        return int(self.draws.sum())


def draw(quota: np.ndarray, most: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Per shard and source the slots it fills: a multinomial over what is left of the quotas, no source beyond ``most`` in all.

    All shards have the same number of slots, give or take one. As later shards make up for
    what earlier ones drew too many or too few, totals stray from the quotas by no more
    than one shard's draws do.
    """
    rng, out = np.random.default_rng(seed), np.zeros((shards, len(quota)), np.int64)
    left, room, slots = quota.astype(float), most.copy(), int(quota.sum())
    for k in range(shards):
        n = (slots * (k + 1)) // shards - (slots * k) // shards
        chance = np.where(room > 0, np.maximum(left, 1e-9), 0.0)
        if n and chance.sum() > 0:
            drawn = np.minimum(rng.multinomial(n, chance / chance.sum()), room)
            short = n - int(drawn.sum())
            for i in np.argsort(drawn - left, kind="stable"):  # what a source cannot give comes from those that lack most
                more = min(short, int(room[i] - drawn[i]))
                drawn[i] += more
                short -= more
            out[k] = drawn
            left -= drawn
            room -= drawn
    return out


def decide(counted: dict[str | None, int], weights: Sequence[float], seed: int = 11) -> Mix:
    sources = sorted((s for s in counted if s is not None)) + [None] * (None in counted)
    sizes = [counted[s] for s in sources]
    goal = targets(sizes, [weights[i % len(weights)] for i in range(len(sources))])
    blocks = -(-np.array(sizes, np.int64) // BLOCK)
    quota = np.array([min(round(g * b / s), PASSES * b) if s else 0 for g, b, s in zip(goal, blocks.tolist(), sizes)], np.int64)
    shards = int(min(max(1, -(-quota.sum() // SHARD_SLOTS)), MOST_SHARDS, max(1, 4_000_000 // max(1, len(sources)))))
    return Mix(sources, sizes, goal, blocks, draw(quota, PASSES * blocks, shards, seed))


def taken_blocks(docs: DataFrame, mix: Mix, seed: int = 11) -> DataFrame:
    """``(s, block, times, low, high)``: how many slots of all output shards map to each block, and the first and last of them as ``(shard, slot)``."""
    spark = docs.sparkSession
    ends = np.cumsum(mix.draws.ravel())
    before = np.cumsum(mix.draws, 0) - mix.draws
    shared = spark.sparkContext.broadcast((ends, before.ravel(), mix.blocks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends, before, blocks = shared.value
        for batch in batches:
            slot = batch.column(0).to_numpy()
            cell = np.searchsorted(ends, slot, "right")
            start = np.where(cell > 0, ends[cell - 1], 0)
            s = cell % len(blocks)
            rank = before[cell] + slot - start
            turn, place, out = rank // blocks[s], rank % blocks[s], np.zeros(len(slot), np.int64)
            for source, t in set(zip(s.tolist(), turn.tolist())):
                own = (s == source) & (turn == t)
                out[own] = permuted(place[own], int(blocks[source]), seed + 1_000_003 * source + 7919 * t)
            shard = cell // len(blocks)
            first = np.where(shard > 0, ends[np.maximum(shard * len(blocks) - 1, 0)], 0)
            yield pa.RecordBatch.from_arrays([pa.array(s.astype(np.int32)), pa.array(out), pa.array(shard.astype(np.int32)), pa.array((slot - first).astype(np.int32))], ["s", "block", "shard", "slot"])

    slots = spark.range(mix.slots).mapInArrow(run, "s int, block long, shard int, slot int")
    place = F.struct("shard", "slot")
    return slots.groupBy("s", "block").agg(F.count("*").alias("times"), F.min(place).alias("low"), F.max(place).alias("high"))


def row_hashes(id_col: str, text_col: str, source_col: str) -> tuple[Column, Column]:
    """What orders the rows of a source, also those without an id or with the same one, and a hash of text and source."""
    text_hash = F.xxhash64(text_col, source_col)
    return F.xxhash64(F.col(id_col).cast("string"), text_hash, F.lit("mix order")), text_hash


def mix_pieces(docs: DataFrame, *, id_col: str, text_col: str, source_col: str, weights: Sequence[float]) -> tuple[DataFrame, DataFrame]:
    """Rows (one per document, with ``key`` to tell repeated ones apart) and the pieces that blocks cut from them.

    Pieces: ``key``, ``first`` and ``last`` word (end exclusive) within the document, ``times``, and the first and last shard and slot that take them.
    """
    spark = docs.sparkSession
    size = F.regexp_count(F.coalesce(text_col, F.lit("")), F.lit(WORD)).cast("long")
    h, text_hash = row_hashes(id_col, text_col, source_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), size.alias("size"), h.alias("h"), text_hash.alias("text_hash"))
    rows = materialize(rows, "word-counts")
    counted = rows.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).limit(MOST_SOURCES + 1).collect()
    if len(counted) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    mix = decide({r["source"]: r["size"] for r in counted}, weights)
    rows_of = {r["source"]: r["n"] for r in counted}
    table = spark.createDataFrame(
        [(i, s, mix.sizes[i], float(mix.targets[i]), max(1, rows_of[s] // CELL_ROWS)) for i, s in enumerate(mix.sources)],
        "s int, source string, source_size long, target double, cells long",
    )
    rows = rows.join(F.broadcast(table), rows["source"].eqNullSafe(table["source"])).drop(table["source"])
    rows = rows.withColumn("cell", F.pmod("h", "cells")).drop("cells")
    base = running_base(rows, ["s"], "cell", F.col("size"), "base")
    inside = Window.partitionBy("s", "cell").orderBy("h", "doc_id", "text_hash", "size")
    placed = rows.withColumn("r", F.row_number().over(inside)).withColumn("own", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    placed = placed.join(base, ["s", "cell"]).withColumn("start", F.col("base") + F.col("own") - F.col("size"))
    placed = placed.withColumn("key", F.struct("s", "cell", "r")).drop("base", "own")
    n, at = F.lit(BLOCK), F.col("start")
    covered = placed.where("size > 0").select("key", "s", "start", "size", F.explode(F.sequence(F.floor(at / n), F.floor((at + F.col("size") - 1) / n))).alias("block"))
    met = covered.join(taken_blocks(docs, mix), ["s", "block"])
    pieces = met.select(
        "key",
        (F.greatest("start", F.col("block") * n) - at).alias("first"),
        (F.least(at + F.col("size"), (F.col("block") + 1) * n) - at).alias("last"),
        "times",
        "low",
        "high",
    )
    return placed, pieces


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = (5, 2, 1)) -> DataFrame:
    """Per row ``doc_id, size, source_size, target, taken``: how many of its words the mix takes, repeats counted;
    ``first_shard, first_slot, last_shard``: where the mix has them (null where it takes none).

    Sources by code point, null last, have ``weights`` in turn. A null or blank text has
    size 0 and is never taken; repeated rows count one by one; an empty table gives an
    empty result. No block is taken more than twice, so no document more than twice its
    size. All draws have fixed seeds: a rerun on the same rows gives the same mix.
    """
    if docs.isEmpty():
        return docs.sparkSession.createDataFrame([], "doc_id long, size long, source_size long, target double, taken long, first_shard int, first_slot int, last_shard int")
    placed, pieces = mix_pieces(docs, id_col=id_col, text_col=text_col, source_col=source_col, weights=weights)
    taken = pieces.groupBy("key").agg(F.sum((F.col("last") - F.col("first")) * F.col("times")).alias("taken"), F.min("low").alias("low"), F.max("high").alias("high"))
    where = [F.col("low.shard").alias("first_shard"), F.col("low.slot").alias("first_slot"), F.col("high.shard").alias("last_shard")]
    return placed.join(taken, "key", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), *where)


def cut(text: str, ranges: list[tuple[int, int]], size: int) -> str:
    """The words of the ranges, with what stands between them; parts that do not touch are set apart by a line break."""
    joined: list[list[int]] = []
    for first, last in sorted(ranges):
        if joined and joined[-1][1] == first:
            joined[-1][1] = last
        else:
            joined.append([first, last])
    if joined == [[0, size]]:
        return text
    spans = [m.span() for m in re.finditer(WORD, text)]
    return "\n".join(text[spans[a][0] : spans[b - 1][1]] for a, b in joined)


def mixed_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", chars_col: str = "n_chars", weights: Sequence[float] = (5, 2, 1)) -> DataFrame:
    """The mix as documents: for each pass in which the mix takes words of a row, the row with these words as its text.

    A row that is taken whole keeps its text as it is; one that is not taken is left out.
    All columns stay; ``chars_col``, where there is one, gets the new length.
    """
    if docs.isEmpty():
        return docs
    placed, pieces = mix_pieces(docs, id_col=id_col, text_col=text_col, source_col=source_col, weights=weights)
    h, t, n, size, parts, rh, rt, rn = free_names(docs.columns, "h", "t", "n", "words", "parts", "row_h", "row_t", "row_n")
    cuts = pieces.groupBy("key").agg(F.collect_list(F.struct("first", "last", "times")).alias("cuts"))
    again = F.row_number().over(Window.partitionBy("h", "text_hash").orderBy("key"))
    chosen = placed.join(cuts, "key").select(F.col("h").alias(h), F.col("text_hash").alias(t), again.alias(n), F.col("size").alias(size), F.col("cuts").alias(parts))
    hash_of, text_of = row_hashes(id_col, text_col, source_col)
    rest = [c for c in docs.columns if c not in (id_col, text_col, source_col)]  # rows with equal id, text and source go by what else they hold
    by = F.xxhash64(F.to_json(F.struct(*rest))) if rest else F.lit(0)
    rows = docs.withColumns({rh: hash_of, rt: text_of})
    rows = rows.withColumn(rn, F.row_number().over(Window.partitionBy(rh, rt).orderBy(by)))
    # equality of the repeat numbers as two inequalities: the join's keys stay those of the window, and texts move once
    met = rows.join(chosen, (F.col(rh) == F.col(h)) & (F.col(rt) == F.col(t)) & (F.col(rn) <= F.col(n)) & (F.col(rn) >= F.col(n)))
    met = met.select(*docs.columns, size, parts)
    names, schema = docs.columns, docs.schema
    k, chars = docs.columns.index(text_col), docs.columns.index(chars_col) if chars_col in docs.columns else -1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, parts, texts = batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), batch.column(k)
            at, out = [], []
            for i in range(batch.num_rows):
                for turn in range(1, 1 + max(p["times"] for p in parts[i])):
                    at.append(i)
                    out.append(cut(texts[i].as_py(), [(p["first"], p["last"]) for p in parts[i] if p["times"] >= turn], size[i]))
            cols = [c.take(pa.array(at, pa.int64())) for c in batch.columns[:-2]]
            cols[k] = pa.array(out, pa.string())
            if chars >= 0:
                cols[chars] = pa.array([len(t) for t in out], pa.int64()).cast(batch.column(chars).type)
            yield pa.RecordBatch.from_arrays(cols, names=names)
        give_back()

    return met.mapInArrow(run, schema)
