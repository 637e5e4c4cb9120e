"""Importance resampling towards a target distribution of hashed word features.

An untrained pre-tokeniser (a regex Split over the text with A-Z lower-cased) returns
words with offsets. Windows over consecutive offset pairs are features; the CRC of a
feature gives its bucket. Histograms of the corpus and of the target give each bucket a
gain, a document's weight is the sum of its features' gains, and Gumbel noise from a hash
of the id turns weights into a sample without replacement: the documents that score highest.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from math import floor, log
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import materialize, small_batches

#: Words are runs of digits, letters a to z and characters beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A long text is cut at a character between words after at least so many characters, as the pre-tokeniser keeps far more than the text in memory.
PIECE = 1 << 16


@cache
def _splitter():
    from tokenizers import Regex, pre_tokenizers

    return pre_tokenizers.Split(Regex(WORD), behavior="removed", invert=True)


@cache
def _gap():
    import re

    return re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]")


def lowered(text: str) -> str:
    """A-Z in lower case, all else as it is."""
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def offsets(text: str) -> list[tuple[int, int]]:
    """Start and end of each word of a lowered text, as the pre-tokeniser gives them."""
    if len(text) <= PIECE:
        return [span for _, span in _splitter().pre_tokenize_str(text)]
    found, start = [], 0
    while start < len(text):
        gap = _gap().search(text, start + PIECE)
        end = gap.start() if gap else len(text)
        found += [(start + a, start + b) for _, (a, b) in _splitter().pre_tokenize_str(text[start:end])]
        start = end
    return found


def buckets_of(text: str, longest: int, buckets: int) -> tuple[int, np.ndarray]:
    """The number of words of a text and the bucket of each feature, repeats included."""
    text = lowered(text)
    spans = offsets(text)
    words = [text[a:b].encode("utf-8", "replace") for a, b in spans]
    out = [crc32(w) % buckets for w in words]
    for size in range(2, longest + 1):
        out += [crc32(b" ".join(words[i : i + size])) % buckets for i in range(len(words) - size + 1)]
    return len(spans), np.array(out, np.uint16 if buckets <= 1 << 16 else np.uint32)


def describe(docs: DataFrame, *, text_col="text", id_col="doc_id", longest: int = 1, buckets: int = 10_000) -> DataFrame:
    """Per row its id, ``n_words``, ``n_features`` and the features' buckets, packed, as a table in the shared folder.

    Features are all runs of 1 to ``longest`` words; a null text has none. Texts are read once.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [buckets_of(t.as_py() or "", longest, buckets) for t in batch.column(1)]
            columns = [batch.column(0), pa.array([n for n, _ in found], pa.int64()), pa.array([len(b) for _, b in found], pa.int64()), pa.array([b.tobytes() for _, b in found], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n_words", "n_features", "packed"])

    return materialize(rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, n_words long, n_features long, packed binary"), "features")


def histogram(described: DataFrame, buckets: int = 10_000) -> np.ndarray:
    """How many features lie in each bucket; tasks count on their own, then buckets are added up."""
    kind = np.uint16 if buckets <= 1 << 16 else np.uint32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for packed in batch.column(0):
                total += np.bincount(np.frombuffer(packed.as_py(), kind), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in described.select("packed").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Of each bucket the thousandfold log ratio of its smoothed shares in the target and in the corpus, rounded down."""
    s_all, t_all, m = int(corpus.sum()), int(target.sum()), len(corpus)
    return np.array([floor(1000 * log((t + 1) * (s_all + m) / ((s + 1) * (t_all + m)))) for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def weigh(described: DataFrame, gain: np.ndarray) -> DataFrame:
    """``id``, ``n_words``, ``n_features`` and ``weight``, the sum of the features' gains (none: 0)."""
    kind = np.uint16 if len(gain) <= 1 << 16 else np.uint32
    shared = described.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weight = [int(shared.value[np.frombuffer(p.as_py(), kind)].sum()) for p in batch.column(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(weight, pa.int64())], ["id", "n_words", "n_features", "weight"])

    return described.mapInArrow(run, f"id {described.schema['id'].dataType.simpleString()}, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, *, percent: int = 10, least_words: int = 20, longest: int = 1, buckets: int = 10_000, seed: int = 2024, text_col="text", id_col="doc_id", target_text_col="text") -> DataFrame:
    """``id``, ``n_words``, ``n_features``, ``weight``, ``score`` and ``rank`` of each row of ``docs``.

    Rows with at least ``least_words`` words may be drawn: the ``percent`` of them (rounded
    down) that score highest are ranked from 1, ties by the smaller id, a null id last and
    hashed as ``null``; all other rows have a null rank. Repeated rows stay repeated and
    have ranks of their own. An empty target or corpus is smoothed like any other. Other
    columns are not looked at.

    The order is dealt to ranges of scores, each sorted on its own; a range's first rank is
    the sum of the smaller ranges' sizes, so no task sees all rows.
    """
    described = describe(docs, text_col=text_col, id_col=id_col, longest=longest, buckets=buckets)
    wanted = describe(target.select(F.lit(0).alias("id"), F.col(target_text_col).alias("text")), id_col="id", longest=longest, buckets=buckets)
    gain = gains(histogram(described, buckets), histogram(wanted, buckets))
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = materialize(weigh(described, gain).withColumn("score", F.col("weight") + noise), "scores")

    may = F.col("n_words") >= least_words
    order = [F.desc("score"), F.asc_nulls_last("id"), F.asc("_row")]  # rows of equal score and id are told apart, so that many of them spread
    ordered = scored.where(may).withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    ordered = materialize(ordered.drop("_row").withColumn("_at", F.monotonically_increasing_id()), "ordered")
    part, at = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ordered.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))  # one row for each range
    drawn = ordered.count() * percent // 100
    ranked = ordered.withColumn("_part", part).join(F.broadcast(starts), "_part").withColumn("rank", F.col("_start") + at + 1)
    columns = ["id", "n_words", "n_features", "weight", "score"]
    ranked = ranked.select(*columns, F.when(F.col("rank") <= drawn, F.col("rank")).cast("long").alias("rank"))
    return ranked.unionByName(scored.where(~may).select(*columns, F.lit(None).cast("long").alias("rank")))
