"""Quality scores by a regularised quadratic discriminant.

Each text becomes a few statistics of its characters, words and lines, transformed so
that their spread hardly depends on the text's length. A class is a normal
distribution over them; its covariance is shrunk towards a sphere by as much as its
number of rows asks for, and its Cholesky factor is kept. A score is the difference of
the two log densities, carried to a probability by a logistic curve fitted on the
learning rows. Class moments and the curve come from sums over all learning rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import hot_keys, join_hot, materialize, small_batches

STATISTICS = ("upper", "digits", "stops", "signs", "blanks", "length", "spread", "echoes", "words", "pairs", "lines")
#: Values beyond so many standard deviations of both classes count as if they lay there.
REACH = 3.5
#: Columns of the histogram for the curve: log-density differences from -LIMIT to LIMIT.
LIMIT, BINS = 60.0, 1200

_OTHER, _LOWER, _UPPER, _DIGIT, _STOP, _SIGN, _BLANK = range(7)


def _kinds() -> np.ndarray:
    """Kind of each character of the basic plane."""
    kind = np.zeros(1 << 16, np.uint8)
    for i in range(1 << 16):
        c = chr(i)
        if c.isspace():
            kind[i] = _BLANK
        elif c.isalpha():
            kind[i] = _UPPER if c.isupper() else _LOWER
        elif c.isdigit():
            kind[i] = _DIGIT
        elif c in ".,;:!?'\"()-":
            kind[i] = _STOP
        else:
            kind[i] = _SIGN
    return kind


_KINDS: np.ndarray | None = None


def _share(part: float, whole: float, few: float) -> float:
    """The angle of a share of counts, whose spread is about the same for all shares; with far fewer than ``few`` counted it stays near zero."""
    return float(np.arcsin(np.sqrt((part + 0.375) / (whole + 0.75 + few))))


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of a whole text, in the order of ``STATISTICS``; a null text counts as empty."""
    global _KINDS
    if _KINDS is None:
        _KINDS = _kinds()
    text = text or ""
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    kinds = np.bincount(_KINDS[np.minimum(codes, 0xFFFF)], minlength=7)
    letters, chars = int(kinds[_LOWER] + kinds[_UPPER]), len(codes)
    words, lines = text.split(), text.split("\n")
    n = len(words)
    ids = np.fromiter(map(hash, words), np.int64, n)
    sizes = np.fromiter(map(len, words), np.int64, n)
    pairs = ids[:-1] * np.int64(1_000_003) + ids[1:]
    return [
        _share(kinds[_UPPER], letters, 30),
        _share(kinds[_DIGIT], chars, 40),
        _share(kinds[_STOP], chars, 40),
        _share(kinds[_SIGN], chars, 40),
        _share(kinds[_BLANK], chars, 0),
        float(np.log1p(sizes.mean())) if n else 0.0,
        float(np.log1p(sizes.std())) if n else 0.0,
        _share(int((ids[1:] == ids[:-1]).sum()), max(0, n - 1), 8),
        float(np.log1p(len(np.unique(ids))) / np.log1p(n)) if n else 1.0,
        float(np.log1p(len(np.unique(pairs))) / np.log1p(n - 1)) if n > 1 else 1.0,
        _share(len(lines) - len(set(lines)), len(lines) - 1, 6),
    ]


def describe(docs: DataFrame, *, text_col="text", id_col="doc_id") -> DataFrame:
    """The id and the statistics of each row, as a table in the shared folder: texts are read once."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([statistics(t.as_py()) for t in batch.column(1)]).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(found[:, j]) for j in range(len(STATISTICS)))], ["id", *STATISTICS])

    schema = f"id {rows.schema['id'].dataType.simpleString()}, " + ", ".join(f"{c} double" for c in STATISTICS)
    return materialize(rows.mapInArrow(run, schema), "statistics")


class Discriminant:
    """Two classes' means and inverse Cholesky factors, the bounds of the statistics, and the curve's two numbers."""

    def __init__(self, low: np.ndarray, high: np.ndarray, means: np.ndarray, factors: list[np.ndarray], curve: tuple[float, float] = (0.0, 1.0)):
        self.low, self.high, self.means, self.factors, self.curve = low, high, means, factors, curve
        self.inverse = [np.linalg.inv(f) for f in factors]
        self.log_det = [float(np.log(np.diag(f)).sum()) for f in factors]

    def difference(self, x: np.ndarray) -> np.ndarray:
        """Log density under class 1 less that under class 0, of each row."""
        x = np.clip(x, self.low, self.high)
        zero, one = ((((x - m) @ i.T) ** 2).sum(1) / 2 + d for m, i, d in zip(self.means, self.inverse, self.log_det))
        return np.clip(zero - one, -LIMIT, LIMIT)

    def score(self, difference: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.curve[0] + self.curve[1] * difference)))


def shrunk(cov: np.ndarray, n: int) -> np.ndarray:
    """The covariance of ``n`` rows, moved towards a sphere of the same size by the oracle-approximating share."""
    p = len(cov)
    size, square = np.trace(cov), float((cov**2).sum())
    apart = (n + 1 - 2 / p) * (square - size**2 / p)
    share = min(1.0, ((1 - 2 / p) * square + size**2) / apart) if apart > 0 else 1.0
    share = max(share, 1e-3)
    return (1 - share) * cov + share * max(size / p, 1e-6) * np.eye(p)


def discriminant(counts: np.ndarray, sums: np.ndarray, products: np.ndarray) -> Discriminant:
    """The classes from their counts, sums of statistics and sums of products; statistics are put on one scale before shrinking."""
    means = sums / counts[:, None]
    covs = np.array([products[c] / counts[c] - np.outer(means[c], means[c]) for c in (0, 1)])
    spread = np.sqrt(np.maximum(np.diagonal(covs, axis1=1, axis2=2), 1e-12))
    low, high = (means - REACH * spread).min(0), (means + REACH * spread).max(0)
    scale = np.sqrt((counts[:, None] * spread**2).sum(0) / counts.sum())
    scale = np.maximum(scale, 1e-4)
    factors = [np.linalg.cholesky(shrunk(covs[c] / np.outer(scale, scale), int(counts[c])) * np.outer(scale, scale)) for c in (0, 1)]
    return Discriminant(low, high, means, factors)


def curve(bins: list[tuple[float, int, int]]) -> tuple[float, float]:
    """Offset and slope of the logistic curve through (difference, label, rows), by Newton steps with a weak pull towards (0, 1)."""
    x, y, n = (np.array([b[i] for b in bins], float) for i in range(3))
    a = np.stack([np.ones_like(x), x], 1)
    at, start = np.array([0.0, 1.0]), np.array([0.0, 1.0])
    loss = lambda w: float((n * np.logaddexp(0, np.where(y > 0.5, -1, 1) * (a @ w))).sum() + ((w - start) ** 2).sum() / 2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-(a @ at)))
        slope = a.T @ (n * (p - y)) + (at - start)
        bend = (a * (n * p * (1 - p))[:, None]).T @ a + np.eye(2)
        step, size = np.linalg.solve(bend, slope), 1.0
        while size > 1e-6 and loss(at - size * step) > loss(at):
            size /= 2
        at = at - size * step
        if np.abs(step).max() < 1e-9:
            break
    return float(at[0]), float(max(at[1], 1e-3))


def fit(described: DataFrame, labels: DataFrame, usable: Column, *, id_col="doc_id", label_col="quality") -> Discriminant | None:
    """Learn from all rows of ``describe`` whose id has a label and satisfies ``usable``, a condition on ``id``.

    An id with both labels, or none that is 0 or 1, teaches nothing; repeated rows count
    as often as they occur. None without two rows of each class. Only sums and a
    histogram of fixed size reach the driver.
    """
    spark = described.sparkSession
    known = labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).alias("label"), F.max(label_col).alias("other"))
    known = known.where("label = other and id is not null").select("id", F.col("label").cast("int").alias("label"))
    rows = materialize(join_hot(described.where(usable), known, "id", hot_keys(described, "id")), "labelled")
    d, pairs = len(STATISTICS), [(i, j) for i in range(len(STATISTICS)) for j in range(i + 1)]
    sums = [F.sum(c).alias(f"s{i}") for i, c in enumerate(STATISTICS)] + [F.sum(F.col(STATISTICS[i]) * F.col(STATISTICS[j])).alias(f"p{k}") for k, (i, j) in enumerate(pairs)]
    found = {r["label"]: r for r in rows.groupBy("label").agg(F.count("*").alias("n"), *sums).collect()}
    if len(found) < 2 or min(r["n"] for r in found.values()) < 2:
        return None
    products = np.zeros((2, d, d))
    for c in (0, 1):
        for k, (i, j) in enumerate(pairs):
            products[c, i, j] = products[c, j, i] = found[c][f"p{k}"]
    model = discriminant(np.array([found[c]["n"] for c in (0, 1)], float), np.array([[found[c][f"s{i}"] for i in range(d)] for c in (0, 1)]), products)
    width = 2 * LIMIT / BINS
    cells = _differences(rows, model, ["label"]).groupBy(F.floor(F.col("difference") / width).alias("cell"), "label").count()
    model.curve = curve(sorted(((r["cell"] + 0.5) * width, r["label"], r["count"]) for r in cells.collect()))
    return model


def _differences(rows: DataFrame, model: Discriminant, kept: list[str]) -> DataFrame:
    """The columns kept and the ``difference`` of each row."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    narrow = rows.select(*kept, *STATISTICS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([batch.column(len(kept) + j).to_numpy(zero_copy_only=False) for j in range(len(STATISTICS))], 1) if batch.num_rows else np.zeros((0, len(STATISTICS)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(shared.value.difference(x))], [*kept, "difference"])

    return narrow.mapInArrow(run, ", ".join(f"{c} {narrow.schema[c].dataType.simpleString()}" for c in kept) + ", difference double")


def score(described: DataFrame, model: Discriminant | None) -> DataFrame:
    """``id`` and ``score`` of each row of ``describe``, 0 to 1, higher where label 1 is likelier.

    Null and empty texts have the statistics of an empty text, and so one common score;
    equal texts have equal scores; without a model all scores are 0.5.
    """
    if model is None:
        return described.select("id", F.lit(0.5).alias("score"))
    offset, slope = model.curve
    return _differences(described, model, ["id"]).select("id", (1 / (1 + F.exp(-(F.lit(offset) + F.lit(slope) * F.col("difference"))))).alias("score"))
