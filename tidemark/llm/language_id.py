"""Language identification with error-correcting output codes.

Every language gets a codeword. One binary classifier per bit looks at character
n-grams and gives a signed margin; a document's language is the codeword with the
least weighted loss against the margins, where bits that were reliable on a
validation part of the sample weigh more. A small gap to the second codeword marks
the document as ambiguous.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import give_back, no_clash, small_batches

UNDETERMINED = "und"
#: More distinct values of the language column are an error in the data.
MOST_LANGUAGES = 1000


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """``n`` codewords of +1 and -1: all distinct splits for up to 6 languages, else random ones well apart."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 6:
        bits = 2 ** (n - 1) - 1
        return np.array([[1 if i == 0 or not (b + 1) >> (i - 1) & 1 else -1 for b in range(bits)] for i in range(n)], float)
    bits, rng, best, apart = int(np.ceil(10 * np.log2(n))), np.random.default_rng(seed), None, -1.0
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], (n, bits))
        split = np.abs(code.sum(0)) < n
        near = (code @ code.T - 2 * bits * np.eye(n)).max()
        if split.all() and bits - near > apart:
            best, apart = code, bits - near
    return best


class NgramHasher:
    """Square-rooted, unit-length counts of the hashed 1- to 4-grams of a text's letters and word borders."""

    def __init__(self, dims: int):
        self.dims = dims

    def letters(self, text: str) -> np.ndarray | None:
        """Code points in lower case, each run of others than letters as one space; None without a letter."""
        kept = "".join(c if c.isalpha() else " " for c in text.lower()) if not text.isascii() else text.lower().translate(ASCII)
        words = kept.split()
        if not words:
            return None
        return np.frombuffer(f" {' '.join(words)} ".encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)

    def __call__(self, text: str | None) -> np.ndarray | None:
        c = self.letters(text) if text else None
        if c is None:
            return None
        total, gram = np.zeros(self.dims), np.zeros(len(c), np.uint64)
        for n in range(1, 5):
            gram = (gram[: len(c) - n + 1] * np.uint64(0x9E3779B97F4A7C15)) + c[n - 1 :] + np.uint64(n)
            mixed = (gram ^ gram >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
            total += np.bincount((mixed >> np.uint64(40)).astype(np.int64) % self.dims, minlength=self.dims)
        out = np.sqrt(total)
        return out / np.linalg.norm(out)


ASCII = {i: " " for i in range(128) if not chr(i).isalpha()}


class CodeModel:
    """The bit classifiers with their codewords; see :func:`train`."""

    def __init__(self, languages: list[str], code: np.ndarray, weights: np.ndarray, bias: np.ndarray, trust: np.ndarray):
        self.languages, self.code, self.weights, self.bias, self.trust = languages, code, weights, bias, trust

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each row of features: best language's index, its share of the soft votes (0 to 1), and its gap to the second."""
        margin = x @ self.weights + self.bias
        loss = (np.logaddexp(0, -margin[:, None, :] * self.code[None]) * self.trust).sum(2) / self.trust.sum()
        vote = np.exp(-(loss - loss.min(1, keepdims=True)) * 8)
        vote /= vote.sum(1, keepdims=True)
        order = np.sort(vote, axis=1)
        return loss.argmin(1), vote.max(1), order[:, -1] - (order[:, -2] if vote.shape[1] > 1 else 0)


def train(rows: list[tuple[str, np.ndarray]], dims: int, steps: int = 120, rate: float = 40.0, ridge: float = 1e-5) -> CodeModel | None:
    """Fit the bits' logistic classifiers by gradient steps; every fifth row only rates the bits."""
    if not rows:
        return None
    languages = sorted({lang for lang, _ in rows})
    code = codewords(len(languages))
    at = {lang: i for i, lang in enumerate(languages)}
    x = np.stack([v for _, v in rows]).astype(np.float32)
    label = np.array([at[lang] for lang, _ in rows])
    y = code[label].astype(np.float32)
    share = 1 / np.bincount(label)[label]
    share /= share.sum()
    fit = np.arange(len(rows)) % 5 != 4 if len(rows) >= 10 * len(languages) else np.ones(len(rows), bool)
    w, b = np.zeros((dims, code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    if len(languages) > 1:
        xf, yf, sf = x[fit], y[fit], share[fit, None].astype(np.float32)
        for _ in range(steps):
            g = sf * yf / (1 + np.exp(yf * (xf @ w + b)))
            w += rate * (xf.T @ g - ridge * w)
            b += 0.1 * rate * g.sum(0)
    rated = ~fit if (~fit).any() else fit
    right = (np.sign(x[rated] @ w + b) == y[rated]).mean(0)
    trust = np.clip(2 * right - 1, 0.05, 1)
    return CodeModel(languages, code, w, b, trust)


def fit(docs: DataFrame, usable: Column, *, text_col="text", lang_col="lang", id_col="doc_id", per_language: int = 300, dims: int = 8192) -> CodeModel | None:
    """Train on at most ``per_language`` rows of each language, taken by a hash of the id.

    Only rows where ``usable`` holds and language and text are not null count. The
    sample is the only thing that reaches the driver, as sparse n-gram counts.
    """
    rows = docs.where(usable & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(lang_col).count().limit(MOST_LANGUAGES + 1).collect()}
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not counts:
        return None
    of_lang = F.create_map(*[F.lit(x) for pair in counts.items() for x in pair])[F.col(lang_col)]
    order = F.xxhash64(F.col(id_col).cast("string"), F.lit("language sample"))
    early = (order.cast("double") / F.lit(2.0**64) + 0.5) * of_lang < 1.5 * per_language + 30
    some = rows.where(early).select(F.col(id_col).alias("id"), lang_col, F.col(text_col).alias("t"), order.alias("o"))
    first = Window.partitionBy(lang_col).orderBy("o", "id", F.xxhash64("t"))
    some = some.withColumn("r", F.row_number().over(first)).where(F.col("r") <= per_language).select(lang_col, "o", "t")
    hasher = NgramHasher(dims)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for lang, o, text in zip(*(c.to_pylist() for c in batch.columns)):
                v = hasher(text)
                if v is not None:
                    at = np.flatnonzero(v)
                    out.append((lang, o, at.astype(np.int32), v[at].astype(np.float32)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in out], pa.string()), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2].tobytes() for r in out], pa.binary()), pa.array([r[3].tobytes() for r in out], pa.binary())],
                ["lang", "o", "at", "v"],
            )

    got = some.mapInArrow(features, "lang string, o long, at binary, v binary").collect()
    dense = []
    for r in sorted(got, key=lambda r: (r["o"], r["lang"], bytes(r["at"]))):
        v = np.zeros(dims, np.float32)
        v[np.frombuffer(r["at"], np.int32)] = np.frombuffer(r["v"], np.float32)
        dense.append((r["lang"], v))
    return train(dense, dims)


def predict(docs: DataFrame, model: CodeModel | None, *, text_col="text", ambiguous_gap: float = 0.1, prefix: str = "") -> DataFrame:
    """Append ``lang_pred`` (``und`` for a null text, one without a letter, or an untrained model),
    ``score`` (0 to 1; 0 for ``und``) and ``ambiguous`` (the two best codewords are nearly as close; true for ``und``).

    All other columns stay; ``prefix`` avoids clashing names. Whole texts are read, long
    ones too; ties go to the language that sorts first; repeated rows stay repeated.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    names = [prefix + c for c in ("lang_pred", "score", "ambiguous")]
    no_clash(docs.columns, names)
    k = docs.columns.index(text_col)
    schema = T.StructType([*docs.schema.fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType()), T.StructField(names[2], T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            n = batch.num_rows
            lang, score, unsure = [UNDETERMINED] * n, np.zeros(n), np.ones(n, bool)
            if own is not None and n:
                hasher = NgramHasher(own.weights.shape[0])
                for start in range(0, n, 256):  # features are wide, a batch of short texts has many rows
                    rows, x = [], []
                    for i, text in enumerate(batch.column(k).slice(start, 256), start):
                        v = hasher(text.as_py())
                        if v is not None:
                            rows.append(i)
                            x.append(v)
                    if rows:
                        best, share, gap = own.decode(np.stack(x))
                        for j, i in enumerate(rows):
                            lang[i], score[i], unsure[i] = own.languages[best[j]], share[j], gap[j] < ambiguous_gap
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score), pa.array(unsure)], names=[f.name for f in schema])
        give_back()

    return docs.mapInArrow(run, schema)
