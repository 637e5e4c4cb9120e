"""The training-data pipeline: language, near duplicates, secrets, mixing, tokens.

Each stage takes all that its predecessor kept, as a table read back from Parquet, and
returns the columns of ``documents``; the last one returns the tokens' digests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import language_id, mixture, ngram_join, piece_codec, secret_scan
from tidemark.llm.common import anti_by_id, free_names, free_prefix, materialize, small_batches
from tidemark.llm.queries import documents, piece_model
from tidemark.session import ship

#: A document goes if the codeword nearest to it has less than this share of the votes: then no language explains it.
LEAST_SHARE = 0.3


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language, whatever their length: those without letters go, and those that no language explains."""
    ship(spark)
    model = language_id.fit(docs, F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    own = free_prefix(docs.columns, "lang_pred", "score", "ambiguous")
    found = language_id.predict(docs, model, prefix=own)
    kept = found.where((F.col(own + "lang_pred") != language_id.UNDETERMINED) & (F.col(own + "score") >= LEAST_SHARE))
    return (kept if model else docs).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id. Rows without an id stay.

    Of rows with the same id and text the one that sorts first by its other columns stays. Of
    different texts under one id the one that sorts first goes by this id, the others by
    numbers above all ids, so that each is judged by itself and may stay.
    """
    ship(spark)
    repeated = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if repeated.isEmpty():
        return _kept(docs, "doc_id")
    (key,) = free_names(docs.columns, "row_key")
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    rows = docs.join(repeated, "doc_id", "left_semi").groupBy("doc_id", "text").agg(F.min(F.struct(*rest)).alias("rest"))
    rows = materialize(rows.select("doc_id", "text", *[F.col("rest")[c].alias(c) for c in rest]), "repeated")
    first = rows.groupBy("doc_id").agg(F.min("text").alias("first"))
    above = docs.agg(F.max("doc_id")).first()[0] + 1
    own = F.when(F.col("text").eqNullSafe(F.col("first")), F.col("doc_id")).otherwise(above + F.monotonically_increasing_id())
    rows = materialize(rows.join(first, "doc_id").withColumn(key, own).select(*docs.columns, key), "keyed")
    others = anti_by_id(docs, repeated, ["doc_id"])
    return _kept(others.withColumn(key, F.col("doc_id")).unionByName(rows), key).drop(key)


def _kept(docs: DataFrame, key: str) -> DataFrame:
    found = materialize(ngram_join.near_duplicates(docs, id_col=key), "components")
    return anti_by_id(docs, found.where(f"{key} <> component_id").select(key).distinct(), [key])


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of each secret."""
    own = free_prefix(docs.columns, "base_spans", "spans")
    found = secret_scan.scan(docs, prefix=own)
    spans = F.col(own + "spans")
    found = found.withColumn("text", secret_scan.redact(F.col("text"), spans))
    return found.withColumn("n_chars", F.when(F.size(spans) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources by their weights, as documents."""
    ship(spark)
    small_batches(spark)
    return mixture.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document its number of tokens and the digests of its ids and of the text they decode to."""
    ship(spark)
    small_batches(spark)
    return piece_codec.encode_decode(docs, piece_model())


STAGES = [
    ("language ID", languages),
    ("n-gram Jaccard join", near_duplicates),
    ("secret scans", secrets),
    ("mixing sources to target weights", mixing),
    ("SentencePiece encoding", tokens),
]

#: Trained classifiers and pseudorandom draws are beyond SQL; the tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
