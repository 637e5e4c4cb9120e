"""One query per operator over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import language_id, license_scan, media, mixture, ngram_join, piece_codec, quality, resampling, secret_scan, sharding, url_filter, vector_search, whitening
from tidemark.llm.common import small_batches


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def piece_model() -> str:
    """The model file's place; a parameter of the operator."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return piece_codec.encode_decode(documents(spark, sf_dir), piece_model())


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    docs = documents(spark, sf_dir)
    model = language_id.fit(docs, ~held_out)
    rows = docs.select("doc_id", "text", F.coalesce(held_out, F.lit(False)).alias("held_out"))
    return language_id.predict(rows, model).select("doc_id", "held_out", "lang_pred", "score", "ambiguous")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(documents(spark, sf_dir).select("doc_id", "text"))
    count = lambda k: F.size(F.filter("base_spans", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(secret_scan.as_text(F.col("base_spans")), 256).alias("base_sha256"),
        secret_scan.as_text(F.col("spans")).alias("spans"),
    )


def op4_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return vector_search.nearest(vectors, F.col("vec_id") % 100 == 0)


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(documents(spark, sf_dir))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_documents(documents(spark, sf_dir), 8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = license_scan.scan(docs, license_scan.fit(docs)).select("doc_id", F.explode_outer(F.array("licenses")).alias("l"))
    return found.select(
        "doc_id",
        F.size("l").cast("long").alias("n_licenses"),
        F.array_join(F.transform("l", lambda r: F.concat_ws(":", r["paragraph"].cast("string"), r["family"])), ",").alias("licenses"),
        F.coalesce(F.array_max(F.transform("l", lambda r: r["probability"])), F.lit(0.0)).alias("probability"),
        F.exists("l", lambda r: r["confirmed"]).alias("confirmed"),
    )


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.mix(documents(spark, sf_dir))


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = media.media_columns(documents(spark, sf_dir))
    return stored.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height", "shard", "offset", "length")


URL_RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    rules = [url_filter.host_rule(verdict, name) for verdict, name in URL_RULES]
    return url_filter.judge(pages, rules).select("page_id", "host", "path", "rule", "verdict")


#: A document is called good from this score on.
GOOD = 0.3


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("id").cast("string")) % 5 == 0
    described = quality.describe(documents(spark, sf_dir))
    model = quality.fit(described, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~held_out)
    scored = quality.score(described, model)
    return scored.select(F.col("id").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), 16)
    return found.withColumn("deviation", F.expr("try_cast(deviation AS LONG)"))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resampling.resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(F.col("id").cast("long").alias("doc_id"), "n_features", "weight", "score", "rank")


QUERIES = {
    f.__name__: f
    for f in (
        op1_sentencepiece,
        op2_language_id,
        op3_secret_scan,
        op4_vector_search,
        op5_ngram_join,
        op6_sharding,
        op7_license_scan,
        op8_mixing,
        op9_media_columns,
        op10_url_filter,
        op11_quality,
        op12_whitening,
        op13_resampling,
    )
}

_FITS = " ".join(
    f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '/{p}') THEN '{h}/{p}'"
    for h, p in (name.split("/", 1) for _, name in sorted(URL_RULES, key=lambda r: -len(r[1])))
)
_BLOCKED = " OR ".join(f"url LIKE '{r.glob.replace('**', '%')}'" for r in url_filter.DEFAULTS)


def _plain(text: str) -> str:
    """SQL for a text in which unreserved characters are not in percent form, letters and signs before digits, and what stays is in capitals."""
    chars = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz-._~0123456789"
    for c in chars:
        for form in sorted({f"%{ord(c):02x}", f"%{ord(c):02X}"}):
            text = f"replace({text}, '{form}', '{c}')"
    for form in sorted({f"{a}{b}" for a in "0123456789abcdefABCDEF" for b in "0123456789abcdefABCDEF" if (a + b) != (a + b).upper()}):
        text = f"replace({text}, '%{form}', '%{form.upper()}')"
    return text


ORACLE_SQL: dict[str, str] = {
    "op10_url_filter": f"""
WITH parsed AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path
  FROM pages),
ruled AS (SELECT *, CASE {_FITS} END AS rule,
  CASE WHEN contains(host, '%') THEN {_plain('host')} ELSE host END AS h, CASE WHEN contains(path, '%') THEN {_plain('path')} ELSE path END AS p FROM parsed),
canon AS (SELECT page_id, host, path, rule,
  '.' || translate(rtrim(regexp_replace(regexp_replace(h, '^.*@', '', 's'), ':[0-9]*$', ''), '.'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
  || CASE WHEN p = '' THEN '' ELSE list_reduce(string_split(p, '/')[2:], lambda acc, s: CASE s WHEN '.' THEN acc WHEN '..' THEN regexp_replace(acc, '/[^/]*$', '', 's') ELSE acc || '/' || s END, '') || CASE WHEN p LIKE '%/.' OR p LIKE '%/..' THEN '/' ELSE '' END END AS url
  FROM ruled)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ({", ".join(f"'{n}'" for v, n in URL_RULES if v == "allow")}) THEN 'allow'
            WHEN rule IS NOT NULL OR {_BLOCKED} THEN 'block' ELSE 'allow' END AS verdict
FROM canon""",
}
