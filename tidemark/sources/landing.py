"""Landed filings, manifests and transcripts as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import fiscal

#: The keys that every stage of ingestion hands on unchanged.
PROVENANCE = ("ticker", "cik", "fiscal_label", "form", "report_date", "accession")
MANIFEST = T.StructType([T.StructField(c, T.StringType()) for c in (*PROVENANCE, "filing_date", "primary_document", "source_url", "local_path", "_corrupt_record")])


def read_manifest(spark: SparkSession, path: str, label: str, schema: T.StructType = MANIFEST) -> DataFrame:
    """A stage's manifest, JSON arrays of flat records or, as :func:`write_manifest` has it, a record on each line; an error that names the stage if it is missing."""
    try:
        first = spark.read.text(path).where("trim(value) <> ''").first()
        lines = first is not None and first[0].strip().startswith("{") and first[0].strip().endswith("}")
        return spark.read.schema(schema).option("multiLine", not lines).json(path)
    except Exception as e:
        raise FileNotFoundError(f"no {label} manifest at {path}: run the stage before") from e


def write_manifest(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def read_filings_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A manifest that is an array or an object with ``filings`` or ``documents``; an empty one is an error."""
    fields = ", ".join(f"{c.name}: string" for c in MANIFEST if c.name != "_corrupt_record").replace(": ", ":")
    one = f"array<struct<{fields}>>"
    text = spark.read.text(path, wholetext=True)
    wrapped = F.from_json("value", f"struct<filings:{one},documents:{one}>")
    rows = text.select(F.coalesce(wrapped["filings"], wrapped["documents"], F.from_json("value", one)).alias("rows")).select(F.inline("rows"))
    if rows.isEmpty():
        raise ValueError(f"no filings in {path}")
    return rows


def read_claims(spark: SparkSession, pattern: str, schema: T.StructType) -> DataFrame:
    """Claims of all files of a pattern, an array or a single object each; files that cannot be parsed are left out."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(pattern)


def existing_only(rows: DataFrame, files: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose file is listed, and those whose file is missing."""
    return rows.join(files.select(path).distinct(), path, "left_semi"), rows.join(files.select(path).distinct(), path, "left_anti")


def with_provenance(rows: DataFrame, *more: str) -> DataFrame:
    return rows.select(*PROVENANCE, *more)


def explode_submissions(payload: DataFrame, columns: list[str]) -> DataFrame:
    """One row per filing of a payload that holds parallel arrays, with its place in them."""
    rest = [c for c in payload.columns if c not in columns]
    rows = payload.select(*rest, F.posexplode(F.arrays_zip(*columns)).alias("position", "_f"))
    return rows.select(*rest, "position", *[F.col(f"_f.{c}").alias(c) for c in columns])


def wanted_filings(filings: DataFrame, periods: DataFrame, forms: tuple[str, ...] = ("10-Q", "10-K")) -> DataFrame:
    """The first filing, in source order, of each declared period ``(ticker, fiscal_label, form)`` with a wanted form and a report date."""
    found = filings.where(F.col("form").isin(*forms) & F.col("report_date").isNotNull()).join(periods, ["ticker", "fiscal_label", "form"])
    first = F.row_number().over(Window.partitionBy("ticker", "fiscal_label").orderBy("position"))
    return found.withColumn("_n", first).where("_n = 1").drop("_n")


def unfilled_periods(periods: DataFrame, filings: DataFrame) -> DataFrame:
    return periods.join(filings, ["ticker", "fiscal_label"], "left_anti")


def check_identifiers(configured: DataFrame, official: DataFrame) -> DataFrame:
    """Companies whose configured number differs from the official one, both padded to ten digits."""
    a = configured.select(F.upper("ticker").alias("ticker"), F.lpad("cik", 10, "0").alias("configured"))
    b = official.select(F.upper("ticker").alias("ticker"), F.lpad("cik", 10, "0").alias("official"))
    return a.join(b, "ticker").where("configured <> official")


def source_url(cik: Column, accession: Column, document: Column) -> Column:
    """Archive address: number without leading zeros, accession without dashes, document name."""
    return F.concat_ws("/", F.lit("https://www.sec.gov/Archives/edgar/data"), cik.cast("bigint").cast("string"), F.replace(accession, F.lit("-"), F.lit("")), document)


def output_name(label: Column, form: Column, document: Column) -> Column:
    suffix = F.regexp_extract(document, r"(\.[A-Za-z0-9]+)$", 1)
    return F.concat(label, F.lit("_"), form, F.when(suffix == "", F.lit(".htm")).otherwise(suffix))


FACT = "struct<start:string,end:string,val:decimal(28,4),accn:string,fy:int,fp:string>"


def explode_company_facts(payloads: DataFrame, column: str = "json") -> DataFrame:
    """Rows ``taxonomy, tag, unit, start, end, val, accn, fy, fp`` of nested fact maps given as JSON text."""
    kind = f"struct<facts:map<string,map<string,struct<units:map<string,array<{FACT}>>>>>>"
    rest = [c for c in payloads.columns if c != column]
    parsed = payloads.select(*rest, F.from_json(column, kind)["facts"].alias("f")).select(*rest, F.explode("f").alias("taxonomy", "tags"))
    parsed = parsed.select(*rest, "taxonomy", F.explode("tags").alias("tag", "body")).select(*rest, "taxonomy", "tag", F.explode("body.units").alias("unit", "entries"))
    return parsed.select(*rest, "taxonomy", "tag", "unit", F.inline("entries"))


def normalize_transcripts(payloads: DataFrame, column: str = "json") -> DataFrame:
    """Symbol, year, quarter and trimmed content of payloads that are an object or a list of one; empty content is dropped."""
    one = "struct<symbol:string,year:int,quarter:int,content:string>"
    rest = [c for c in payloads.columns if c != column]
    text = F.trim(F.col(column))
    parsed = F.when(text.startswith("["), F.get(F.from_json(text, f"array<{one}>"), F.lit(0))).otherwise(F.from_json(text, one))
    rows = payloads.select(*rest, parsed.alias("p")).select(*rest, "p.symbol", "p.year", "p.quarter", F.trim("p.content").alias("content"))
    return rows.where("content <> ''")


def transcript_records(rows: DataFrame, label: str = "fiscal_label", text: str = "content") -> DataFrame:
    return rows.withColumns({"fiscal_year": fiscal.fiscal_year(F.col(label)), "fiscal_quarter": fiscal.fiscal_quarter(F.col(label)), "char_count": F.length(text)})
