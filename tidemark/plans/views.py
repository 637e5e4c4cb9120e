"""Domain-shaped views over the fixture tables.

A view is SQL that Spark and DuckDB both read, with ``{name}`` for tables and other
views; where the dialects differ there are two texts.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

_FY = "CAST(year(o_orderdate) AS INT) + CASE WHEN month(o_orderdate) > fye_month THEN 1 ELSE 0 END"
_FQ = "CAST(floor(((month(o_orderdate) - fye_month + 11) % 12) / 3) AS INT) + 1"

VIEWS: dict[str, str | dict[str, str]] = {
    "companies": """
SELECT n_nationkey AS company_key, n_name AS ticker, lpad(CAST(n_nationkey AS STRING), 10, '0') AS cik,
       CAST(1 + n_nationkey % 12 AS INT) AS fye_month
FROM {nation}""",
    "fiscal_orders": f"""
SELECT ticker, cik, fye_month, o_orderkey, o_orderdate, CAST(o_orderdate AS DATE) AS day, c_acctbal,
       {_FY} AS fy, {_FQ} AS fq,
       'FY' || CAST({_FY} AS STRING) || '-Q' || CAST({_FQ} AS STRING) AS fiscal_label
FROM {{orders}} JOIN {{customer}} ON o_custkey = c_custkey JOIN {{companies}} ON c_nationkey = company_key""",
    "filings": """
SELECT ticker, cik, fiscal_label, fy, fq, CASE WHEN fq = 4 THEN '10-K' ELSE '10-Q' END AS form,
       cik || '-' || fiscal_label AS accession, min(day) AS first_day, max(day) AS report_date, count(*) AS n_orders
FROM {fiscal_orders} GROUP BY ticker, cik, fiscal_label, fy, fq""",
    "sums": """
SELECT ticker, cik, fiscal_label, fy, fq, min(day) AS period_start, max(day) AS period_end,
       CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2))) AS DOUBLE) AS revenue,
       CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_discount AS DECIMAL(4,2))) AS DOUBLE) AS cost,
       CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_tax AS DECIMAL(4,2))) AS DOUBLE) AS tax,
       CAST(sum(CAST(l_quantity AS DECIMAL(12,2))) AS DOUBLE) AS shares,
       CAST(max(CAST(c_acctbal AS DECIMAL(12,2))) AS DOUBLE) AS cash
FROM {fiscal_orders} JOIN {lineitem} ON l_orderkey = o_orderkey
GROUP BY ticker, cik, fiscal_label, fy, fq""",
    "facts": """
SELECT ticker, cik, cik || '-' || fiscal_label AS accession, CASE WHEN fq = 4 THEN '10-K' ELSE '10-Q' END AS form,
       fiscal_label, fy, fq, concept,
       CASE concept WHEN 'Revenues' THEN revenue WHEN 'CostOfRevenue' THEN cost WHEN 'GrossProfit' THEN round(revenue - cost, 4)
            WHEN 'OperatingIncomeLoss' THEN round(revenue - 2 * cost, 4) WHEN 'NetIncomeLoss' THEN round(revenue - 2 * cost - tax, 4)
            WHEN 'Assets' THEN cash ELSE shares END AS value,
       CASE WHEN concept = 'WeightedAverageNumberOfSharesOutstandingBasic' THEN 'shares' ELSE 'USD' END AS unit,
       CASE WHEN concept <> 'Assets' THEN period_start END AS period_start, period_end
FROM {sums} CROSS JOIN (VALUES ('Revenues'), ('CostOfRevenue'), ('GrossProfit'), ('OperatingIncomeLoss'), ('NetIncomeLoss'), ('Assets'),
     ('WeightedAverageNumberOfSharesOutstandingBasic')) AS c(concept)
WHERE concept <> 'NetIncomeLoss' OR fq <> 2""",
    "fact_entries": """
SELECT accession, form, concept AS tag, unit, period_start AS start_day, period_end AS end_day, value, 0 AS position FROM {facts}
UNION ALL SELECT accession, form, 'RevenueFromContractWithCustomerExcludingAssessedTax', unit, period_start, period_end, value + 1, 1
FROM {facts} WHERE concept = 'Revenues' AND fq = 1
UNION ALL SELECT f.accession, f.form, f.concept, f.unit, y.start_day, f.period_end, f.value * 4, 2
FROM {facts} f JOIN (SELECT cik, fy, min(period_start) AS start_day FROM {facts} GROUP BY cik, fy) y ON f.cik = y.cik AND f.fy = y.fy
WHERE f.period_start IS NOT NULL AND f.fq > 1""",
    "chunks": {
        "spark": """
SELECT CAST(doc_id AS STRING) || '-' || CAST(chunk_index AS STRING) AS chunk_id, doc_id, source AS accession, chunk_index, content,
       CAST(doc_id AS STRING) AS parent_id, CASE WHEN lang = 'en' THEN 'transcript' ELSE 'filing' END AS doc_type,
       CASE doc_id % 5 WHEN 0 THEN 'mda' WHEN 1 THEN 'Risk_Factors' WHEN 2 THEN 'business' WHEN 3 THEN 'properties' ELSE 'exhibits' END AS section
FROM {documents} LATERAL VIEW posexplode(split(text, '\\n')) l AS chunk_index, content""",
        "duckdb": """
SELECT CAST(doc_id AS STRING) || '-' || CAST(chunk_index AS STRING) AS chunk_id, doc_id, source AS accession, chunk_index, content,
       CAST(doc_id AS STRING) AS parent_id, CASE WHEN lang = 'en' THEN 'transcript' ELSE 'filing' END AS doc_type,
       CASE doc_id % 5 WHEN 0 THEN 'mda' WHEN 1 THEN 'Risk_Factors' WHEN 2 THEN 'business' WHEN 3 THEN 'properties' ELSE 'exhibits' END AS section
FROM (SELECT *, unnest(string_split(text, chr(10))) AS content, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS INT) AS chunk_index FROM {documents}) d""",
    },
    "requests": "SELECT event_id, user_id, event_type, ts, value, CAST(user_id AS STRING) || '::' || event_type AS request_key FROM {events}",
    "decision_log": "SELECT CAST(user_id AS STRING) AS run_id, event_id, event_type AS agent, ts, value AS latency_ms, props AS tool_args FROM {events}",
    "golden": """
SELECT item_id AS claim_id, CASE item_id % 5 WHEN 0 THEN 'numeric' WHEN 1 THEN 'sentiment' WHEN 2 THEN 'comparison' WHEN 3 THEN 'factual' ELSE 'absence' END AS claim_type,
       text, CASE item_id % 3 WHEN 0 THEN 'edge' ELSE 'plain' END AS edge_case
FROM {benchmark}""",
    "labelled": "SELECT d.doc_id, d.source, d.lang, d.text, l.quality, l.toxic FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id",
}


def _text(name: str, engine: str) -> str:
    view = VIEWS[name]
    return view if isinstance(view, str) else view[engine]


def duckdb(sql: str) -> str:
    """DuckDB SQL with the views put in as nested queries."""
    return re.sub(r"\{([a-z]\w*)\}", lambda m: m[1] if m[1] in TABLES else f"({duckdb(_text(m[1], 'duckdb'))})", sql)


def spark_sql(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Spark's result of SQL over tables and views."""
    names = sorted(set(re.findall(r"\{([a-z]\w*)\}", sql)))
    return spark.sql(sql, **{n: view(spark, sf_dir, n) for n in names})


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table or a view as a DataFrame."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spark_sql(spark, sf_dir, _text(name, "spark"))
