"""Queries of landing, tables, parsing, chunking and calendar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import fiscal, text
from tidemark.operators import chunking, filters, parsing
from tidemark.plans.registry import query
from tidemark.staging import shared_path
from tidemark.sources import landing, tables

FISCAL = "(SELECT DISTINCT ticker, cik, fye_month, day, fy, fq, fiscal_label FROM {fiscal_orders})"


def _written(rows, name: str, by: str) -> str:
    """Writes a table's ``value`` texts to a new place in the shared folder, a folder for each value of ``by``."""
    path = shared_path(rows.sparkSession, name)
    rows.repartition(by).write.partitionBy(by).text(path)
    return path


_MANIFEST = "SELECT ticker, cik, fiscal_label, form, CAST(report_date AS STRING) AS report_date, accession FROM {filings}"


@query(_MANIFEST, "filings")
def a1_a4_manifest(filings):
    """A stage's manifest written and read again by the next stage."""
    path = shared_path(filings.sparkSession, "manifest")
    landing.write_manifest(landing.with_provenance(filings.withColumn("report_date", F.col("report_date").cast("string"))), path)
    return landing.with_provenance(landing.read_manifest(filings.sparkSession, path, "filings"))


@query(_MANIFEST, "filings")
def a5_filings_manifest(filings):
    """A manifest of each company, as an array or as an object that holds one under either name."""
    rows = landing.with_provenance(filings.withColumn("report_date", F.col("report_date").cast("string")))
    array = F.to_json(F.collect_list(F.struct(*rows.columns)))
    kind = F.crc32("ticker") % 3
    rows = rows.groupBy("ticker").agg(array.alias("a")).select("ticker", F.when(kind == 0, F.col("a")).otherwise(F.concat(F.lit('{"'), F.when(kind == 1, "filings").otherwise("documents"), F.lit('": '), "a", F.lit("}"))).alias("value"))
    return landing.with_provenance(landing.read_filings_manifest(filings.sparkSession, _written(rows.withColumnRenamed("ticker", "company"), "filings", "company")))


@query("SELECT claim_id, claim_type, text FROM {golden} WHERE claim_type <> 'absence'", "golden")
def a14_load_claims(golden):
    """Claim files by type, one of a single object each where the type is sentiment; the file of one type is broken and left out."""
    claim = F.to_json(F.struct("claim_id", "claim_type", "text"))
    rows = golden.select(F.when(F.col("claim_type") == "sentiment", F.concat_ws("-", "claim_type", "claim_id")).otherwise(F.col("claim_type")).alias("file"), "claim_type", claim.alias("c"))
    whole = F.array_join(F.sort_array(F.collect_list("c")), ",")
    rows = rows.groupBy("file", "claim_type").agg(whole.alias("w")).select("file", F.when(F.col("claim_type") == "sentiment", F.col("w")).when(F.col("claim_type") == "absence", "[{not json").otherwise(F.concat(F.lit("["), "w", F.lit("]"))).alias("value"))
    path = _written(rows, "claims", "file")
    return landing.read_claims(golden.sparkSession, f"{path}/*", golden.select("claim_id", "claim_type", "text").schema)


@query("SELECT p_partkey, p_name FROM part WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45)", "part", "lineitem")
def a2_existing_only(part, lineitem):
    files = lineitem.where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return landing.existing_only(part, files, "p_partkey")[0].select("p_partkey", "p_name")


@query("SELECT p_partkey, p_name FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45)", "part", "lineitem")
def a2_missing(part, lineitem):
    files = lineitem.where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return landing.existing_only(part, files, "p_partkey")[1].select("p_partkey", "p_name")


@query("SELECT ticker, cik, fiscal_label, CAST(report_date AS STRING) AS report_date, form, accession FROM {filings}", "filings")
def a3_with_provenance(filings):
    return landing.with_provenance(filings.withColumn("report_date", F.col("report_date").cast("string")))


@query("SELECT o_custkey AS cik, o_orderkey AS accession, o_orderpriority AS form FROM orders", "orders")
def a6_explode_submissions(orders):
    rows = orders.groupBy(F.col("o_custkey").alias("cik")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderpriority"))).alias("s"))
    payload = rows.select("cik", F.transform("s", lambda s: s["o_orderkey"]).alias("accession"), F.transform("s", lambda s: s["o_orderpriority"]).alias("form"))
    return landing.explode_submissions(payload, ["accession", "form"]).drop("position")


_DATED = """(SELECT ticker, fiscal_label, CASE WHEN fq = 4 THEN '10-K' WHEN o_orderkey % 7 = 0 THEN '8-K' ELSE '10-Q' END AS form,
 CASE WHEN o_orderkey % 11 <> 0 THEN day END AS report_date, o_orderkey AS position FROM {fiscal_orders})"""


@query(
    f"""SELECT ticker, fiscal_label, form, report_date, position FROM (
SELECT *, row_number() OVER (PARTITION BY ticker, fiscal_label ORDER BY position) AS n FROM {_DATED} d
WHERE form IN ('10-Q', '10-K') AND report_date IS NOT NULL AND EXISTS (SELECT 1 FROM {{filings}} f WHERE f.ticker = d.ticker AND f.fiscal_label = d.fiscal_label AND f.form = d.form AND f.fy < 2000)) WHERE n = 1""",
    "fiscal_orders",
    "filings",
)
def a7_select_wanted_filings(orders, filings):
    form = F.when(F.col("fq") == 4, "10-K").when(F.col("o_orderkey") % 7 == 0, "8-K").otherwise("10-Q")
    rows = orders.select("ticker", "fiscal_label", form.alias("form"), F.when(F.col("o_orderkey") % 11 != 0, F.col("day")).alias("report_date"), F.col("o_orderkey").alias("position"))
    return landing.wanted_filings(rows, filings.where("fy < 2000").select("ticker", "fiscal_label", "form"))


@query("SELECT ticker, fiscal_label FROM {filings} WHERE NOT EXISTS (SELECT 1 FROM {filings} g WHERE g.ticker = filings.ticker AND g.fiscal_label = filings.fiscal_label AND g.n_orders >= 20)".replace("FROM {filings} WHERE", "FROM {filings} filings WHERE"), "filings")
def a8_unfilled_periods(filings):
    return landing.unfilled_periods(filings.select("ticker", "fiscal_label"), filings.where("n_orders >= 20").select("ticker", "fiscal_label"))


@query("SELECT upper(n_name) AS ticker, lpad(CAST(n_nationkey AS STRING), 10, '0') AS configured, lpad(CAST(n_regionkey AS STRING), 10, '0') AS official FROM nation WHERE n_nationkey <> n_regionkey", "nation")
def a9_check_identifiers(nation):
    mine = nation.select(F.col("n_name").alias("ticker"), F.col("n_nationkey").cast("string").alias("cik"))
    theirs = nation.select(F.lower("n_name").alias("ticker"), F.col("n_regionkey").cast("string").alias("cik"))
    return landing.check_identifiers(mine, theirs)


@query(
    """SELECT accession, 'https://www.sec.gov/Archives/edgar/data/' || CAST(CAST(cik AS BIGINT) AS STRING) || '/' || replace(accession, '-', '') || '/doc.htm' AS url,
 fiscal_label || '_' || form || '.htm' AS name FROM {filings}""",
    "filings",
)
def a10_build_source_url(filings):
    doc = F.lit("doc.htm")
    return filings.select("accession", landing.source_url(F.col("cik"), F.col("accession"), doc).alias("url"), landing.output_name(F.col("fiscal_label"), F.col("form"), doc).alias("name"))


@query("SELECT cik, concept AS tag, unit, CAST(period_end AS STRING) AS \"end\", round(value, 4) AS val, accession AS accn, fy FROM {facts}", "facts")
def a11_explode_company_facts(facts):
    entry = F.struct(F.col("period_start").cast("string").alias("start"), F.col("period_end").cast("string").alias("end"), F.round("value", 4).cast("decimal(28,4)").alias("val"), F.col("accession").alias("accn"), "fy", F.concat(F.lit("Q"), "fq").alias("fp"))
    by_unit = facts.groupBy("cik", "concept", "unit").agg(F.collect_list(entry).alias("e"))
    by_tag = by_unit.groupBy("cik", "concept").agg(F.struct(F.map_from_entries(F.collect_list(F.struct("unit", "e"))).alias("units")).alias("u"))
    nested = by_tag.groupBy("cik").agg(F.to_json(F.struct(F.create_map(F.lit("us-gaap"), F.map_from_entries(F.collect_list(F.struct("concept", "u")))).alias("facts"))).alias("json"))
    return landing.explode_company_facts(nested).select("cik", "tag", "unit", "end", F.col("val").cast("double").alias("val"), "accn", "fy")


@query("SELECT conv_id, turn, 'S' || CAST(conv_id AS STRING) AS symbol, CAST(2000 + conv_id % 20 AS INT) AS year, trim(text) AS content FROM conversations WHERE trim(text) <> ''", "conversations")
def a12_normalize_transcripts(conversations):
    one = F.to_json(F.struct(F.concat(F.lit("S"), F.col("conv_id")).alias("symbol"), (2000 + F.col("conv_id") % 20).cast("int").alias("year"), F.lit(1).alias("quarter"), F.col("text").alias("content")))
    json = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("["), one, F.lit("]"))).otherwise(one)
    return landing.normalize_transcripts(conversations.select("conv_id", "turn", json.alias("json"))).drop("quarter")


@query("SELECT doc_id, CAST(2000 + doc_id % 20 AS INT) AS fiscal_year, CAST(1 + doc_id % 4 AS INT) AS fiscal_quarter, CAST(length(text) AS INT) AS char_count FROM documents", "documents")
def a13_build_transcript_records(documents):
    label = fiscal.make_label(2000 + F.col("doc_id") % 20, 1 + F.col("doc_id") % 4)
    rows = documents.select("doc_id", F.col("text").alias("content"), label.alias("fiscal_label"))
    return landing.transcript_records(rows).select("doc_id", "fiscal_year", "fiscal_quarter", "char_count")


@query("SELECT doc_id, source, lang, '' AS subsection, coalesce(CASE WHEN lang <> 'fr' THEN source END, 'none') AS parent FROM documents", "documents")
def a15_flatten_index_docs(documents):
    rows = documents.select("doc_id", "source", "lang", F.when(F.col("lang") != "fr", F.col("source")).alias("parent"))
    return tables.flatten_index_docs(rows, {"subsection": F.lit(""), "parent": F.lit("none")})


@query("SELECT c_custkey, c_name, CASE WHEN c_nationkey < 5 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal FROM customer", "customer")
def a16_upsert_index(customer):
    rows = customer.select("c_custkey", "c_name", "c_acctbal", "c_nationkey")
    new = rows.where("c_nationkey < 5").withColumn("c_acctbal", F.col("c_acctbal") + 1)
    path = shared_path(customer.sparkSession, "index")
    tables.upsert_index(path, rows, "c_custkey")
    tables.upsert_index(path, new, "c_custkey")
    return tables.table(customer.sparkSession, path).drop("c_nationkey")


@query("SELECT accession, concept, period_start, period_end, CASE WHEN fq = 1 THEN value * 2 ELSE value END AS value FROM {facts} WHERE fq <> 1 OR concept <> 'Assets'", "facts")
def a17_load_facts(facts):
    rows = facts.select("accession", "concept", "period_start", "period_end", "value", "fq")
    new = rows.where("fq = 1 and concept <> 'Assets'").withColumn("value", F.col("value") * 2)
    path = shared_path(facts.sparkSession, "facts")
    tables.load_facts(path, rows)
    tables.load_facts(path, new)
    return tables.table(facts.sparkSession, path).drop("fq")


@query("SELECT ticker, concept, count(*) AS n FROM {facts} WHERE concept = 'Revenues' GROUP BY ticker, concept", "facts")
def a18_count_facts(facts):
    return tables.fetch_facts(facts, concept="Revenues").groupBy("ticker", "concept").agg(F.count("*").alias("n"))


@query("SELECT run_id, event_id, agent, row_number() OVER (PARTITION BY run_id ORDER BY ts, event_id) AS place FROM {decision_log}", "decision_log")
def a19_run_logs(log):
    from pyspark.sql import Window

    return log.select("run_id", "event_id", "agent", F.row_number().over(Window.partitionBy("run_id").orderBy("ts", "event_id")).cast("long").alias("place"))


@query("SELECT o_orderkey AS run_id, nullif(substring(o_orderpriority, 1, 200), '') AS snippet FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 20", "orders")
def a20_list_reports(orders):
    status = F.when(F.col("o_orderstatus") == "F", "completed").otherwise("running")
    reports = orders.select(F.col("o_orderkey").alias("run_id"), status.alias("status"), F.col("o_orderdate").alias("created_at"), F.col("o_orderpriority").alias("report"))
    return tables.list_reports(reports, 20, 20).select("run_id", "snippet")


@query("SELECT o_orderkey, CASE WHEN o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) THEN 'deleted' ELSE o_orderstatus END AS status FROM orders", "orders", "customer")
def a21_soft_delete(orders, customer):
    gone = orders.join(customer.where("c_acctbal < 0"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey")
    return tables.soft_delete(orders.select("o_orderkey", F.col("o_orderstatus").alias("status")), gone, "o_orderkey")


@query("SELECT p_partkey, p_type FROM part WHERE starts_with(p_type, 'PROMO')", "part")
def a22_list_by_prefix(part):
    return tables.list_by_prefix(part.select("p_partkey", "p_type"), "PROMO", "p_type")


@query("SELECT doc_id, n_chars FROM documents WHERE lang = 'en' AND source = 'src3'", "documents")
def b1_equality_filter(documents):
    return filters.equality_filter(documents, lang="en", source="src3", text=None).select("doc_id", "n_chars")


@query("SELECT doc_id, coalesce(source, '') AS accession, -1 AS chunk_index, 0.0 AS score FROM documents".replace("0.0", "CAST(0 AS DOUBLE)"), "documents")
def b2_to_candidates(documents):
    hits = documents.select("doc_id", F.col("source").alias("accession"))
    return filters.to_candidates(hits, {"doc_id": F.lit(-1), "accession": F.lit(""), "chunk_index": F.lit(-1), "score": F.lit(0.0)})


@query(
    """SELECT event_id, 'missing: ' || CASE WHEN event_type = 'error' AND value < 20 THEN 'company, query' WHEN event_type = 'error' THEN 'company' ELSE 'query' END AS error
FROM events WHERE event_type = 'error' OR value < 20""",
    "events",
)
def b3_require_fields(events):
    rows = events.select("event_id", F.when(F.col("event_type") != "error", F.col("event_type")).alias("company"), F.when(F.col("value") >= 20, "q").otherwise(" ").alias("query"))
    return filters.require_fields(rows, "company", "query")[1].select("event_id", "error")


@query("SELECT section, count(*) AS n FROM {chunks} WHERE section <> 'exhibits' GROUP BY section", "chunks")
def b4_drop_canonical_sections(chunks):
    return filters.drop_canonical_sections(chunks).groupBy("section").agg(F.count("*").alias("n"))


@query("SELECT page_id, md5(regexp_replace(regexp_replace(html, '<script\\b[^>]*>.*?</script\\s*>', '', 'gis'), '<style\\b[^>]*>.*?</style\\s*>', '', 'gis')) AS digest FROM pages", "pages")
def c1_strip_noise(pages):
    return pages.select("page_id", F.md5(parsing.strip_noise(F.col("html"))).alias("digest"))


@query(
    """SELECT page_id, array_to_string(list_filter(list_transform(regexp_extract_all(html, '<li\\b[^>]*>(.*?)</li>', 1, 'is'),
 lambda x: trim(regexp_replace(regexp_replace(x, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'))), lambda x: x <> ''), chr(10)) AS rows FROM pages""",
    "pages",
)
def c2_list_items(pages):
    return pages.select("page_id", F.array_join(parsing.list_items(F.col("html")), "\n").alias("rows"))


@query("SELECT page_id AS id, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '<h[1-6]\\b')) FROM pages) GROUP BY page_id", "pages")
def c3_page_events(pages):
    """Headings of each page, by the parser."""
    return parsing.page_events(pages).where("kind = 'heading'").groupBy("id").agg(F.count("*").alias("n"))


def _cells_page(documents):
    """A page with one table for each document: a row for each line, a cell for each word, in four forms of HTML by the id."""
    safe = F.replace(F.replace(F.col("text"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    cell = lambda before, after: lambda line: F.array_join(F.transform(F.filter(F.split(line, r"\s+"), lambda w: w != ""), lambda w: F.concat(F.lit(before), w, F.lit(after))), "")
    row = lambda before, words, after: F.array_join(F.transform(F.split(safe, "\n"), lambda line: F.concat(F.lit(before), words(line), F.lit(after))), "")
    form = F.col("doc_id") % 4
    rows = (
        F.when(form == 0, row("<tr>", cell("<td>", "</td>"), "</tr>"))
        .when(form == 1, row("<tr>", cell("<td>", ""), ""))
        .when(form == 2, row("<tbody><tr><td></td>", cell("<th>", "</th><td> </td>"), ""))
        .otherwise(row("<tr><td><table>", cell("<td>", ""), "</table></td></tr>"))
    )
    return documents.select(F.col("doc_id").alias("page_id"), F.concat(F.lit("<html><body><p>before<table>"), rows, F.lit("</table>after</body></html>")).alias("html"))


@query(
    """WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
w AS (SELECT doc_id, generate_subscripts(l, 1) AS i, list_filter(regexp_split_to_array(unnest(l), '\\s+'), lambda x: x <> '') AS w FROM l),
r AS (SELECT doc_id, i, array_to_string(w, ' | ') AS r, array_to_string(w, ' ') AS whole FROM w WHERE len(w) > 0)
SELECT doc_id AS id, CAST(count(*) * CASE WHEN doc_id % 4 = 3 THEN 2 ELSE 1 END AS BIGINT) AS n,
 md5(string_agg(CASE WHEN doc_id % 4 = 3 THEN whole || ' | ' || r || chr(10) || r ELSE r END, chr(10) ORDER BY i)) AS digest FROM r GROUP BY doc_id""",
    "documents",
)
def c2_extract_tables(documents):
    """Tables with all words of all documents: closed, without end tags, with empty cells, and nested."""
    found = parsing.extract_tables(parsing.page_events(_cells_page(documents), kinds=("table",)))
    return found.select("id", F.size(F.split("rows", "\n")).cast("long").alias("n"), F.md5("rows").alias("digest"))


def _unescaped(html: str) -> str:
    """SQL for a page's text without the few references that the pages hold."""
    return f"regexp_replace(replace(replace(replace({html}, '&copy;', '©'), '&middot;', '·'), '&quot;', '\"'), '&amp;?', '&', 'g')"


_AFTER_HEADING = "regexp_replace(regexp_replace(split_part(html, '<h1>', 2), '<!--.*?-->', ' ', 'gs'), '<[^>]*>', ' ', 'g')"


@query(f"SELECT page_id AS id, md5(trim(regexp_replace(html_unescaped, '\\s+', ' ', 'g'))) AS digest FROM (SELECT page_id, {_unescaped(_AFTER_HEADING)} AS html_unescaped FROM pages)", "pages")
def c3_after_heading(pages):
    """All that the pages say from their heading on."""
    events = parsing.page_events(pages)
    return parsing.text_between(events, F.when(F.col("kind") == "heading", F.col("content"))).select("id", F.md5("body").alias("digest"))


def _anchored_pages(documents):
    """Pages with all lines of each document: of four lines one follows an anchor, two are paragraphs and one a table of its first word and the rest, with an anchor on the rest."""
    safe = F.replace(F.replace(F.col("text"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    first, rest = (lambda line: F.regexp_extract(line, r"^\s*(\S*)", 1)), (lambda line: F.regexp_replace(line, r"^\s*\S*", ""))

    def html(line, i):
        n = i.cast("string")
        anchored = F.concat(F.lit('<a name="n'), n, F.lit('"></a><p>'), line)
        table = F.concat(F.lit("<table><tr><td>"), first(line), F.lit('<td id="t'), n, F.lit('">'), rest(line), F.lit("</table>"))
        return F.when(i % 4 == 0, anchored).when(i % 4 == 2, table).otherwise(F.concat(F.lit("<p>"), line))

    return documents.select(F.col("doc_id").alias("page_id"), F.concat(F.lit("<html><body>"), F.array_join(F.transform(F.split(safe, "\n"), html), ""), F.lit("</body></html>")).alias("html"))


@query(
    """WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
e AS (SELECT doc_id, generate_subscripts(l, 1) - 1 AS i, trim(regexp_replace(unnest(l), '\\s+', ' ', 'g')) AS line FROM l),
c AS (SELECT *, split_part(line, ' ', 1) AS a, trim(substr(line, length(split_part(line, ' ', 1)) + 1)) AS b FROM e),
said AS (SELECT doc_id, 'n' || CAST(i - i % 4 AS STRING) AS key, i, CASE i % 4 WHEN 2 THEN CASE WHEN b = '' THEN a ELSE a || ' | ' || b END ELSE line END AS t FROM c WHERE i % 4 < 3
 UNION ALL SELECT doc_id, 't' || CAST(i - i % 2 AS STRING), i, CASE i % 4 WHEN 2 THEN b ELSE line END FROM c WHERE i % 4 >= 2)
SELECT doc_id AS id, key, md5(coalesce(string_agg(t, ' ' ORDER BY i) FILTER (WHERE t <> ''), '')) AS digest FROM said GROUP BY doc_id, key""",
    "documents",
)
def c3_text_between(documents):
    """From each anchor to the next, tables as rows, and the rest of a table that an anchor stands in."""
    events = parsing.page_events(_anchored_pages(documents))
    named = F.when(F.col("kind").isin("anchor", "name"), F.col("target"))
    return parsing.text_between(events, named).select("id", "key", F.md5("body").alias("digest"))


def _bodies(method: str = "", heading: str = "''") -> str:
    """SQL for the sections of the pages that :func:`_whole_pages` makes of documents."""
    return f"""WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
e AS (SELECT doc_id, generate_subscripts(l, 1) - 1 AS i, trim(regexp_replace(unnest(l), '\\s+', ' ', 'g')) AS line FROM d),
b AS (SELECT doc_id, i % 3 AS k, string_agg(line, ' ' ORDER BY i) AS body FROM e WHERE line <> '' GROUP BY doc_id, i % 3)
SELECT doc_id AS id, CASE k WHEN 0 THEN 'mda' WHEN 1 THEN 'quantitative_qualitative_disclosures' ELSE 'controls_and_procedures' END AS section,
 {method} md5({heading} || body) AS digest FROM b"""


def _whole_pages(documents, contents: bool):
    """Filing pages whose three sections hold all lines of a document, every third line in the same one."""
    safe = F.replace(F.replace(F.col("text"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    lines = F.split(safe, "\n")
    links = "".join(f'<a href="#s{k}">Item {k + 2}. Section</a>' for k in range(3)) if contents else ""
    part = lambda k: F.array_join(F.transform(F.filter(lines, lambda line, i: i % 3 == k), lambda line: F.concat(F.lit("<p>"), line, F.lit("</p>"))), "")
    body = [F.concat(F.lit(f'<h2 id="s{k}">Item {k + 2}. Section</h2>'), part(k)) for k in range(3)]
    page = F.concat(F.lit("<html><style>x</style><body>" + links), *body, F.lit("</body></html>"))
    return documents.select(F.col("doc_id").alias("page_id"), page.alias("html"))


@query(_bodies(heading="'Item ' || CAST(k + 2 AS STRING) || '. Section '"), "documents")
def c6_toc_segment(documents):
    """All lines of all documents; a section without any line is left out."""
    found = parsing.toc_sections(parsing.page_events(_whole_pages(documents, True))).where(~F.col("body").rlike(r"^Item \d\. Section$"))
    return found.select("id", "section", F.md5("body").alias("digest"))


@query(_bodies(), "documents")
def c7_heading_segment(documents):
    found = parsing.heading_sections(parsing.page_events(_whole_pages(documents, False)), F.lit("10-Q"))
    return found.select("id", "section", F.md5("body").alias("digest"))


@query(_bodies("CASE WHEN doc_id % 2 = 0 THEN 'toc' ELSE 'headings' END AS method,", "CASE WHEN doc_id % 2 = 0 THEN 'Item ' || CAST(k + 2 AS STRING) || '. Section ' ELSE '' END"), "documents")
def c10_parse_filings(documents):
    """Every other page has a table of contents."""
    even = F.col("doc_id") % 2 == 0
    pages = _whole_pages(documents.where(even), True).unionByName(_whole_pages(documents.where(~even), False))
    found = parsing.parse_filings(pages).where(~F.col("body").rlike(r"^Item \d\. Section$"))
    return found.select("id", "section", "method", F.md5("body").alias("digest"))


@query("SELECT doc_id AS id, CAST(k + 2 AS STRING) AS item, 'I' AS part FROM documents, (VALUES (0), (1), (2)) v(k)", "documents")
def c4_toc_anchors(documents):
    return parsing.toc_anchors(parsing.page_events(_whole_pages(documents, True))).select("id", "item", "part")


#: Links of made contents: their text, what their target begins with, and the part they mark or the item they name, with a part of its own or without.
_CONTENTS = (
    ("Part I. Financial Information", "x", "I", "", ""), ("Item 4. Controls", "y", "", "", "4"), ("Part II", "z", "II", "", ""), ("Item 5. Other", "y", "", "", "5"),
    ("Item 1A. Risks", "y", "", "", "1A"), ("12", "item_2_s", "", "", "2"), ("Legal Proceedings", "u", "", "II", "1"), ("Item 6. Exhibits", "y", "", "", "6"),
    ("page 3", "part_ii_s", "II", "", ""), ("Management’s Discussion and Analysis", "u", "", "I", "2"), ("Item 99. Beyond", "y", "", "", ""), ("Item 2. Sales", "y", "", "", "2"), ("Counterpart I", "u", "I", "", ""),
)


def _contents_pages(documents):
    """Pages with a link for each line of a document, of a kind that jumps about with id and line; all targets are on the page."""
    kind = lambda i: ((F.col("doc_id") * 7 + i * i + i) % len(_CONTENTS)).cast("int")
    of = lambda k, i: F.get(F.array(*[F.lit(row[k]) for row in _CONTENTS]), kind(i))
    lines = F.split("text", "\n")
    links = F.array_join(F.transform(lines, lambda _, i: F.concat(F.lit('<tr><td><a href="#'), of(1, i), i.cast("string"), F.lit('">'), of(0, i), F.lit("</a>"))), "")
    ends = F.array_join(F.transform(lines, lambda _, i: F.concat(F.lit('<p id="'), of(1, i), i.cast("string"), F.lit('">x'))), "")
    return documents.select(F.col("doc_id").alias("page_id"), F.concat(F.lit("<table>"), links, F.lit("</table>"), ends).alias("html"))


@query(
    f"""WITH k(kind, marker, own, item) AS (VALUES {", ".join(f"({n}, nullif('{r[2]}', ''), nullif('{r[3]}', ''), nullif('{r[4]}', ''))" for n, r in enumerate(_CONTENTS))}),
l AS (SELECT doc_id, unnest(range(0, len(string_split(text, chr(10))))) AS i FROM documents),
r AS (SELECT doc_id, i, marker, own, item, count(marker) OVER w AS since, coalesce(last_value(marker IGNORE NULLS) OVER w, 'I') AS base,
  CASE WHEN own IS NULL THEN CAST(regexp_extract(item, '^(\\d+)', 1) AS INT) * 10 + CASE WHEN item LIKE '%A' THEN 1 ELSE 0 END END AS o
  FROM l JOIN k ON kind = (doc_id * 7 + i * i + i) % {len(_CONTENTS)} WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
b AS (SELECT *, coalesce(o <= last_value(o IGNORE NULLS) OVER (PARTITION BY doc_id, since ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS again FROM r),
p AS (SELECT doc_id, i, item, coalesce(own, CASE WHEN base = 'I' AND bool_or(again) OVER (PARTITION BY doc_id, since ORDER BY i) THEN 'II' ELSE base END) AS part FROM b)
SELECT doc_id AS id, part, item, CAST(max(i) AS BIGINT) AS line FROM p WHERE item IS NOT NULL GROUP BY doc_id, part, item""",
    "documents",
)
def c4_contents(documents):
    """Contents that jump between parts and items, by text, target and title; of each item the last link."""
    found = parsing.toc_anchors(parsing.page_events(_contents_pages(documents)))
    return found.select("id", "part", "item", F.regexp_extract("target", r"(\d+)$", 1).cast("long").alias("line"))


_ITEMS = "(SELECT conv_id, turn, CAST(1 + (turn * 2 + conv_id) % 6 AS STRING) || CASE WHEN (conv_id + turn) % 3 = 0 THEN 'A' ELSE '' END AS item FROM conversations)"


@query(
    f"""WITH o AS (SELECT conv_id, turn, item, CAST(regexp_extract(item, '^(\\d+)', 1) AS INT) * 10 + CASE WHEN item LIKE '%A' THEN 1 ELSE 0 END AS n FROM {_ITEMS} i),
r AS (SELECT *, CASE WHEN n <= lag(n) OVER (PARTITION BY conv_id ORDER BY turn) THEN 1 ELSE 0 END AS reset FROM o)
SELECT conv_id, turn, item, CASE WHEN max(reset) OVER (PARTITION BY conv_id ORDER BY turn) = 1 THEN 'II' ELSE 'I' END AS part FROM r""",
    "conversations",
)
def c5_ordinal_reset(conversations):
    letter = F.when((F.col("conv_id") + F.col("turn")) % 3 == 0, "A").otherwise("")
    items = conversations.select("conv_id", "turn", F.concat((1 + (F.col("turn") * 2 + F.col("conv_id")) % 6).cast("string"), letter).alias("item"))
    return parsing.ordinal_reset(items, "conv_id", "turn")


@query(
    """SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN CASE p_size % 6 WHEN 1 THEN 'business' WHEN 2 THEN 'properties' WHEN 3 THEN 'legal_proceedings' WHEN 4 THEN 'mine_safety' WHEN 5 THEN 'market_for_registrant_equity' END
 ELSE CASE p_size % 6 WHEN 1 THEN 'legal_proceedings' WHEN 2 THEN 'unregistered_sales' WHEN 3 THEN 'defaults_senior_securities' WHEN 4 THEN 'mine_safety' WHEN 5 THEN 'other_information' END END AS section FROM part""",
    "part",
)
def c8_canonical_section(part):
    form = F.when(F.col("p_partkey") % 2 == 0, "10-K").otherwise("10-Q")
    return part.select("p_partkey", parsing.canonical_section(form, F.lit("II"), (F.col("p_size") % 6).cast("string")).alias("section"))


_TITLES = ("Management’s Discussion and Analysis of Results", "RISK FACTORS", "Legal Proceedings", "Controls and Procedures", "Cover", "Exhibits – Index", "Quantitative and Qualitative Disclosures")


@query(
    """SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN 'I/2' WHEN 1 THEN 'II/1A' WHEN 2 THEN 'II/1' WHEN 3 THEN 'I/4' WHEN 5 THEN 'II/6' WHEN 6 THEN 'I/3' END AS quarterly,
CASE o_orderkey % 7 WHEN 0 THEN '7' WHEN 1 THEN '1A' WHEN 2 THEN '3' WHEN 3 THEN '9A' WHEN 5 THEN '15' WHEN 6 THEN '7A' END AS annual FROM orders""",
    "orders",
)
def c9_known_titles(orders):
    title = F.get(F.array(*[F.lit(t) for t in _TITLES]), (F.col("o_orderkey") % 7).cast("int"))
    return orders.select("o_orderkey", parsing.title_item(F.lit("10-Q"), title).alias("quarterly"), parsing.title_item(F.lit("10-K"), title).alias("annual"))


def _title_case(rules) -> str:
    return "CASE " + " ".join(f"WHEN contains(t, '{name.replace(chr(39), chr(39) * 2)}') THEN '{found}'" for name, found in rules) + " END"


_QUARTERLY, _ANNUAL = _title_case((n, f"{p}/{i}") for n, p, i in parsing.TITLES_10Q), _title_case(parsing.TITLES_10K)


@query(
    f"""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), e AS (SELECT doc_id, generate_subscripts(l, 1) - 1 AS i, unnest(l) AS line FROM l),
k AS (SELECT doc_id, i, line || ' ' || [{", ".join(f"'{t.replace(chr(39), chr(39) * 2)}'" for t in _TITLES)}][length(line) % {len(_TITLES)} + 1] || ' ' || line AS title FROM e),
n AS (SELECT doc_id, i, replace(translate(lower(title), '’‘“”–—', chr(39) || chr(39) || '""--'), chr(0), '') AS t FROM k)
SELECT doc_id, CAST(i AS INT) AS i, {_QUARTERLY} AS quarterly, {_ANNUAL} AS annual FROM n""",
    "documents",
)
def c9_title_lookup(documents):
    """Titles within the lines of all documents."""
    rows = documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    title = F.concat_ws(" ", "line", F.get(F.array(*[F.lit(t) for t in _TITLES]), F.length("line") % len(_TITLES)), "line")
    return rows.select("doc_id", "i", parsing.title_item(F.lit("10-Q"), title).alias("quarterly"), parsing.title_item(F.lit("10-K"), title).alias("annual"))


_ABBR = "|".join(text.ABBREVIATIONS)
_SENTENCES = f"list_filter(list_transform(string_split(regexp_replace(regexp_replace({{0}}, '\\b({_ABBR})\\.', '\\1' || chr(2), 'g'), '([.!?])\\s+([A-Z\"(])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda s: regexp_replace(translate(s, chr(2), '.'), '^\\s+|\\s+$', '', 'g')), lambda s: s <> '')"


@query(f"SELECT doc_id, CAST(len(s) AS INT) AS n, md5(array_to_string(s, chr(1))) AS digest FROM (SELECT doc_id, {_SENTENCES.format('text')} AS s FROM documents)", "documents")
def d1_split_sentences(documents):
    rows = documents.select("doc_id", text.sentences(F.col("text")).alias("s"))
    return rows.select("doc_id", F.size("s").alias("n"), F.md5(F.array_join("s", text.MARK)).alias("digest"))


@query("SELECT doc_id, md5(text) AS digest, CAST(length(text) AS INT) AS last_end, true AS contiguous FROM documents", "documents")
def d2_sentence_spans(documents):
    """The spans' pieces put together give the text, and spans follow one another."""
    rows = documents.select("doc_id", "text", text.sentence_pieces(F.col("text")).alias("p"))
    rows = rows.select("doc_id", F.array_join("p", "").alias("joined"), text.spans(F.col("p")).alias("s"))
    chain = F.aggregate("s", F.struct(F.lit(0).alias("at"), F.lit(True).alias("ok")), lambda a, x: F.struct(x["e"].alias("at"), (a["ok"] & (a["at"] == x["s"])).alias("ok")))
    return rows.select("doc_id", F.md5("joined").alias("digest"), chain["at"].alias("last_end"), chain["ok"].alias("contiguous"))


@query("SELECT conv_id, turn, CAST(len(list_filter(string_split(regexp_replace(trim(text), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: s <> '')) AS INT) AS n FROM conversations", "conversations")
def d3_split_sentences_simple(conversations):
    return conversations.select("conv_id", "turn", F.size(text.simple_sentences(F.col("text"))).alias("n"))


@query("SELECT conv_id, turn, CAST(len(regexp_extract_all(regexp_replace(text, '[^\\x00-\\x7F]', 'a', 'g'), '\\w+|[^\\w\\s]')) AS INT) AS n FROM conversations", "conversations")
def d4_token_count(conversations):
    plain = F.regexp_replace("text", r"[^\x00-\x7F]", "a")
    return conversations.select("conv_id", "turn", text.token_count(plain).alias("n"))


@query("SELECT doc_id, CAST(len(string_split(text, chr(10))) - CASE WHEN text LIKE '%' || chr(10) THEN 1 ELSE 0 END AS INT) AS n, CAST(length(text) AS INT) AS last_end FROM documents WHERE text <> ''", "documents")
def d5_line_spans(documents):
    rows = documents.where("text <> ''").select("doc_id", text.spans(text.line_pieces(F.col("text"))).alias("s"))
    return rows.select("doc_id", F.size("s").alias("n"), F.element_at("s", -1)["e"].alias("last_end"))


@query(
    """WITH l AS (SELECT doc_id, chunk_index AS line, contains(content, '|') AS t FROM {chunks}),
f AS (SELECT *, CASE WHEN t IS DISTINCT FROM lag(t) OVER (PARTITION BY doc_id ORDER BY line) THEN 1 ELSE 0 END AS new FROM l),
r AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY line) AS run FROM f)
SELECT doc_id, CAST(run AS BIGINT) AS run, bool_or(t) AS is_table, min(line) AS first_line, count(*) AS n_lines FROM r GROUP BY doc_id, run""",
    "documents",
)
def d6_classify_runs(documents):
    return chunking.classify_runs(documents)


@query("SELECT doc_id, contains(text, chr(10)) AND length(text) - length(replace(text, '|', '')) >= 2 AS row_shaped FROM documents", "documents")
def d7_is_row_shaped(documents):
    return documents.select("doc_id", text.is_row_shaped(F.col("text")).alias("row_shaped"))


_PACK = """WITH RECURSIVE s AS (SELECT {0} AS k, row_number() OVER (PARTITION BY {0} ORDER BY {1}) AS i, {2} AS n FROM {3}),
w AS (SELECT k, i, n, n AS used, 0 AS g FROM s WHERE i = 1
 UNION ALL SELECT s.k, s.i, s.n, CASE WHEN w.used + s.n > {4} THEN s.n ELSE w.used + s.n END, w.g + CASE WHEN w.used + s.n > {4} THEN 1 ELSE 0 END
 FROM w JOIN s ON s.k = w.k AND s.i = w.i + 1)
SELECT k AS {0}, CAST(g AS INT) AS block, count(*) AS n_sentences, CAST(sum(n) AS BIGINT) AS n_tokens FROM w GROUP BY k, g"""


@query(_PACK.format("conv_id", "turn", "CAST(length(text) AS INT)", "conversations", 700), "conversations")
def d8_pack_rows(conversations):
    rows = conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("c"))
    return chunking.group_sentences(rows, 700, id_col="conv_id", pieces=F.transform("c", lambda c: c["text"]), size=F.length).drop("body")


_SIZE_OF_VECTOR = "20 + CAST(floor(abs(CAST(embedding[1] AS DOUBLE)) * 1000) AS INT) % 200"


@query(
    f"""WITH RECURSIVE v AS (SELECT label, vec_id, embedding, {_SIZE_OF_VECTOR} AS n, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS prior FROM embeddings),
s AS (SELECT label, vec_id, n, round(CAST(list_cosine_similarity(CAST(prior AS DOUBLE[]), CAST(embedding AS DOUBLE[])) AS DOUBLE), 9) AS similarity FROM v),
q AS (SELECT label, quantile_cont(similarity, 0.25) AS cut FROM s GROUP BY label),
r AS (SELECT s.label, vec_id, n, similarity, coalesce(similarity <= cut, false) AS valley, row_number() OVER (PARTITION BY s.label ORDER BY vec_id) AS i FROM s JOIN q ON s.label = q.label),
w AS (SELECT label, vec_id, i, similarity, valley, n AS used, 0 AS child FROM r WHERE i = 1
 UNION ALL SELECT r.label, r.vec_id, r.i, r.similarity, r.valley, CASE WHEN w.used >= {chunking.CHILD_MIN} AND (r.valley OR w.used + r.n > {chunking.CHILD_MAX}) THEN r.n ELSE w.used + r.n END,
 w.child + CASE WHEN w.used >= {chunking.CHILD_MIN} AND (r.valley OR w.used + r.n > {chunking.CHILD_MAX}) THEN 1 ELSE 0 END FROM w JOIN r ON r.label = w.label AND r.i = w.i + 1)
SELECT label, vec_id, similarity, valley, CAST(child AS INT) AS child FROM w""",
    "embeddings",
)
def d9_semantic_valleys(embeddings):
    """Valleys and children of each label's vectors; sizes come from the vectors."""
    size = 20 + F.floor(F.abs(F.get("embedding", F.lit(0)).cast("double")) * 1000).cast("int") % 200
    rows = chunking.semantic_breaks(embeddings.withColumn("tokens", size), "label", "vec_id", "embedding", "tokens")
    return rows.select("label", "vec_id", "similarity", "valley", "child")


@query("SELECT doc_id, md5(text) AS digest, true AS within FROM documents", "documents")
def d10_enforce_max(documents):
    """The parts of every text joined give the text, and all stay within the limit."""
    parts = chunking.enforce_max(documents.select("doc_id", "text"), 300, id_col="doc_id")
    out = parts.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("part", "body"))).alias("c"), (F.max("n_tokens") <= 300).alias("within"))
    return out.select("doc_id", F.md5(F.array_join(F.transform("c", lambda c: c["body"]), "")).alias("digest"), "within")


@query("SELECT doc_id, md5(text) AS digest, true AS large_enough FROM documents WHERE text <> ''", "documents")
def d12_semantic_split(documents):
    """The children of every text joined give the text, and none is small unless it is the only one."""
    parts = chunking.semantic_split(documents.where("text <> ''").select("doc_id", "text"))
    out = parts.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("child", "body"))).alias("c"), ((F.min("n_tokens") >= chunking.CHILD_MIN) | (F.count("*") == 1)).alias("large_enough"))
    return out.select("doc_id", F.md5(F.array_join(F.transform("c", lambda c: c["body"]), "")).alias("digest"), "large_enough")


@query(
    """WITH RECURSIVE s AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, length(text)) AS i, length(text) AS n FROM conversations),
w AS (SELECT conv_id, i, n, n AS used, 0 AS g FROM s WHERE i = 1
 UNION ALL SELECT s.conv_id, s.i, s.n, CASE WHEN w.used < 300 AND w.used + s.n <= 700 THEN w.used + s.n ELSE s.n END, w.g + CASE WHEN w.used < 300 AND w.used + s.n <= 700 THEN 0 ELSE 1 END FROM w JOIN s ON s.conv_id = w.conv_id AND s.i = w.i + 1)
SELECT conv_id, CAST(g AS INT) AS unit, count(*) AS n_turns, CAST(sum(n) AS BIGINT) AS n_chars FROM w GROUP BY conv_id, g""",
    "conversations",
)
def d14_coalesce_units(conversations):
    rows = conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.length("text").alias("n")))).alias("c"))
    rows = rows.select("conv_id", F.transform("c", lambda c: c["n"]).alias("n")).withColumn("g", chunking.coalesce_units(F.col("n"), 300, 700))
    items = rows.select("conv_id", F.inline(F.arrays_zip("n", "g")))
    return items.groupBy("conv_id", F.col("g").alias("unit")).agg(F.count("*").alias("n_turns"), F.sum("n").alias("n_chars"))


@query(None, "documents")
def d13_macro_units(documents):
    return documents.select("doc_id", F.size(chunking.macro_units(F.col("text"))).alias("n_units"))


@query(
    "SELECT * FROM (" + _PACK.format("doc_id", "i0", "n0", f"(SELECT doc_id, generate_subscripts(s, 1) AS i0, len(regexp_extract_all(regexp_replace(unnest(s), '[^\\x00-\\x7F]', 'a', 'g'), '\\S+')) AS n0 FROM (SELECT doc_id, {_SENTENCES.format('text')} AS s FROM documents))", 60) + ") WHERE n_tokens >= 20",
    "documents",
)
def d16_group_sentences(documents):
    return chunking.group_sentences(documents, 60, 20, size=text.word_count).drop("body")


@query(
    """WITH RECURSIVE d AS (SELECT doc_id, text, contains(text, chr(10)) AND length(text) - length(replace(text, '|', '')) >= 2 AS shaped FROM documents),
l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g') <> '') AS l FROM d WHERE shaped),
u AS (SELECT doc_id, generate_subscripts(l, 1) AS place, unnest(l) AS t, true AS is_row FROM l UNION ALL SELECT doc_id, 1, text, false FROM d WHERE NOT shaped),
f AS (SELECT *, NOT is_row OR length(t) > 2000 AS is_long FROM u),
p AS (SELECT *, coalesce(lag(is_long) OVER (PARTITION BY doc_id ORDER BY place), false) AS was_long FROM f),
g AS (SELECT *, sum(CASE WHEN is_long OR was_long THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY place) AS segment FROM p),
c AS (SELECT doc_id, segment, place, CASE WHEN is_long THEN list_filter(string_split_regex(t, '[ \\t-\\r]+'), lambda w: w <> '') ELSE [t] END AS c FROM g),
k AS (SELECT doc_id, segment, place, generate_subscripts(c, 1) AS k, length(unnest(c)) AS n FROM c),
s AS (SELECT doc_id, segment, n, row_number() OVER (PARTITION BY doc_id, segment ORDER BY place, k) AS i FROM k),
w AS (SELECT doc_id, segment, i, n, n AS used, 0 AS b FROM s WHERE i = 1
 UNION ALL SELECT s.doc_id, s.segment, s.i, s.n, CASE WHEN w.used + s.n > 2000 THEN s.n ELSE w.used + s.n END, w.b + CASE WHEN w.used + s.n > 2000 THEN 1 ELSE 0 END FROM w JOIN s ON s.doc_id = w.doc_id AND s.segment = w.segment AND s.i = w.i + 1),
o AS (SELECT doc_id, segment, b, count(*) AS n_sentences, CAST(sum(n) AS BIGINT) AS n_tokens FROM w GROUP BY doc_id, segment, b)
SELECT doc_id, block, n_sentences, n_tokens FROM (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY segment, b) - 1 AS INT) AS block FROM o) WHERE n_tokens >= 500""",
    "documents",
)
def d15_split_oversized(documents):
    """All texts: those shaped like rows by lines, the others by words."""
    out = chunking.split_oversized(documents, 2000, 500, size=F.length)
    return out.select("doc_id", "block", F.col("n_items").alias("n_sentences"), "n_tokens")


@query(None, "documents")
def d17_parent_blocks(documents):
    section = F.when(F.col("doc_id") % 3 == 0, "mda").otherwise("business")
    out = chunking.parent_blocks(documents.select("doc_id", section.alias("section"), "text"), 200, 20)
    return out.select("doc_id", "block", "n_tokens", F.md5("body").alias("digest"))


@query(
    """WITH RECURSIVE s AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, length(text)) AS i, length(text) AS n FROM conversations),
w AS (SELECT conv_id, i, n, n AS used, 0 AS g FROM s WHERE i = 1
 UNION ALL SELECT s.conv_id, s.i, s.n, CASE WHEN w.used >= 300 THEN s.n ELSE w.used + s.n END, w.g + CASE WHEN w.used >= 300 THEN 1 ELSE 0 END FROM w JOIN s ON s.conv_id = w.conv_id AND s.i = w.i + 1),
e AS (SELECT conv_id, max(g) AS last, arg_max(used, i) < 300 AND max(g) > 0 AS short FROM w GROUP BY conv_id)
SELECT conv_id, CAST(CASE WHEN short AND g = last THEN g - 1 ELSE g END AS INT) AS part, count(*) AS n_turns, CAST(sum(n) AS BIGINT) AS n_chars FROM w JOIN e USING (conv_id) GROUP BY ALL""",
    "conversations",
)
def d11_merge_small(conversations):
    """Turns merged until a group has 300 characters; a short rest joins the last full group."""
    rows = conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.length("text").alias("n")))).alias("c"))
    rows = rows.select("conv_id", F.transform("c", lambda c: c["n"]).alias("n")).withColumn("g", chunking.merge_small(F.col("n"), 300))
    rows = rows.select("conv_id", F.inline(F.arrays_zip("n", "g")))
    return rows.groupBy("conv_id", F.col("g").alias("part")).agg(F.count("*").alias("n_turns"), F.sum("n").alias("n_chars"))


@query(None, "documents")
def d18_detect_subsection(documents):
    section = F.when(F.col("doc_id") % 2 == 0, "mda").otherwise("properties")
    return documents.select("doc_id", chunking.detect_subsection(F.col("text"), section).alias("subsection"))


@query(
    """SELECT conv_id, CAST(count(*) AS INT) AS n_turns, string_agg(upper(substr(role, 1, 1)) || substr(role, 2), ',' ORDER BY turn) AS speakers FROM conversations WHERE trim(text) <> '' GROUP BY conv_id""",
    "conversations",
)
def d19_speaker_turns(conversations):
    line = F.concat(F.initcap("role"), F.lit(": "), F.regexp_replace("text", r"[:\n]", " "))
    rows = conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("l")))).alias("c"))
    rows = rows.select("conv_id", chunking.speaker_turns(F.array_join(F.transform("c", lambda c: c["l"]), "\n")).alias("t"))
    return rows.select("conv_id", F.size("t").alias("n_turns"), F.array_join(F.transform("t", lambda t: t["speaker"]), ",").alias("speakers"))


@query(
    """WITH RECURSIVE t AS (SELECT conv_id, turn, role, CAST(len(regexp_extract_all(text, '\\w+|[^\\w\\s]')) AS INT) AS n FROM conversations),
s AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, n, role) AS i FROM t),
w AS (SELECT conv_id, i, role, n, n AS used, 1 AS k, 0 AS g FROM s WHERE i = 1
 UNION ALL SELECT s.conv_id, s.i, s.role, s.n, CASE WHEN w.k >= 4 OR w.used + s.n > 600 THEN s.n ELSE w.used + s.n END, CASE WHEN w.k >= 4 OR w.used + s.n > 600 THEN 1 ELSE w.k + 1 END,
  w.g + CASE WHEN w.k >= 4 OR w.used + s.n > 600 THEN 1 ELSE 0 END FROM w JOIN s ON s.conv_id = w.conv_id AND s.i = w.i + 1),
m AS (SELECT *, max(g) OVER (PARTITION BY conv_id) + 1 AS chunk_total FROM w)
SELECT conv_id, g AS chunk_index, chunk_total, arg_min(role, i) AS speaker, count(*) AS n_turns, CAST(sum(n) AS BIGINT) AS n_tokens FROM m GROUP BY conv_id, g, chunk_total HAVING sum(n) >= 80""",
    "conversations",
)
def d20_group_turns(conversations):
    return chunking.group_turns(conversations, "conv_id", "turn")


@query(
    """SELECT chunk_id, row_number() OVER (PARTITION BY accession, section ORDER BY doc_id, chunk_index) - 1 AS chunk_place, count(*) OVER (PARTITION BY accession, section) AS chunk_total,
row_number() OVER (PARTITION BY parent_id ORDER BY doc_id, chunk_index) - 1 AS parent_index, count(*) OVER (PARTITION BY parent_id) AS parent_total FROM {chunks}""",
    "chunks",
)
def d21_chunk_records(chunks):
    rows = chunks.withColumnRenamed("chunk_index", "line")
    out = chunking.chunk_records(rows, ["accession", "section"], ["parent_id"], ["doc_id", "line"])
    return out.select("chunk_id", F.col("chunk_index").cast("long").alias("chunk_place"), "chunk_total", F.col("parent_index").cast("long").alias("parent_index"), "parent_total")


@query("SELECT accession, section, count(*) AS n, count(DISTINCT parent_id) AS parents FROM {chunks} GROUP BY accession, section", "chunks")
def d22_chunk_manifest(chunks):
    return chunks.groupBy("accession", "section").agg(F.count("*").alias("n"), F.countDistinct("parent_id").alias("parents"))


@query("SELECT o_orderkey, fiscal_label FROM {fiscal_orders}", "orders", "customer", "companies")
def e1_derive_fiscal_label(orders, customer, companies):
    rows = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(companies, F.col("c_nationkey") == F.col("company_key"))
    return rows.select("o_orderkey", fiscal.derive_label(F.col("o_orderdate"), F.col("fye_month")).alias("fiscal_label"))


@query("SELECT accession, fy AS fiscal_year, fq AS fiscal_quarter FROM {filings}", "filings")
def e2_parse_fiscal_label(filings):
    label = F.when(F.col("fy") % 2 == 0, F.col("fiscal_label")).otherwise(F.concat(F.lit("Q"), F.col("fq"), F.lit("_FY"), F.col("fy")))
    return filings.select("accession", fiscal.fiscal_year(label).alias("fiscal_year"), fiscal.fiscal_quarter(label).alias("fiscal_quarter"))


@query("SELECT accession, CASE WHEN fy % 3 = 0 THEN 'n/a' ELSE fiscal_label END AS label FROM {filings}", "filings")
def e3_normalize_label(filings):
    label = F.when(F.col("fy") % 3 == 0, "n/a").otherwise(F.concat(F.lit("Q"), F.col("fq"), F.lit("_"), F.col("fy")))
    return filings.select("accession", fiscal.normalize_label(label).alias("label"))


@query("SELECT accession, 'FY' || CAST(CASE WHEN fq > 2 THEN fy ELSE fy - 1 END AS STRING) || '-Q' || CAST(CASE WHEN fq > 2 THEN fq - 2 ELSE fq + 2 END AS STRING) AS prior FROM {filings}", "filings")
def e4_prior_label(filings):
    return filings.select("accession", fiscal.prior_label(F.col("fiscal_label"), 2).alias("prior"))


@query("SELECT a.accession, b.fiscal_label AS prior, CASE WHEN a.fy * 4 + a.fq - b.fy * 4 - b.fq >= 1 THEN a.fy * 4 + a.fq - b.fy * 4 - b.fq ELSE 9 END AS back FROM {filings} a JOIN {filings} b ON a.cik = b.cik AND a.fq = b.fq", "filings")
def e5_quarters_back(filings):
    b = filings.select("cik", "fq", F.col("fiscal_label").alias("prior"))
    rows = filings.join(b, ["cik", "fq"])
    return rows.select("accession", "prior", fiscal.quarters_back(F.col("fiscal_label"), F.col("prior"), F.lit(9)).alias("back"))


@query("SELECT accession, coalesce(CASE WHEN form LIKE '10-Q%' THEN date_diff('day', first_day, report_date) BETWEEN 80 AND 100 ELSE date_diff('day', first_day, report_date) BETWEEN 350 AND 380 END, false) AS fits FROM {filings}", "filings")
def e6_duration_window(filings):
    return filings.select("accession", F.coalesce(fiscal.duration_fits(F.col("form"), F.col("first_day"), F.col("report_date")), F.lit(False)).alias("fits"))
