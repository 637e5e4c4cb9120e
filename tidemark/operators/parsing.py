"""Filing pages to sections: events of each page (see :mod:`tidemark.operators.pages`), everything around them native."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.operators.filters import drop_canonical_sections
from tidemark.operators.pages import HIDDEN_TAGS, extract_tables, page_events  # noqa: F401
from tidemark.staging import written

#: Sections of an annual report by item.
ITEMS_10K = {
    "1": "business", "1A": "risk_factors", "1B": "unresolved_staff_comments", "1C": "cybersecurity", "2": "properties",
    "3": "legal_proceedings", "4": "mine_safety", "5": "market_for_registrant_equity", "6": "reserved", "7": "mda",
    "7A": "quantitative_qualitative_disclosures", "8": "financial_statements", "9": "changes_in_disagreements_accountants",
    "9A": "controls_and_procedures", "9B": "other_information", "9C": "disclosure_re_foreign_jurisdictions",
    "10": "directors_executive_officers", "11": "executive_compensation", "12": "security_ownership", "13": "certain_relationships",
    "14": "principal_accountant_fees", "15": "exhibits",
}
#: Sections of a quarterly report by part and item.
ITEMS_10Q = {
    ("I", "1"): "financial_statements", ("I", "2"): "mda", ("I", "3"): "quantitative_qualitative_disclosures",
    ("I", "4"): "controls_and_procedures", ("II", "1"): "legal_proceedings", ("II", "1A"): "risk_factors",
    ("II", "2"): "unregistered_sales", ("II", "3"): "defaults_senior_securities", ("II", "4"): "mine_safety",
    ("II", "5"): "other_information", ("II", "6"): "exhibits",
}
#: Parts of titles in the order they are tried, with part and item.
TITLES_10Q = (
    ("management's discussion and analysis", "I", "2"), ("quantitative and qualitative", "I", "3"), ("controls and procedures", "I", "4"),
    ("financial statements", "I", "1"), ("risk factors", "II", "1A"), ("legal proceedings", "II", "1"), ("unregistered sales", "II", "2"),
    ("other information", "II", "5"), ("exhibits", "II", "6"),
)
TITLES_10K = (
    ("management's discussion and analysis", "7"), ("quantitative and qualitative", "7A"), ("controls and procedures", "9A"),
    ("financial statements", "8"), ("risk factors", "1A"), ("unresolved staff comments", "1B"), ("cybersecurity", "1C"),
    ("legal proceedings", "3"), ("properties", "2"), ("business", "1"), ("mine safety", "4"), ("market for registrant", "5"),
    ("reserved", "6"), ("changes in and disagreements", "9"), ("other information", "9B"), ("disclosure regarding foreign", "9C"),
    ("directors, executive officers", "10"), ("executive compensation", "11"), ("security ownership", "12"),
    ("certain relationships", "13"), ("principal accountant fees", "14"), ("exhibits", "15"),
)
#: Fixed value: a title with this in it is a part marker of a quarterly report's contents, whatever follows it.
TITLE_MARKER = "part i"
#: Numbers of parts in links' targets.
PARTS = {"I": "I", "II": "II", "III": "III", "IV": "IV", "1": "I", "2": "II", "3": "III", "4": "IV"}


def strip_noise(html: Column) -> Column:
    """The page without script, style and hidden header blocks, as far as a pattern can tell."""
    out = html
    for tag in HIDDEN_TAGS:
        out = F.regexp_replace(out, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", "")
    return out


def list_items(html: Column) -> Column:
    """Texts of the page's list items, empty ones left out."""
    found = F.regexp_extract_all(html, F.lit(r"(?is)<li\b[^>]*>(.*?)</li>"), F.lit(1))
    plain = F.transform(found, lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, "<[^>]*>", " "), r"\s+", " ")))
    return F.filter(plain, lambda x: x != "")


def section_map(spark: SparkSession) -> DataFrame:
    rows = [("10-Q", p, i, s) for (p, i), s in ITEMS_10Q.items()] + [("10-K", p, i, s) for i, s in ITEMS_10K.items() for p in ("I", "II", "III", "IV")]
    return spark.createDataFrame(rows, "form string, part string, item string, section string")


def canonical_section(form: Column, part: Column, item: Column) -> Column:
    """Section of an item: by part and item for 10-Q, by item else; null if there is none."""
    out = F.lit(None).cast("string")
    for i, s in ITEMS_10K.items():
        out = F.when((form != "10-Q") & (item == i), s).otherwise(out)
    for (p, i), s in ITEMS_10Q.items():
        out = F.when((form == "10-Q") & (part == p) & (item == i), s).otherwise(out)
    return out


def title_item(form: Column, title: Column) -> Column:
    """``part/item`` for 10-Q and ``item`` else of the first known part of a title that occurs, null if none does."""
    # one CASE with all titles: what its conditions share, the plain title, is computed once
    plain = text.normalize_title(title)
    q = reduce(lambda case, row: case.when(plain.contains(row[0]), f"{row[1]}/{row[2]}"), TITLES_10Q, F)
    k = reduce(lambda case, row: case.when(plain.contains(row[0]), row[1]), TITLES_10K, F)
    return F.when(form == "10-Q", q).otherwise(k)


def item_ordinal(item: Column) -> Column:
    """1 as 10, 1A as 11, 2 as 20."""
    letter = F.upper(F.regexp_extract(item, "([A-Ca-c])$", 1))
    return F.regexp_extract(item, r"^(\d+)", 1).cast("int") * 10 + F.when(letter == "", 0).otherwise(F.ascii(letter) - 64)


def carried_parts(items: DataFrame, by: str, place: str, marker: Column) -> DataFrame:
    """Append ``part``, in order of ``place``: the last ``marker`` (I before any), and under I the part is II from the first item on
    whose ordinal does not exceed that of the item before it. A marker starts the count of ordinals anew; rows without an item count for nothing."""
    order = Window.partitionBy(by).orderBy(place)
    rows = items.withColumn("_marker", marker).withColumn("_since", F.count("_marker").over(order)).withColumn("_base", F.coalesce(F.last("_marker", True).over(order), F.lit("I")))
    within = Window.partitionBy(by, "_since").orderBy(place)
    rows = rows.withColumn("_o", item_ordinal(F.col("item")))
    before = F.last("_o", True).over(within.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_reset", F.coalesce(F.col("_o") <= before, F.lit(False)))
    again = F.max("_reset").over(within.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("part", F.when(again & (F.col("_base") == "I"), "II").otherwise(F.col("_base"))).drop("_marker", "_since", "_base", "_o", "_reset")


def ordinal_reset(items: DataFrame, by: str, place: str) -> DataFrame:
    """Append ``part``: II from the first item on whose ordinal does not exceed the one before, else I."""
    return carried_parts(items, by, place, F.lit(None).cast("string"))


def _valid(form: str) -> list[str]:
    return sorted({i for _, i in ITEMS_10Q} if form == "10-Q" else set(ITEMS_10K))


def _blank(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def _part_name(c: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in PARTS.items() for x in pair])[F.upper(c)]


def text_between(events: DataFrame, key: Column, kinds: tuple[str, ...] = ("text", "title", "table")) -> DataFrame:
    """``id, start, key, body``: from each event with a ``key`` that is not null to the next one, what the kinds say in document order.

    Tables keep their rows; of a table that the section begins in, the rest comes text by
    text. The section's start is carried along the events, so a page is sorted once and
    nothing is joined.
    """
    order = Window.partitionBy("id").orderBy("place")
    begun = F.last(F.when(key.isNotNull(), F.struct(F.col("place").alias("start"), key.alias("key"))), True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = events.withColumn("_in", begun).where("_in is not null")
    start = F.col("_in.start")
    said = (F.col("place") > start) & (F.col("kind").isin(*kinds) | (F.col("kind") == "cell") & (F.col("inside") < start))
    found = rows.groupBy("id", start.alias("start"), F.col("_in.key").alias("key")).agg(F.array_sort(F.collect_list(F.when(said, F.struct("place", "content")))).alias("said"))
    return found.select("id", "start", "key", F.array_join(F.transform("said", lambda c: c["content"]), " ").alias("body"))


def _first_of_section(bodies: DataFrame, form: Column) -> DataFrame:
    """``id, section, body`` of ``key`` part and item, by the form: the first of equal sections, empty ones and unknown items left out."""
    named = bodies.withColumn("section", canonical_section(form, F.col("key.part"), F.col("key.item"))).where("section is not null and body <> ''")
    first = F.row_number().over(Window.partitionBy("id", "section").orderBy("start"))
    return named.withColumn("_n", first).where("_n = 1").select("id", "section", "body")


def heading_sections(events: DataFrame, form: Column, valid: list[str] | None = None) -> DataFrame:
    """``id, section, body``: sections under headings ``Item N`` (a heading, or a bold run) to the next one, under the part that
    ``Part N`` headings or the ordinals tell; repeated running headers continue a section, the first of equal sections wins."""
    heads = events.where(F.col("kind").isin("heading", "bold")).select("id", "place", "content")
    part = _part_name(_blank(F.regexp_extract("content", r"(?i)^\s*part\s+(i{1,3}|iv)\b", 1)))
    item = _blank(F.upper(F.regexp_extract("content", r"(?i)^(?:item|part)\s+(\d{1,2}[A-C]?)[.\s]", 1)))
    heads = heads.select("id", "place", part.alias("marker"), F.when(part.isNull(), item).alias("item"))
    heads = heads.where(F.col("marker").isNotNull() | (F.col("item").isin(*(valid or sorted(set(ITEMS_10K) | {i for _, i in ITEMS_10Q})))))
    order = Window.partitionBy("id").orderBy("place")
    marked = carried_parts(heads, "id", "place", F.col("marker")).where("item is not null").withColumn("key", F.struct("part", "item"))
    marked = marked.withColumn("_new", F.coalesce(F.col("key") != F.lag("key").over(order), F.lit(True))).where("_new")
    return _first_of_section(text_between(_keyed(events, marked), F.col("key"), ("text", "table")), form)


def _keyed(events: DataFrame, starts: DataFrame) -> DataFrame:
    """``events`` with the ``key`` of the start at their place; pages without a start go. The starts of a page come as one row, so that events are dealt by page alone."""
    of_page = starts.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("place", "key"))).alias("_keys"))
    return events.join(of_page, "id").withColumn("key", F.try_element_at("_keys", F.col("place"))).drop("_keys")


def toc_anchors(events: DataFrame, form: str = "10-Q") -> DataFrame:
    """Links of a page's contents that name an item: ``id, place, target, part, item, at``.

    An item is named by the link's text, its target or its title. The part is the one that a
    "Part N" link names before it, or that the ordinals tell (see :func:`carried_parts`);
    a title has a part of its own. Of links to the same item the last whose target is on the
    page counts; ``at`` is the target's place.
    """
    some = events.where(F.col("kind").isin("link", "anchor", "name")).select("id", "place", "kind", "content", "target")
    spot = Window.partitionBy("id", "target")
    by_id, by_name = (F.min(F.when(F.col("kind") == kind, F.col("place"))).over(spot) for kind in ("anchor", "name"))
    links = some.withColumn("at", F.coalesce(by_id, by_name)).where("kind = 'link'")
    marker = F.coalesce(
        _blank(F.regexp_extract("content", r"(?i)^\s*part\s+(i{1,3}|iv)\b", 1)),
        _blank(F.regexp_extract("target", r"(?i)part[_-](i{1,3}|iv|1|2|3|4)(?:[_-]|$)", 1)),
    )
    by_text = _blank(F.upper(F.regexp_extract("content", r"(?i)item\s+(1[ABC]?|[2-9][ABC]?|1[0-5])\b", 1)))
    by_slug = _blank(F.upper(F.regexp_extract("target", r"(?i)item[_-](\d{1,2}[a-c]?)(?:[_-]|$)", 1)))
    links = links.withColumn("marker", _part_name(marker)).withColumn("numbered", F.coalesce(by_text, by_slug))
    untold = F.col("marker").isNull() & F.col("numbered").isNull()
    title = F.when(untold, title_item(F.lit(form), F.col("content")))
    if form == "10-Q":
        links = links.withColumn("marker", F.when(untold & text.normalize_title(F.col("content")).contains(TITLE_MARKER), "I").otherwise(F.col("marker")))
        title = F.when(F.col("marker").isNull(), title)
        own_part, titled = F.get(F.split(title, "/"), 0), F.get(F.split(title, "/"), 1)
    else:
        own_part, titled = F.lit(None).cast("string"), title
    links = links.withColumn("own_part", own_part).withColumn("item", F.when(F.col("marker").isNull(), F.coalesce("numbered", titled)))
    links = links.where(F.col("marker").isNotNull() | F.col("item").isin(*_valid(form)))
    # titles with a part of their own leave the others' ordinals alone
    told = links.withColumn("_item", F.col("item")).withColumn("item", F.when(F.col("own_part").isNull() & F.lit(form == "10-Q"), F.col("item")))
    found = carried_parts(told, "id", "place", F.col("marker")).withColumn("item", F.col("_item")).where("item is not null and at is not null")
    found = found.withColumn("part", F.coalesce("own_part", "part"))
    last = F.row_number().over(Window.partitionBy("id", "part", "item").orderBy(F.desc("place")))
    return found.withColumn("_n", last).where("_n = 1").select("id", "place", "target", "part", "item", "at")


def toc_sections(events: DataFrame, form: str = "10-Q", least: int = 3) -> DataFrame:
    """``id, section, body`` from the target of each item in the contents to the next item's, where the contents name ``least`` items; the first of equal sections wins."""
    links = toc_anchors(events, form)
    links = links.withColumn("_n", F.count("*").over(Window.partitionBy("id"))).where(F.col("_n") >= least)
    starts = links.groupBy("id", F.col("at").alias("place")).agg(F.min_by(F.struct("part", "item"), "place").alias("key"))
    return _first_of_section(text_between(_keyed(events, starts), F.col("key")), F.lit(form))


def parse_filings(pages: DataFrame, form: str = "10-Q", id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """``id, section, body, method``: by the table of contents where that gives any section to keep, else by headings; dropped sections are left out.

    Pages are parsed once; their events are a table in the shared folder, of which the
    contents and the headings read a few rows and two columns. Both kinds of sections are tables there too.
    """
    events = written(page_events(pages, id_col, html_col), "events")
    toc = written(drop_canonical_sections(toc_sections(events, form)), "sections")
    heads = drop_canonical_sections(heading_sections(events.join(toc.select("id").distinct(), "id", "left_anti"), F.lit(form), _valid(form)))
    heads = written(heads, "sections")
    return toc.withColumn("method", F.lit("toc")).unionByName(heads.withColumn("method", F.lit("headings")))
