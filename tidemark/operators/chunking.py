"""Texts to parent blocks and children, and transcripts to groups of turns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import folds, text

#: Token sizes.
PARENT, CHILD, CHILD_MIN, CHILD_MAX, CHUNK_MIN, TURNS, TURN_TOKENS, PERCENTILE = 1000, 250, 80, 375, 80, 4, 600, 0.25
#: Openings of discussion sections that name a topic.
TOPICS = (
    "revenue", "gross margin", "operating income", "operating expenses", "net income", "earnings per share", "segment", "cloud",
    "productivity", "intelligent cloud", "more personal computing", "liquidity", "capital", "cash flows", "overview",
    "critical accounting", "recent accounting", "three months", "nine months", "twelve months",
)
HEADER = r"^(?:[A-Z][A-Z &/\-]{2,49})(?=[ ][A-Za-z])"
MACRO = r"(^|(?<=[.!?] ))(?=[A-Z][A-Z &/\-]{5,49}[ ][A-Za-z])"
BULLET = "•"


def classify_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, run, is_table, first_line, n_lines``: maximal runs of lines with and without ``|``."""
    lines = docs.select(id_col, F.posexplode(F.split(text_col, "\n")).alias("line", "content")).withColumn("is_table", F.col("content").contains("|"))
    order = Window.partitionBy(id_col).orderBy("line")
    lines = lines.withColumn("new", F.coalesce(F.col("is_table") != F.lag("is_table").over(order), F.lit(True)).cast("int"))
    lines = lines.withColumn("run", F.sum("new").over(order))
    return lines.groupBy(id_col, "run").agg(F.first("is_table").alias("is_table"), F.min("line").alias("first_line"), F.count("*").alias("n_lines"))


def group_sentences(docs: DataFrame, budget: int = PARENT, least: int = 0, *, id_col: str = "doc_id", pieces: Column | None = None, size=text.token_count) -> DataFrame:
    """``id, block, n_sentences, n_tokens, body``: sentences packed greedily into blocks; blocks below ``least`` tokens are left out."""
    pieces = pieces if pieces is not None else text.sentences(F.col("text"))
    rows = docs.select(id_col, pieces.alias("s")).withColumn("n", F.transform("s", lambda s: size(s).cast("int")))
    rows = rows.withColumn("g", folds.pack_long(budget)("n"))
    rows = rows.select(id_col, F.posexplode(F.arrays_zip("g", "n", "s")).alias("place", "z")).select(id_col, "place", "z.*")
    out = rows.groupBy(id_col, F.col("g").alias("block")).agg(F.count("*").alias("n_sentences"), F.sum("n").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("place", "s"))).alias("c"))
    out = out.where(F.col("n_tokens") >= least)
    return out.select(id_col, "block", "n_sentences", "n_tokens", F.array_join(F.transform("c", lambda c: c["s"]), " ").alias("body"))


def macro_units(body: Column) -> Column:
    """Units of a discussion section, cut at headers in capitals and at bullets."""
    cut = F.split(body, MACRO)
    units = F.flatten(F.transform(cut, lambda u: F.split(u, BULLET)))
    return F.filter(F.transform(units, lambda u: F.regexp_replace(u, r"^\s+|\s+$", "")), lambda u: u != "")


def coalesce_units(sizes: Column, least: int = CHUNK_MIN, most: int = PARENT) -> Column:
    """Group number of each unit: one joins the group before while that is below ``least`` tokens and both stay within ``most``."""
    return folds.join_while_small(least, most)(sizes)


def merge_small(sizes: Column, least: int = CHILD_MIN) -> Column:
    """Group number of each item: a group grows until it has ``least`` tokens; what is left at the end joins the last full group."""
    return folds.grow_to(least)(sizes)


def split_oversized(docs: DataFrame, target: int, least: int, *, id_col: str = "doc_id", text_col: str = "text", size=text.token_count) -> DataFrame:
    """``id, block, n_items, n_tokens, body``: tables cut at lines, prose and over-long lines at words; blocks below ``least`` tokens are left out.

    An over-long line is a segment of its own; packing never crosses segments. Blocks are slices of a text's own items, so nothing is shuffled.
    """
    body = F.col(text_col)
    words = lambda t: F.filter(F.split(t, r"\s+"), lambda w: w != "")
    lines = F.filter(F.split(body, "\n"), lambda line: text.strip(line) != "")
    units = F.when(text.is_row_shaped(body), F.transform(lines, lambda line: F.struct((size(line) > target).alias("long"), line.alias("t")))).otherwise(F.array(F.struct(F.lit(True).alias("long"), body.alias("t"))))
    rows = docs.select(id_col, units.alias("u"))
    begins = lambda u, i: u["long"] | F.coalesce(F.get(F.col("u"), i - 1)["long"], F.lit(False))
    parts = lambda u: F.when(u["long"], words(u["t"])).otherwise(F.array(u["t"]))
    items = F.flatten(F.transform("u", lambda u, i: F.transform(parts(u), lambda t, k: F.struct(t.alias("t"), u["long"].alias("long"), ((k == 0) & begins(u, i)).alias("fresh")))))
    rows = rows.select(id_col, items.alias("c"))
    rows = rows.select(id_col, "c", F.transform("c", lambda c: size(c["t"]).cast("int")).alias("n"), F.transform("c", lambda c: c["fresh"]).alias("fresh"))
    rows = rows.withColumn("g", folds.packed_runs(target)(F.col("n"), F.col("fresh")))

    def block(start: Column, count: Column, total: Column, i: Column) -> Column:
        own = F.transform(F.slice("c", start, count), lambda c: c["t"])
        joined = F.when(F.get(F.col("c"), start - 1)["long"], F.array_join(own, " ")).otherwise(F.array_join(own, "\n"))
        return F.struct(i.alias("block"), count.cast("long").alias("n_items"), total.alias("n_tokens"), joined.alias("body"))

    return rows.select(id_col, F.inline(folds.runs_of("g", block))).where(F.col("n_tokens") >= least)


def parent_blocks(sections: DataFrame, target: int = PARENT, least: int = CHUNK_MIN, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, block, n_tokens, body``: units of discussion sections with more than one, merged while small; sentences packed to the target else."""
    rows = sections.withColumn("_u", macro_units(F.col(text_col)))
    topical = (F.col("section") == "mda") & (F.size("_u") > 1)
    units = rows.where(topical).select(id_col, "_u").withColumn("n", F.transform("_u", lambda u: text.token_count(u).cast("int")))
    units = units.withColumn("g", coalesce_units(F.col("n"), least, target))
    units = units.select(id_col, F.posexplode(F.arrays_zip("g", "n", "_u")).alias("place", "z")).select(id_col, "place", "z.*")
    merged = units.groupBy(id_col, F.col("g").alias("block")).agg(F.sum("n").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("place", "_u"))).alias("c"))
    merged = merged.where(F.col("n_tokens") >= least).select(id_col, "block", "n_tokens", F.array_join(F.transform("c", lambda c: c["_u"]), " ").alias("body"))
    rest = rows.where(~topical).withColumn("_s", text.sentences(F.col(text_col)))
    packed = group_sentences(rest, target, least, id_col=id_col, pieces=F.col("_s"))
    return merged.unionByName(packed.select(id_col, "block", "n_tokens", "body"))


def enforce_max(children: DataFrame, most: int = CHILD_MAX, *, id_col: str = "child_id", text_col: str = "text", size=text.token_count) -> DataFrame:
    """Children within ``most`` tokens as they are, others cut at word starts; the parts of a child joined give its text."""
    pieces = F.filter(F.split(text_col, r"(?<=\s)(?=\S)"), lambda w: w != "")
    rows = children.select(id_col, F.when(size(F.col(text_col)) <= most, F.array(text_col)).otherwise(pieces).alias("p"))
    rows = rows.select(id_col, "p", F.transform("p", lambda p: size(p).cast("int")).alias("n")).withColumn("g", folds.packed_runs(most)(F.col("n")))
    part = lambda start, count, total, i: F.struct(i.alias("part"), total.alias("n_tokens"), F.array_join(F.slice("p", start, count), "").alias("body"))
    return rows.select(id_col, F.inline(folds.runs_of("g", part)))


def detect_subsection(body: Column, section: Column) -> Column:
    """For three sections the leading header in capitals or a known topic, in snake case; else empty. Longer topics are tried first."""
    plain = F.trim(body)
    header = F.trim(F.regexp_extract(plain, HEADER, 0))
    out = F.lit("")
    for topic in sorted(TOPICS, key=len):
        out = F.when(F.lower(plain).startswith(topic), topic.replace(" ", "_")).otherwise(out)
    snake = F.replace(F.lower(header), F.lit(" "), F.lit("_"))
    return F.when(~section.isin("mda", "risk_factors", "business"), "").when(F.length(header) >= 3, snake).otherwise(out)


def semantic_breaks(sentences: DataFrame, by: str, place: str, vector: str, tokens: str, percentile: float = PERCENTILE, least: int = CHILD_MIN, most: int = CHILD_MAX) -> DataFrame:
    """Append ``similarity`` to the sentence before, ``valley`` (at or below the parent's percentile) and ``child``.

    A child ends before a valley, or where the next sentence would exceed ``most``, once it
    has ``least`` tokens; what is left over stays with the last one. Sorted rows stream by
    with the child's number and size; rows without a parent are left out.
    """
    from tidemark.functions.vectors import cosine

    order = Window.partitionBy(by).orderBy(place)
    rows = sentences.where(F.col(by).isNotNull()).withColumn("similarity", F.round(cosine(F.lag(vector).over(order), F.col(vector)), 9))
    limit = F.percentile("similarity", F.lit(percentile)).over(Window.partitionBy(by))
    rows = rows.withColumn("valley", F.coalesce(F.col("similarity") <= limit, F.lit(False)))
    sizes = rows.withColumn("_n", F.col(tokens).cast("int")).repartition(by).sortWithinPartitions(by, place)
    names = rows.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, child, used = None, 0, 0
        for batch in batches:
            children = []
            for k, n, wanted in zip(*(batch.column(c).to_pylist() for c in (by, "_n", "valley"))):
                if k != now:
                    now, child, used = k, 0, 0
                if used >= least and (wanted or used + n > most):
                    child, used = child + 1, 0
                used += n
                children.append(child)
            kept = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(children, pa.int32())], [*names, "child"])

    return sizes.mapInArrow(cut, T.StructType([*rows.schema.fields, T.StructField("child", T.IntegerType())]))


def semantic_split(blocks: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", target: int = CHILD, least: int = CHILD_MIN, most: int = CHILD_MAX, model=None) -> DataFrame:
    """``id, child, n_tokens, body``: each block cut into children that joined give its text.

    Runs of table lines are packed line by line to the target; runs of prose above the
    target are cut at valleys between sentences. Children above ``most`` are then cut at
    words, and neighbours merged until they have ``least`` tokens, so that a merged child
    may exceed ``most``. An empty text has no child.
    """
    model = model or embed
    joined = lambda c, name: F.array_join(F.transform(c, lambda x: x[name]), "")
    lines = blocks.select(id_col, F.posexplode(text.line_pieces(F.col(text_col))).alias("line", "piece")).withColumn("is_table", F.col("piece").contains("|"))
    order = Window.partitionBy(id_col).orderBy("line")
    new = F.coalesce(F.col("is_table") != F.lag("is_table").over(order), F.lit(True))
    lines = lines.withColumn("run", F.sum(new.cast("int")).over(order))
    runs = lines.groupBy(id_col, "run").agg(F.first("is_table").alias("is_table"), F.array_sort(F.collect_list(F.struct("line", "piece"))).alias("c"))
    runs = runs.withColumn("body", joined(F.col("c"), "piece")).withColumn("s", text.sentence_pieces(F.col("body")))
    whole = ~F.col("is_table") & ((F.size("s") <= 1) | (text.token_count(F.col("body")) <= target))
    single = runs.where(whole).select(id_col, "run", F.lit(0).alias("part"), "body")

    rows = runs.where("is_table").select(id_col, "run", F.transform("c", lambda c: c["piece"]).alias("p"))
    rows = rows.withColumn("n", F.transform("p", lambda p: text.token_count(p).cast("int"))).withColumn("g", folds.pack_long(target)("n"))
    rows = rows.select(id_col, "run", F.posexplode(F.arrays_zip("g", "p")).alias("place", "z")).groupBy(id_col, "run", F.col("z.g").alias("part"))
    tables = rows.agg(F.array_sort(F.collect_list(F.struct("place", "z.p"))).alias("c")).select(id_col, "run", "part", joined(F.col("c"), "p").alias("body"))

    said = runs.where(~F.col("is_table") & ~whole).select(F.struct(id_col, "run").alias("of"), F.posexplode("s").alias("place", "piece"))
    said = model(said.withColumn("n", text.token_count(F.col("piece")).cast("int")), "piece")
    cut = semantic_breaks(said, "of", "place", "embedding", "n", least=least, most=most)
    prose = cut.groupBy("of", F.col("child").alias("part")).agg(F.array_sort(F.collect_list(F.struct("place", "piece"))).alias("c"))
    prose = prose.select(F.col(f"of.{id_col}"), "of.run", "part", joined(F.col("c"), "piece").alias("body"))

    pieces = single.unionByName(tables).unionByName(prose).select(F.struct(id_col, "run", "part").alias("at"), "body")
    parts = enforce_max(pieces, most, id_col="at", text_col="body").select(F.col(f"at.{id_col}"), F.col("at.run"), F.col("at.part").alias("k"), F.col("part").alias("m"), "n_tokens", "body")
    rows = parts.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("run", "k", "m", "n_tokens", "body"))).alias("c"))
    rows = rows.withColumn("g", merge_small(F.transform("c", lambda c: c["n_tokens"].cast("int")), least))
    rows = rows.select(id_col, F.posexplode(F.arrays_zip("g", "c")).alias("place", "z"))
    out = rows.groupBy(id_col, F.col("z.g").alias("child")).agg(F.sum("z.c.n_tokens").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("place", "z.c.body"))).alias("c"))
    return out.select(id_col, "child", "n_tokens", joined(F.col("c"), "body").alias("body"))


def speaker_turns(body: Column) -> Column:
    """``array<struct<speaker, said>>``: turns that begin with ``Name: `` at a line's start; a text without any is one turn without a speaker."""
    pattern = r"(?m)^([A-Z][^:\n]{2,50}):\s"
    names = F.regexp_extract_all(body, F.lit(pattern), F.lit(1))
    said = F.slice(F.split(body, pattern), 2, F.size(names))
    turns = F.zip_with(names, said, lambda n, s: F.struct(n.alias("speaker"), text.strip(s).alias("said")))
    whole = F.array(F.struct(F.lit("").alias("speaker"), text.strip(body).alias("said")))
    return F.filter(F.when(F.size(names) == 0, whole).otherwise(turns), lambda t: t["said"] != "")


def group_turns(turns: DataFrame, by: str, place: str, *, speaker: str = "role", said: str = "text", n_turns: int = TURNS, most: int = TURN_TOKENS, least: int = CHUNK_MIN) -> DataFrame:
    """``id, chunk_index, chunk_total, speaker, n_turns, n_tokens``: up to four turns within 600 tokens; small chunks are left out but keep their number."""
    rows = turns.withColumn("_n", text.token_count(F.col(said)).cast("int"))
    packed = rows.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(F.col(place).alias("p"), F.col("_n").alias("n"), F.col(speaker).alias("speaker")))).alias("c"))
    packed = packed.withColumn("g", folds.pack_counted(most, n_turns)(F.transform("c", lambda c: c["n"])))
    items = packed.select(by, (F.array_max("g") + 1).alias("chunk_total"), F.inline(F.zip_with("c", "g", lambda c, g: F.struct(c["p"].alias("p"), c["n"].alias("n"), c["speaker"].alias("speaker"), g.alias("chunk_index")))))
    out = items.groupBy(by, "chunk_index", "chunk_total").agg(F.min_by("speaker", "p").alias("speaker"), F.count("*").alias("n_turns"), F.sum("n").alias("n_tokens"))
    return out.where(F.col("n_tokens") >= least)


def chunk_records(blocks: DataFrame, section: list[str], parent: list[str], order: list[str]) -> DataFrame:
    """Append dense ``chunk_index, chunk_total`` per section, ``parent_index, parent_total`` per parent, and a stable ``chunk_key``."""
    s, p = Window.partitionBy(*section), Window.partitionBy(*parent)
    rows = blocks.withColumns(
        {
            "chunk_index": F.row_number().over(s.orderBy(*order)) - 1,
            "chunk_total": F.count("*").over(s),
            "parent_index": F.row_number().over(p.orderBy(*order)) - 1,
            "parent_total": F.count("*").over(p),
        }
    )
    return rows.withColumn("chunk_key", F.sha2(F.concat_ws("|", *parent, F.col("parent_index").cast("string")), 256))


def embed(texts: DataFrame, column: str, dims: int = 64) -> DataFrame:
    """Append ``embedding``: hashed bag of words of unit length, the default where no model is given."""
    words = F.regexp_extract_all(F.lower(column), F.lit("[a-z0-9]+"), F.lit(0))
    places = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(dims)).cast("int"))

    @F.arrow_udf("array<float>")
    def counted(found: pa.Array) -> pa.Array:
        rows = np.repeat(np.arange(len(found)), pc.fill_null(pc.list_value_length(found), 0).to_numpy())
        n = np.bincount(rows * dims + found.flatten().to_numpy(), minlength=len(found) * dims).reshape(-1, dims).astype(float)
        n = (n / np.maximum(np.sqrt((n * n).sum(axis=1, keepdims=True)), 1e-12)).astype(np.float32)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * dims), pa.array(n.ravel()))

    return texts.withColumn("embedding", counted(places))


def embed_with(load, batch: int = 256):
    """An embedding function like :func:`embed` around a model: ``load()`` gives a callable from a list of texts to a list of vectors.

    The model is loaded once in each task, whatever the number of batches, and called
    with ``batch`` texts at most; null texts count as empty.
    """

    def vectors_of(texts: DataFrame, column: str) -> DataFrame:
        @F.pandas_udf("array<float>")
        def run(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = load()
            for said in columns:
                said = ["" if t is None else t for t in said.tolist()]
                out: list = []
                for start in range(0, len(said), batch):
                    out += [np.asarray(v, np.float32) for v in model(said[start : start + batch])]
                yield pd.Series(out)

        return texts.withColumn("embedding", run(column))

    return vectors_of


def embed_distinct(texts: DataFrame, known: DataFrame, column: str, model) -> DataFrame:
    """Embed each distinct text once unless its vector is known, and put the vectors back by the text's hash.

    ``known`` holds ``text_key, embedding``; ``model`` appends ``embedding`` to distinct texts.
    """
    rows = texts.withColumn("text_key", F.sha2(F.trim(column), 256))
    new = model(rows.dropDuplicates(["text_key"]).join(known, "text_key", "left_anti").select("text_key", column))
    return rows.join(known.unionByName(new.select("text_key", "embedding")), "text_key")
