"""A blocked inverted index over chunks, and BM25 search that skips blocks which cannot hold a query's k best.

The index is a table: a row for each block of chunks and each term in it, with the
block's chunks that have the term and what bounds the term's impact there. Files are
sorted by filter keys and terms, so a search reads the row groups of its terms. Blocks
have one value of each filter key. A query first scores the blocks with the greatest
bounds; its k-th score there decides which other blocks are read at all.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.staging import shared_path, written

#: Published defaults of BM25.
K1, B = 1.2, 0.75
TERM = "[a-z0-9]+"
#: Chunks of a block at most, terms (repeats counted) that end it, and bytes of a row group of the index.
BLOCK_CHUNKS, BLOCK_POSTINGS, GROUP_BYTES = 4_096, 500_000, 4 << 20
#: Chunks whose terms are counted at once.
SPLIT_CHUNKS = 256
#: Blocks that a query scores before it prunes, queries whose scores a task holds at once, and terms that are looked up by pushed filters.
FIRST_BLOCKS, QUERY_ROWS, PUSHED_TERMS = 2, 256, 200
#: Queries that are sent to the rows all at once, and chunks and bytes of text that are scored against them at once.
SENT_QUERIES, SLICE_CHUNKS, SLICE_BYTES = 1_024, 8_192, 4 << 20


@dataclass
class TextIndex:
    """``table``: rows ``(block, term, n, most, shortest, docs, counts, lengths, ids, *keys)``. A block's row with an empty term
    has its ids, how many they are (n), their terms (most), and how many have a text (shortest); other rows have the number of chunks
    with the term, its greatest count, the length of the shortest of them, and packed: places, counts and lengths."""

    table: DataFrame
    keys: tuple[str, ...]
    chunks: int
    mean_length: float


def terms_of(column: Column) -> Column:
    return F.regexp_extract_all(F.lower(column), F.lit(TERM), F.lit(0))


def index_texts(chunks: DataFrame, *, id_col: str = "chunk_id", text_col: str = "content", keys: tuple[str, ...] = (), path: str | None = None) -> TextIndex:
    """Write the index of all chunks to ``path`` (a new place in the shared folder if None). Each text is read and split once.

    With ``keys``, chunks of equal keys are brought together by ranges, so that a key with very many chunks spreads over tasks.
    """
    spark = chunks.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = chunks.select(F.col(id_col).alias("id"), *[F.col(k).cast("string").alias(k) for k in keys], F.col(text_col).alias("text"))
    rows = rows.repartitionByRange(parts, *keys, "id").sortWithinPartitions(*keys) if keys else rows.repartition(parts, "id")
    kind = chunks.schema[id_col].dataType.simpleString()
    schema = f"block long, term string, n long, most long, shortest long, docs binary, counts binary, lengths binary, ids array<{kind}>" + "".join(f", {k} string" for k in keys)
    place = path or shared_path(spark, "index")
    built = rows.select("id", *keys, F.lower("text").alias("text")).mapInArrow(_blocks(len(keys), list(keys)), schema)
    built.sortWithinPartitions(*keys, "term").write.option("parquet.block.size", GROUP_BYTES).parquet(place)
    return open_index(spark.read.schema(schema).parquet(place), keys)


def open_index(table: DataFrame, keys: tuple[str, ...] = ()) -> TextIndex:
    """An index that :func:`index_texts` has written."""
    n, total, told = table.where("term = ''").agg(F.sum("n"), F.sum("most"), F.sum("shortest")).first()
    return TextIndex(table, tuple(keys), n or 0, (total or 0) / told if told else 1.0)


def _split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The terms of lower-case texts one after the other, and how many each text has: as :data:`TERM` says, by the bytes."""
    at = np.frombuffer(texts.buffers()[1], np.int32 if texts.type == pa.string() else np.int64)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    at = at - at[0]
    inside = _IS_TERM[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begins = at[:-1][at[:-1] < len(raw)]
    first[begins] = inside[begins]  # a term ends with its text
    last = inside.copy()
    last[:-1] &= ~inside[1:] | first[1:]
    starts = np.flatnonzero(first)
    offsets = np.concatenate([[0], np.cumsum(np.flatnonzero(last) + 1 - starts)]).astype(np.int32)
    terms = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(raw[inside]))
    return terms, np.diff(np.searchsorted(starts, at))


_IS_TERM = np.zeros(256, bool)
_IS_TERM[[*range(ord("a"), ord("z") + 1), *range(ord("0"), ord("9") + 1)]] = True


def _packed(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Consecutive runs of ``values`` as binaries, after a null one; run i ends at ``bounds[i + 1]``."""
    ends = np.concatenate([[0], bounds]).astype(np.int64) * values.itemsize
    valid = np.packbits(np.arange(len(bounds)) > 0, bitorder="little")
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds), [pa.py_buffer(valid), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


def _block(number: int, key: tuple, key_names: list[str], ids: pa.Array, texts: pa.Array) -> pa.RecordBatch:
    """Rows of the index for the chunks of a block: terms are numbered, and one sort brings each term's chunks together."""
    order = pa.compute.sort_indices(ids)  # nulls last
    ids, texts = ids.take(order), texts.take(order)
    words, lengths = _split(texts)
    coded = words.dictionary_encode()
    names = coded.dictionary
    by_name = pa.compute.sort_indices(names).to_numpy()
    rank = np.empty(len(names), np.int64)
    rank[by_name] = np.arange(len(names))
    pairs = np.sort(rank[coded.indices.to_numpy()] * len(ids) + np.repeat(np.arange(len(ids)), lengths))
    starts = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]])) if len(pairs) else np.zeros(0, np.int64)
    counts = np.diff(np.append(starts, len(pairs))).astype(np.int32)
    of_term, docs = np.divmod(pairs[starts], len(ids))
    own = lengths[docs].astype(np.int32)
    bounds = np.searchsorted(of_term, np.arange(len(names) + 1))
    at, size = bounds[:-1], 1 + len(names)
    most, least = (f.reduceat(x, at) if len(at) else x for f, x in ((np.maximum, counts), (np.minimum, own)))
    columns = [
        pa.array(np.full(size, number), pa.int64()),
        pa.concat_arrays([pa.array([""], pa.string()), names.take(pa.array(by_name))]),
        pa.array(np.append(len(ids), np.diff(bounds)), pa.int64()),
        pa.array(np.append(lengths.sum(), most), pa.int64()),
        pa.array(np.append(len(texts) - texts.null_count, least), pa.int64()),
        _packed(docs.astype(np.uint16), bounds),
        _packed(counts, bounds),
        _packed(own, bounds),
        pa.concat_arrays([pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.nulls(size - 1, pa.list_(ids.type))]),
        *(pa.array([k] * size, pa.string()) for k in key),
    ]
    return pa.RecordBatch.from_arrays(columns, ["block", "term", "n", "most", "shortest", "docs", "counts", "lengths", "ids", *key_names])


def _blocks(n_keys: int, key_names: list[str]):
    """Rows of the index for batches of ``id, keys, lower-case text`` in which equal keys stand together. A block has chunks of one key, and ends with the chunk that brings it to its terms (repeats counted) or bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, key, held, chunks, terms = TaskContext.get().partitionId() << 32, None, [], 0, 0

        def done() -> pa.RecordBatch:
            ids, texts = (pa.concat_arrays([h[i] for h in held]) for i in (0, 1))
            return _block(number, key, key_names, ids, texts)

        for batch in (whole.slice(i, SPLIT_CHUNKS) for whole in batches for i in range(0, whole.num_rows, SPLIT_CHUNKS)):
            own_keys = list(zip(*(batch.column(1 + i).to_pylist() for i in range(n_keys)))) if n_keys else [()] * batch.num_rows
            ids, texts = batch.column(0), batch.column(1 + n_keys)
            sizes = _split(texts)[1].tolist()
            start = 0
            for at, (own, n) in enumerate(zip(own_keys, sizes)):
                if chunks and (own != key or chunks >= BLOCK_CHUNKS or terms >= BLOCK_POSTINGS):
                    if at > start:
                        held.append((ids.slice(start, at - start), texts.slice(start, at - start)))
                    yield done()
                    number, held, chunks, terms, start = number + 1, [], 0, 0, at
                key, chunks, terms = own, chunks + 1, terms + n
            if batch.num_rows > start:
                held.append((ids.slice(start), texts.slice(start)))
        if chunks:
            yield done()

    return run


def _with_terms(table: DataFrame, terms: list[str]) -> DataFrame:
    """The index rows of the terms. Few terms are pushed to the files' row groups, in sets that stay sets there; many are met by a join with the terms (those of the queries of one block)."""
    if len(terms) <= PUSHED_TERMS:
        sets = [terms[i : i + 10] for i in range(0, len(terms), 10)]
        wanted = F.lit(False)
        for some in sets:
            wanted = wanted | F.col("term").isin(some)
        return table.where(wanted)
    return table.join(F.broadcast(table.sparkSession.createDataFrame([(t,) for t in terms], "term string")), "term", "left_semi")


def _with_keys(table: DataFrame, clauses: dict[str, set | None]) -> DataFrame:
    """The index rows that any query's clauses allow: of keys that every query names, only the values named."""
    for key, values in clauses.items():
        if values is not None and len(values) <= PUSHED_TERMS:
            table = table.where(F.col(key).isin(sorted(values)))
    return table


def search(index: TextIndex, queries: DataFrame, k: int, *, query_col: str = "query", clauses: dict[str, str] | None = None, block_queries: int = 4_096) -> DataFrame:
    """``query_id, id, score, rank``: the k best chunks of each query by BM25, ties by id; chunks without any of its terms are not found.

    ``clauses`` names, for some of the index's keys, the query column with the value that a
    chunk must have; a null value asks for nothing. Frequencies and lengths are those of
    the whole index, whatever the clauses. Queries are taken in blocks of about
    ``block_queries``; of a block the driver holds the terms.
    """
    spark, clauses = queries.sparkSession, clauses or {}
    query_kind, id_kind = queries.schema["query_id"].dataType.simpleString(), index.table.schema["ids"].dataType.elementType.simpleString()
    asked = queries.select("query_id", *[F.col(c).cast("string").alias(f"_{key}") for key, c in clauses.items()], F.explode(F.array_distinct(terms_of(F.col(query_col)))).alias("term"))
    blocks = max(1, -(-queries.count() // block_queries))
    found = None
    for block in range(blocks):
        own = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block)
        part = _search_block(index, own.collect(), k, clauses, query_kind, id_kind) if index.chunks else None
        if part is not None:
            found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], f"query_id {query_kind}, id {id_kind}, score double, rank int")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _search_block(index: TextIndex, asked: list, k: int, clauses: dict[str, str], query_kind: str, id_kind: str) -> DataFrame | None:
    spark = index.table.sparkSession
    terms = sorted({r["term"] for r in asked})
    if not terms:
        return None
    counted = _with_terms(index.table.select("term", "n"), terms).groupBy("term").agg(F.sum("n").alias("df"))
    idf = {r["term"]: float(np.log(1 + (index.chunks - r["df"] + 0.5) / (r["df"] + 0.5))) for r in counted.collect()}
    asked = [r for r in asked if r["term"] in idf]
    if not asked:
        return None
    named = {key: None if any(r[f"_{key}"] is None for r in asked) else {r[f"_{key}"] for r in asked} for key in clauses}
    rows = _with_keys(_with_terms(index.table, ["", *sorted(idf)]), named)

    # the most that a query can score in a block
    table = spark.createDataFrame([(r["query_id"], r["term"], idf[r["term"]], *[r[f"_{key}"] for key in clauses]) for r in asked], f"query_id {query_kind}, term string, idf double" + "".join(f", _{key} string" for key in clauses))
    most = F.col("most") * (K1 + 1) / (F.col("most") + K1 * (1 - B + B * F.col("shortest") / index.mean_length))
    met = rows.where("term <> ''").select("block", "term", "most", "shortest", *clauses).join(F.broadcast(table), "term")
    for key in clauses:
        met = met.where(F.col(f"_{key}").isNull() | (F.col(f"_{key}") == F.col(key)))
    bounds = met.groupBy("query_id", "block").agg((F.sum(F.col("idf") * most) + 1e-6).alias("bound"))
    order = Window.partitionBy("query_id").orderBy(F.desc("bound"), "block")
    bounds = written(bounds.withColumn("turn", F.row_number().over(order)), "bounds")

    ids = sorted({r["query_id"] for r in asked})
    place, of_term = {q: i for i, q in enumerate(ids)}, {}
    for r in asked:
        of_term.setdefault(r["term"], []).append(place[r["query_id"]])
    shared = spark.sparkContext.broadcast((place, {t: (idf[t], np.array(sorted(at))) for t, at in of_term.items()}, index.mean_length))
    kind = f"query_id {query_kind}, id {id_kind}, score double"

    def scored(pairs: DataFrame) -> DataFrame:
        wanted = pairs.select("query_id", "block")
        own = rows.select("block", "term", "docs", "counts", "lengths", "ids").join(wanted.select("block").distinct(), "block", "left_semi")
        return own.groupBy("block").cogroup(wanted.groupBy("block")).applyInArrow(_scores(shared, k), kind)

    first = written(scored(bounds.where(F.col("turn") <= FIRST_BLOCKS)), "first-scores")
    least = first.withColumn("_n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score")))).where(F.col("_n") == k).select("query_id", F.col("score").alias("least"))
    others = bounds.where(F.col("turn") > FIRST_BLOCKS).join(least, "query_id", "left").where(F.col("bound") >= F.coalesce("least", F.lit(0.0)))
    return first.unionByName(scored(others))


def _scores(shared, k: int):
    """The k best chunks of a block for each query that asks it, by adding up its terms' rows."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        place, of_term, mean_length = shared.value
        asking = np.array(sorted(place[q] for q in right.column("query_id").to_pylist()))
        names = {i: q for q, i in place.items()}
        ids, terms = [], []
        for term, docs, counts, lengths, own in zip(*(left.column(c).to_pylist() for c in ("term", "docs", "counts", "lengths", "ids"))):
            if not term:
                ids = own
                continue
            idf, at = of_term[term]
            n, length = np.frombuffer(counts, np.int32).astype(float), np.frombuffer(lengths, np.int32)
            terms.append((term, at, np.frombuffer(docs, np.uint16), idf * n * (K1 + 1) / (n + K1 * (1 - B + B * length / mean_length))))
        terms.sort(key=lambda t: t[0])
        out: list[tuple] = []
        spot = np.full(len(place), -1)
        for start in range(0, len(asking), QUERY_ROWS):
            some = asking[start : start + QUERY_ROWS]
            spot[:] = -1
            spot[some] = np.arange(len(some))
            score = np.zeros((len(some), len(ids)))
            for _, at, docs, impact in terms:
                if len(mine := spot[at][spot[at] >= 0]):
                    score[np.ix_(mine, docs)] += impact
            score = score.round(6)
            if len(ids) > k:
                floor = np.maximum(np.partition(score, len(ids) - k, axis=1)[:, len(ids) - k], 1e-9)
                q, at = np.nonzero(score >= floor[:, None])
            else:
                q, at = np.nonzero(score > 0)
            order = np.lexsort((at, -score[q, at], q))  # ids stand in order within a block
            q, at = q[order], at[order]
            first = np.searchsorted(q, q, "left")
            kept = np.arange(len(q)) - first < k
            out += [(names[int(some[a])], ids[b], float(score[a, b])) for a, b in zip(q[kept], at[kept])]
        types = (right.schema.field("query_id").type, left.schema.field("ids").type.value_type, pa.float64())
        return pa.table([pa.array([o[i] for o in out], t) for i, t in enumerate(types)], ["query_id", "id", "score"])

    return run


def clause_groups(named: list[tuple]) -> dict[tuple, list[int]]:
    """Places of queries by the values that their clauses name."""
    alike: dict[tuple, list[int]] = {}
    for i, values in enumerate(named):
        alike.setdefault(tuple(values), []).append(i)
    return alike


def allowed(keys: list[pa.Array], named: tuple) -> np.ndarray | None:
    """Which rows have the named values, a null one allowing any; None if no value is named."""
    fits = None
    for own, value in zip(keys, named):
        if value is not None:
            same = pa.compute.fill_null(pa.compute.equal(own, value), False).to_numpy(zero_copy_only=False)
            fits = same if fits is None else fits & same
    return fits


class Best:
    """The k best of the rows seen so far for each of some queries, ties to the smaller id. Rows come in the order of ids, part by part."""

    def __init__(self, size: int, k: int):
        self.k, self.rows, self.least = k, [[] for _ in range(size)], np.full(size, -np.inf)

    def add(self, query: int, places: np.ndarray, scores: np.ndarray, ids: pa.Array) -> None:
        if len(places) > self.k:
            floor = np.partition(scores, -self.k)[-self.k]
            above = np.flatnonzero(scores > floor)
            kept = np.concatenate([above, np.flatnonzero(scores == floor)[: self.k - len(above)]])
            places, scores = places[kept], scores[kept]
        new = list(zip((-scores).tolist(), ids.take(pa.array(places)).to_pylist()))
        own = sorted(self.rows[query] + new, key=lambda r: (r[0], r[1] is None, 0 if r[1] is None else r[1]))[: self.k]
        self.rows[query] = own
        if len(own) == self.k:
            self.least[query] = -own[-1][0]

    def table(self, names: pa.Array, id_type: pa.DataType) -> pa.RecordBatch:
        found = [(n, i, -s) for n, own in enumerate(self.rows) for s, i in own]
        return pa.RecordBatch.from_arrays([names.take(pa.array([f[0] for f in found], pa.int64())), pa.array([f[1] for f in found], id_type), pa.array([f[2] for f in found], pa.float64())], ["query_id", "id", "score"])


def _slices(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[pa.RecordBatch]:
    """Parts of the batches with few chunks and, but for single long ones, few bytes of text."""
    for batch in batches:
        size = pa.compute.fill_null(pa.compute.binary_length(batch.column(text)), 0).to_numpy().astype(np.int64)
        part = np.cumsum(size) // SLICE_BYTES * (batch.num_rows // SLICE_CHUNKS + 1) + np.arange(batch.num_rows) // SLICE_CHUNKS
        starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else []
        for start, end in zip(starts, [*starts[1:], batch.num_rows]):
            yield batch.slice(start, end - start)


def _postings(texts: pa.Array, terms: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the given terms: term, chunk and count, by terms and then chunks; and the lengths of all chunks."""
    words, lengths = _split(texts)
    at = pa.compute.fill_null(pa.compute.index_in(words, value_set=terms), -1).to_numpy().astype(np.int64)
    known = at >= 0
    pairs, counts = np.unique(at[known] * len(texts) + np.repeat(np.arange(len(texts)), lengths)[known], return_counts=True)
    return *np.divmod(pairs, max(len(texts), 1)), counts, lengths


def search_few(chunks: DataFrame, queries: DataFrame, k: int, *, id_col: str = "chunk_id", text_col: str = "content", query_col: str = "query", clauses: dict[str, str] | None = None) -> DataFrame:
    """What :func:`search` finds, without an index: the queries' terms go to the chunks, which are read twice (for
    the terms' frequencies, then for scores) and never shuffled. For up to :data:`SENT_QUERIES` queries; the driver holds their terms."""
    spark, clauses = queries.sparkSession, clauses or {}
    asked = queries.select("query_id", F.array_distinct(terms_of(F.col(query_col))).alias("terms"), F.array(*[F.col(c) for c in clauses.values()]).cast("array<string>").alias("named")).where(F.size("terms") > 0).toArrow()
    own_terms = asked.column("terms").to_pylist()
    query_kind, id_kind = queries.schema["query_id"].dataType.simpleString(), chunks.schema[id_col].dataType.simpleString()
    rows = chunks.select(F.col(id_col).alias("id"), *[F.col(c).cast("string").alias(c) for c in clauses], F.lower(text_col).alias("text"))
    terms = sorted({t for own in own_terms for t in own})
    sent = spark.sparkContext.broadcast(terms)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(sent.value, pa.string())
        n, total, told, df = 0, 0, 0, np.zeros(len(known), np.int64)
        for part in _slices(batches, 0):
            of_term, _, _, lengths = _postings(part.column(0), known)
            df += np.bincount(of_term, minlength=len(known))
            n, total, told = n + part.num_rows, total + int(lengths.sum()), told + part.num_rows - part.column(0).null_count
        seen = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(seen, [-1, -2, -3])), pa.array(np.append(df[seen], [n, total, told]))], ["term", "n"])

    counted = {r["term"]: r["n"] for r in rows.select("text").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()} if terms else {}
    n, total, told = (counted.get(i, 0) for i in (-1, -2, -3))
    idf = np.array([np.log(1 + (n - counted.get(i, 0) + 0.5) / (counted.get(i, 0) + 0.5)) for i in range(len(terms))])
    place = {t: i for i, t in enumerate(terms)}
    sets: dict[tuple, int] = {}  # queries of the same terms are scored once
    of_query = [sets.setdefault(tuple(sorted(place[t] for t in own)), len(sets)) for own in own_terms]
    shared = spark.sparkContext.broadcast((asked.column("query_id").combine_chunks(), of_query, clause_groups(asked.column("named").to_pylist()), list(sets), idf, total / told if told else 1.0))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, of_query, alike, sets, idf, mean_length = shared.value
        known, best, id_type = pa.array(sent.value, pa.string()), Best(len(names), k), None
        asking: list[dict[int, list[int]]] = []  # for each block of sets, the sets with a term
        for start in range(0, len(sets), QUERY_ROWS):
            block: dict[int, list[int]] = {}
            for i, own in enumerate(sets[start : start + QUERY_ROWS]):
                for t in own:
                    block.setdefault(t, []).append(i)
            asking.append({t: np.array(i)[:, None] for t, i in block.items()})
        for part in _slices(batches, 1 + len(clauses)):
            part = part.take(pa.compute.sort_indices(part.column(0)))
            ids, id_type = part.column(0), part.schema.types[0]
            of_term, docs, counts, lengths = _postings(part.column(1 + len(clauses)), known)
            impact = idf[of_term] * counts * (K1 + 1) / (counts + K1 * (1 - B + B * lengths[docs] / mean_length))
            starts = np.flatnonzero(np.concatenate([[True], of_term[1:] != of_term[:-1]])) if len(of_term) else np.zeros(0, np.int64)
            ends = np.append(starts[1:], len(of_term))
            fits = {named: allowed([part.column(1 + i) for i in range(len(clauses))], named) for named in alike}
            for number, block in enumerate(asking):
                scores = np.zeros((min(QUERY_ROWS, len(sets) - number * QUERY_ROWS), len(ids)))
                for t, a, b in zip(of_term[starts].tolist(), starts.tolist(), ends.tolist()):
                    if (mine := block.get(t)) is not None:
                        scores[mine, docs[a:b]] += impact[a:b]
                for named, members in alike.items():
                    for j in members:
                        if of_query[j] // QUERY_ROWS != number:
                            continue
                        own = scores[of_query[j] % QUERY_ROWS]
                        near = (own > 0) & (own >= best.least[j] - 1e-6)  # what rounding can still bring to the k-th
                        found = np.flatnonzero(near if fits[named] is None else near & fits[named])
                        rounded = own[found].round(6)
                        if len(good := np.flatnonzero((rounded >= best.least[j]) & (rounded > 0))):
                            best.add(j, found[good], rounded[good], ids)
        if id_type is not None:
            yield best.table(names, id_type)

    kind = f"query_id {query_kind}, id {id_kind}, score double"
    found = rows.mapInArrow(score, kind) if terms else spark.createDataFrame([], kind)
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)


def bm25(chunks: DataFrame, queries: DataFrame, k: int, *, id_col: str = "chunk_id", text_col: str = "content", query_col: str = "query", block_queries: int = 4_096) -> DataFrame:
    """``query_id, id, score, rank``: the k best chunks of each query by BM25, by an index of the chunks written for it."""
    return search(index_texts(chunks, id_col=id_col, text_col=text_col), queries, k, query_col=query_col, block_queries=block_queries)
