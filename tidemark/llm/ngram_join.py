"""Jaccard self-join of word n-gram sets by PartEnum signatures.

Two sets of sizes a and b with a Jaccard similarity of at least t % differ in at most
(a + b)(100 - t) / (100 + t) elements. Sizes fall into bands, so that a partner is in the
same or a neighbouring band; a set takes part in its own band's instance of the scheme and
in the next one. An instance partitions the domain of elements by hash, in two levels: n1
parts of ``SECOND`` = 3 each. A first-level part in which a pair differs in at most one
element has two or more second-level parts that are equal; so every subset of two of the
three is signed. A pair within distance k differs in two elements or more in at most k / 2
of the first-level parts, hence shares a signature of each of the n1 - k / 2 others. What
is shared must be neither empty nor *hot* (shared by more than ``HOT`` sets), which holds
for one of them at least if one of the two sets has fewer than n1 - k / 2 first-level
parts that have an empty or hot signature. So:

* sets that are short of other parts also sign their single elements;
* hot signatures only matter between sets that are short of parts without them; such
  sets are few and stand in dense groups, which are compared within by blocks.

No pair is lost, and no group of a shared passage or of copies is expanded into pairs:
sets that share a signature are first compared with the group's smallest id only; what
that links is one component; only members of different components are compared further.
The argument also says how many cold signatures a linked pair shares at least, which
leaves few pairs to compare. Every comparison counts exactly, by 64-bit hashes.

Signatures move as packs: a task sorts its signatures, cuts them into ranges (buckets)
and writes each range as one row of differences. A signature that many sets of a task
have goes to its bucket once, and its ids come after it as one row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import anti_by_id, give_back, hot_keys, join_hot, materialize, small_batches

WORDS, PERCENT, HOT, SECOND = 5, 75, 64, 3
#: Signatures a task sorts together, signatures of a bucket, ids of a signature that a pack holds, and bits by which signatures exceed their number.
FLUSH, BUCKET, GROUP, SPARE_BITS = 250_000, 1_000_000, 4, 16
#: Sets and elements in a block of a dense group, and distinct elements counted at a time.
BLOCK, BLOCK_ELEMENTS, COLUMNS = 256, 250_000, 4_096
#: Edges whose components one task may find.
FEW_EDGES = 100_000
#: Words whose hashes a worker keeps; a full table starts anew.
KEPT_WORDS = 100_000


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = WordHashes()


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted hashes of the distinct word n-grams of a text in lower-cased A-Z; of all words as one with fewer than n."""
    found = text.encode("utf-8", "replace").lower().split() if text else []
    if not found:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_hashes.__getitem__, found), np.uint64, len(found))
    n = min(words, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - n + 1 + k]
    return np.unique(mixed(out))


def bands(size: int, percent: int) -> tuple[int, int, int]:
    """The number of the size's band, its upper end, and that of the next band."""
    number, top = 0, 0
    while top < size:
        top = max(top + 1, (top + 1) * 100 // percent)
        number += 1
    return number, top, max(top + 1, (top + 1) * 100 // percent)


_bands: dict[tuple[int, int], list[tuple]] = {}


def first_level(top: int, percent: int) -> int:
    """First-level parts of the instance whose band ends at ``top``: enough to exceed those that a pair may differ in by a margin for empty ones."""
    most = 2 * top * (100 - percent) // (100 + percent) // 2
    return max(most + 1, int(most * 1.1 + 0.25 * top**0.5) + 1)


def scheme(m: int, percent: int) -> list[tuple]:
    """Of both instances of a set of ``m`` elements: number, first-level parts, most that may differ, and what sets apart the subsets of each part."""
    if (m, percent) not in _bands:
        if len(_bands) > 100_000:
            _bands.clear()
        number, *tops = bands(m, percent)
        _bands[m, percent] = found = []
        for instance, top in ((number, tops[0]), (number + 1, tops[1])):
            n = first_level(top, percent)
            if (instance, n) not in _places:
                _places[instance, n] = mixed(np.arange(SECOND * n, dtype=np.uint64) + np.uint64(instance << 32)).reshape(n, SECOND)
            found.append((instance, n, (m + min(top, m * 100 // percent)) * (100 - percent) // (100 + percent), _places[instance, n]))
    return _bands[m, percent]


#: By place of a subset of two of three parts: its parts.
ONE, OTHER = np.array([0, 0, 1]), np.array([1, 2, 2])
_places: dict[tuple[int, int], np.ndarray] = {}


def signatures(s: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Hashes and kinds of a set's signatures, and how many first-level parts (own instance, next one) or elements (likewise) it can spare.

    The lowest bit of a kind is its instance's parity, the next one tells single elements.
    """
    m = len(s)
    high, elements = s >> np.uint64(32), mixed(s)
    found, kinds, spare, spare_single = [], [], [], []
    for instance, n, most, places in scheme(m, percent):
        part = (high * np.uint64(SECOND * n) >> np.uint64(32)).astype(np.int64)  # rises with the sorted hashes
        starts = np.flatnonzero(np.diff(part, prepend=-1))
        content = np.zeros(SECOND * n, np.uint64)
        content[part[starts]] = mixed(np.add.reduceat(elements, starts))
        content = content.reshape(n, SECOND)  # an empty part has 0
        x, y = content[:, ONE], content[:, OTHER]
        own = mixed(x * np.uint64(0xD6E8FEB86659FD93) + y * np.uint64(0xA0761D6478BD642F) + places)
        empty = (x | y) == 0
        n_empty = int(empty.sum())
        found.append(own[~empty] if n_empty else own.ravel())
        kinds.append(np.full(len(found[-1]), instance & 1, np.uint64))
        spare.append(n - most // 2 - 1 - (int(empty.any(1).sum()) if n_empty else 0))
        spare_single.append(m - most - 1)
        if spare[-1] < 0:
            found.append(mixed(s + np.uint64(instance << 32)))
            kinds.append(np.full(m, 2 | instance & 1, np.uint64))
    if scheme(m, percent)[0][0] & 1:  # spare numbers by parity: even instance first
        spare.reverse()
        spare_single.reverse()
    return np.concatenate(found), np.concatenate(kinds), spare + spare_single


def packed(values: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted signatures, their ids and, where it is not 1, the number of ids each stands for, as the bytes that differ."""
    steps = np.diff(values, prepend=values[:1]).astype(np.uint64)
    low = int(ids.min())
    many = np.flatnonzero(counts > 1).astype(np.uint32)
    out = [np.array([len(values), len(many), values[0], low], np.int64).tobytes()]
    for column in (steps, (ids - low).astype(np.uint64)):
        width = max(1, (int(column.max()).bit_length() + 7) // 8)
        out += [bytes([width]), column.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()]
    return b"".join([*out, many.tobytes(), counts[many].astype(np.uint32).tobytes()])


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, n_many, first, low = np.frombuffer(data, np.int64, 4).tolist()
    at, columns = 32, []
    for _ in range(2):
        width = data[at]
        column = np.zeros((n, 8), np.uint8)
        column[:, :width] = np.frombuffer(data, np.uint8, n * width, at + 1).reshape(width, n).T
        columns.append(column.view(np.int64)[:, 0])
        at += 1 + n * width
    counts = np.ones(n, np.int64)
    counts[np.frombuffer(data, np.uint32, n_many, at)] = np.frombuffer(data, np.uint32, n_many, at + 4 * n_many)
    return columns[0].cumsum() + first, columns[1] + low, counts


def runs_of(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal sorted values begin, and their lengths."""
    starts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
    return starts, np.diff(np.concatenate([starts, [len(values)]]))


def sign(texts: DataFrame, words: int, percent: int, buckets: int, bits: int) -> DataFrame:
    """Rows by ``bucket`` and ``kind``: 0 packs of signatures, 1 the ids (``data``) of one signature, 2 a text's note of its set size and spare numbers.

    A signature is ``bits`` bits of a hash and two bits of kind.
    """

    def bucket_of(values: np.ndarray) -> np.ndarray:
        return (values >> 2 >> max(0, bits - 30)) * buckets >> min(bits, 30)

    def flush(values: np.ndarray, ids: np.ndarray) -> Iterator[tuple]:
        order = np.argsort(values, kind="stable")
        values, ids = values[order], ids[order]
        counts, keep = np.ones(len(values), np.int64), np.ones(len(values), bool)
        starts, sizes = runs_of(values)
        for at, n in zip(starts[sizes > GROUP].tolist(), sizes[sizes > GROUP].tolist()):
            own = np.unique(ids[at : at + n])
            if len(own) > GROUP:
                yield int(bucket_of(values[at : at + 1])[0]), 1, int(values[at]), own.tobytes(), None, None
                ids[at], counts[at], keep[at + 1 : at + n] = own[0], len(own), False
        values, ids, counts = values[keep], ids[keep], counts[keep]
        for own in np.split(np.arange(len(values)), runs_of(bucket_of(values))[0][1:]):
            if len(own):
                yield int(bucket_of(values[own[:1]])[0]), 0, None, packed(values[own], ids[own], counts[own]), None, None

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], ["bucket", "kind", "sig", "data", "id", "note"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, ids, held = [], [], 0
        for batch in batches:
            notes = []
            for i, t, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                s = shingle_set(text.as_py(), words)
                note = [len(s), 0, 0, 0, 0]
                if len(s) and i is not None:
                    found, kinds, note[1:] = signatures(s, percent)
                    values.append((found >> np.uint64(64 - bits) << np.uint64(2) | kinds).view(np.int64))
                    ids.append(np.full(len(found), i, np.int64))
                    held += len(found)
                notes.append((xxhash.xxh3_64_intdigest(t) % buckets, 2, None, None, i, f"{t}|{'|'.join(map(str, note))}"))
                if held >= FLUSH:
                    yield batch_of(list(flush(np.concatenate(values), np.concatenate(ids))))
                    values, ids, held = [], [], 0
            if notes:
                yield batch_of(notes)
        if held:
            yield batch_of(list(flush(np.concatenate(values), np.concatenate(ids))))
        values, ids = [], []
        give_back()

    return texts.select("id", "t", "text").mapInArrow(run, "bucket int, kind int, sig long, data binary, id long, note string")


def shared_signatures(signed: DataFrame, hot: int, parts: int) -> DataFrame:
    """``sig, ids, pivot, hot`` of signatures that two or more ids have, ``pivot`` being the smallest of these, and ``id, note`` of all notes.

    Rows arrive by bucket: its packs, of about ``BUCKET`` signatures in all, are held
    together; the ids of frequent signatures and the notes stream by.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["sig", "ids", "pivot", "hot", "id", "note"]

        def out(sig, sizes, ids, pivot, is_hot) -> pa.RecordBatch:
            n, offsets = len(sig), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids, pa.int64()))
            return pa.RecordBatch.from_arrays([pa.array(sig, pa.int64()), lists, pa.array(pivot, pa.int64()), pa.array(is_hot, pa.bool_()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.string())], names)

        packs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        frequent: dict[int, tuple[int, bool]] = {}
        bucket = None

        def close() -> Iterator[pa.RecordBatch]:
            """What the packs of a bucket share; of signatures whose ids follow, pivot and heat are kept."""
            if not packs:
                return
            values, ids, counts = (np.concatenate(c) for c in zip(*packs))
            packs.clear()
            order = np.lexsort((-counts, ids, values))
            values, ids, counts = values[order], ids[order], counts[order]
            new = np.concatenate([[True], (values[1:] != values[:-1]) | (ids[1:] != ids[:-1]) | (counts[1:] > 1)])
            values, ids, counts = values[new], ids[new], counts[new]
            starts, sizes = runs_of(values)
            total = np.add.reduceat(counts, starts)
            grouped = np.maximum.reduceat(counts, starts) > 1
            for at in np.flatnonzero(grouped).tolist():
                frequent[int(values[starts[at]])] = (int(ids[starts[at]]), bool(total[at] > hot))
            many = np.repeat(total > 1, sizes) & (counts == 1)
            if many.any():
                left = np.add.reduceat(many.astype(np.int64), starts)
                some = left > 0
                yield out(values[starts[some]], left[some], ids[many], ids[starts[some]], total[some] > hot)

        for batch in batches:
            kinds = batch.column(1).to_numpy()
            noted = batch.filter(pa.array(kinds == 2))
            n = noted.num_rows
            if n:
                yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.int64()), pa.nulls(n, pa.bool_()), noted.column(4), noted.column(5)], names)
            groups: list[tuple[int, np.ndarray, int, bool]] = []
            for at in np.flatnonzero(kinds < 2).tolist():
                if (own := batch.column(0)[at].as_py()) != bucket:
                    yield from close()
                    frequent.clear()
                    bucket = own
                data = batch.column(3)[at].as_py()
                if kinds[at] == 0:
                    packs.append(unpacked(data))
                else:
                    yield from close()
                    sig = batch.column(2)[at].as_py()
                    groups.append((sig, np.frombuffer(data, np.int64), *frequent[sig]))
            if groups:
                sig, ids, pivot, is_hot = zip(*groups)
                yield out(sig, [len(i) for i in ids], np.concatenate(ids), pivot, is_hot)
        yield from close()
        give_back()

    dealt = signed.repartition(parts, "bucket") if parts else signed.repartition("bucket")
    return dealt.sortWithinPartitions("bucket", "kind").mapInArrow(run, "sig long, ids array<long>, pivot long, hot boolean, id long, note string")


def sets_of(texts: DataFrame, wanted: DataFrame, words: int, most: int = 500_000) -> DataFrame:
    """``(id, members)``: the n-gram sets, as bytes, of the texts whose id is wanted."""
    ids = wanted.select("id").distinct()
    if ids.count() <= most:
        ids = F.broadcast(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(text.as_py(), words).tobytes() for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["id", "members"])

    return texts.join(ids, "id", "left_semi").select("id", "text").mapInArrow(run, "id long, members binary")


def linked(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Those pairs ``(a, b)`` whose sets are similar enough, counted exactly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                common = len(x) + len(y) - len(np.union1d(x, y))
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    sets = materialize(sets_of(texts, pairs.select(F.explode(F.array("a", "b")).alias("id")), words), "sets")
    left, right = sets.select(F.col("id").alias("a"), F.col("members").alias("x")), sets.select(F.col("id").alias("b"), F.col("members").alias("y"))
    met = join_hot(join_hot(pairs.select("a", "b"), left, "a", hot_keys(pairs, "a")), right, "b", hot_keys(pairs, "b"))
    return met.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def components_of_few(edges: DataFrame) -> DataFrame:
    """``(id, component)`` by union and find in one task; the caller has counted the edges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = x = parent.setdefault(parent[x], parent[x])
            return x

        for batch in batches:
            for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                u, v = root(u), root(v)
                parent[max(u, v)] = min(u, v)
        ids = sorted(parent)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([root(i) for i in ids], pa.int64())], ["id", "component"])

    return edges.coalesce(1).mapInArrow(run, "id long, component long")


def smallest_reachable(edges: DataFrame, few: int = FEW_EDGES) -> DataFrame:
    """``(id, component)`` of every id in the edges ``(a, b)``: the smallest id of its connected component.

    Up to ``few`` edges, counted before, go to one task. More take alternating large-star
    and small-star steps; each needs one aggregation and one join, and no group meets in one task.
    """
    now = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    if now.count() <= few:
        return materialize(components_of_few(now), "components")
    state = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        hot = hot_keys(both, "u")
        large = join_hot(both.where("v > u"), low, "u", hot).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        now = materialize(small.where("u <> v").distinct(), "edges")
        new = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if new == state:
            return now.select(F.col("u").alias("id"), F.col("v").alias("component"))
        state = new


def dense_groups(hot_rows: DataFrame, asked: DataFrame) -> DataFrame:
    """``(id, dense)``: ids that are short of signatures outside hot ones, by groups that share hot signatures.

    Ids whose signature's pivot is short too meet in the pivot; those of other signatures in the smallest of them.
    """
    short = asked.where("short").select("id", "kind")
    pivots = short.withColumnRenamed("id", "pivot")
    met = hot_rows.select("id", "kind", "pivot").distinct().join(short, ["id", "kind"], "left_semi").join(pivots, ["pivot", "kind"], "left_semi")
    rows = hot_rows.join(pivots, ["pivot", "kind"], "left_anti").join(short, ["id", "kind"], "left_semi")
    rows = materialize(rows.select("sig", "id"), "short")
    first = rows.groupBy("sig").agg(F.min("id").alias("b"))
    meet = join_hot(rows, first, "sig", hot_keys(rows, "sig")).select(F.col("id").alias("a"), "b")
    return smallest_reachable(meet.unionByName(met.select(F.col("id").alias("a"), F.col("pivot").alias("b"))).where("a <> b").distinct()).withColumnRenamed("component", "dense")


def dense_links(dense: DataFrame, texts: DataFrame, words: int, percent: int, block: int = BLOCK) -> DataFrame:
    """Links ``(a, b)`` within groups ``(id, dense, n)`` that connect what all links of a group connect.

    A group is cut into blocks by a hash of the id; each pair of blocks is one task of
    bounded size, which counts all overlaps by matrix products and returns a spanning
    forest of its links, so that no pair is ever a row.
    """
    sets = sets_of(texts, dense, words)
    sizes = dense.groupBy("dense").agg(F.count("*").alias("c"), F.sum("n").alias("n"))
    blocks = sizes.select("dense", F.ceil(F.greatest(F.col("c") / block, F.col("n") / BLOCK_ELEMENTS)).cast("int").alias("blocks"))
    rows = dense.join(blocks, "dense").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).join(sets, "id")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    rows = rows.select("dense", "id", "own", "members", other).select("dense", "id", "members", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def compare(table: pa.Table) -> pa.Table:
        ids = table["id"].to_numpy()
        order = np.argsort(ids)
        ids = ids[order]
        sets = [np.frombuffer(table["members"][int(k)].as_buffer(), np.uint64) for k in order]
        sizes = np.array([len(s) for s in sets])
        who, (elements, place, n) = np.repeat(np.arange(len(sets)), sizes), np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        often = np.full(len(elements), -1)
        often[n > 1] = np.arange(int((n > 1).sum()))
        column, held = often[place], often[place] >= 0
        column, who = column[held], who[held]
        overlap = np.zeros((len(sets), len(sets)), np.float32)
        for start in range(0, int((n > 1).sum()), COLUMNS):
            now = (column >= start) & (column < start + COLUMNS)
            m = np.zeros((len(sets), COLUMNS), np.float32)
            m[who[now], column[now] - start] = 1
            overlap += m @ m.T
        alike = np.triu(100 * overlap >= percent * (sizes[:, None] + sizes[None, :] - overlap), 1)
        parent, out = list(range(len(sets))), []

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for x, y in zip(*map(np.ndarray.tolist, np.nonzero(alike))):
            rx, ry = root(x), root(y)
            if rx != ry:
                parent[max(rx, ry)] = min(rx, ry)
                out.append((int(ids[x]), int(ids[y])))
        return pa.table({"a": pa.array([o[0] for o in out], pa.int64()), "b": pa.array([o[1] for o in out], pa.int64())})

    return rows.groupBy("dense", "i", "j").applyInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT, hot: int = HOT) -> DataFrame:
    """One row per input row: ``id_col, n_shingles, component_id``.

    ``component_id`` is the smallest id that links reach. Null, empty and blank texts have
    an empty set and their own id; fewer than ``words`` words make one n-gram; equal texts
    always share a component (unless blank). Rows without an id have a size but no
    component. Repeated rows stay repeated; an empty table gives an empty result; only
    the two columns named are read, so other columns cannot clash.
    """
    spark = docs.sparkSession
    small_batches(spark)
    text_key = F.coalesce(F.sha2(text_col, 256), F.lit("null"))
    rows = materialize(docs.select(F.col(id_col).cast("long").alias("id"), text_key.alias("t"), F.octet_length(text_col).alias("size")), "keys")
    first = rows.groupBy("t").agg(F.min("id").alias("rep"))
    hot_texts = hot_keys(rows, "t")
    copies = join_hot(rows, first, "t", hot_texts).where("id <> rep").select("id", "t").distinct()
    texts = docs.select(F.col(id_col).cast("long").alias("id"), text_key.alias("t"), F.coalesce(text_col, F.lit("")).alias("text"))
    texts = anti_by_id(texts, copies, ["id", "t"])
    expected = max(1_000, (rows.agg(F.sum("size")).first()[0] or 0) // 4)  # about 1.3 signatures a word
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(16 * tasks, -(-expected // BUCKET))
    signed = sign(texts, words, percent, buckets, min(60, expected.bit_length() + SPARE_BITS))
    found = materialize(shared_signatures(signed, hot, buckets // 16 if buckets > 16 * tasks else 0), "shared")
    part = F.split("note", r"\|")
    notes = found.where("note is not null").select("id", part[0].alias("t"), *[part[k + 1].cast("long").alias(c) for k, c in enumerate(("n", "even", "odd", "even1", "odd1"))])
    shared = found.where("note is null").select("sig", F.explode("ids").alias("id"), "pivot", "hot")

    # per id and kind of signature: how many it must share, outside hot ones, with any partner
    kind = F.col("sig").bitwiseAND(3)
    sizes = notes.where("n > 0 and id is not null").groupBy("id").agg(*[F.min(c).alias(c) for c in ("n", "even", "odd", "even1", "odd1")])
    heat = shared.groupBy("id", kind.alias("kind")).agg(F.count_if("hot").alias("n_hot"))
    spare = F.element_at(F.array("even", "odd", "even1", "odd1"), (F.col("kind") + 1).cast("int")) - F.col("n_hot")
    asked = materialize(heat.join(sizes, "id").select("id", "kind", "n", (F.greatest(spare, F.lit(0)) + 1).alias("need"), (spare < 0).alias("short")), "needs")

    # first the groups' smallest ids, where enough signatures speak for them
    votes = shared.where("id <> pivot").groupBy("id", "pivot").count()
    best = votes.groupBy("id").agg(F.max(F.struct("count", (-F.col("pivot")).alias("p"))).alias("m"))
    best = best.join(sizes, "id").where(F.col("m.count") * 8 >= F.col("n")).select(F.col("id").alias("a"), (-F.col("m.p")).alias("b"))
    edges = materialize(linked(best, texts, words, percent), "links")

    # sets that may meet in hot signatures only: groups of these are compared within, block by block
    dense = materialize(dense_groups(shared.where("hot").withColumn("kind", kind), asked), "dense")
    within = materialize(dense_links(dense.join(sizes.select("id", "n"), "id"), texts, words, percent), "dense-links")
    edges = materialize(edges.unionByName(within), "links")
    parts = smallest_reachable(edges)

    # then pairs of different components that share as many cold signatures as a linked pair must
    placed = shared.where("not hot").join(parts, "id", "left").withColumn("c", F.coalesce("component", "id")).select("sig", "id", "c")
    open_sigs = placed.groupBy("sig").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("sig")
    placed = placed.join(open_sigs, "sig", "left_semi").withColumn("kind", kind).join(asked, ["id", "kind"]).join(dense, "id", "left")
    left = materialize(placed.select("sig", "kind", "id", "c", "n", "need", F.coalesce("dense", -1 - F.col("id")).alias("g")), "open")
    a, b = (left.select("sig", "kind", F.col("id").alias(i), *[F.col(c).alias(f"{c}_{i}") for c in ("c", "n", "need", "g")]) for i in ("a", "b"))
    fits = (F.col("c_a") < F.col("c_b")) & (F.col("g_a") != F.col("g_b")) & (100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    counted = a.join(b.drop("kind"), "sig").where(fits).groupBy("a", "b", "kind").agg(F.count("*").alias("n"), F.max(F.greatest("need_a", "need_b")).alias("need"))
    pairs = materialize(counted.where("n >= need").select("a", "b").distinct(), "pairs")
    more = linked(pairs, texts, words, percent)
    parts = smallest_reachable(edges.unionByName(more))

    classes = first.join(notes.select("id", "t", "n").distinct(), (first["rep"].eqNullSafe(notes["id"])) & (first["t"] == notes["t"])).select(first["t"], "rep", "n")
    classes = classes.join(parts.withColumnRenamed("id", "rep"), "rep", "left").select("t", "rep", "n", "component")
    own = F.when(F.col("n") == 0, F.col("id")).when(F.col("id").isNull(), F.lit(None)).otherwise(F.coalesce("component", "rep"))
    classes = materialize(classes, "classes")
    return join_hot(rows, classes, "t", hot_texts).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), own.cast("long").alias("component_id"))
