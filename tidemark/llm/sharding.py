"""Contiguous sharding with the least possible largest shard.

Documents with equal texts form atomic groups, ordered by a hash of the text. The
smallest capacity that a given number of contiguous shards needs is found by binary
search; a capacity is feasible if filling shard after shard greedily fits. The search
needs prefix sums only where a cut may fall: sums over hash ranges reach the driver,
and the few ranges around the possible cuts are split further until each holds a
single group there. Their number is bounded whatever the number of groups.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import materialize, running_base

#: First split of the hash range in bits, further splits, and rows that are numbered together.
FIRST_BITS, NEXT_BITS, CELL_ROWS = 12, 8, 2_000


def greedy(prefix: list[int], shards: int, capacity: int) -> list[int] | None:
    """Indexes where shards end if each takes as many of the ordered sizes as fit, or None if some remain."""
    ends, at = [], 0
    for _ in range(shards):
        end = bisect_right(prefix, (prefix[at - 1] if at else 0) + capacity)
        ends.append(end)
        at = end
    return ends if at == len(prefix) else None


def least_capacity(sizes: list[int], shards: int) -> int:
    """Binary search for the smallest capacity that is feasible for the ordered sizes."""
    prefix = list(accumulate(sizes))
    if not prefix:
        return 0
    low, high = max(-(-prefix[-1] // shards), max(sizes)), prefix[-1]
    while low < high:
        middle = (low + high) // 2
        if greedy(prefix, shards, middle) is None:
            low = middle + 1
        else:
            high = middle
    return low


def cuts(groups: DataFrame, shards: int) -> list[int]:
    """Hashes at which shards 1, 2, ... begin; ``groups`` has one row ``(o, bytes)`` per atomic group."""

    def split(ranges: list[tuple[int, int]], bits: int) -> list[tuple[int, int, int, bool]]:
        """Sums of the groups in the given ranges ``(first, shift)`` of hashes, by their next ``bits``."""
        out = []
        for shift in sorted({s for _, s in ranges}):
            own = [lo for lo, s in ranges if s == shift]
            rows = groups if shift >= 64 else groups.where(F.shiftright("o", shift).isin([lo >> shift for lo in own]))
            by = rows.groupBy(F.shiftright("o", max(0, shift - bits)).alias("k"))
            out += [(r.k << max(0, shift - bits), max(0, shift - bits), r.bytes, r.n == 1) for r in by.agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n")).collect()]
        return out

    parts = sorted(split([(0, 64)], FIRST_BITS))
    while parts:
        sizes = [p[2] for p in parts]
        prefix = list(accumulate(sizes))
        high = least_capacity(sizes, shards)
        low = max(-(-prefix[-1] // shards), max((p[2] for p in parts if p[3]), default=0))
        early, late, open_parts = 0, 0, set()
        for _ in range(shards):  # between which parts the cut falls at any capacity from low to high
            first = bisect_right(prefix, early + low)
            last = min(bisect_right(prefix, late + high), len(parts) - 1)
            open_parts |= {k for k in range(first, last + 1) if not parts[k][3] and parts[k][1] > 0}
            early = prefix[first - 1] if first else 0
            late = min(late + high, prefix[last])
        if not open_parts:
            ends = greedy(prefix, shards, high)
            return [parts[e][0] if e < len(parts) else 2**63 for e in ends[:-1]]
        finer = split([(parts[k][0], parts[k][1]) for k in open_parts], NEXT_BITS)
        parts = sorted([p for k, p in enumerate(parts) if k not in open_parts] + finer)
    return [2**63] * (shards - 1)


def shard_documents(docs: DataFrame, shards: int = 8, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Assign each row a shard and a gapless slot within it.

    Returns ``id_col, size, text_crc32, shard, slot``. ``size`` is the text's UTF-8 bytes
    plus 1; a null text has 1 and checksum 0, and null texts form one group. Equal texts,
    and so repeated rows, share a shard; an empty table gives an empty result. Shards are
    as even as whole groups allow. Slots go by a hash of id and text, then the id.
    """
    o = F.xxhash64(F.coalesce(F.sha2(text_col, 256), F.lit("null")))
    rows = docs.select(
        id_col,
        (F.coalesce(F.octet_length(text_col), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text_col, F.lit(""))).alias("text_crc32"),
        o.alias("o"),
    )
    rows = materialize(rows, "sizes")
    groups = materialize(rows.groupBy("o").agg(F.sum("size").alias("bytes")), "groups")
    starts = cuts(groups, shards)
    shard = sum((F.when(F.col("o") >= s, 1).otherwise(0) if s < 2**63 else F.lit(0) for s in starts), F.lit(0))
    cells = max(1, rows.count() // CELL_ROWS)
    rows = rows.withColumn("shard", shard.cast("int")).withColumn("cell", F.pmod(F.xxhash64(F.col(id_col).cast("string"), "o", F.lit("slot")), F.lit(cells)))
    base = running_base(rows, ["shard"], "cell", F.lit(1), "base")
    inside = Window.partitionBy("shard", "cell").orderBy(id_col, "o")
    numbered = rows.withColumn("r", F.row_number().over(inside)).join(base, ["shard", "cell"])
    return numbered.select(id_col, "size", "text_crc32", "shard", (F.col("base") + F.col("r") - 1).alias("slot"))
