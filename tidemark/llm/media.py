"""Media columns: content-addressed payloads in tar shards.

Payloads become 8-bit greyscale PNG images, 576 samples to a row. Each distinct payload
is stored once, under its digest, in a tar archive of bounded size in the shared folder;
a lost executor's archives are simply made again. Rows carry digest, archive, offset and
length. Metadata columns come from reading only the range of each member's header.

Workers write and read archives with Arrow's file systems, which take local folders,
HDFS and the usual object stores by their address.
"""

from __future__ import annotations

import hashlib
import re
import struct
import tarfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import anti_by_id, hot_keys, join_hot, materialize, shared_folder, small_batches

ROW, SHARD_BYTES, LEVEL, HEADER = 576, 4 << 20, 3, 33
KINDS = {"integer": pa.int32(), "long": pa.int64(), "string": pa.string()}


def payload_of(text: Column) -> Column:
    """The text in UTF-8 with bytes 255 appended up to a positive multiple of 576; null counts as empty."""
    raw = F.encode(F.coalesce(text, F.lit("")), "UTF-8")
    n = F.octet_length(raw)
    return F.concat(raw, F.unhex(F.repeat(F.lit("FF"), (F.greatest(F.ceil(n / ROW), F.lit(1)) * ROW - n).cast("int"))))


def to_png(payload: bytes) -> bytes:
    samples = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    rows = np.concatenate([np.zeros((len(samples), 1), np.uint8), samples], 1)

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = struct.pack(">IIBBBBB", ROW, len(samples), 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes(), LEVEL)) + chunk(b"IEND", b"")


def from_png(image: bytes) -> np.ndarray:
    """The samples of an image that :func:`to_png` made, one array row per image row; checksums are verified."""
    at, data, width = 8, [], 0
    while at < len(image):
        (n,), kind = struct.unpack(">I", image[at : at + 4]), image[at + 4 : at + 8]
        body = image[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack(">I", image[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("a damaged image")
        if kind == b"IHDR":
            width = struct.unpack(">I", body[:4])[0]
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    return np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(-1, width + 1)[:, 1:]


def feature_of(samples: np.ndarray) -> str:
    """Mean, deviation, entropy in bits and share of padding of the samples, in a fixed format."""
    n = np.bincount(samples.ravel(), minlength=256)
    p = n / n.sum()
    mean = float((p * np.arange(256)).sum())
    deviation = float(np.sqrt((p * (np.arange(256) - mean) ** 2).sum()))
    bits = float(-(p[p > 0] * np.log2(p[p > 0])).sum())
    return f"mean={mean:.4f};deviation={deviation:.4f};entropy={bits:.4f};padding={p[255]:.4f}"


def file_in(folder: str, name: str):
    """A file system that reads and writes ranges, and the path in it of a file in the shared folder."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", folder))
    return system, f"{path}/{name}"


def put(folder: str, name: str, content: bytes) -> None:
    """Write a file named by its content: under another name first, so that a half-written one is never seen."""
    system, path = file_in(folder, name)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}"
    with system.open_output_stream(part) as out:
        out.write(content)
    system.move(part, path)


def pack(payloads: DataFrame, folder: str) -> DataFrame:
    """Write tar archives of ``(digest, payload)`` rows to the folder, each closed at about 4 MiB and named by its digest.

    Returns ``digest, shard, offset, length`` of every member. An archive of a task that
    failed stays behind unused; whoever runs again writes its own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[bytes] = []
        members: list[tuple[str, int, int]] = []
        size = 0

        def close() -> pa.RecordBatch:
            tar = b"".join([*parts, bytes(1024)])
            shard = hashlib.sha256(tar).hexdigest()
            put(folder, f"{shard}.tar", tar)
            digests, offsets, lengths = zip(*members)
            return pa.RecordBatch.from_arrays([pa.array(digests), pa.array([shard] * len(members)), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())], ["digest", "shard", "offset", "length"])

        for batch in batches:
            for digest, payload in zip(batch.column(0), batch.column(1)):
                image = to_png(payload.as_py())
                info = tarfile.TarInfo(f"{digest.as_py()}.png")
                info.size = len(image)
                parts += [info.tobuf(tarfile.USTAR_FORMAT), image, bytes(-len(image) % 512)]
                members.append((digest.as_py(), size + 512, len(image)))
                size += 512 + len(image) + -len(image) % 512
                if size >= SHARD_BYTES:
                    yield close()
                    parts, members, size = [], [], 0
        if members:
            yield close()

    return payloads.select("digest", "payload").mapInArrow(run, "digest string, shard string, offset long, length long")


class Ranges:
    """Reads ranges of the folder's archives, one archive open at a time, and counts the bytes."""

    def __init__(self, folder: str):
        self.folder, self.shard, self.file, self.bytes = folder, None, None, 0

    def read(self, shard: str, offset: int, length: int) -> bytes:
        if shard != self.shard:
            self.close()
            system, path = file_in(self.folder, f"{shard}.tar")
            self.shard, self.file = shard, system.open_input_file(path)
        got = self.file.read_at(length, offset)
        self.bytes += len(got)
        return got

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
        self.shard = self.file = None


def appended(members: DataFrame, folder: str, length: Callable[[int], int], of: Callable[[bytes], tuple], schema: str) -> DataFrame:
    """``members`` with the columns of ``schema``, made from a range at the start of each member."""
    added = T.StructType.fromDDL(schema)
    own = [members.columns.index(c) for c in ("shard", "offset", "length")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges = Ranges(folder)
        try:
            for batch in batches:
                rows = [of(ranges.read(shard, at, length(n))) for shard, at, n in zip(*(batch.column(k).to_pylist() for k in own))]
                cols = [pa.array([r[k] for r in rows], KINDS[f.dataType.typeName()]) for k, f in enumerate(added)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *cols], [*batch.schema.names, *added.names])
        finally:
            ranges.close()

    return members.mapInArrow(run, T.StructType([*members.schema.fields, *added.fields]))


def header_of(start: bytes) -> tuple[int, int, int]:
    return struct.unpack(">IIB", start[16:25])


def header_columns(members: DataFrame, folder: str) -> DataFrame:
    """Append ``width, height, bits`` of every member, by reading its first 33 bytes only."""
    return appended(members, folder, lambda n: HEADER, header_of, "width int, height int, bits int")


def content_of(image: bytes) -> tuple:
    samples = from_png(image)
    payload = samples.tobytes()
    return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(image), hashlib.sha256(image).hexdigest(), feature_of(samples)


def read_back(members: DataFrame, folder: str) -> DataFrame:
    """Append what the stored bytes of every member give: payload size and digest, checksum of its last 32 bytes, media size and digest, feature."""
    return appended(members, folder, lambda n: n, content_of, "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def distinct_payloads(docs: DataFrame, rows: DataFrame, hot: list, id_col: str, text_col: str) -> DataFrame:
    """``digest, payload`` once for each digest in ``rows``.

    Copies are told by narrow rows, so texts move only where copies are more than may be
    broadcast, or where rows of the same id repeat a text.
    """
    first = rows.groupBy("digest").agg(F.min("k").alias("rep"), F.count("*").alias("n"))
    first = materialize(first.where("n > 1"), "repeated")
    copies = join_hot(rows, first, "digest", hot).where("k <> rep").select("digest", "k").distinct()
    full = docs.select(id_key(id_col).alias("k"), F.col(text_col).alias("text"), F.sha2(payload_of(F.col(text_col)), 256).alias("digest"))
    full = anti_by_id(full, copies, ["digest", "k"], 200_000)
    again = rows.groupBy("digest", "k").count().where("count > 1").join(first, "digest").where("k = rep").select("digest")
    again = materialize(again, "repeated-ids")
    if again.isEmpty():
        single = full
    else:
        few = full.join(again, "digest", "left_semi").groupBy("digest").agg(F.first("text").alias("text"))
        single = anti_by_id(full, again, ["digest"], 200_000).select("digest", "text").unionByName(few)
    return single.select("digest", payload_of(F.col("text")).alias("payload"))


def id_key(id_col: str) -> Column:
    """The id as text, with a null apart from every id."""
    return F.when(F.col(id_col).isNull(), "-").otherwise(F.concat(F.lit("+"), F.col(id_col).cast("string")))


def media_columns(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> DataFrame:
    """Store every text as an image and return what its stored form tells.

    One row per input row: ``id_col, n_bytes``, the columns of :func:`read_back` and
    :func:`header_columns`, and ``shard, offset, length`` of the stored member in
    ``folder`` (a new one in the shared folder by default). Null and empty texts share one
    payload of 576 bytes 255; equal texts share one member, whether their ids are equal,
    null or not; repeated rows stay repeated; an empty table gives an empty result; other
    columns are not read.
    """
    small_batches(docs.sparkSession)
    folder = folder or f"{shared_folder(docs.sparkSession)}/media-{uuid.uuid4().hex}"
    size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long")
    rows = docs.select(F.col(id_col).alias("id"), id_key(id_col).alias("k"), size.alias("n_bytes"), F.sha2(payload_of(F.col(text_col)), 256).alias("digest"))
    rows = materialize(rows, "digests")
    hot = hot_keys(rows, "digest")
    members = materialize(pack(distinct_payloads(docs, rows, hot, id_col, text_col), folder), "members")
    stored = materialize(read_back(header_columns(members, folder), folder), "stored")
    return join_hot(rows, stored, "digest", hot).select(F.col("id").alias(id_col), "n_bytes", *stored.columns)
