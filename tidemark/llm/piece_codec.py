"""SentencePiece encoding and decoding with a prefix table.

Merge-type (BPE) models have a useful property: whether token ``b`` can follow
token ``a`` depends on the two alone, and every prefix of a text has exactly one
token that ends its encoding. The encoder walks once over a text. An automaton
reports the pieces that end at each position; the piece whose predecessor (the
unique last token of the prefix before it) is compatible with it becomes that
prefix's last token. The ids are then read backwards from the last prefix.

Pieces never hold a space mark after another character in the models this was
made for, so a text falls into independent stretches at such places; the
encoder checks the model for this and keeps the ids of frequent stretches. A
stretch that ends in a few signs continues the kept result of the prefix before them.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidemark.llm.common import give_back

SPACE = "▁"
#: Entries kept per worker: of stretches in the newer and the older of two tables, and of pair tests.
STRETCHES, PAIRS = 80_000, 200_000
#: Stands for the text's start in pair tests: any piece may follow it.
START = 0xFFFFF
#: Signs at the end of a stretch that may continue kept ids; more of them are encoded with the stretch.
TAIL = 3


class PairTable(dict):
    """Pair tests by ``a << 20 | b``, made when first asked for."""

    def __init__(self, test):
        self.test = test

    def __missing__(self, key: int) -> bool:
        if len(self) >= PAIRS:
            self.clear()
        self[key] = found = key >> 20 == START or self.test(key >> 20, key & 0xFFFFF)
        return found


class PieceCodec:
    """Encoder for one model file; decoding is the library's own."""

    def __init__(self, model_file: str):
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.sp = sp
        self.decode = sp.decode
        self.end = sp.eos_id()
        self.pieces = sp.id_to_piece(list(range(sp.vocab_size())))
        normal = [i for i in range(sp.vocab_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.ids = {self.pieces[i]: i for i in normal}
        self.joinable = frozenset(self.ids.values())
        self.score = {self.pieces[i]: sp.get_score(i) for i in normal}
        self.bytes = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.matcher = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            if self.merged(piece) == [piece]:  # else no text is ever encoded with it
                self.matcher.add_word(piece, (len(piece), i))
        self.matcher.make_automaton()
        held = self.held = {c for piece in self.ids for c in piece}
        self.alone = re.compile("([^" + "".join(map(re.escape, sorted(held))) + "]+)").split
        cut = "".join(re.escape(c) for c in "\n\t" if c not in held)
        apart = all(SPACE not in piece.lstrip(SPACE) for piece in self.ids)
        stretch = f"{SPACE}*[^{SPACE}{cut}]+|{SPACE}+" + (f"|[{cut}]" if cut else "")
        self.stretches = re.compile(stretch).findall if apart else lambda text: [text]
        self.pairs = PairTable(self.compatible)
        self.decimals = [str(i) for i in range(len(self.pieces))]
        self.sizes = [len(p) for p in self.pieces]
        self.known: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    def merged(self, text: str) -> list[str]:
        """The merges as they are defined: best score first, of equal ones the leftmost."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, a: int, b: int) -> bool:
        """Whether ``b`` directly after ``a`` survives the merges across their border."""
        x, y = self.pieces[a], self.pieces[b]
        return self.merged(x + y) == [x, y]

    def prefix_table(self, text: str) -> list[int]:
        """For each place in a text, all of whose characters are pieces, the id of the last token of the prefix that ends there; then ``START``.

        The place before the first is the list's last, as Python counts.
        """
        last = [-1] * len(text)
        last.append(START)
        pairs = self.pairs
        for at, (size, i) in self.matcher.iter(text):
            if last[at] < 0 and pairs[last[at - size] << 20 | i]:
                last[at] = i
        return last

    def encode_known(self, text: str) -> list[int]:
        """The ids of a text, all of whose characters are pieces."""
        last, out, at, sizes = self.prefix_table(text), [], len(text) - 1, self.sizes
        while at >= 0:
            i = last[at]
            if i < 0:
                raise ValueError("the model's merges leave a prefix without a last token")
            out.append(i)
            at -= sizes[i]
        out.reverse()
        return out

    def encode_stretch(self, text: str) -> list[int]:
        if self.held.issuperset(text):
            return self.encode_known(text)
        out: list[int] = []
        for k, part in enumerate(self.alone(text)):
            if k % 2:  # characters that no piece holds stand alone, as their bytes
                out += [self.bytes[b] for b in part.encode("utf-8", "replace")]
            elif part:
                out += self.encode_known(part)
        return out

    def look_up(self, text: str) -> tuple[int, ...]:
        """Ids of a stretch, from the tables where they have it.

        A stretch that ends in signs continues the kept ids of what stands before up to
        ``TAIL`` of them, as long as each sign is compatible with the token before it.
        """
        got = self.older.get(text)
        if got is None:
            for cut in range(len(text) - 1, max(0, len(text) - 1 - TAIL), -1):
                if text[cut].isalnum() or text[cut] not in self.ids:
                    break
                kept = self.known.get(text[:cut]) or self.older.get(text[:cut])
                if kept:
                    got = self.continued(kept, text[cut:])
                    break
            if got is None:
                got = tuple(self.encode_stretch(text))
        if len(text) <= 64:
            if len(self.known) >= STRETCHES:
                self.older, self.known = self.known, {}
            self.known[text] = got
        return got

    def continued(self, ids: tuple[int, ...], signs: str) -> tuple[int, ...] | None:
        """``ids`` and one id for each sign, or None where a sign would merge with what stands before it."""
        for sign in signs:
            one = self.ids[sign]
            if ids[-1] not in self.joinable or not self.pairs[ids[-1] << 20 | one]:
                return None
            ids = (*ids, one)
        return ids

    def encode(self, text: str) -> tuple[list[int], str]:
        """All ids with the end id, and the same as decimals joined by one space."""
        ids: list[int] = []
        if text:
            for s in self.stretches(SPACE + text.replace(" ", SPACE)):
                ids += self.known.get(s) or self.look_up(s)
        ids.append(self.end)
        return ids, " ".join(map(self.decimals.__getitem__, ids))


_codecs: dict[str, PieceCodec] = {}


def codec(model_file: str) -> PieceCodec:
    """One codec per model and worker process."""
    if model_file not in _codecs:
        _codecs[model_file] = PieceCodec(model_file)
    return _codecs[model_file]


def encode_decode(
    docs: DataFrame, model_file: str, *, id_col: str = "doc_id", text_col: str = "text", tokens: bool = False, digests: bool = True
) -> DataFrame:
    """Encode each text whole with an end id and decode the ids again.

    Returns one row per input row: ``id_col``, ``n_tokens``; with ``digests`` also
    ``ids_sha256`` and ``decoded_sha256``; with ``tokens`` also ``ids`` and ``decoded``.
    A null text counts as empty (one id, the end). Repeated rows give repeated rows,
    an empty table an empty result; other columns are not read. No row moves to
    another partition and no state outlives a task but two bounded tables.
    """
    fields = [docs.select(id_col).schema[0], T.StructField("n_tokens", T.LongType())]
    if digests:
        fields += [T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    if tokens:
        fields += [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_file)
        for batch in batches:
            n, ids_sha, text_sha, all_ids, texts = [], [], [], [], []
            for text in batch.column(1):
                ids, decimals = own.encode(text.as_py() or "")
                n.append(len(ids))
                back = own.decode(ids)
                if digests:
                    ids_sha.append(hashlib.sha256(decimals.encode()).hexdigest())
                    text_sha.append(hashlib.sha256(back.encode()).hexdigest())
                if tokens:
                    all_ids.append(ids)
                    texts.append(back)
            cols = [batch.column(0), pa.array(n, pa.int64())]
            if digests:
                cols += [pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            if tokens:
                cols += [pa.array(all_ids, pa.list_(pa.int32())), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, [f.name for f in fields])
        give_back()

    return docs.select(id_col, text_col).mapInArrow(run, T.StructType(fields))
