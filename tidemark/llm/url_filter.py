"""URL filtering with a bit-parallel wildcard automaton.

All glob rules together form one bit vector over several 64-bit words: a rule of m
elements has m + 1 bits, bit i meaning that i elements have matched. One step reads one
character of every URL of a batch: bits shift where the next element takes the character
and stay where a wildcard takes it. What is left after the last character tells which
rules fit, all at once.

Globs: ``?`` is any character, ``*`` any run without ``/``, ``**`` any run.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import no_clash

#: Cells of the character matrix of a batch: longer URLs go in smaller groups.
CELLS = 4_000_000


@dataclass(frozen=True)
class Rule:
    """``glob`` is matched against ``.host/path``; of the fitting rules the one with the highest rank decides."""

    name: str
    verdict: str
    glob: str
    rank: int


def host_rule(verdict: str, name: str) -> Rule:
    """A rule ``host/path`` for a host with all its subdomains and the paths that begin with its path; longer ones rank higher."""
    host, _, path = name.partition("/")
    return Rule(name, verdict, f"*.{_literal(host)}/{_literal(path)}**", 1_000 + len(name))


def _literal(text: str) -> str:
    return "".join("\\" + c if c in "*?\\" else c for c in text)


#: Rules for URLs that no rule of the caller fits: block what is hardly prose, allow the rest.
DEFAULTS = tuple(Rule(g, "block", g, 1) for g in ("**/login**", "**/wp-admin/**", "**/cart/**", "**.exe", "**.zip", "**.jpg", "**.png", "**/search/**"))


class Automaton:
    """The packed masks of a rule list, and their simulation over a batch of texts."""

    def __init__(self, globs: Sequence[str]):
        takes: list[str | None] = []  # per bit: the character that leads to it; "" for none, None for any
        stays: list[str] = []  # per bit: "" nothing, "*" or "**"
        self.ends: list[int] = []
        self.starts: list[int] = []
        for glob in globs:
            self.starts.append(len(takes))
            takes.append("")
            stays.append("")
            k = 0
            while k < len(glob):
                if glob[k] == "*":
                    run = len(glob) - len(glob[k:].lstrip("*")) - k
                    stays[-1] = "**" if run > 1 or stays[-1] == "**" else "*"
                    k += run
                    continue
                escaped = glob[k] == "\\" and k + 1 < len(glob)
                k += escaped
                takes.append(None if glob[k] == "?" and not escaped else glob[k])
                stays.append("")
                k += 1
            self.ends.append(len(takes) - 1)
        self.chars = sorted({c for c in takes if c} | {"/"})
        self.words = max(1, -(-len(takes) // 64))
        pack = lambda bits: np.array([sum(1 << b - 64 * w for b in bits if b // 64 == w) for w in range(self.words)], np.uint64)
        kinds = [*self.chars, None]  # the last kind is any other character
        self.step = np.stack([pack([b for b, c in enumerate(takes) if c is None or c and c == kind]) for kind in kinds])
        self.stay = np.stack([pack([b for b, s in enumerate(stays) if s == "**" or s == "*" and kind != "/"]) for kind in kinds])
        self.first = pack(self.starts)
        self.codes = np.array([ord(c) for c in self.chars], np.uint32)

    def kinds(self, text: str) -> np.ndarray:
        points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
        at = np.searchsorted(self.codes, points)
        return np.where(self.codes[np.minimum(at, len(self.codes) - 1)] == points, at, len(self.codes)).astype(np.uint8 if len(self.codes) < 255 else np.uint16)

    def run(self, texts: Sequence[str]) -> np.ndarray:
        """A row per text, a column per glob: whether it matches the whole text."""
        out = np.zeros((len(texts), len(self.ends)), bool)
        order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
        while order:
            size = max(1, min(len(order), CELLS // max(1, len(texts[order[0]]))))
            own, order = order[:size], order[size:]
            state = self._simulate([self.kinds(texts[i]) for i in own])
            for g, bit in enumerate(self.ends):
                out[own, g] = state[:, bit // 64] >> np.uint64(bit % 64) & np.uint64(1)
        return out

    def _simulate(self, rows: list[np.ndarray]) -> np.ndarray:
        """``rows`` by falling length, so that those still running are the first ones."""
        lengths = np.array([len(r) for r in rows])
        grid = np.full((len(rows), int(lengths[0])), len(self.codes), np.uint16)
        for i, r in enumerate(rows):
            grid[i, : len(r)] = r
        state = np.repeat(self.first[None], len(rows), 0)
        for k in range(grid.shape[1]):
            n = int(np.searchsorted(-lengths, -k, "left"))
            now, kind = state[:n], grid[:n, k]
            shifted = now << np.uint64(1)
            shifted[:, 1:] |= now[:, :-1] >> np.uint64(63)
            state[:n] = shifted & self.step[kind] | now & self.stay[kind]
        return state


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty without ``://``."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


UNRESERVED = re.compile("%(2[dDeE]|3[0-9]|4[1-9a-fA-F]|5[0-9aA]|5[fF]|6[1-9a-fA-F]|7[0-9aAeE])")


def canonical(host: str, path: str) -> str:
    """``.host/path`` without user, port and the host's trailing dots, in which no unreserved character is in percent form and no segment is ``.`` or ``..``.

    Hosts are in lower case A-Z; percent forms that stay are in capitals.
    """
    plain = lambda t: re.sub("%[0-9a-fA-F]{2}", lambda m: m[0].upper(), UNRESERVED.sub(lambda m: chr(int(m[1], 16)), t))
    host = re.sub(":[0-9]*$", "", plain(host).rpartition("@")[2]).rstrip(".")
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    out: list[str] = []
    first, *segments = plain(path).split("/")
    for k, segment in enumerate(segments):
        if segment == "..":
            del out[-1:]
        elif segment != ".":
            out.append(segment)
        if segment in (".", "..") and k == len(segments) - 1:
            out.append("")
    return f".{host}{first}" + "".join(f"/{segment}" for segment in out)


def judge(pages: DataFrame, rules: Sequence[Rule], *, url_col: str = "url", prefix: str = "") -> DataFrame:
    """Append ``host``, ``path``, ``rule`` (null where a default or none decided) and ``verdict``.

    The caller's rules come first, over host and path as they stand; where none fits, the
    defaults over the canonical URL; ``allow`` where none of these fits. A null or empty
    URL, or one without ``://``, has empty host and path. Long URLs are matched whole,
    repeated rows stay repeated, other columns stay; equal ranks go to the rule listed
    first. No row moves.
    """
    names = [prefix + c for c in ("host", "path", "rule", "verdict")]
    no_clash(pages.columns, names)
    listed = sorted(rules, key=lambda r: -r.rank)
    parsed = pages.withColumns({names[0]: host_of(F.col(url_col)), names[1]: path_of(F.col(url_col))})
    schema = T.StructType([*parsed.schema.fields, T.StructField(names[2], T.StringType()), T.StructField(names[3], T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        named, common = Automaton([r.glob for r in listed]), Automaton([r.glob for r in DEFAULTS])
        for batch in batches:
            host, path = batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()
            fits = named.run([f".{h}{p}" if h or p else "" for h, p in zip(host, path)])
            first = [int(f.argmax()) if f.any() else -1 for f in fits]
            rest = [i for i, f in enumerate(first) if f < 0]
            verdict = [listed[f].verdict if f >= 0 else "allow" for f in first]
            for i, f in zip(rest, common.run([canonical(host[i], path[i]) for i in rest])):
                if f.any():
                    verdict[i] = DEFAULTS[int(f.argmax())].verdict
            rule = [listed[f].name if f >= 0 else None for f in first]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rule, pa.string()), pa.array(verdict, pa.string())], names=[f.name for f in schema])

    return parsed.mapInArrow(run, schema)
