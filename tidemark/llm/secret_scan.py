"""Secret scanning with DataFrame functions only.

Three base patterns give spans of assignments, access keys and long hex strings. The
entropy scan adds spans: over every long run of key characters a window slides along;
the counts of its characters change by one entering and one leaving character, which
keeps the sum of c * log2(c) and with it the window's Shannon entropy up to date. A run
counts where a window reaches the threshold of its character class, unless the
allow-list explains it. Work grows with a text's length, and with the number of its
matches times the logarithm of that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import free_names, no_clash

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Kind -> pattern, group that must be long enough, and its least length; in the order of ties.
BASE = {"assign": (ASSIGN, 1, 6), "access": ("AKIA[A-Z0-9]{16,}", 0, 20), "hex": ("[0-9a-f]{24,}", 0, 24)}
KEY = "A-Za-z0-9+/_=-"
#: Runs of key characters; a run starts where no key character stands before it.
CANDIDATE = rf"(?<![{KEY}])[{KEY}]{{20,}}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Character class of a run -> pattern and least entropy in bits of some window.
CLASSES = {"hex": ("^[0-9a-fA-F]+$", 3.0), "alphanumeric": ("^[A-Za-z0-9]+$", 3.8), "any": ("", 4.0)}
WINDOW = 20
#: Code points in a block of a text that is redacted.
BLOCK = 1_024
#: Runs that are no secrets, whatever their entropy.
ALLOWED = (
    r"^[0-9+/_=-]+$",
    r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
    r"(?i)example|sample|dummy|placeholder|changeme|x{6}",
    r"(?i)abcdefghij|0123456789",
    r"^(?=[a-z])(?!.*[/_-]{2})(?=.*[/_-])[a-z/_-]*[0-9]*$",
)


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, combine) -> Column:
    """The running ``combine`` (an associative function) of an array, in log2(n) passes that each combine with the value 1, 2, 4, ... places before.

    A fold that appends to an array would copy it at every step.
    """
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(values), F.lit(1)).cast("double"))).cast("int"))
    back = lambda k: F.call_function("shiftleft", F.lit(1), k)
    return F.aggregate(steps, values, lambda acc, k: F.transform(acc, lambda v, i: F.when(i >= back(k), combine(v, F.get(acc, i - back(k)))).otherwise(v)))


def found(text: Column, pattern: str, group: int, least: int, kind: int) -> Column:
    """Spans ``struct(start, kind, end, run)`` of the pattern's matches, leftmost first, without those whose group is too short.

    The texts between the matches give the positions, in code points, by running sums.
    """
    gaps = F.split(text, pattern, -1)
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.arrays_zip(gaps.alias("gap"), whole.alias("m"), (F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else F.array()).alias("v"))

    def spans(zipped: Column) -> Column:
        matches = F.filter(zipped, lambda z: z["m"].isNotNull())  # the text after the last match has none
        ends = running(F.transform(matches, lambda z: F.length(z["gap"]) + F.length(z["m"])), lambda a, b: a + b)
        value = lambda z: F.length(z["v"]) if group else F.length(z["m"])
        placed = F.zip_with(matches, ends, lambda z, e: F.struct((e - F.length(z["m"])).alias("start"), F.lit(kind).alias("kind"), e.alias("end"), z["m"].alias("run"), value(z).alias("n")))
        return F.filter(placed, lambda s: s["n"] >= least)

    return let(parts, spans)


def bare(spans: Column) -> Column:
    """Spans without the text they cover."""
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))


def c_log_c(c: Column) -> Column:
    return F.when(c <= 1, F.lit(0.0)).otherwise(c * F.log2(c))


def window_entropy(run: Column, window: int = WINDOW) -> Column:
    """The highest Shannon entropy in bits of any window of a run of at least ``window`` characters (up to 31).

    The fold's state: the window's counts, five bits each and twelve to a number, the sum of
    c * log2(c) over them, and the best entropy so far.
    """
    alphabet = F.array(*[F.lit(c) for c in ALPHABET])
    places = F.transform(F.filter(F.split(run, ""), lambda ch: ch != ""), lambda ch: F.array_position(alphabet, ch).cast("int"))
    numbers = -(-(len(ALPHABET) + 1) // 12)

    def fold(p: Column) -> Column:
        start = F.struct(F.array_repeat(F.lit(0).cast("long"), numbers).alias("c"), F.lit(0.0).alias("s"), F.lit(0.0).alias("best"))
        word, bit = (lambda at: F.floor(at / 12).cast("int")), (lambda at: (at % 12 * 5).cast("int"))
        count = lambda c, at: F.call_function("shiftright", F.get(c, word(at)), bit(at)).bitwiseAND(31)
        one = lambda at: F.call_function("shiftleft", F.lit(1).cast("long"), bit(at))

        def step(acc: Column, i: Column) -> Column:
            come, full = F.get(p, i), i >= window
            go = F.get(p, F.greatest(i - window, F.lit(0)))
            c_in, c_out = count(acc["c"], come), count(acc["c"], go)
            gain = c_log_c(c_in + 1) - c_log_c(c_in) + F.when(full, c_log_c(c_out - 1) - c_log_c(c_out)).otherwise(F.lit(0.0))
            same = full & (come == go)
            total = acc["s"] + F.when(same, F.lit(0.0)).otherwise(gain)
            moved = F.transform(acc["c"], lambda c, k: c + F.when(k == word(come), one(come)).otherwise(0) - F.when(full & (k == word(go)), one(go)).otherwise(0))
            bits = lambda s: F.when(i >= window - 1, F.log2(F.lit(float(window))) - s / window).otherwise(F.lit(0.0))
            return let(total, lambda s: F.struct(F.when(same, acc["c"]).otherwise(moved).alias("c"), s.alias("s"), F.greatest(acc["best"], bits(s)).alias("best")))

        return F.aggregate(F.sequence(F.lit(0), F.size(p) - 1), start, step, lambda acc: acc["best"])

    return let(places, fold)


def entropy_spans(text: Column) -> Column:
    """Spans of runs with a window of high entropy for their character class that the allow-list does not explain."""

    def secret(run: Column) -> Column:
        least = F.lit(CLASSES["any"][1])
        for pattern, bits in reversed([v for v in CLASSES.values() if v[0]]):
            least = F.when(run.rlike(pattern), bits).otherwise(least)
        explained = F.lit(False)
        for pattern in ALLOWED:
            explained = explained | run.rlike(pattern)
        return F.when(explained, False).otherwise(window_entropy(run) >= least)

    return bare(F.filter(found(text, CANDIDATE, 0, WINDOW, len(BASE)), lambda s: secret(s["run"])))


NONE = "array<struct<start:int,kind:int,end:int>>"


def scan(docs: DataFrame, *, text_col: str = "text", prefix: str = "") -> DataFrame:
    """Append ``base_spans`` and ``spans``: arrays of ``struct(start, kind, end)`` in code points, end exclusive,
    sorted by start, then kind (0 assign, 1 access, 2 hex, 3 entropy), then end.

    Nulls and empty texts have no spans; long texts are scanned whole; repeated rows stay
    repeated; all other columns stay (``prefix`` avoids clashing names). No row moves.
    """
    names = [prefix + "base_spans", prefix + "spans"]
    no_clash(docs.columns, names)
    text = F.coalesce(F.col(text_col), F.lit(""))
    none = F.array().cast(NONE)
    kinds = [F.when(text.rlike(pattern), bare(found(text, pattern, group, least, k))).otherwise(none) for k, (pattern, group, least) in enumerate(BASE.values())]
    more = F.when(text.rlike(CANDIDATE), entropy_spans(text)).otherwise(none)
    # exploding an array of one struct keeps the optimizer from repeating the scan for each use of its result
    (own,) = free_names([*docs.columns, *names], "scanned")
    once = docs.select("*", F.explode(F.array(F.struct(F.sort_array(F.concat(*kinds)).alias("base"), more.alias("more")))).alias(own))
    return once.withColumns({names[0]: F.col(f"{own}.base"), names[1]: F.sort_array(F.concat(f"{own}.base", f"{own}.more"))}).drop(own)


def as_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in (*BASE, "entropy")])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with each stretch that spans cover replaced by ``mark``; spans must be sorted by start.

    Spans that touch or overlap share a mark only if they overlap. The text is cut into
    blocks first, so that no piece is looked for from the text's beginning.
    """
    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))

    def piece(b: Column, start: Column, end: Column) -> Column:
        """Code points from start to end, end exclusive."""
        first, last = F.floor(start / BLOCK).cast("int"), F.floor((end - 1) / BLOCK).cast("int")
        from_first = F.substring(F.get(b, first), (start % BLOCK + 1).cast("int"), F.least(end - start, F.lit(BLOCK)).cast("int"))
        between = F.array_join(F.slice(b, first + 2, F.greatest(last - first - 1, F.lit(0))), "")
        longer = F.concat(from_first, between, F.substring(F.get(b, last), F.lit(1), (end - last * BLOCK).cast("int")))
        return F.when(end <= start, "").when(first == last, from_first).otherwise(longer)

    def joined(b: Column, covered: Column) -> Column:
        before = lambda i: F.when(i > 0, F.get(covered, i - 1)).otherwise(F.lit(0))
        kept = F.transform(spans, lambda s, i: F.when(s["start"] >= before(i), F.concat(piece(b, before(i), s["start"]), F.lit(mark))).otherwise(""))
        rest = piece(b, F.element_at(covered, -1), F.length(text))
        return F.concat(F.array_join(kept, ""), rest)

    ends = running(F.transform(spans, lambda s: s["end"]), F.greatest)
    whole = let(F.struct(blocks.alias("b"), ends.alias("e")), lambda x: joined(x["b"], x["e"]))
    return F.when(F.size(spans) > 0, whole).otherwise(text)
