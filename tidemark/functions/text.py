"""Text functions on columns; everything stays within the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions import folds

MARK = "\x01"
#: Words whose full stop ends no sentence.
ABBREVIATIONS = ("Mr", "Mrs", "Ms", "Dr", "Prof", "Sr", "Jr", "Inc", "Corp", "Ltd", "Co", "vs", "etc", "approx", "est", "avg")
#: Words that say nothing about a topic.
STOPWORDS = (
    "the", "a", "an", "is", "was", "were", "are", "be", "been", "being",
    "in", "on", "at", "to", "of", "for", "and", "or", "but", "with", "as",
    "by", "from", "this", "that", "these", "those", "it", "its", "we", "our",
    "what", "which", "who", "how", "did", "do", "does", "will", "would",
    "q1", "q2", "q3", "q4", "fy", "fy2025", "fy2026",
)


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _marked(text: Column, abbreviations: str) -> Column:
    """The text with a code in place of each full stop after an abbreviation, and codes for the characters that serve as marks."""
    own = F.replace(F.replace(text, F.lit("\x02"), F.lit("\x02\x03")), F.lit(MARK), F.lit("\x02\x04"))
    plain = F.when(text.contains("\x02") | text.contains(MARK), own).otherwise(text)
    return F.regexp_replace(plain, abbreviations, "$1\x02\x05")


def _unmarked(piece: Column) -> Column:
    out = piece
    for code, char in (("\x05", "."), ("\x04", MARK), ("\x03", "\x02")):
        out = F.replace(out, F.lit("\x02" + code), F.lit(char))
    return F.when(piece.contains("\x02"), out).otherwise(piece)


def sentences(text: Column) -> Column:
    """Sentences without surrounding white space; a full stop after an abbreviation ends none."""
    kept = _marked(text, rf"\b({'|'.join(ABBREVIATIONS)})\.")
    cut = F.regexp_replace(kept, r'([.!?])\s+(?=[A-Z"(])', "$1" + MARK)
    parts = F.transform(F.split(cut, MARK), lambda s: F.regexp_replace(_unmarked(s), r"^\s+|\s+$", ""))
    return F.filter(parts, lambda s: s != "")


def spans(pieces: Column) -> Column:
    """Half-open spans of consecutive pieces, without empty ones; together they cover the text exactly."""
    return folds.running_spans(F.transform(pieces, lambda p: F.length(p)))


def sentence_pieces(text: Column) -> Column:
    """The text cut behind the white space between sentences; the pieces joined give the text."""
    kept = _marked(text, rf"(?i)(?<![A-Za-z])({'|'.join(ABBREVIATIONS)})\.")
    cut = F.regexp_replace(kept, r'([.!?]\s+)(?=[A-Z"(])', "$1" + MARK)
    return F.transform(F.split(cut, MARK), lambda s: _unmarked(s))


def simple_sentences(text: Column) -> Column:
    return F.filter(F.split(F.trim(text), r"(?<=[.!?])\s+"), lambda s: s != "")


def token_count(text: Column) -> Column:
    """Tokens as words and single signs; callers may pass another expression instead."""
    return F.regexp_count(text, F.lit(r"\w+|[^\w\s]"))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\S+"))


def line_pieces(text: Column) -> Column:
    """Lines with their line break; joined they give the text."""
    return F.filter(F.split(text, r"(?<=\n)"), lambda s: s != "")


def is_row_shaped(text: Column) -> Column:
    return text.contains("\n") & (F.regexp_count(text, F.lit(r"\|")) >= 2)


def tokens(text: Column, stopwords: bool = True) -> Column:
    """Distinct lower-case words of letters and digits, without stopwords if asked for."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)))
    return F.array_except(found, F.array(*[F.lit(w) for w in STOPWORDS])) if stopwords else found


def overlap(query: Column, text: Column, *, stopwords: bool = True, empty: float = 1.0, longer_than: int = 0) -> Column:
    """Share of the query's tokens that the text has; ``empty`` where the query has none."""
    asked = tokens(query, stopwords)
    if longer_than:
        asked = F.filter(asked, lambda w: F.length(w) > longer_than)
    n = F.size(asked)
    return F.when(n == 0, F.lit(empty)).otherwise(F.size(F.array_intersect(asked, tokens(text, False))) / n)


def numeric_tokens(text: Column) -> Column:
    """Digit runs without thousands commas and without a trailing full stop."""
    found = F.regexp_extract_all(text, F.lit(r"\d[\d,]*\.?\d*"), F.lit(0))
    return F.transform(found, lambda n: F.regexp_replace(F.translate(n, ",", ""), r"\.$", ""))


def normalize_title(text: Column) -> Column:
    """Lower case, with typographic quotes and dashes as plain ones."""
    return F.translate(F.lower(text), "’‘“”–—", "''\"\"--")


#: The line that states an absence, and Markdown headings.
ABSENCE_LINE = r"(?im)^[ \t]*no (?:verified )?data available\.?[ \t]*(?:\[[A-Z]+\])*[ \t]*$\n?"
HEADING_LINE = r"(?im)^[ \t]*#{1,6}[ \t].*$\n?"


def strip_absence(text: Column) -> Column:
    """Without lines that only state an absence and without Markdown headings."""
    return F.regexp_replace(F.regexp_replace(text, ABSENCE_LINE, ""), HEADING_LINE, "")


def normalize_metric(metric: Column) -> Column:
    """A metric's name in snake case: signs to spaces, ``%`` as pct, ``(cc)`` as cc."""
    s = F.trim(F.lower(metric))
    s = F.replace(F.replace(s, F.lit("(cc)"), F.lit("cc")), F.lit("(c.c.)"), F.lit("cc"))
    s = F.regexp_replace(s, "%", "pct")
    s = F.regexp_replace(s, r"(?U)[^\w\s]", " ")
    s = F.regexp_replace(F.regexp_replace(s, r"\s+", "_"), "_+", "_")
    return F.regexp_replace(s, "^_+|_+$", "")
