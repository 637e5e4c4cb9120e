"""One pass of a standard HTML parser per page: what it holds, in document order."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEADING_TAGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
HIDDEN_TAGS = ("script", "style", "ix:header", "ix:hidden", "ix:references", "ix:resources")
VOID_TAGS = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: An open paragraph or heading ends where one of these begins.
BLOCK_TAGS = HEADING_TAGS | frozenset("address article aside blockquote center details dialog div dl fieldset figure footer form header hr main menu nav ol p pre section table ul".split())
CELL_TAGS, BODY_TAGS = frozenset(("td", "th")), frozenset(("tbody", "thead", "tfoot"))
BOLD_TAGS = frozenset(("b", "strong"))
#: Characters of an output batch of events, and what a row counts for besides its content.
BATCH_BYTES, ROW_BYTES = 4 << 20, 64
_UNSEEN = re.compile(r"display\s*:\s*none", re.I)


class _Open:
    """An element that has not ended: its tag, whether it hides what is in it, its event, and the words gathered for it."""

    __slots__ = ("tag", "hides", "event", "words", "rows")

    def __init__(self, tag: str, hides: bool = False):
        self.tag, self.hides, self.event, self.words, self.rows = tag, hides, None, [], []


class PageReader(HTMLParser):
    """``events``: ``[kind, content, target, table]`` in order.

    Kinds are ``anchor`` and ``name`` (an element's id or name, the target), ``link`` (into the
    page), ``heading`` and ``bold``, which stand before their own texts; ``text``, ``title``
    (text in a heading), ``table`` and ``cell``. An outermost table is one event with a
    line for each row, filled cells joined by `` | ``; as cells may hold tables, a row lists the
    cells within its cells too, and rows within rows have lines of their own. Text of a table that is in
    no cell is a cell or a line of its own. ``cell`` repeats the table's texts one by one, for sections that
    begin inside it; ``table`` is then the place of the table's event, else -1.

    Elements without end tags end as HTML says: cells, rows, list items, paragraphs,
    links and headings by what follows, all others with the element around them. An end
    tag reaches no element outside the cell that it stands in.
    """

    def __init__(self):
        super().__init__()
        self.events: list[list] = []
        self.path: list[_Open] = []
        self.open: defaultdict[str, int] = defaultdict(int)  # how many of each tag are open: pages may leave very many open
        self.takers: list[_Open] = []  # open elements that gather words
        self.tables: list[_Open] = []
        self.hiding = 0

    # open elements

    def _shut(self, at: int) -> None:
        """End the open elements from ``at`` on."""
        while len(self.path) > at:
            end = self.path.pop()
            self.open[end.tag] -= 1
            self.hiding -= end.hides
            if self.takers and self.takers[-1] is end:
                self.takers.pop()
            if self.tables and self.tables[-1] is end:
                self.tables.pop()
            if end.tag == "table" and end.event is not None:
                lines = [" | ".join(filled) for row in end.rows if (filled := [joined for cell in row if (joined := " ".join(cell))])]
                if lines:
                    self.events[end.event][:2] = "table", "\n".join(lines)
            elif end.event is not None and end.tag != "table":
                inner = " ".join(end.words)
                kind = "link" if end.tag == "a" else "bold" if end.tag in BOLD_TAGS else "heading"
                if inner and not (kind == "bold" and len(inner) > 300):
                    self.events[end.event][:2] = kind, inner

    def _any_open(self, tags) -> bool:
        for t in tags:
            if self.open[t]:
                return True
        return False

    def _last(self, tags, stops=()) -> int | None:
        """The innermost open element with one of the tags that no element of ``stops`` is around."""
        if not self._any_open(tags):
            return None
        for i in range(len(self.path) - 1, -1, -1):
            tag = self.path[i].tag
            if tag in tags:
                return i
            if tag in stops:
                return None
        return None

    def _end_last(self, tags, stops=()) -> None:
        if (at := self._last(tags, stops)) is not None:
            self._shut(at)

    def _make_room(self, tag: str) -> None:
        """End what cannot hold ``tag``."""
        if tag in BLOCK_TAGS:
            self._end_last(("p",), _TABLE_SCOPE)
            self._end_last(HEADING_TAGS, _TABLE_SCOPE)
        if tag == "li":
            self._end_last(("li",), _TABLE_SCOPE | {"ul", "ol", "menu"})
        elif tag in ("dt", "dd"):
            self._end_last(("dt", "dd"), _TABLE_SCOPE | {"dl"})
        elif tag == "a":
            self._end_last(("a",), _TABLE_SCOPE)
        table = self._last(("table",))
        if table is None:
            return
        if tag == "table" and self._last(_CELL_SCOPE, ("table",)) is None:
            self._shut(table)
        elif tag in CELL_TAGS:
            row = self._last(("tr",), ("table",))
            self._shut(table + 1 if row is None else row + 1)
            if row is None:
                self._begin("tr", {})
        elif tag == "tr":
            body = self._last(BODY_TAGS, ("table",))
            self._shut(table + 1 if body is None else body + 1)
        elif tag in BODY_TAGS or tag in ("caption", "colgroup"):
            self._shut(table + 1)

    def _begin(self, tag: str, have: dict[str, str]) -> None:
        new = _Open(tag, tag in HIDDEN_TAGS or bool(have and _UNSEEN.search(have.get("style", ""))))
        self.path.append(new)
        self.open[tag] += 1
        self.hiding += new.hides
        if self.hiding:
            return
        table = self.tables[0].event if self.tables else -1
        for key, kind in _NAMED if have else ():
            if have.get(key):
                self.events.append([kind, "", have[key], table])
        target = have.get("href", "") if tag == "a" else ""
        if tag in HEADING_TAGS or tag in BOLD_TAGS or target.startswith("#"):
            new.event = len(self.events)
            self.events.append([None, "", target[1:], table])
            self.takers.append(new)
        elif tag == "table":
            if table < 0:
                new.event = len(self.events)
                self.events.append([None, "", "", -1])
            self.tables.append(new)
        elif tag == "tr" and self.tables:
            self.tables[0].rows.append(new.rows)
            self.takers.append(new)
        elif tag in CELL_TAGS and self.tables:
            self.takers.append(new)
            for e in self.takers:
                if e.tag == "tr":
                    e.rows.append(new.words)

    # the parser's calls

    def updatepos(self, i, j):
        """Lines are not counted: nothing asks for them."""
        return j

    def parse_starttag(self, i):
        """Tags without attributes and the texts between them are taken in one go, up to what needs the parser."""
        if (found := _PLAIN.match(self.rawdata, i)) is None:
            return super().parse_starttag(i)
        while found:
            end, tag, data = found.groups()
            if end:
                self.handle_endtag(tag)
            else:
                self.handle_starttag(tag, ())
            if data:
                self.handle_data(data)
            i = found.end()
            found = _PLAIN.match(self.rawdata, i)
        return i

    def handle_starttag(self, tag, attrs):
        if tag in VOID_TAGS:
            if tag == "hr":
                self._make_room(tag)
            return
        self._make_room(tag)
        self._begin(tag, {k: v or "" for k, v in attrs})

    def handle_endtag(self, tag):
        if tag in HEADING_TAGS:
            self._end_last(HEADING_TAGS, _TABLE_SCOPE)
        elif tag == "table":
            self._end_last(("table",))
        elif tag == "tr" or tag in BODY_TAGS or tag in _CELL_SCOPE:
            self._end_last((tag,), ("table",))
        else:
            self._end_last((tag,), _TABLE_SCOPE)

    def handle_data(self, data):
        words = " ".join(data.split())
        if not words or self.hiding:
            return
        loose = True
        for e in self.takers:
            if e.tag != "tr":
                e.words.append(words)
                loose = loose and e.tag not in CELL_TAGS
        if not self.tables:
            self.events.append(["title" if self._any_open(HEADING_TAGS) else "text", words, "", -1])
            return
        self.events.append(["cell", words, "", self.tables[0].event])
        if loose:
            row = next((e for e in self.takers if e.tag == "tr"), None)
            (self.tables[0].rows if row is None else row.rows).append([[words]] if row is None else [words])

    def close(self):
        super().close()
        self._shut(0)


_NAMED = (("id", "anchor"), ("name", "name"))
#: A tag without attributes whose content is markup, and the text behind it if that has no reference and another tag follows.
_PLAIN = re.compile("<(/?)(td|tr|th|p|tbody|thead|tfoot|table|div|span|li|ul|ol|b|strong|h[1-6])>(?:([^<&]+)(?=<))?")
_CELL_SCOPE = CELL_TAGS | {"caption"}
_TABLE_SCOPE = _CELL_SCOPE | {"table"}


def page_events(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", kinds: tuple[str, ...] | None = None) -> DataFrame:
    """``id, place, kind, content, target, inside``: what a page holds, in document order (see :class:`PageReader`; ``inside`` is the
    place of the table around). One parse per page; null pages and those that the parser rejects give no rows. With ``kinds`` only
    events of these leave the parser, with the same places.

    A task holds the events of one page, and passes on rows whenever they fill a batch.
    """
    kind = pages.schema[id_col].dataType.simpleString()
    return pages.select(id_col, html_col).mapInArrow(_events(kinds), f"id {kind}, place int, kind string, content string, target string, inside int")


def _events(kinds: tuple[str, ...] | None = None):
    """Batches of id and page to batches of events."""
    wanted = None if kinds is None else frozenset(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows, used = batch.column(0), [], 0
            for at, html in enumerate(batch.column(1)):
                reader = PageReader()
                try:
                    reader.feed(html.as_py() or "")
                    reader.close()
                except (AssertionError, ValueError):
                    continue
                for place, (kind, content, target, inside) in enumerate(reader.events):
                    if kind and (wanted is None or kind in wanted):
                        rows.append((at, place, kind, content, target, inside))
                        used += len(content) + ROW_BYTES
                        if used >= BATCH_BYTES:
                            yield _batch(ids, rows)
                            rows, used = [], 0
            if rows:
                yield _batch(ids, rows)

    return run


def _batch(ids: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
    """Events as an Arrow batch; the first field of a row is the place of its page's id."""
    at, place, kind, content, target, inside = zip(*rows)
    columns = [ids.take(pa.array(at, pa.int32())), pa.array(place, pa.int32()), *(pa.array(c, pa.string()) for c in (kind, content, target)), pa.array(inside, pa.int32())]
    return pa.RecordBatch.from_arrays(columns, ["id", "place", "kind", "content", "target", "inside"])


def extract_tables(events: DataFrame) -> DataFrame:
    """``id, place, rows``: each outermost table of a page, a line for each row."""
    return events.where("kind = 'table'").select("id", "place", F.col("content").alias("rows"))
