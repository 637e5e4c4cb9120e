"""The page reader on odd HTML against made trees, and contents against a plain walk over links."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tidemark.operators import parsing
from tidemark.operators.pages import PageReader


def events(html):
    reader = PageReader()
    reader.feed(html)
    reader.close()
    return [(i, *e) for i, e in enumerate(reader.events) if e[0]]


def said(html):
    return [e[2] for e in events(html) if e[1] in ("text", "title", "table")]


@pytest.mark.parametrize(
    "html, wanted",
    [
        ("<table><tr><td>A<td>B<tr><td>C</table>after", ["A | B\nC", "after"]),
        ("<table><tr><td>A<table><tr><td>B</td></tr></table>C</td></tr></table>x", ["A B C | B\nB", "x"]),
        ("<table><caption>Sums<tr><th>h<td></td><td> </td><td>v</table>", ["Sums\nh | v"]),
        ("<table>loose<tr>row<td>A</table>", ["loose\nrow | A"]),
        ("<table><td>A<table><tr><td>B", ["A B | B\nB"]),
        ("<table><tr><td>A</td><table><tr><td>B</table>z", ["A", "B", "z"]),
        ("<table><tr><td>A</tr><tbody><tr><td>B</tbody><tfoot><tr><td>C</table>", ["A\nB\nC"]),
        ("<table><tr><td><p>A<p>B<div>C</td><td><b>D</td></tr></table></div>E</b>F", ["A B C | D", "E", "F"]),
        ("<td>stray<tr>row</table>end", ["stray", "row", "end"]),
        ('<p style="display: none">x<p>shown', ["shown"]),
        ('<ul><li>a<li style="DISPLAY:NONE">b<b>c<li>d</ul>e', ["a", "d", "e"]),
        ('<table><tr style="display:none"><td>x<tr><td>y</table>z', ["y", "z"]),
        ('<div style="display:none"><table><tr><td>x</table></div>z', ["z"]),
        ("<h2>Item 1.<p>text", ["Item 1.", "text"]),
        ("<script>a < b</script><ix:header><p>h</ix:header>z", ["z"]),
        ("a<br>b<img src=x>c</p></div>d", ["a", "b", "c", "d"]),
    ],
)
def test_odd_pages(html, wanted):
    assert said(html) == wanted


def test_links_end_where_the_next_begins():
    html = '<table><tr><td><a href="#x">Item 1. <b>One</b><td><a href="#y">two<tr><td><a href="/z">three</table><a name="x"></a>'
    assert [(e[1], e[2], e[3]) for e in events(html) if e[1] in ("link", "name")] == [("link", "Item 1. One", "x"), ("link", "two", "y"), ("name", "", "x")]
    assert events("<h1>Big <i>news")[0][1:3] == ("heading", "Big news")


def made_table(rng, depth=0):
    """A random table as rows of cells of words and tables."""
    return [[[made_table(rng, depth + 1) if depth < 2 and rng.random() < 0.15 else f"w{rng.randrange(99)}" for _ in range(rng.randrange(3))] for _ in range(rng.randrange(1, 4))] for _ in range(rng.randrange(1, 4))]


def html_of(table, rng):
    """HTML of a made table that leaves end tags out, puts row groups in and hides things at random."""
    out = "<table>"
    for row in table:
        if rng.random() < 0.2:
            out += rng.choice(["<tbody>", "<tfoot>", '<tr style="display:none"><td>no<td>no'])
        out += "<tr>"
        for cell in row:
            out += rng.choice(["<td>", "<th>", "<td><p>"])
            for x in cell:
                out += f" {x} " + rng.choice(["", "<p>", "<br>", "<span>"]) if isinstance(x, str) else html_of(x, rng)
            if rng.random() < 0.2:
                out += "<i style='display:none'>no"
            out += rng.choice(["", "</td>", "</th></td>"]) if rng.random() < 0.9 else "</div></ul>"
        out += rng.choice(["", "</tr>"])
    return out + "</table>"


def words_of(cell):
    return " ".join(x if isinstance(x, str) else " ".join(filter(None, (words_of(c) for row in x for c in row))) for x in cell if isinstance(x, str) or words_of([c for row in x for cell in row for c in cell]))


def cells_of(row):
    return [c for cell in row for c in [words_of(cell), *(d for x in cell if not isinstance(x, str) for inner in x for d in cells_of(inner))]]


def lines_of(table):
    out = []
    for row in table:
        if filled := [c for c in cells_of(row) if c]:
            out.append(" | ".join(filled))
        for cell in row:
            for x in cell:
                if not isinstance(x, str):
                    out += lines_of(x)
    return out


def test_made_tables_against_their_trees():
    rng = random.Random(8)
    for _ in range(400):
        table = made_table(rng)
        html = "<p>before" + html_of(table, rng) + "after"
        lines = lines_of(table)
        assert said(html) == ["before", *(["\n".join(lines)] if lines else []), "after"], html
        assert " ".join(e[2] for e in events(html) if e[1] == "cell").split() == words_of([table]).split()


LINKS = [
    ("Part I", "a"), ("PART II – Other", "b"), ("Item 1. Statements", "c"), ("Item 1A", "d"), ("Item 2.", "e"), ("Item 4", "f"), ("Item 5", "g"), ("Item 6", "h"), ("7", "item_3_x"), ("8", "part_2_y"),
    ("Risk Factors", "i"), ("Exhibits", "j"), ("Controls and Procedures", "k"), ("Our part in it", "l"), ("Item 12", "m"), ("Cover", "n"), ("see Part II", "o"), ("Item 4 Mine", "p"), ("Item 7A", "q"),
]


def plain_contents(links, present, form):
    """Walk the links one by one with the part and the last ordinal in hand."""
    valid = {"1", "1A", "2", "3", "4", "5", "6"} if form == "10-Q" else set(parsing.ITEMS_10K)
    part, last, found = "I", 0, {}
    for text, target in links:
        mark = re.match(r"\s*part\s+(i{1,3}|iv)\b", text, re.I) or re.search(r"part[_-](i{1,3}|iv|1|2|3|4)(?:[_-]|$)", target, re.I)
        if mark:
            part, last = parsing.PARTS[mark[1].upper()], 0
            continue
        item = re.search(r"item\s+(1[ABC]?|[2-9][ABC]?|1[0-5])\b", text, re.I) or re.search(r"item[_-](\d{1,2}[a-c]?)(?:[_-]|$)", target, re.I)
        key = None
        if item:
            item = item[1].upper()
            if item not in valid:
                continue
            if form == "10-Q":
                number = int(re.match(r"\d+", item)[0]) * 10 + (ord(item[-1]) - 64 if item[-1].isalpha() else 0)
                part, last = ("II" if number <= last and part == "I" else part), number
            key = (part, item)
        elif form == "10-Q":
            title = text.lower()
            if "part i" in title:
                part, last = "I", 0
                continue
            key = next(((p, i) for name, p, i in parsing.TITLES_10Q if name in title), None)
        else:
            item = next((i for name, i in parsing.TITLES_10K if name in title_of(text)), None)
            key = item and (part, item)
        if key and target in present:
            found[key] = target
    return found


def title_of(text):
    return text.lower()


@pytest.mark.parametrize("form", ["10-Q", "10-K"])
def test_contents_against_a_plain_walk(spark, form):
    rng, pages, wanted = random.Random(6), [], {}
    for page in range(120):
        links = [(t, f"{a}{n}" if not a.startswith(("item", "part")) else f"{a}_{n}") for n, (t, a) in enumerate(rng.choices(LINKS, k=rng.randrange(14)))]
        links += rng.choices(links, k=2) if links and rng.random() < 0.3 else []
        present = {t for _, t in links if rng.random() < 0.85}
        html = "<table>" + "".join(f'<tr><td><a href="#{t}">{x}</a>' for x, t in links) + "</table>" + "".join(rng.choice([f'<p id="{t}">x', f'<a name="{t}">x</a>']) for t in sorted(present))
        pages.append((page, html))
        for (part, item), target in plain_contents(links, present, form).items():
            wanted[page, part, item] = target
    got = parsing.toc_anchors(parsing.page_events(spark.createDataFrame(pages, "page_id long, html string")), form).collect()
    assert len(got) == len(wanted) and {(r["id"], r["part"], r["item"]): r["target"] for r in got} == wanted


FILING = """<table><tr><td><a href="#p1">Part I</a><tr><td><a href="#a">Item 4.</a><tr><td><a href="#p2">Part II</a><tr><td><a href="#b">Item 1A</a><tr><td><a href="#c">Item 5.</a></table>
<p id="p1">Part I<p id="a">Item 4.<p>Fine.<table><tr><td>x<td>1<tr><td id="b">Risk<td>2<tr><td>y</table><p>Rain.<p id="p2">Part II<p id="c">Item 5. Other<p>Nothing."""


def test_contents_jump_to_the_second_part(spark):
    """From Part I Item 4 to Part II Item 5; a section that begins inside a table has the rest of it."""
    got = {r["section"]: (r["body"], r["method"]) for r in parsing.parse_filings(spark.createDataFrame([(1, FILING)], "page_id long, html string")).collect()}
    assert got == {
        "controls_and_procedures": ("Item 4. Fine. x | 1\nRisk | 2\ny", "toc"),
        "risk_factors": ("Risk 2 y Rain. Part II", "toc"),
        "other_information": ("Item 5. Other Nothing.", "toc"),
    }


def test_headings_under_part_markers(spark):
    html = "<h1>Part I</h1><h2>Item 4. Controls</h2><p>Fine.<h1>PART II</h1><h2>Item 5. Other</h2>First.<h2>Item 5. Other</h2><table><tr><td>a<td>b</table><h2>Item 77.</h2>still"
    page = spark.createDataFrame([(1, html), (2, None), (3, "<table><tr><td>A<td>B")], "page_id long, html string")
    got = {(r["id"], r["section"]): r["body"] for r in parsing.parse_filings(page).collect()}
    assert got == {(1, "controls_and_procedures"): "Fine.", (1, "other_information"): "First. a | b still"}


def test_text_between_any_starts(spark):
    page = spark.createDataFrame([(1, "lead<h1>A</h1>one<p>two<h1>B</h1><h1>C</h1><table><tr><td>x<td>y</table>")], "page_id long, html string")
    found = parsing.page_events(page)
    got = parsing.text_between(found, F.when(F.col("kind") == "heading", F.col("content"))).collect()
    assert {r["key"]: r["body"] for r in got} == {"A": "A one two", "B": "B", "C": "C x | y"}
    assert parsing.text_between(found, F.lit(None).cast("string")).count() == 0


def test_events_leave_in_small_batches(spark, monkeypatch):
    """a batch of many pages, or one long page, is not held as events, and only the kinds asked for leave the parser."""
    import pyarrow as pa

    from tidemark.operators import pages as reader

    html = ["<p>a</p>" + "<table><tr><td>" + "<td>".join(f"w{i}" for i in range(500)) + "</table>", None, "<h1>t</h1><p>x &amp; y < z</p>"] * 20
    whole = list(reader._events()(iter([pa.RecordBatch.from_pydict({"id": list(range(60)), "html": html})])))
    monkeypatch.setattr(reader, "BATCH_BYTES", 4_000)
    small = list(reader._events()(iter([pa.RecordBatch.from_pydict({"id": list(range(60)), "html": html})])))
    assert pa.Table.from_batches(small).to_pylist() == pa.Table.from_batches(whole).to_pylist()
    assert max(b.num_rows for b in small[:10]) <= 4_000 // reader.ROW_BYTES + 1 < whole[0].num_rows
    df = spark.createDataFrame([(i, h) for i, h in enumerate(html)], "page_id long, html string")
    tables = parsing.page_events(df, kinds=("table",)).orderBy("id").collect()
    assert tables == parsing.page_events(df).where("kind = 'table'").orderBy("id").collect() and len(tables) == 20


def test_plain_tags_in_one_go():
    """Tags taken without the parser give the events that the parser gives."""
    import random

    from tidemark.operators import pages as reader

    class Slow(reader.PageReader):
        parse_starttag = reader.HTMLParser.parse_starttag

    rng = random.Random(7)
    parts = "<p> </p> <table> </table> <tr> <td> </td> <th> <tbody> <h1> </h2> <b> </b> <script> </script> <title> <a> <br> <td/> < &lt; word <li> </ul> <TD> <td class=x> <!--c--> <span> </div> <caption>".split(" ")
    for _ in range(300):
        page = "".join(rng.choice(parts) + rng.choice(["", " ", "x", "a < b"]) for _ in range(rng.randrange(50)))
        found = []
        for kind in (reader.PageReader, Slow):
            one = kind()
            one.feed(page)
            one.close()
            found.append(one.events)
        assert found[0] == found[1], page
