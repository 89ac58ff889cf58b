"""Pages as trees against a plain walk over objects, and against known pages."""

import random
import re
from collections import Counter
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import tree

PAGES = "page_id long, html string"
VOID = {"br", "hr", "img", "input", "meta", "link"}


class Element:
    def __init__(self, tag, style, parent):
        self.tag, self.style, self.parent, self.children = tag, style, parent, []

    def elements(self):
        for c in self.children:
            if isinstance(c, Element):
                yield c
                yield from c.elements()

    def texts(self):
        for c in self.children:
            if isinstance(c, Element):
                yield from c.texts()
            else:
                yield self, c

    def text(self):
        return "".join(t for _, t in self.texts())

    def packed(self):
        return "".join(t.strip() for _, t in self.texts())

    def up(self):
        at = self
        while at is not None:
            yield at
            at = at.parent


class Build(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Element("", "", None)
        self.stack, self.data = [self.root], ""

    def flush(self):
        keep = self.stack[-1].tag in ("pre", "code", "textarea")
        if self.data:
            self.stack[-1].children.append(self.data if keep else re.sub(r"\s+", " ", self.data))
        self.data = ""

    def handle_starttag(self, tag, attrs):
        self.flush()
        e = Element(tag, dict(attrs).get("style") or "", self.stack[-1])
        self.stack[-1].children.append(e)
        if tag not in VOID:
            self.stack.append(e)

    def handle_endtag(self, tag):
        if tag in [e.tag for e in self.stack]:
            self.flush()
            while self.stack.pop().tag != tag:
                pass

    def handle_data(self, data):
        self.data += data

    def handle_comment(self, data):
        self.flush()


def parsed(html):
    b = Build()
    b.feed(html)
    b.close()
    b.flush()

    def tidy(e):
        out = []
        for c in e.children:
            if isinstance(c, Element):
                tidy(c)
                if c.tag in ("script", "style") or re.search(r"display\s*:\s*none", c.style, re.I):
                    continue
                if c.tag == "font" or c.tag.startswith("ix:"):
                    for x in c.children:
                        if isinstance(x, Element):
                            x.parent = e
                    out += c.children
                    continue
            out.append(c)
        e.children = out

    tidy(b.root)
    return b.root


def bold(e):
    return e.tag in ("b", "strong") or bool(re.search(r"font-weight\s*:\s*(700|bold)", e.style, re.I))


def pt(e):
    m = re.search(r"font-size\s*:\s*([0-9]+(?:\.[0-9]+)?)pt", e.style, re.I) if e.tag == "span" else None
    return float(m[1]) if m else None


def dominant(e):
    n = Counter()
    for at, t in e.texts():
        if t.strip():
            for x in at.up():
                if pt(x) is not None:
                    n[pt(x)] += len(t.strip())
                    break
                if x is e:
                    break
    return max(n, key=lambda s: n[s]) if n else None


def plain_headings(html):
    """(level, text) in order, by walking the objects."""
    root = parsed(html)
    every = [e for e in root.elements() if e.tag in tree.BLOCKS]
    order = {id(e): k for k, e in enumerate(root.elements())}
    in_table = lambda e: any(x.tag == "table" for x in e.parent.up())
    squeezed = lambda e: " ".join(e.text().split())
    has_bold = lambda e: any(x.tag in ("b", "strong") or re.search(r"font-weight\s*:\s*(700|bold)", x.style) for x in [e, *e.elements()])
    last = {}
    for e in every:
        if m := re.match(r"\s*Item\s+(\d+[A-Z]?)\.", squeezed(e), re.I):
            last[m[1].upper()] = e
    outside = [order[id(e)] for e in last.values() if not in_table(e)]
    starts = [e for e in last.values() if not (outside and order[id(e)] < min(outside) and in_table(e))]
    starts.sort(key=lambda e: order[id(e)])
    parts = {}
    for e in every:
        if (m := re.match(r"\s*PART\s+(I{1,3}V?|IV)\b", squeezed(e), re.I)) and has_bold(e):
            parts[m[1].upper()] = e
    spans = Counter()
    for e in root.elements():
        if pt(e) is not None:
            spans[pt(e)] += len(e.packed())
    body = max(spans, key=lambda s: spans[s]) if spans else None

    def isolated(e):
        if e.tag in ("td", "th") or in_table(e) or dominant(e) is None or (body is not None and dominant(e) < body):
            return False
        row = [c for c in e.parent.children if isinstance(c, Element) and (c is e or c.packed())]
        k = next(i for i, c in enumerate(row) if c is e)
        return not any(c.tag in tree.NOT_BESIDE for c in (row[k - 1 : k] if k else []) + row[k + 1 : k + 2])

    heads = {}
    for e in reversed(every):
        text = squeezed(e)
        if not text or any(id(d) in heads for d in e.elements()):
            continue
        if re.match(r"\s*PART\s+(I{1,3}V?|IV)\b", text, re.I):
            level = 1 if e in parts.values() and has_bold(e) else None
        else:
            strong = body is not None and len(text) < 150 and dominant(e) is not None and dominant(e) > body * 1.1
            level = 2 if e in starts and (has_bold(e) or isolated(e) or strong) else None
        if level and not any(isinstance(c, Element) and c.tag in tree.BLOCKS and c.packed() for c in e.children):
            heads[id(e)] = (level, text, e)
    out = [(order[i], level, text) for i, (level, text, _) in heads.items()]
    free = [e for e in every if not any(id(x) in heads for x in e.up())]
    noise = {t for t, n in Counter(e.packed() for e in free).items() if n >= 4 and 3 <= len(t) <= 50}
    region, found = None, {}
    for e in every:
        if id(e) in {id(s) for s in starts} and (e.tag in ("div", "p") or id(e) in heads):
            region = id(e)
            continue
        text = e.packed()
        form = e.tag in ("div", "p") and not in_table(e) and not any(d.tag in ("div", "p", "table") for d in e.elements()) and 3 <= len(text) <= 200 and not text.isnumeric() and not (len(text) > 30 and text[-1] in ".!?")
        form = form and all(any(bold(x) for x in list(at.up())[: list(at.up()).index(e) + 1]) for at, t in e.texts() if t.strip())
        if region and form and e in free and text not in noise and not re.match(r"\s*Item\s+\d+[A-Z]?\b", text, re.I) and dominant(e) is not None:
            found.setdefault(region, []).append((order[id(e)], dominant(e), text))
    for rows in found.values():
        sizes = sorted({s for _, s, _ in rows}, reverse=True)
        out += [(at, min(sizes.index(s), 2) + 3, text) for at, s, text in rows]
    return [x[1:] for x in sorted(out)]


def found(spark, pages):
    rows = tree.headings(tree.nodes(spark.createDataFrame(pages, PAGES))).orderBy("page_id", "pre").collect()
    return {i: [(r.level, r.text) for r in rows if r.page_id == i] for i, _ in pages}


def made_up(draw):
    """A page of nested, badly closed elements with headings of all forms."""
    words = ["Item 1. Business", "Item&nbsp;1A. Risks", "ITEM 7. Review", "PART I", "Part II", "Overview", "Liquidity", "12", "A much longer line that ends with a dot.", "Running head", " ", "x", "Products<br>sold", "see <!-- c --> below"]
    styles = ["", "", "font-size:10pt", "font-size: 12.5PT; color:red", "font-weight:bold", "FONT-WEIGHT: 700", "display : none", "font-size:14pt;font-weight:700"]

    def part(depth):
        tag = draw.choice(["div", "div", "p", "span", "span", "b", "table", "td", "section", "font", "ix:x", "pre", "li", "script"])
        style = draw.choice(styles)
        inside = "".join(part(depth + 1) if draw.random() < 0.55 and depth < 5 else draw.choice(words) for _ in range(draw.randrange(4)))
        end = f"</{tag}>" if draw.random() < 0.95 else ""
        return f'<{tag} style="{style}">{inside}{end}' if style else f"<{tag}>{inside}{end}"

    return "<html><body>" + "".join(part(0) for _ in range(draw.randrange(3, 14))) + "</body></html>"


def test_headings_equal_a_plain_walk(spark):
    draw = random.Random(3)
    pages = [(k, made_up(draw)) for k in range(400)]
    got = found(spark, pages)
    wrong = [(k, got[k], plain_headings(h), h) for k, h in pages if got[k] != plain_headings(h)]
    # a block around a heading is no heading itself, though its own inner block is gone by then
    assert not wrong, wrong[0]
    assert sum(map(len, got.values())) > 100


def test_filings_equal_a_plain_walk(spark):
    rows = tree.filings(spark, "/root/testdata/sf0.001").where("page_id < 12").collect()
    got = found(spark, [(r.page_id, r.html) for r in rows])
    assert all(got[r.page_id] == plain_headings(r.html) for r in rows) and all(got.values())


def test_numbers_are_intervals(spark):
    html = "<div>a<p>b<b>c</b></p><!-- x -->d</div><i>e"
    rows = tree.nodes(spark.createDataFrame([(1, html), (2, None), (3, ""), (None, "<p>x")], PAGES)).orderBy("page_id", "pre").collect()
    assert [(r.tag, r.text, r.pre, r.last, r.parent, r.solid) for r in rows if r.page_id == 1] == [
        ("div", None, 0, 6, -1, 4), ("#text", "a", 1, 1, 0, 1), ("p", None, 2, 5, 0, 2), ("#text", "b", 3, 3, 2, 1), ("b", None, 4, 5, 2, 1), ("#text", "c", 5, 5, 4, 1), ("#text", "d", 6, 6, 0, 1), ("i", None, 7, 8, -1, 1), ("#text", "e", 8, 8, 7, 1),
    ]
    assert {r.page_id for r in rows} == {1, None}


@pytest.mark.parametrize(
    ("inner", "size"),
    [
        ('<span style="font-size:12pt">Heading</span>', 12.0), ('<span style="font-size:10pt">Heading of it</span><span style="font-size:6pt">(1)</span>', 10.0), ("Heading", None), ('<span style="font-size:12px">Heading</span>', None),
        ('<span style="font-size:10pt">ab<span style="font-size:9.5pt">cdef</span></span>', 9.5), ('<span style="font-size:10pt">ab</span><span style="font-size:8pt">cd</span>', 10.0),
    ],
)
def test_dominant_sizes(spark, inner, size):
    rows = tree.blocks(tree.nodes(spark.createDataFrame([(1, f'<span style="font-size:40pt"><div>{inner}</div></span>')], PAGES))).collect()
    assert [r.size for r in rows] == [size]


def test_bold_only_forms(spark):
    forms = {
        '<div style="font-weight:700">Heading</div>': True, "<p><b>Heading</b></p>": True, "<div><b>Head</b>ing</div>": False, "<table><tr><td><div><b>Heading</b></div></td></tr></table>": False, "<div><b>12345</b></div>": False, "<div><b>ab</b></div>": False,
        "<div><b>" + "x" * 201 + "</b></div>": False, "<div><b>This sentence is longer than thirty.</b></div>": False, "<div><b>Short one.</b></div>": True, "<div> <b>Two</b> <strong>parts</strong></div>": True, '<b><div>Heading</div></b>': False,
    }
    rows = tree.blocks(tree.nodes(spark.createDataFrame(list(enumerate(forms)), PAGES))).groupBy("page_id").agg(F.max("bold_only").alias("b")).collect()
    assert {r.page_id: r.b for r in rows} == dict(enumerate(forms.values()))


def test_markdown_of_a_filing(spark):
    html = '<title>T</title><div><b>PART I</b></div><p><b>Item 1. Business</b></p><p>We sell <i>things</i>.</p><h3>As is</h3><div><b><span style="font-size:9pt">Products</span></b></div><p></p><td>cell</td>loose'
    assert tree.emitted(tree.nodes(spark.createDataFrame([(1, html)], PAGES))).first().markdown == "T\n\n# PART I\n\n## Item 1. Business\n\nWe sell things.\n\n### As is\n\n### Products\n\ncell\n\nloose"


def passes(query, spark):
    """How often a query's plan parses the pages and shuffles rows."""
    plan = tree.QUERIES[query](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    return plan.count("MapInArrow"), len(re.findall(r"Exchange hashpartitioning", plan)), plan.count("Join")


def test_markdown_parses_pages_once(spark):
    # pages and their nodes are dealt out once each, and no table meets itself
    assert passes("h13_page_markdown", spark) == (1, 2, 0)


def test_headings_parse_pages_once(spark):
    assert passes("h12_page_headings", spark) == (1, 2, 0)


def test_markdown_of_headings_within_others(spark):
    html = '<p><b>Item 1. A</b></p><div><b><span style="font-size:9pt">Over <td><b>Item 2. B</b></td> after</span></b></div><p><b><span style="font-size:9pt">Next</span></b> </p>end'
    assert tree.emitted(tree.nodes(spark.createDataFrame([(1, html)], PAGES))).first().markdown == "## Item 1. A\n\n### OverItem 2. Bafter\n\n## Item 2. B\n\n### Next\n\nend"
