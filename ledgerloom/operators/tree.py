"""Pages as trees in a table: every element and text with its place in pre-order and the last place within it, so ancestry is a comparison of numbers; and the headings found on it.

A node is within another if ``pre <= node.pre <= last``. One parser in tasks numbers the nodes of a page; what a block says, how large and bold it is, where items and
parts begin and which blocks are headings are groups and windows over the nodes, one after another: the pages are parsed once, their nodes shuffled once, by page, and no table is
joined with itself. The queries read filings whose bodies are the given ``pages``.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions import SPACE, bound, stripped
from ..sources import derived
from .headings import ITEM, ITEM_NAME, NOT_BESIDE, PART

#: Blocks that may be headings, elements within which a block is none, ones whose white space stays, unseen ones, and ones that are nothing but their content.
BLOCKS, NESTED = ("div", "p", "td", "th"), ("div", "p", "table")
KEPT_AS_IS, UNSEEN, UNWRAPPED = {"pre", "code", "textarea", "script", "style"}, {"script", "style"}, {"font"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
LINES = {"div", "p", "td", "th", "li", "pre", "h1", "h2", "h3", "h4", "h5", "h6"}
#: What a style says.
HIDDEN, SIZE, WEIGHT = re.compile(r"display\s*:\s*none", re.I), re.compile(r"font-size\s*:\s*([0-9]+(?:\.[0-9]+)?)pt", re.I), r"font-weight\s*:\s*(700|bold)"
BOLD, BOLD_AS_WRITTEN = re.compile(WEIGHT, re.I), re.compile(WEIGHT)
REPEATS = 4
#: Nodes that the parser hands over at once.
BATCH = 5_000

NODE = pa.schema(
    [
        ("page_id", pa.int64()), ("pre", pa.int32()), ("last", pa.int32()), ("parent", pa.int32()), ("depth", pa.int32()), ("tag", pa.string()), ("text", pa.string()), ("solid", pa.int32()), ("in_table", pa.bool_()),
        ("bold", pa.bool_()), ("bold_at", pa.int32()), ("size", pa.float64()), ("size_at", pa.int32()), ("blocks", pa.list_(pa.int32())), ("line_at", pa.int32()), ("line_tag", pa.string()),
    ]
)
NODES = "page_id long, pre int, last int, parent int, depth int, tag string, text string, solid int, in_table boolean, bold boolean, bold_at int, size double, size_at int, blocks array<int>, line_at int, line_tag string"


class Parser(HTMLParser):
    """Numbers a page's elements and texts. An end tag closes up to the last open element of its name and is ignored if there is none; what is open at the end ends there."""

    def __init__(self, page_id: int):
        super().__init__(convert_charrefs=True)
        self.page, self.nodes, self.data, self.within = page_id, [], [], 0
        # tag, node (None: only its content counts), hidden, and of the nearest: bold, (size, at), blocks, line, whether in a table
        self.open: list[tuple] = [("", None, False, -1, (None, -1), (), (-1, ""), False)]

    def flush(self) -> None:
        raw, top = "".join(self.data), self.open[-1]
        self.data.clear()
        if raw and not top[2]:
            parent = next((x for x in reversed(self.open) if x[1] is not None), None)
            text = raw if any(x[0] in KEPT_AS_IS for x in self.open[-1:]) else re.sub(r"\s+", " ", raw)
            self.within += len(text.strip())
            pre = len(self.nodes)
            self.nodes.append([self.page, pre, pre, parent[1] if parent else -1, len(self.open) - 1, "#text", text, len(text.strip()), top[7], False, top[3], top[4][0], top[4][1], list(top[5]), *top[6]])

    def handle_starttag(self, tag, attrs):
        self.flush()
        style = next((v or "" for k, v in attrs if k == "style"), "")
        _, _, hidden, bold, size, blocks, line, in_table = self.open[-1]
        hidden = hidden or tag in UNSEEN or bool(HIDDEN.search(style))
        node = None
        if not hidden and not tag.startswith("ix:") and tag not in UNWRAPPED:
            node = len(self.nodes)
            parent = next((x[1] for x in reversed(self.open) if x[1] is not None), -1)
            own = SIZE.search(style) if tag == "span" else None
            if tag in BLOCKS:
                blocks = (*blocks, node)
            row = [self.page, node, node, parent, len(self.open) - 1, tag, None, self.within, in_table, tag in ("b", "strong") or bool(BOLD_AS_WRITTEN.search(style)), bold, float(own.group(1)) if own else None, size[1], list(blocks), *line]
            self.nodes.append(row)
            if tag in ("b", "strong") or BOLD.search(style):
                bold = node
            if own:
                size = (float(own.group(1)), node)
            if tag in LINES:
                line = (node, tag)
            in_table = in_table or tag == "table"
        if tag in VOID:
            if node is not None:
                self.nodes[node][7] = 0
        else:
            self.open.append((tag, node, hidden, bold, size, blocks, line, in_table))

    def handle_endtag(self, tag):
        if any(x[0] == tag for x in self.open):
            self.flush()
            while self.shut() != tag:
                pass

    def shut(self) -> str:
        tag, node, *_ = self.open.pop()
        if node is not None:
            self.nodes[node][2], self.nodes[node][7] = len(self.nodes) - 1, self.within - self.nodes[node][7]
        return tag

    def handle_data(self, data):
        self.data.append(data)

    def handle_comment(self, data):
        self.flush()

    def finish(self) -> list[list]:
        self.close()
        self.flush()
        while len(self.open) > 1:
            self.shut()
        return self.nodes


def nodes(pages: DataFrame) -> DataFrame:
    """The nodes of ``pages`` (page_id, html). Elements have their tag, the characters of the texts within (``solid``, each stripped), whether they are bold or (spans) sized themselves; texts have their
    tag ``#text`` and text, white space collapsed. ``bold_at`` and ``size_at`` are the nearest bold and sized elements around, -1 for none: one lies within a block if its
    number is not smaller than the block's. ``blocks`` are the blocks around, outermost first, a block itself included. Hidden elements and scripts are left out, ``ix:`` and
    font tags leave their content. A null page has no nodes. Pages are dealt out before they are parsed, since one file of them may be one task; the nodes are dealt out by page."""

    def told(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), NODE.types, strict=True)], schema=NODE)

    def run(batches):
        rows = []
        for batch in batches:
            for k in range(batch.num_rows):
                parser = Parser(batch.column(0)[k].as_py())
                parser.feed(batch.column(1)[k].as_py() or "")
                rows += parser.finish()
                if len(rows) >= BATCH:
                    yield told(rows)
                    rows = []
        if rows:
            yield told(rows)

    return pages.select(F.col("page_id").cast("long"), "html").repartition("page_id").mapInArrow(run, NODES).repartition("page_id")


def collapsed(text: Column) -> Column:
    return stripped(F.regexp_replace(text, rf"[{SPACE}]+", " "))


def body_sizes(tree: DataFrame) -> DataFrame:
    """(page_id, body_size): the size whose spans hold most characters, nested ones counted each; the first seen of equal ones."""
    by = tree.where("tag = 'span' and size is not null").groupBy("page_id", "size").agg(F.sum("solid").alias("chars"), F.min("pre").alias("first"))
    return by.groupBy("page_id").agg(F.max_by("size", F.struct("chars", -F.col("first"))).alias("body_size"))


def blocks(tree: DataFrame, texts: bool = False) -> DataFrame:
    """The blocks of a table of nodes: page_id, pre, last, parent, tag, in_table, solid; text (collapsed) and packed (its texts stripped and joined); size (that most of its characters have, of
    sizes set within it, the first of equal ones), has_bold (it or an element within), bold_only (a heading's form: div or p outside tables without another one or a table
    within, of 3 to 200 characters, no number, no sentence if over 30, every text bold by an element within or the block), holds_block (a block child holds text); and what ``beside`` told.

    With ``texts`` each text is a row too, with its tag ``#text``, its text as it is (raw) and its line.
    """
    is_text = F.col("tag") == "#text"
    # a text's own row has a number that no block has
    alone = -2 - F.col("pre")
    around = tree.withColumn("block", F.explode(F.when(is_text, F.concat("blocks", F.array(alone))).otherwise(F.col("blocks")) if texts else F.col("blocks")))
    own = F.col("block").isin(F.col("pre"), alone)
    run = F.struct("pre", "text", F.when(F.col("size_at") >= F.col("block"), F.col("size")).alias("size"), (F.col("bold_at") >= F.col("block")).alias("bold"), F.col("solid").alias("n"))
    node = F.struct("pre", "last", "parent", "tag", "in_table", "solid", *(c for c in ("before", "after", "body_size") if c in tree.columns), *([F.col("text").alias("raw"), "line_at", "line_tag"] if texts else []))
    by = around.groupBy("page_id", "block").agg(
        F.first(F.when(own, node), ignorenulls=True).alias("node"),
        F.sort_array(F.collect_list(F.when(is_text & ~own, run))).alias("runs"),
        F.max(F.col("bold")).alias("has_bold"),
        F.max(F.col("tag").isin(*NESTED) & ~own).alias("nests"),
        F.max(F.col("tag").isin(*BLOCKS) & (F.col("parent") == F.col("block")) & (F.col("solid") > 0)).alias("holds_block"),
    )
    full = F.filter("runs", lambda r: r["n"] > 0)
    sizes = F.array_distinct(F.filter(F.transform("full", lambda r: r["size"]), lambda x: x.isNotNull()))
    chars = lambda s: F.aggregate(F.filter("full", lambda r: r["size"] == s), F.lit(0), lambda a, r: a + r["n"])
    most = F.array_max(F.transform("sizes", lambda s, k: F.struct(chars(s).alias("chars"), (-k).alias("k"), s.alias("size"))))["size"]
    joined = F.array_join(F.transform("runs", lambda r: r["text"]), "")
    by = by.withColumns({"full": full, "joined": joined}).withColumn("sizes", sizes)
    packed = F.array_join(F.transform("full", lambda r: stripped(r["text"])), "")
    rows = by.select("page_id", "node.*", collapsed(F.col("joined")).alias("text"), packed.alias("packed"), most.alias("size"), "has_bold", "nests", "holds_block", (~F.exists("full", lambda r: ~r["bold"])).alias("all_bold"))
    n = F.length("packed")
    form = F.col("tag").isin("div", "p") & ~F.col("in_table") & ~F.col("nests") & n.between(3, 200) & ~F.col("packed").rlike(r"^\p{N}+$") & ((n <= 30) | ~F.col("packed").rlike(r"[.!?]\z"))
    return rows.withColumn("bold_only", form & F.col("all_bold")).drop("all_bold", "nests")


def beside(tree: DataFrame) -> DataFrame:
    """``tree`` with body_size (as ``body_sizes`` has it) and before and after, the tags of an element's nearest siblings that hold text."""
    same = Window.partitionBy("page_id", "of_size")
    sized = tree.withColumn("of_size", F.when(F.col("tag") == "span", F.col("size")))
    sized = sized.withColumns({"chars": F.sum("solid").over(same), "first": F.min("pre").over(same)})
    body = F.max(F.when(F.col("of_size").isNotNull(), F.struct("chars", (-F.col("first")).alias("first"), "of_size"))).over(Window.partitionBy("page_id"))
    # those without text stand apart
    w = Window.partitionBy("page_id", "parent", "holds").orderBy("pre")
    rows = sized.withColumn("body_size", body["of_size"]).withColumn("holds", (F.col("tag") != "#text") & (F.col("solid") > 0))
    return rows.withColumns({"before": F.lag("tag").over(w), "after": F.lead("tag").over(w)}).drop("of_size", "chars", "first", "holds")


def standing(tree: DataFrame, texts: bool = False) -> DataFrame:
    """``blocks`` with text and isolated (no block-like sibling with text beside it, outside tables and cells, sized, not smaller than the page's body) and strong (short and over a tenth larger); with ``texts`` also all texts."""
    rows = blocks(beside(tree), texts).where((F.col("solid") > 0) | (F.col("tag") == "#text"))
    near = lambda c: F.coalesce(F.col(c).isin(*NOT_BESIDE), F.lit(False))
    isolated = ~F.col("tag").isin("td", "th") & ~F.col("in_table") & F.col("size").isNotNull() & F.coalesce(F.col("size") >= F.col("body_size"), F.lit(True)) & ~near("before") & ~near("after")
    strong = F.coalesce((F.length("text") < 150) & (F.col("size") > F.col("body_size") * 1.1), F.lit(False))
    return rows.withColumns({"isolated": isolated, "strong": strong}).drop("before", "after", "body_size")


def so_far() -> WindowSpec:
    """A page's rows up to one, in order."""
    return Window.partitionBy("page_id").orderBy("pre").rowsBetween(Window.unboundedPreceding, Window.currentRow)


def item_starts(rows: DataFrame) -> DataFrame:
    """``rows`` with item_num, the item that a block names, and starts, whether the item's region starts there: at the last block of each item; those in tables before the first outside are a table of contents."""
    num = F.upper(F.regexp_extract("text", ITEM, 1))
    rows = rows.withColumn("item_num", F.when((F.col("tag") != "#text") & (num != ""), num))
    rows = rows.withColumn("starts", F.col("item_num").isNotNull() & (F.col("pre") == F.max("pre").over(Window.partitionBy("page_id", "item_num"))))
    rows = rows.withColumn("body", F.min(F.when(F.col("starts") & ~F.col("in_table"), F.col("pre"))).over(Window.partitionBy("page_id")))
    return rows.withColumn("starts", F.col("starts") & (F.col("body").isNull() | ~(F.col("in_table") & (F.col("pre") < F.col("body"))))).drop("body")


def item_regions(rows: DataFrame) -> DataFrame:
    """(page_id, item_num, start, end): the regions of ``item_starts``. A region ends where the next begins."""
    return item_starts(rows).where("starts").select("page_id", "item_num", F.col("pre").alias("start"), F.lead("pre").over(Window.partitionBy("page_id").orderBy("pre")).alias("end"))


def part_starts(rows: DataFrame) -> DataFrame:
    """``rows`` with part, the part that a bold block names, and anchor, whether it is the last of its part."""
    part = F.upper(F.regexp_extract("text", PART, 1))
    rows = rows.withColumn("part", F.when((F.col("tag") != "#text") & F.col("has_bold") & (part != ""), part))
    return rows.withColumn("anchor", F.col("part").isNotNull() & (F.col("pre") == F.max("pre").over(Window.partitionBy("page_id", "part"))))


def part_anchors(rows: DataFrame) -> DataFrame:
    """(page_id, part, pre): the last bold block of each part."""
    return part_starts(rows).where("anchor").select("page_id", "part", "pre")


def promoted(rows: DataFrame) -> DataFrame:
    """``standing`` blocks with level, null for none: parts at their anchors are 1, items where their region starts and they are bold, isolated or strong are 2; none that has a block child with text or
    another heading within. Such headings don't overlap. free tells blocks that are no heading and not within one."""
    rows = part_starts(item_starts(rows))
    part = F.col("text").rlike(PART)
    level = F.when(F.col("anchor"), 1).when(~part & F.col("starts") & (F.col("has_bold") | F.col("isolated") | F.col("strong")), 2)
    rows = rows.withColumn("level", F.when(F.col("page_id").isNotNull() & ~F.col("holds_block"), level)).withColumn("found", F.col("level").isNotNull())
    # the next one found is within it if any is
    inner = F.lead("pre").over(Window.partitionBy("page_id", "found").orderBy("pre"))
    rows = rows.withColumn("inner", inner).withColumn("level", F.when(F.col("inner").isNull() | (F.col("inner") > F.col("last")), F.col("level")))
    until = F.max(F.when(F.col("level").isNotNull(), F.col("last"))).over(so_far())
    return rows.withColumn("until", until).withColumn("free", (F.col("tag") != "#text") & (F.col("until").isNull() | (F.col("until") < F.col("pre")))).drop("found", "inner", "until", "part", "anchor")


def noise(rows: DataFrame) -> DataFrame:
    """(page_id, packed): short texts of four blocks or more, such as running heads."""
    return rows.where(F.length("packed").between(3, 50)).groupBy("page_id", "packed").count().where(F.col("count") >= REPEATS).select("page_id", "packed")


def subsections(rows: DataFrame) -> DataFrame:
    """``promoted`` rows with sub, null for none: bold-only sized blocks in item regions that are no noise and name no item; their sizes from large to small are levels 3, 4 and 5 of the region.

    A region is entered at its first block if that is a div, a p or a heading by now; a block around a heading is none itself.
    """
    enters = F.col("starts") & (F.col("level").isNotNull() | F.col("tag").isin("div", "p"))
    same = F.count(F.when(F.col("free"), 1)).over(Window.partitionBy("page_id", "packed"))
    rows = rows.withColumn("noise", F.length("packed").between(3, 50) & (same >= REPEATS)).withColumn("region", F.last(F.when(enters, F.col("item_num")), ignorenulls=True).over(so_far()))
    own = F.col("free") & F.col("bold_only") & F.col("size").isNotNull() & ~F.col("packed").rlike(ITEM_NAME) & ~F.col("noise") & ~enters & F.col("region").isNotNull() & F.col("page_id").isNotNull()
    rows = rows.withColumn("own", own)
    rank = F.dense_rank().over(Window.partitionBy("page_id", "region", "own").orderBy(F.desc("size")))
    return rows.withColumn("sub", F.when(F.col("own"), F.least(rank, F.lit(3)) + 2)).drop("noise", "region", "own")


def headings(tree: DataFrame) -> DataFrame:
    """(page_id, pre, level, text): all headings of the pages."""
    rows = subsections(promoted(standing(tree))).where("level is not null or sub is not null")
    return rows.select("page_id", "pre", F.coalesce("level", "sub").alias("level"), F.when(F.col("level").isNotNull(), F.col("text")).otherwise(F.col("packed")).alias("text"))


def emitted(tree: DataFrame) -> DataFrame:
    """(page_id, markdown): the texts of each line-like element (or else of their parent) as one paragraph, in order; headings, found or written as such, with as many ``#`` as their level."""
    rows = subsections(promoted(standing(tree, texts=True)))
    # neither the promoted nor the subsections overlap among themselves, so the last that began is the one around, if it hasn't ended
    last = lambda level, text: F.last(F.when(F.col(level).isNotNull(), F.struct("pre", "last", F.col(level).alias("level"), F.col(text).alias("text"))), ignorenulls=True).over(so_far())
    texts = rows.withColumns({"one": last("level", "text"), "other": last("sub", "packed")}).where("tag = '#text'")
    texts = texts.withColumn("found", F.when(F.col("one.last") >= F.col("pre"), F.col("one")).when(F.col("other.last") >= F.col("pre"), F.col("other")))
    texts = texts.withColumn("of", F.coalesce("found.pre", F.when(F.col("line_at") >= 0, F.col("line_at")).otherwise(F.col("parent"))))
    native = F.when(F.col("line_tag").rlike("^h[1-6]$"), F.substring("line_tag", 2, 1).cast("int"))
    lines = texts.groupBy("page_id", "of").agg(F.min("pre").alias("at"), F.first("found").alias("found"), F.first(native).alias("native"), F.sort_array(F.collect_list(F.struct("pre", F.col("raw").alias("text")))).alias("l"))
    level = F.coalesce("found.level", "native")
    line = F.coalesce("found.text", collapsed(F.array_join(F.transform("l", lambda x: x["text"]), "")))
    marked = F.concat(F.when(level.isNotNull(), F.concat(F.repeat(F.lit("#"), level), F.lit(" "))).otherwise(""), F.col("line"))
    by = lines.withColumn("line", line).where("line <> ''").groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("at", marked.alias("line")))).alias("l"))
    return by.select("page_id", F.array_join(F.transform("l", lambda x: x["line"]), "\n\n").alias("markdown"))


#: Filings: a contents table, parts and items in several forms, sized and bold subsections, running heads and hidden parts, around the given page's own markup.
FILINGS = """SELECT page_id, concat('<html><body><table><tr><td>Item 1. Business</td><td>Item 1A. Risks</td><td>Item 9. Later</td></tr></table><div style="font-weight:bold">PART I</div><div><font><span style="font-size:12pt;font-weight:700">Item&nbsp;1.</span><span style="font-size:12pt"> Business</span></font></div>',
  '<p><span style="font-size:10pt">', url, ' tells of its business at length.</span></p><div style="display:none">Item 3. Hidden</div><div>Running head</div><div><b><span style="font-size:14pt">Overview ', page_id % 7, '</span></b></div>',
  '<div style="margin-top:6pt"></div><p style="font-weight:700"><span style="font-size:', 11 + page_id % 3, 'pt">Products of the year</span><span style="font-size:6pt">(1)</span></p>', html, '<div>Running head</div><div><p><b>PART', chr(10), 'II</b></p></div>',
  CASE WHEN page_id % 2 = 0 THEN '<section><p>x</p><div><span style="font-size:12.5pt"><ix:nonnumeric>Item 1A.</ix:nonnumeric> Risk Factors</span></div></section>' ELSE '<div><div>Item 1A. Risk Factors</div>and more</div>' END,
  '<div>Running head</div><p><b><span style="font-size:10pt">Running head</span></b></p><div style="FONT-WEIGHT: bold"><span style="font-size:9pt">Competition</span></div><p><b>12</b></p><p><b>A sentence that is long enough to be one.</b></p><span style="font-size:10pt">', substr(url, 1, 40), '</span></body></html>') AS html FROM pages"""


def filings(spark, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, FILINGS, "pages")


def of_tree(f):
    return lambda spark, sf_dir: f(nodes(filings(spark, sf_dir)))


def node_table(spark, sf_dir: str) -> DataFrame:
    return nodes(filings(spark, sf_dir)).select("page_id", "pre", "last", "parent", "depth", "tag", F.md5("text").alias("text_md5"), "solid", "in_table", "bold_at", "size", "size_at", F.size("blocks").alias("n_blocks"))


def block_table(tree: DataFrame) -> DataFrame:
    return standing(tree).select("page_id", "pre", "last", "parent", "tag", F.md5("text").alias("text_md5"), "size", "has_bold", "bold_only", "holds_block", "isolated", "strong")


def markdown_digest(tree: DataFrame) -> DataFrame:
    rows = emitted(tree)
    told = bound(F.col("markdown"), lambda m: F.struct(F.md5(m).alias("markdown_md5"), F.length(m).alias("n_chars")))
    return rows.select("page_id", told.alias("t")).select("page_id", "t.*")


QUERIES = {
    "h1_tree": node_table,
    "h3_page_body_sizes": of_tree(body_sizes),
    "h5_page_blocks": of_tree(block_table),
    "h6_page_regions": of_tree(lambda t: item_regions(blocks(t))),
    "h7_page_parts": of_tree(lambda t: part_anchors(blocks(t))),
    "h11_page_noise": of_tree(lambda t: noise(blocks(t))),
    "h12_page_headings": of_tree(headings),
    "h13_page_markdown": of_tree(markdown_digest),
}
#: DuckDB has no parser of HTML; tests compare these with a plain walk over the page's objects.
ORACLE_SQL: dict[str, str] = {}
