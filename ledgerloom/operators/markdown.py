"""Cleaning of filings' Markdown, rule by rule, and profiles of it; the queries read Markdown derived from ``documents``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import SPACE, SQL_SPACE, bound, stripped
from ..sources import derived
from .sections import _POINTERS, FEW, POINTER, remaining, sql_remaining, sql_strip

PART_I, ITEM_1 = r"(?m)^# (?:PART|Part) I\b", r"(?m)^## (?:ITEM|Item) 1\b"
PAGE = r"(?m)^[ \t]*\d*[ \t]*\n---[ \t]*(?:\n|\z)(?:\[Table of Contents\]\([^)]+\)[ \t]*(?:\n|\z))?"
#: Abbreviations that keep their capitals, and words that stay small after the first.
ABBREVIATIONS = ("MD&A", "SEC", "U.S.", "U.S", "R&D", "CEO", "CFO", "CTO", "ESG", "AI", "IT", "IPO")
SMALL = ("of", "the", "and", "for", "to", "in", "on", "at", "by", "a", "an", "or", "as", "is")
#: White space but for line ends, for the inside of brackets.
BLANK = rf"{SPACE}&&[^\n]"


def front(md: Column) -> Column:
    return F.regexp_extract(md, r"(?s)\A(---\n.*?\n---\n)", 1)


def anchor_type(md: Column) -> Column:
    body = F.substring(md, F.length(front(md)) + 1, F.length(md))
    return F.when(body.rlike(PART_I), "part").when(body.rlike(ITEM_1), "item").otherwise("none")


def strip_cover(md: Column) -> Column:
    """Without what stands before the first Part I, else the first Item 1; front matter stays, and all stays without either."""
    body = F.substring(md, F.length(front(md)) + 1, F.length(md))
    cut = lambda at: F.regexp_replace(body, r"(?ms)\A.*?(?=" + at.removeprefix("(?m)") + ")", "")
    return F.when(anchor_type(md) == "none", md).otherwise(F.concat(front(md), F.when(body.rlike(PART_I), cut(PART_I)).otherwise(cut(ITEM_1))))


def strip_pages(md: Column) -> Column:
    return F.regexp_replace(md, PAGE, "")


def section_list(md: Column) -> Column:
    """The text cut before each heading of level 1 or 2; joined, it is the text. The first part stands before any heading and may be empty."""
    return F.concat(F.when(md.rlike(r"\A#{1,2} "), F.array(F.lit(""))).otherwise(F.array().cast("array<string>")), F.split(md, r"(?m)^(?=#{1,2} )"))


def is_part_three(section: Column) -> Column:
    return section.rlike(r"\A## (?:ITEM|Item) 1[0-4]\b[^\n]*\n")


def is_stub(section: Column) -> Column:
    empty_or_pointing = lambda body: ~body.rlike(rf"[^{SPACE}]") | (body.rlike("(?i)" + POINTER) & (remaining(body) < FEW))
    return is_part_three(section) & bound(F.regexp_replace(section, r"\A[^\n]*\n", ""), empty_or_pointing)


def strip_stubs(md: Column) -> Column:
    """Without the sections of items 10 to 14 that are empty or only point elsewhere."""
    return F.array_join(F.filter(section_list(md), lambda s: ~is_stub(s)), "")


def merge_titles(md: Column) -> Column:
    """A bare item heading takes the next line that isn't blank, if that is a short title, plain or as a bullet: all capitals or each word capitalised."""
    small = "(?i:" + "|".join(SMALL) + rf")(?=[{SPACE}]|$)"
    cased = rf"\p{{Lu}}[^{SPACE}]*(?:[{BLANK}]+(?:{small}|\p{{Lu}}[^{SPACE}]*))*"
    capitals = rf"(?=[^\n]*\p{{Lu}})[^\p{{Ll}}\n]*[^\p{{Ll}}{SPACE}]"
    # possessive, so that no run of blank lines is deep
    pattern = rf"(?m)^(## (?:ITEM|Item)[{BLANK}]++\d+[A-Z]?)\.?[ \t]*+\n(?:[{BLANK}]*+\n)*+[{BLANK}]*+(?:- [{BLANK}]*+)?(?![#|]|```|- )(?=[^\n]{{1,99}}$)({cased}|{capitals})[{BLANK}]*$"
    return F.regexp_replace(md, pattern, "$1. $2")


def capitalised(word: Column) -> Column:
    """First letter of each hyphened part large, the rest small; what follows an apostrophe is small."""
    one = lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substring(x, F.lit(2), F.length(x))))
    head = F.substring_index(word, "'", 1)
    return F.concat(F.array_join(F.transform(F.split(head, "-"), one), "-"), F.lower(F.substring(word, F.length(head) + 1, F.length(word))))


def title_case(title: Column) -> Column:
    words = F.split(title, r"\s+")
    bare = lambda w, marks: F.regexp_replace(F.lower(w), rf"^[{marks}]+|[{marks}]+$", "").isin(*SMALL)
    off = F.exists(F.transform(words, lambda w, k: ~((k > 0) & bare(w, ".,;:'\"")) & ~F.upper(w).isin(*ABBREVIATIONS) & w.rlike(r"^\p{L}") & ~w.rlike(r"^\p{Lu}")), lambda x: x)
    wrong = ~(title.rlike(r"\p{Lu}") & title.rlike(r"\p{Ll}")) | off
    fixed = F.transform(words, lambda w, k: F.when(F.upper(w).isin(*ABBREVIATIONS), F.upper(w)).when((k > 0) & bare(w, ".,;:"), F.lower(w)).otherwise(capitalised(w)))
    return F.when(wrong, F.array_join(fixed, " ")).otherwise(title)


def normal_headings(md: Column) -> Column:
    """``# Part II`` and ``## Item 1A. Title`` in one form, titles in title case."""
    parts = F.regexp_replace(md, r"(?m)^# (?:PART|Part)\s+([IVX]+)\b\.?[ \t]*$", "# Part $1")
    item = r"^## (?:ITEM|Item)\s+(\d+[A-Z]?)\.?[ \t]*(.*)$"

    def line(x: Column) -> Column:
        title = stripped(F.regexp_extract(x, item, 2))
        head = F.concat(F.lit("## Item "), F.regexp_extract(x, item, 1), F.lit("."))
        return F.when(~x.rlike(item), x).when(title == "", head).otherwise(F.concat(head, F.lit(" "), title_case(title)))

    return F.array_join(F.transform(F.split(parts, "\n"), line), "\n")


#: The rules in their order.
RULES = (strip_cover, strip_pages, strip_stubs, merge_titles, normal_headings)


def clean(md: Column) -> Column:
    """All rules; each one's result is computed once."""
    return reduce(bound, RULES, md)


MD = """SELECT doc_id, concat(CASE doc_id % 4 WHEN 0 THEN concat('Cover page', chr(10), '# PART I', chr(10)) WHEN 1 THEN concat('Cover', chr(10)) WHEN 2 THEN concat('---', chr(10), 'title: x', chr(10), '---', chr(10), 'Cover', chr(10), '# Part I.', chr(10)) ELSE '' END,
  CASE WHEN doc_id % 4 < 3 THEN concat('## ITEM 1.', chr(10), chr(10), 'BUSINESS OVERVIEW', chr(10)) ELSE concat('## Overview', chr(10)) END, text, chr(10), '12', chr(10), '---', chr(10), '[Table of Contents](#toc)', chr(10),
  '## Item 1A. RISK FACTORS AND THE COMPANY''S 10-K FOR SEC', chr(10), text, chr(10), chr(10), '---', chr(10), '# PART III', chr(10), '## ITEM 10.', chr(10), '- DIRECTORS, EXECUTIVE OFFICERS', chr(10), 'Incorporated herein by reference to the proxy.', chr(10),
  '## Item 11. Executive compensation', chr(10), 'The rest is incorporated by reference. ', text, chr(10), '## Item 12. Ownership', chr(10), chr(10), '## Item 14. FEES', chr(10), 'A short body.', chr(10), '## ITEM 15.', chr(10), 'Exhibits and Other Schedules', chr(10), '| --- | --- |', chr(10), text, chr(10), '---') AS md FROM documents"""


def source(spark, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, MD, "documents")


def ruled(rule):
    def query(spark, sf_dir: str) -> DataFrame:
        out = bound(bound(F.col("md"), rule), lambda x: F.struct(F.md5(x).alias("md5"), F.length(x).alias("n_chars")))
        return source(spark, sf_dir).select("doc_id", out.alias("out")).select("doc_id", "out.*")

    return query


def stub_sections(spark, sf_dir: str) -> DataFrame:
    """Each section of items 10 to 14: what remains of it and whether it is a stub."""
    s = source(spark, sf_dir).select("doc_id", F.posexplode(section_list(F.col("md"))).alias("place", "s")).where(is_part_three(F.col("s")))
    return s.select("doc_id", "place", remaining(F.regexp_replace("s", r"\A[^\n]*\n", "")).alias("remaining"), is_stub(F.col("s")).alias("is_stub"))


def profile(spark, sf_dir: str) -> DataFrame:
    """Of each filing: links to the contents, bare dashes, page and table separators, items 10 to 14 by kind, later items, and the anchor."""
    s = source(spark, sf_dir)
    count = lambda p: F.regexp_count("md", F.lit(p))

    def kinds(parts: Column) -> Column:
        kind = F.transform(parts, lambda x: F.when(is_stub(x), "stub").when(x.rlike("(?i)" + POINTER), "hybrid").otherwise("real"))
        of = lambda all_, name: F.size(F.filter(all_, lambda x: x == name)).alias(f"n_{name}")
        return bound(kind, lambda k: F.struct(*(of(k, name) for name in ("stub", "hybrid", "real"))))

    s = s.withColumn("kinds", bound(F.filter(section_list(F.col("md")), is_part_three), kinds))
    return s.select(
        "doc_id", count(r"\[Table of Contents\]\([^)]+\)").alias("n_links"), count(r"(?m)^---[ \t]*$").alias("n_dashes"), count(PAGE).alias("n_pages"), count(r"(?m)^\|[ \-:|]+\|[ \t]*$").alias("n_tables"),
        "kinds.*", F.col("md").rlike(r"(?m)^## (?:ITEM|Item) (?:1C|9[ABC])\b").alias("has_late"), anchor_type(F.col("md")).alias("anchor"),
    )


def variants(spark, sf_dir: str) -> DataFrame:
    """Kinds of headings over the corpus: how many, the first three, and how many have an empty or a very short title."""
    lines = source(spark, sf_dir).select("doc_id", F.posexplode(F.split("md", "\n")).alias("line_idx", "line")).where(F.col("line").rlike("^#{1,6} "))
    item = r"^## (?:ITEM|Item)\s+\d+[A-Z]?\.?[ \t]*(.*)$"
    kind = F.when(F.col("line").rlike("^# PART"), "PART").when(F.col("line").rlike("^# Part"), "Part").when(F.col("line").rlike("^## ITEM"), "ITEM").when(F.col("line").rlike("^## Item"), "Item").otherwise("other")
    title = stripped(F.regexp_extract("line", item, 1))
    rows = lines.select("doc_id", "line_idx", "line", kind.alias("kind"), title.alias("title"))
    by = rows.groupBy("kind").agg(F.count("*").alias("n"), F.count_if(F.col("kind").isin("ITEM", "Item") & (F.col("title") == "")).alias("n_empty"), F.count_if(F.length("title").between(1, 4)).alias("n_short"))
    # three of each task's rows before the last ranking
    first = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(64)))
    for keys in (["kind", "salt"], ["kind"]):
        first = first.withColumn("p", F.row_number().over(Window.partitionBy(*keys).orderBy("doc_id", "line_idx"))).where("p <= 3")
    samples = first.groupBy("kind").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "line_idx", "line"))), lambda x: x["line"]), "; ").alias("samples"))
    return by.join(samples, "kind")


#: Headings of parts and items as a report reads them; an empty rest of the line takes the next text.
PART_HEADING, ITEM_HEADING = (r"(?m)^#{{1,3}} (?:PART|Part){s}+[IVX]+\.?{s}*[^\n]*$", r"(?m)^#{{1,4}} (?:ITEM|Item){s}+\d+[A-Z]?\.?{s}*[^\n]*$")
ITEM_TITLE = r"\A#{{1,4}} (?:ITEM|Item){s}+\d+[A-Z]?\.?{s}*([^\n]*)\z"
TABLE_RISK = r"(?m)^[ \t]*\d*[ \t]*\n\|[ \-:|]+\|[ \t]*$"
_J = f"[{SPACE}]"


def part_variant(line: Column) -> Column:
    """How a part's heading is written: UPPER or Mixed, with a period or not; Standard is ``Part I``."""
    upper, period = line.rlike(r"^#+ PART"), stripped(line).endswith(".")
    return F.when(upper & period, "UPPER+period").when(upper, "UPPER").when(period, "Mixed+period").otherwise("Standard")


def item_title(line: Column) -> Column:
    return stripped(F.regexp_extract(line, ITEM_TITLE.format(s=_J), 1))


def item_variant(line: Column) -> Column:
    """How an item's heading is written: without a title, in capitals (its title glued to the number, in capitals or not), or with a title alone in capitals."""
    upper, glued = line.rlike(r"^#+ ITEM"), line.rlike(r"\d+[A-Z]?\.[A-Za-z]")

    def of(title: Column) -> Column:
        capitals = title.rlike(r"\p{Lu}") & ~title.rlike(r"\p{Ll}")
        return (
            F.when(title == "", "empty-title").when(upper & glued, "UPPER+nospace").when(upper & capitals, "UPPER+UPPERtitle").when(upper, "UPPER+mixedtitle").when(capitals, "Item+UPPERtitle").otherwise("Standard")
        )

    return bound(item_title(line), of)


def body_of(md: Column) -> Column:
    return F.substring(md, F.length(front(md)) + 1, F.length(md))


def short_titles(markdown: DataFrame) -> DataFrame:
    """(doc_id, line_idx, heading): item headings of Markdown (doc_id, md), normalised, whose title has one to four characters; a converter may have dropped the rest."""
    lines = markdown.select("doc_id", F.posexplode(F.split(normal_headings(F.col("md")), "\n")).alias("line_idx", "heading"))
    title = stripped(F.regexp_extract("heading", r"^## Item \d+[A-Z]?\.(.*)$", 1))
    return lines.where(F.length(title).between(1, 4))


def heading_variants(markdown: DataFrame) -> DataFrame:
    """(kind, variant, n, samples) over Markdown (doc_id, md): headings of parts and items by how they are written, with the first three by doc_id and place."""
    body = body_of(F.col("md"))
    all_ = lambda pattern, kind, variant: F.transform(F.regexp_extract_all(body, F.lit(pattern.format(s=_J)), F.lit(0)), lambda x, k: F.struct(k.alias("place"), F.lit(kind).alias("kind"), variant(x).alias("variant"), stripped(x).alias("line")))
    rows = markdown.select("doc_id", F.inline(F.concat(all_(PART_HEADING, "part", part_variant), all_(ITEM_HEADING, "item", item_variant))))
    by = rows.groupBy("kind", "variant").agg(F.count("*").alias("n"))
    first = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(64)))
    for keys in (["kind", "variant", "salt"], ["kind", "variant"]):  # three of each task's rows before the last ranking
        first = first.withColumn("p", F.row_number().over(Window.partitionBy(*keys).orderBy("doc_id", "place"))).where("p <= 3")
    samples = first.groupBy("kind", "variant").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "place", "line"))), lambda x: x["line"]), "; ").alias("samples"))
    return by.join(samples, ["kind", "variant"])


def audit(markdown: DataFrame) -> DataFrame:
    """Per filing (doc_id, md): headings whose title has one to four characters or none, dashes that no page separator explains (dash_gap; over five is wide), table separators that could
    be taken for a page's, and whether items 1C, 9A, 9B and 9C are there, 1C as a stub: it points elsewhere or has under 200 characters."""
    body = body_of(F.col("md"))
    titles = F.transform(F.regexp_extract_all(body, F.lit(ITEM_HEADING.format(s=_J)), F.lit(0)), lambda x: F.rtrim(stripped(item_title(x)), F.lit(".")))
    count = lambda p: F.regexp_count("b", F.lit(p))
    sections = F.filter(F.split("b", r"(?m)^(?=#{1,4} )"), lambda x: x.rlike(rf"\A#{{1,4}} (?:ITEM|Item){_J}+(?:1C|9A|9B|9C)\b[^\n]*\n"))
    number = lambda x: F.regexp_extract(x, rf"\A#{{1,4}} (?:ITEM|Item){_J}+(\d+[A-Z])", 1)
    late = F.transform(sections, lambda x: bound(stripped(F.regexp_replace(x, r"\A[^\n]*\n", "")), lambda t: F.struct(number(x).alias("item"), (t.rlike("(?i)" + POINTER) | (F.length(t) < 200)).alias("stub"))))
    rows = markdown.select("doc_id", body.alias("b"), titles.alias("titles")).withColumn("late", late)
    size = lambda test: F.size(F.filter("titles", test))
    has = lambda item: F.exists("late", lambda x: x["item"] == item).alias(f"has_{item.lower()}")
    gap = count(r"(?m)^---[ \t]*$") - count(PAGE)
    return rows.select(
        "doc_id", size(lambda t: F.length(stripped(t)).between(1, 4)).alias("n_truncated"), size(lambda t: stripped(t) == "").alias("n_empty"), gap.alias("dash_gap"), (gap > 5).alias("wide_gap"),
        F.regexp_count(F.concat(F.lit("\n"), F.col("b")), F.lit(TABLE_RISK)).alias("n_table_risks"), *(has(x) for x in ("1C", "9A", "9B", "9C")), F.exists("late", lambda x: (x["item"] == "1C") & x["stub"]).alias("stub_1c"),
    )


#: Markdown as MD, with headings of every variant, odd table separators and late items.
VARIED = f"""SELECT doc_id, concat(md, chr(10), CASE doc_id % 4 WHEN 0 THEN '# PART II.' WHEN 1 THEN '# Part II.' WHEN 2 THEN '## PART II' ELSE '# Part II Other' END, chr(10), 'x', chr(10), CASE doc_id % 6 WHEN 0 THEN '## ITEM 1C.CYBER' WHEN 1 THEN '## Item 1C. CYBER' WHEN 2 THEN '### ITEM 1C. Cyber' WHEN 3 THEN '## ITEM 1C. CYBER RISK'
  WHEN 4 THEN '## Item 1C' ELSE '#### Item 9B. Oth.' END, chr(10), CASE WHEN doc_id % 5 = 0 THEN 'It is incorporated by reference.' ELSE '' END, chr(10), '12', chr(10), '| -- | :-: |', chr(10), CASE WHEN doc_id % 3 = 0 THEN concat('---', chr(10), '---', chr(10), 'y', chr(10), '---', chr(10), 'y', chr(10), '---', chr(10), 'y', chr(10), '---', chr(10), 'y', chr(10), '---', chr(10), 'y', chr(10), '---', chr(10)) ELSE text END,
  CASE WHEN doc_id % 2 = 0 THEN concat(chr(10), '## Item 9A. Controls', chr(10), text, chr(10), '## Item 16.') ELSE '' END) AS md FROM (SELECT m.doc_id, m.md, d.text FROM ({MD}) m JOIN documents d ON m.doc_id = d.doc_id)"""


def varied(spark, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, VARIED, "documents")


def outline(markdown: DataFrame) -> DataFrame:
    """(doc_id, node, header_path, text_md5) of Markdown (doc_id, md): a node is a heading with the lines up to the next, or what stands before the first, unless blank. Its path is
    the open headings above it and its own: a heading closes those of its level and deeper. Lines between fences are no headings. A slash in a heading parts it, and a heading isn't repeated after an equal one."""
    rows = markdown.select("doc_id", F.posexplode(F.split("md", "\n")).alias("line_idx", "line"))
    w = Window.partitionBy("doc_id").orderBy("line_idx")
    rows = rows.withColumn("fenced", F.count_if(F.col("line").startswith("```")).over(w) % 2 == 1)
    level = F.length(F.regexp_extract("line", r"^(#{1,6}) +(.*[^ ].*)$", 1))
    rows = rows.withColumn("level", F.when(~F.col("fenced") & (level > 0), level)).withColumn("title", F.when(F.col("level").isNotNull(), stripped(F.regexp_extract("line", r"^#{1,6} +(.*)$", 1))))
    rows = rows.withColumn("node", F.count("level").over(w))
    heads = rows.where("level is not null").select("doc_id", "node", "line_idx", "level", "title")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    last = {}
    for k in range(1, 6):  # the last heading of each level, and the last of a higher level, which closes it
        last[f"h{k}"] = F.last(F.when(F.col("level") == k, F.struct("line_idx", "title")), ignorenulls=True).over(before)
        last[f"above{k}"] = F.last(F.when(F.col("level") < k, F.col("line_idx")), ignorenulls=True).over(before)
    heads = heads.withColumns(last)
    open_ = [F.when((F.col("level") > k) & (F.col(f"h{k}.line_idx") > F.coalesce(F.col(f"above{k}"), F.lit(-1))), F.col(f"h{k}.title")) for k in range(1, 6)]
    parts = F.filter(F.flatten(F.transform(F.array_compact(F.array(*open_)), lambda x: F.split(x, "/"))), lambda x: x != "")
    path = bound(parts, lambda p: F.array_join(F.when(F.get(p, F.size(p) - 1).eqNullSafe(F.col("title")), p).otherwise(F.array_append(p, F.col("title"))), " / "))
    texts = rows.groupBy("doc_id", "node").agg(F.array_sort(F.collect_list(F.struct("line_idx", "line"))).alias("l")).select("doc_id", "node", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("text"))
    out = texts.join(heads.select("doc_id", "node", path.alias("header_path")), ["doc_id", "node"], "left").where((F.col("node") > 0) | (stripped("text") != ""))
    return out.select("doc_id", "node", F.coalesce("header_path", F.lit("")).alias("header_path"), F.md5("text").alias("text_md5"))


def nested(spark, sf_dir: str) -> DataFrame:
    return outline(derived(spark, sf_dir, NESTED, "documents"))


#: Markdown with headings of all levels, slashes, repeats and a fence around the documents' texts.
NESTED = """SELECT doc_id, concat(CASE WHEN doc_id % 3 = 0 THEN '' ELSE concat('Intro ', source, chr(10)) END, '# Annual ', source, chr(10), text, chr(10), '### Deep ', doc_id % 4, chr(10), text, chr(10), '## Part/Whole', chr(10), '### Below', chr(10), 'x', chr(10), '### Below', chr(10), '#### Below', chr(10), '```', chr(10), '# not one', chr(10), '```', chr(10),
  CASE WHEN doc_id % 2 = 0 THEN '# Second' ELSE '## Second' END, chr(10), text, chr(10), '###### Six', chr(10), '#no heading', chr(10), '##### Five') AS md FROM documents"""

_BODY = "substr(md, length(regexp_extract(md, '(?s)\\A(---\\n.*?\\n---\\n)', 1)) + 1)"
_P1, _I1 = "^# (?:PART|Part) I\\b", "^## (?:ITEM|Item) 1\\b"
_ANCHOR = f"CASE WHEN regexp_matches({_BODY}, '(?m){_P1}') THEN 'part' WHEN regexp_matches({_BODY}, '(?m){_I1}') THEN 'item' ELSE 'none' END"
_STUBBED = "regexp_matches(s, '\\A## (?:ITEM|Item) 1[0-4]\\b[^\\n]*\\n')"
_REST = "regexp_replace(s, '\\A[^\\n]*\\n', '')"
_LEFT = sql_remaining(_REST, _POINTERS[:1])
_IS_STUB = f"({_STUBBED} AND (NOT regexp_matches({_REST}, '\\S') OR (regexp_matches({_REST}, '(?i){_POINTERS[0]}') AND {_LEFT} < {FEW})))"
_SECTIONS = "string_split(regexp_replace(md, '(?m)^(#{1,2} )', chr(1) || '\\1', 'g'), chr(1))"
_SMALL = "|".join(SMALL)
_ABBREVIATIONS = ", ".join(f"'{x}'" for x in ABBREVIATIONS)


def _sql_clean(upto: int, only: int | None = None) -> str:
    rules = (
        f"CASE WHEN {_ANCHOR} = 'none' THEN md ELSE regexp_extract(md, '(?s)\\A(---\\n.*?\\n---\\n)', 1) || CASE WHEN {_ANCHOR} = 'part' THEN regexp_replace({_BODY}, '(?ms)\\A.*?({_P1})', '\\1') ELSE regexp_replace({_BODY}, '(?ms)\\A.*?({_I1})', '\\1') END END",
        f"regexp_replace(md, '{PAGE}', '', 'g')",
        f"array_to_string(list_filter({_SECTIONS}, lambda s: NOT {_IS_STUB}), '')",
        f"regexp_replace(md, '(?m)^(## (?:ITEM|Item)[ \\t]+\\d+[A-Z]?)\\.?[ \\t]*\\n(?:[ \\t]*\\n)*[ \\t]*(?:- )?(\\p{{Lu}}[^\\p{{Ll}}\\n]*[^\\p{{Ll}}\\s]|\\p{{Lu}}\\S*(?:[ \\t]+(?:(?i:{_SMALL})|\\p{{Lu}}\\S*))*)[ \\t]*$', '\\1. \\2', 'g')",
        f"""array_to_string(list_transform(string_split(regexp_replace(md, '(?m)^# (?:PART|Part)\\s+([IVX]+)\\b\\.?[ \\t]*$', '# Part \\1', 'g'), chr(10)), lambda x: CASE WHEN NOT regexp_matches(x, '^## (?:ITEM|Item)\\s+(\\d+[A-Z]?)') THEN x
          ELSE '## Item ' || regexp_extract(x, '^## (?:ITEM|Item)\\s+(\\d+[A-Z]?)', 1) || '.' || CASE WHEN regexp_matches(x, '^## (?:ITEM|Item)\\s+\\d+[A-Z]?\\.?[ \\t]*$') THEN '' ELSE ' ' ||
          CASE WHEN NOT (regexp_matches(t(x), '\\p{{Lu}}') AND regexp_matches(t(x), '\\p{{Ll}}')) OR len(list_filter(string_split_regex(t(x), '\\s+')[2:], lambda w: NOT regexp_matches(lower(w), '^[.,;:]*({_SMALL})[.,;:]*$') AND upper(w) NOT IN ({_ABBREVIATIONS}) AND regexp_matches(w, '^\\p{{Ll}}'))) > 0 OR regexp_matches(t(x), '^\\p{{Ll}}')
          THEN array_to_string(list_transform(string_split_regex(t(x), '\\s+'), lambda w, k: CASE WHEN upper(w) IN ({_ABBREVIATIONS}) THEN upper(w) WHEN k > 1 AND regexp_matches(lower(w), '^[.,;:]*({_SMALL})[.,;:]*$') THEN lower(w)
            ELSE array_to_string(list_transform(string_split(string_split(w, '''')[1], '-'), lambda g: upper(g[1]) || lower(g[2:])), '-') || lower(w[length(string_split(w, '''')[1]) + 1:]) END), ' ') ELSE t(x) END END END), chr(10))""",
    )
    sql = f"({MD})"
    for k, rule in enumerate(rules):
        if k == only or only is None and k < upto:
            sql = f"(SELECT doc_id, {_with_titles(rule)} AS md FROM {sql})"
    return sql


def _with_titles(rule: str) -> str:
    return rule.replace("t(x)", "trim(regexp_extract(x, '^## (?:ITEM|Item)\\s+\\d+[A-Z]?\\.?[ \\t]*(.*)$', 1))")


def _digest(sql: str) -> str:
    return f"SELECT doc_id, md5(md) AS md5, CAST(length(md) AS INTEGER) AS n_chars FROM {sql}"


def _count(pattern: str) -> str:
    return f"CAST(len(regexp_extract_all(md, '{pattern}')) AS INTEGER)"


_KIND = "CASE WHEN line LIKE '# PART%' THEN 'PART' WHEN line LIKE '# Part%' THEN 'Part' WHEN line LIKE '## ITEM%' THEN 'ITEM' WHEN line LIKE '## Item%' THEN 'Item' ELSE 'other' END"
_LINES = f"""SELECT *, {_KIND} AS kind, trim(regexp_extract(line, '^## (?:ITEM|Item)\\s+\\d+[A-Z]?\\.?[ \\t]*(.*)$', 1)) AS title FROM (SELECT doc_id, unnest(string_split(md, chr(10))) AS line, generate_subscripts(string_split(md, chr(10)), 1) AS k FROM ({MD})) WHERE regexp_matches(line, '^#{{1,6}} ')"""

QUERIES = {
    "m1_cover_strip": ruled(strip_cover), "m2_page_separators": ruled(strip_pages), "m3_part_three_stubs": ruled(strip_stubs), "m4_stub_sections": stub_sections, "m5_split_titles": ruled(merge_titles),
    "m6_headings": ruled(normal_headings), "m7_clean": ruled(clean), "m8_profile": profile, "m9_heading_variants": variants,
    "c4_outline": nested,
    "m9_variant_report": lambda s, d: heading_variants(varied(s, d)), "m9_audit": lambda s, d: audit(varied(s, d)), "m6_short_titles": lambda s, d: short_titles(varied(s, d)),
}
ORACLE_SQL = {name: _digest(_sql_clean(0, k)) for name, k in (("m1_cover_strip", 0), ("m2_page_separators", 1), ("m3_part_three_stubs", 2), ("m5_split_titles", 3), ("m6_headings", 4))} | {
    "m4_stub_sections": f"SELECT doc_id, CAST(place - 1 AS INTEGER) AS place, CAST({_LEFT} AS INTEGER) AS remaining, {_IS_STUB} AS is_stub FROM (SELECT doc_id, unnest({_SECTIONS}) AS s, generate_subscripts({_SECTIONS}, 1) AS place FROM ({MD})) WHERE {_STUBBED}",
    "m7_clean": _digest(_sql_clean(5)),
    "m8_profile": f"""SELECT doc_id, {_count("\\[Table of Contents\\]\\([^)]+\\)")} AS n_links, {_count("(?m)^---[ \\t]*$")} AS n_dashes, {_count(PAGE)} AS n_pages, {_count("(?m)^\\|[ \\-:|]+\\|[ \\t]*$")} AS n_tables,
      CAST(len(list_filter({_SECTIONS}, lambda s: {_IS_STUB})) AS INTEGER) AS n_stub, CAST(len(list_filter({_SECTIONS}, lambda s: {_STUBBED} AND NOT {_IS_STUB} AND regexp_matches(s, '(?i){_POINTERS[0]}'))) AS INTEGER) AS n_hybrid,
      CAST(len(list_filter({_SECTIONS}, lambda s: {_STUBBED} AND NOT {_IS_STUB} AND NOT regexp_matches(s, '(?i){_POINTERS[0]}'))) AS INTEGER) AS n_real, regexp_matches(md, '(?m)^## (?:ITEM|Item) (?:1C|9[ABC])\\b') AS has_late, {_ANCHOR} AS anchor FROM ({MD})""",
    "m9_heading_variants": f"""SELECT kind, count(*) AS n, count(*) FILTER (WHERE kind IN ('ITEM', 'Item') AND title = '') AS n_empty, count(*) FILTER (WHERE length(title) BETWEEN 1 AND 4) AS n_short,
      string_agg(line, '; ' ORDER BY doc_id, k) FILTER (WHERE p <= 3) AS samples FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY doc_id, k) AS p FROM ({_LINES})) GROUP BY 1""",
}
ORACLE_SQL |= {
    "c4_outline": f"""WITH l AS (SELECT doc_id, CAST(generate_subscripts(string_split(md, chr(10)), 1) AS INTEGER) AS i, unnest(string_split(md, chr(10))) AS line FROM ({NESTED})),
      f AS (SELECT *, count(*) FILTER (WHERE starts_with(line, '```')) OVER (PARTITION BY doc_id ORDER BY i) % 2 = 1 AS fenced FROM l),
      h AS (SELECT *, CASE WHEN NOT fenced AND regexp_matches(line, '^#{{1,6}} +[^ ]') THEN length(regexp_extract(line, '^(#{{1,6}}) ', 1)) END AS level FROM f),
      n AS (SELECT *, count(level) OVER (PARTITION BY doc_id ORDER BY i) AS node FROM h),
      heads AS (SELECT doc_id, node, i, level, trim(regexp_replace(line, '^#{{1,6}} +', '')) AS title FROM n WHERE level IS NOT NULL),
      paths AS (SELECT c.doc_id, c.node, any_value(c.title) AS title, list_filter(flatten(list(string_split(p.title, '/') ORDER BY p.i)), lambda x: x <> '') AS above FROM heads c LEFT JOIN heads p ON p.doc_id = c.doc_id AND p.i < c.i AND p.level < c.level
        AND NOT EXISTS (SELECT 1 FROM heads q WHERE q.doc_id = c.doc_id AND q.i > p.i AND q.i < c.i AND q.level <= p.level) GROUP BY 1, 2),
      texts AS (SELECT doc_id, node, string_agg(line, chr(10) ORDER BY i) AS text FROM n GROUP BY 1, 2)
      SELECT t.doc_id, t.node, CASE WHEN p.node IS NULL THEN '' ELSE array_to_string(CASE WHEN len(above) > 0 AND above[-1] = title THEN above ELSE list_append(coalesce(above, []), title) END, ' / ') END AS header_path, md5(text) AS text_md5
      FROM texts t LEFT JOIN paths p ON p.doc_id = t.doc_id AND p.node = t.node WHERE t.node > 0 OR trim(text) <> ''""",
}
_W = f"[{SQL_SPACE}]"
_VBODY = f"(SELECT doc_id, {_BODY} AS b FROM ({VARIED}))"
_TITLE = f"{sql_strip(f"regexp_extract(line, '(?s)^#{{1,4}} (?:ITEM|Item){_W}+[0-9]+[A-Z]?[.]?{_W}*([^\\n]*)$', 1)")}"
_LINES = f"""SELECT doc_id, 'part' AS kind, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS place FROM (SELECT doc_id, regexp_extract_all(b, '{PART_HEADING.format(s=_W)}', 0) AS l FROM {_VBODY}) UNION ALL SELECT doc_id, 'item', unnest(l), generate_subscripts(l, 1) - 1 FROM (SELECT doc_id, regexp_extract_all(b, '{ITEM_HEADING.format(s=_W)}', 0) AS l FROM {_VBODY})"""
_LATE = f"""SELECT doc_id, regexp_extract(x, '^#{{1,4}} (?:ITEM|Item){_W}+([0-9]+[A-Z])', 1) AS item, regexp_matches(t, '(?i){_POINTERS[0]}') OR length(t) < 200 AS stub FROM (SELECT doc_id, x, {sql_strip("regexp_replace(x, '^[^\\n]*\\n', '')")} AS t FROM
  (SELECT doc_id, unnest(string_split(regexp_replace(b, '(?m)^(#{{1,4}} )', chr(1) || '\\1', 'g'), chr(1))) AS x FROM {_VBODY}) WHERE regexp_matches(x, '^#{{1,4}} (?:ITEM|Item){_W}+(?:1C|9A|9B|9C)\\b[^\\n]*\\n'))"""
ORACLE_SQL |= {
    "m9_variant_report": f"""SELECT kind, variant, count(*) AS n, string_agg(line, '; ' ORDER BY doc_id, place) FILTER (WHERE p <= 3) AS samples FROM (SELECT *, row_number() OVER (PARTITION BY kind, variant ORDER BY doc_id, place) AS p FROM (SELECT doc_id, kind, place, {sql_strip("line")} AS line, CASE WHEN kind = 'part' THEN
        CASE WHEN upper_ AND {sql_strip("line")} LIKE '%.' THEN 'UPPER+period' WHEN upper_ THEN 'UPPER' WHEN {sql_strip("line")} LIKE '%.' THEN 'Mixed+period' ELSE 'Standard' END WHEN title = '' THEN 'empty-title' WHEN upper_ AND regexp_matches(line, '[0-9]+[A-Z]?[.][A-Za-z]') THEN 'UPPER+nospace' WHEN upper_ AND caps THEN 'UPPER+UPPERtitle'
        WHEN upper_ THEN 'UPPER+mixedtitle' WHEN caps THEN 'Item+UPPERtitle' ELSE 'Standard' END AS variant FROM (SELECT *, regexp_matches(line, '^#+ (PART|ITEM)') AS upper_, regexp_matches(title, '\\p{{Lu}}') AND NOT regexp_matches(title, '\\p{{Ll}}') AS caps FROM (SELECT *, {_TITLE} AS title FROM ({_LINES}))))) GROUP BY 1, 2""",
    "m9_audit": f"""SELECT doc_id, CAST(coalesce(tr, 0) AS INTEGER) AS n_truncated, CAST(coalesce(em, 0) AS INTEGER) AS n_empty, CAST(gap AS INTEGER) AS dash_gap, gap > 5 AS wide_gap, CAST(risks AS INTEGER) AS n_table_risks, coalesce(c1, false) AS has_1c, coalesce(a9, false) AS has_9a, coalesce(b9, false) AS has_9b, coalesce(c9, false) AS has_9c, coalesce(s1, false) AS stub_1c
      FROM (SELECT doc_id, len(regexp_extract_all(b, '(?m)^---[ \\t]*$')) - len(regexp_extract_all(b, '{PAGE}')) AS gap, len(regexp_extract_all(chr(10) || b, '{TABLE_RISK}')) AS risks FROM {_VBODY})
      LEFT JOIN (SELECT doc_id, count(*) FILTER (WHERE length(t) BETWEEN 1 AND 4) AS tr, count(*) FILTER (WHERE t = '') AS em FROM (SELECT doc_id, trim(rtrim({_TITLE}, '.')) AS t FROM ({_LINES}) WHERE kind = 'item') GROUP BY 1) USING (doc_id)
      LEFT JOIN (SELECT doc_id, bool_or(item = '1C') AS c1, bool_or(item = '9A') AS a9, bool_or(item = '9B') AS b9, bool_or(item = '9C') AS c9, bool_or(item = '1C' AND stub) AS s1 FROM ({_LATE}) GROUP BY 1) USING (doc_id)""",
    "m6_short_titles": f"""SELECT doc_id, CAST(i - 1 AS INTEGER) AS line_idx, '## Item ' || regexp_extract(line, '^## (?:ITEM|Item)\\s+([0-9]+[A-Z]?)', 1) || '. ' || CASE WHEN regexp_matches(t, '\\p{{Ll}}') THEN t ELSE upper(t[1]) || lower(t[2:]) END AS heading FROM (SELECT *, trim(regexp_extract(line, '^## (?:ITEM|Item)\\s+[0-9]+[A-Z]?[.]?[ \\t]*(.*)$', 1)) AS t
      FROM (SELECT doc_id, unnest(string_split(md, chr(10))) AS line, generate_subscripts(string_split(md, chr(10)), 1) AS i FROM ({VARIED})) WHERE regexp_matches(line, '^## (?:ITEM|Item)\\s+[0-9]+[A-Z]?')) WHERE length(t) BETWEEN 1 AND 4""",
}
