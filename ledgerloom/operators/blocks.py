"""Blocks of item texts: heading candidates, anchors, plausible detection, assembly, and the chunks made of them.

The queries read items and their filings' Markdown that are derived from ``documents``.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import SPACE, SQL_SPACE, bound, citation, stripped
from ..sources import derived
from .corpus import OVERLAP, SIZE
from .sections import sql_strip

PRELUDE_CHARS, REPEATS, FIRST_ANCHOR = 3000, 4, 0.30
#: Headings that tell nothing, compared without case.
NOISE = (
    "TABLE OF CONTENTS",
    "FORM 10-K",
    "FORWARD-LOOKING STATEMENTS",
    "FORWARD-LOOKING INFORMATION",
    "Cautionary Note About Forward-Looking Statements",
    "Cautionary Note on Forward-Looking Statements",
    "DOCUMENTS INCORPORATED BY REFERENCE",
    "SIGNATURES",
    "POWER OF ATTORNEY",
    "AVAILABLE INFORMATION",
    "UNITED STATES",
    "SECURITIES AND EXCHANGE COMMISSION",
    "Washington, D.C. 20549",
    "•",
    "or",
)
#: Shapes of headings that tell nothing.
NOISE_SHAPES = (
    r"(?i)^PART\s+[IVX]+$",
    r"^\d+$",
    r"^[•\-]+$",
    r"(?i)^Commission File",
    r"(?i)^For the (fiscal year|transition period)",
    r"(?i)^\d{4}\s+(annual|form\s*10[-\s]?k|annual report)",
    r"(?i)^Item\s+\d+[a-c]?\b",
    r"^[A-Z\s.,&]+(?:INC|CORP|CORPORATION|COMPANY|LLC|LP)\.?$",
    r"(?i)^Index to",
    r"(?i)^Notes to (the )?consolidated financial statements",
    r"(?i)^Consolidated Statements? of",
    r"(?i)^Consolidated Balance Sheets?",
    r"(?i)^Report of Independent",
)


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: t if t is None or unicodedata.is_normalized("NFKC", t) else unicodedata.normalize("NFKC", t))


def canonical(text: Column) -> Column:
    """One form of quotes, dashes, compatible characters and white space; the case stays."""
    return F.trim(F.regexp_replace(F.translate(nfkc(text), "‘’“”–—", "''\"\"--"), rf"[{SPACE}]+", " "))


def prepared(texts: DataFrame) -> DataFrame:
    """(filing_id, item_id, n_chars, lines, canon): a row for each text (filing_id, item_id, text), its lines and their canonical forms in arrays, so all that follows is within a row; the
    compatible characters are put in one form in one pass over the texts."""
    rows = texts.select("filing_id", "item_id", F.length("text").alias("n_chars"), F.split("text", "\n").alias("lines"), nfkc(F.col("text")).alias("folded"))
    even = F.regexp_replace(F.translate("folded", "‘’“”–—", "''\"\"--"), rf"[{SPACE}&&[^\n]]+", " ")
    return rows.select("filing_id", "item_id", "n_chars", "lines", F.transform(F.split(even, "\n"), lambda x: F.trim(x)).alias("canon"))


def lines(rows: DataFrame) -> DataFrame:
    """(filing_id, item_id, line_idx, line, canon, at): the lines of ``prepared`` texts, ``at`` being the characters before one."""
    each = rows.select("filing_id", "item_id", F.posexplode(F.arrays_zip(F.col("lines").alias("line"), F.col("canon").alias("canon"))).alias("line_idx", "z")).select("filing_id", "item_id", "line_idx", "z.*")
    before = F.sum(F.length("line") + 1).over(Window.partitionBy("item_id").orderBy("line_idx").rowsBetween(Window.unboundedPreceding, -1))
    return each.withColumn("at", F.coalesce(before, F.lit(0)))


def heading_candidates(markdown: DataFrame, registrant: Column) -> DataFrame:
    """(filing_id, level, heading, canon): different headings of level 3 and 4 of each filing's Markdown (filing_id, line) without noise: fixed texts
    and shapes, the registrant's name, and what stands four times or more at any level."""
    md = markdown.withColumn("hashes", F.regexp_extract("line", r"^(#{1,6}) (.+)$", 1)).where("hashes <> ''")
    md = md.select("filing_id", F.length("hashes").alias("level"), stripped(F.regexp_extract("line", r"^(#{1,6}) (.+)$", 2)).alias("heading"), registrant.alias("registrant"))
    md = md.withColumn("canon", canonical(F.col("heading"))).withColumn("fold", F.lower("canon"))
    counted = md.withColumn("n", F.count("*").over(Window.partitionBy("filing_id", "fold")))
    noise = F.col("fold").isin(*(x.lower() for x in NOISE)) | (F.col("fold") == F.lower("registrant")) | (F.col("n") >= REPEATS) | (F.col("heading") == "")
    for shape in NOISE_SHAPES:
        noise |= F.col("heading").rlike(shape)
    return counted.where(F.col("level").isin(3, 4) & ~F.coalesce(noise, F.lit(False))).select("filing_id", "level", "heading", "canon").distinct()


def fallback_lines(lines_: Column) -> Column:
    """Numbers of the lines that look like a heading by themselves and stand like one: no sentence ends just before, and long prose follows."""
    solid = F.filter(F.transform(lines_, lambda x, i: F.struct(i.alias("i"), stripped(x).alias("s"))), lambda x: x["s"] != "")

    def stands(all_: Column) -> Column:
        def heading(x: Column, place: Column) -> Column:
            s = x["s"]
            shaped = F.length(s).between(5, 120) & ~s.rlike(r"\d{3,}") & ~s.rlike(rf"^[\d{SPACE}]+$") & ~s.rlike(rf"(?i)^item[{SPACE}]+\d+[a-c]?\.?") & ~s.rlike(r"^\(\d+\)") & ~s.rlike(r"[|$%]") & ~s.rlike(r"[.,;:]$")
            before = F.coalesce(F.get(lines_, x["i"] - 1), F.lit(""))
            return F.when(shaped & ~before.rlike(rf"[.!?][{SPACE}]*+\z") & (F.length(F.get(all_, place + 1)["s"]) > 80), x["i"])

        return F.filter(F.transform(all_, heading), lambda i: i.isNotNull())

    return bound(solid, stands)


def marked(rows: DataFrame, candidates: DataFrame) -> DataFrame:
    """``prepared`` rows with the line numbers of each source's anchors (h3 and h4: lines equal to a candidate of their filing; fallback), the first source in order
    with two anchors or more, the first of them in the text's first 30 %, and its anchors (``marks``; both null where there is none)."""
    by = candidates.groupBy("filing_id").agg(*(F.collect_set(F.when(F.col("level") == k, F.col("canon"))).alias(f"known{k}") for k in (3, 4)))
    number = F.filter(F.sequence(F.lit(0), F.size("lines") - 1), lambda i: F.get("canon", i) != "")
    at = lambda known: F.filter("some", lambda i: F.array_contains(known, F.get("canon", i)))
    none = F.array().cast("array<int>")
    rows = rows.join(by, "filing_id", "left").withColumn("some", F.when(F.col("known3").isNull(), none).otherwise(number))
    rows = rows.select("filing_id", "item_id", "n_chars", "lines", F.coalesce(at("known3"), none).alias("h3"), F.coalesce(at("known4"), none).alias("h4"), fallback_lines(F.col("lines")).alias("fallback"))
    before = lambda i: F.aggregate(F.slice("lines", 1, i), F.lit(0), lambda n, x: n + F.length(x) + 1)
    good = lambda c: F.when(F.size(c) >= 2, before(F.get(c, F.lit(0))) <= FIRST_ANCHOR * F.col("n_chars")).otherwise(False)
    source = F.when(good("h3"), "markdown_h3").when(good("h4"), "markdown_h4").when(good("fallback"), "text_fallback")
    rows = rows.withColumn("source", source)
    return rows.withColumn("marks", F.when(F.col("source") == "markdown_h3", F.col("h3")).when(F.col("source") == "markdown_h4", F.col("h4")).when(F.col("source") == "text_fallback", F.col("fallback")))


def assembled(rows: DataFrame) -> DataFrame:
    """(filing_id, item_id, source, block, heading, text, prelude): each item of ``marked`` in blocks from anchor to anchor, block 0 being the prelude.

    What comes before the first anchor is the prelude if it has at most 3,000 characters, else a block without heading (-1). An
    item without a plausible detection is one flat unit, heading null. No line is lost. ``prelude`` is the text of block 0 where that isn't the whole item.
    """
    cuts = F.concat(F.array(F.lit(-1)), F.coalesce("marks", F.array().cast("array<int>")))

    def cut(cuts: Column) -> Column:
        def part(at: Column, k: Column) -> Column:
            stop = F.coalesce(F.get(cuts, k + 1), F.size("lines"))
            text = stripped(F.array_join(F.slice("lines", at + 2, stop - at - 1), "\n"))
            return F.struct(k.alias("block"), F.when(k > 0, stripped(F.get("lines", at))).alias("heading"), text.alias("text"), (stop - at - 1).alias("n"))

        return F.filter(F.transform(cuts, part), lambda x: (x["block"] > 0) | (x["n"] > 0))

    rows = rows.select("filing_id", "item_id", "source", bound(cuts, cut).alias("parts"))
    structured = F.col("source").isNotNull()
    first = F.get(F.filter("parts", lambda x: (x["block"] == 0) & structured & (F.length(x["text"]) <= PRELUDE_CHARS)), F.lit(0))
    each = rows.withColumn("prelude", first["text"]).select("filing_id", "item_id", "source", "prelude", F.inline("parts"))
    block = F.when((F.col("block") == 0) & structured & (F.length("text") > PRELUDE_CHARS), -1).otherwise(F.col("block"))
    return each.select("filing_id", "item_id", "source", block.alias("block"), "heading", "text", "prelude")


def units(blocks: DataFrame) -> DataFrame:
    """Chunkable units in order: a flat body; or the prelude, if it isn't empty, and then the blocks, which carry the prelude as context."""
    own = blocks.where("block <> 0 or source is null or text <> ''")
    return own.select("filing_id", "item_id", "block", "heading", "text", F.when((F.col("block") != 0) & (F.col("prelude") != ""), F.col("prelude")).alias("prelude"))


def chunked(pieces: DataFrame) -> DataFrame:
    """512-word chunks of units that overlap by 50 and never cross a unit, numbered from 0 without a gap over each filing; with header path and citation."""
    w = pieces.where("text <> ''").select("filing_id", "item_id", "block", "heading", F.split("text", " ").alias("w"))
    last = F.greatest(F.ceil((F.size("w") - OVERLAP) / (SIZE - OVERLAP)) - 1, F.lit(0)).cast("int")
    cut = w.select("filing_id", "item_id", "block", "heading", F.posexplode(F.transform(F.sequence(F.lit(0), last), lambda i: F.slice("w", i * (SIZE - OVERLAP) + 1, SIZE))).alias("piece", "c"))
    index = F.row_number().over(Window.partitionBy("filing_id").orderBy("item_id", "block", "piece")) - 1
    path = F.concat_ws(" / ", F.concat(F.lit("F"), "filing_id"), F.lit("2024"), F.concat(F.lit("Item "), F.col("item_id") % 12, F.lit(".")), "heading")
    return cut.select("filing_id", "item_id", "block", index.alias("chunk_index"), path.alias("header_path"), F.md5(F.array_join("c", " ")).alias("digest")).withColumn("citation", citation(F.col("filing_id").cast("string"), (F.col("item_id") % 12).cast("string"), F.col("chunk_index")))


HEADS = "concat('Overview Of ', source, ' ', doc_id % 5) AS h1, concat('Results For ', lang, ' ', doc_id % 3) AS h2"
ITEMS = f"""SELECT filing_id, doc_id AS item_id, CASE WHEN doc_id % 7 = 0 THEN concat(text, chr(10), h1, chr(10), text, chr(10), text, chr(10), h2, chr(10), text, ' ', text) WHEN doc_id % 7 = 1 THEN text
  ELSE concat('Item ', doc_id % 12, '. Heading', chr(10), h1, chr(10), text, chr(10), '  ', h2, chr(10), CASE doc_id % 3 WHEN 0 THEN chr(9) WHEN 1 THEN chr(160) ELSE '' END, chr(10), text) END AS text FROM (SELECT doc_id, text, CAST(floor(doc_id / 12) AS BIGINT) AS filing_id, {HEADS} FROM documents)"""
MARKDOWN = f"""SELECT CAST(floor(doc_id / 12) AS BIGINT) AS filing_id, concat(CASE doc_id % 4 WHEN 0 THEN '### ' WHEN 1 THEN '#### ' WHEN 2 THEN '##  ' ELSE '' END, CASE k WHEN 1 THEN h1 WHEN 2 THEN h2 WHEN 3 THEN 'PART II' WHEN 4 THEN 'Table of contents' ELSE concat(upper(lang), ' CORP') END) AS line
  FROM (SELECT doc_id, lang, {HEADS} FROM documents) CROSS JOIN (SELECT 1 AS k UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5) n"""


def items(spark, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, ITEMS, "documents")


def candidates(spark, sf_dir: str) -> DataFrame:
    return heading_candidates(derived(spark, sf_dir, MARKDOWN, "documents"), F.lit("Results For en 1"))


def all_marked(spark, sf_dir: str) -> DataFrame:
    return marked(prepared(items(spark, sf_dir)), candidates(spark, sf_dir))


def canonical_lines(spark, sf_dir: str) -> DataFrame:
    return lines(prepared(items(spark, sf_dir))).select("item_id", "line_idx", "at", F.md5("canon").alias("canon_md5"))


def anchors(spark, sf_dir: str) -> DataFrame:
    named = lambda c, name: F.transform(c, lambda i: F.struct(i.alias("line_idx"), F.lit(name).alias("source")))
    both = F.concat(named("h3", "markdown_h3"), named("h4", "markdown_h4"))
    return all_marked(spark, sf_dir).select("item_id", F.inline(both))


def fallbacks(spark, sf_dir: str) -> DataFrame:
    return prepared(items(spark, sf_dir)).select("item_id", F.explode(fallback_lines(F.col("lines"))).alias("line_idx"))


def sources(spark, sf_dir: str) -> DataFrame:
    return all_marked(spark, sf_dir).where("source is not null").select("item_id", "source")


def blocks(spark, sf_dir: str) -> DataFrame:
    return assembled(all_marked(spark, sf_dir))


def block_table(spark, sf_dir: str) -> DataFrame:
    return blocks(spark, sf_dir).where("block <> 0 or source is null").select("item_id", "source", "block", "heading", F.md5("text").alias("text_md5"))


def preludes(spark, sf_dir: str) -> DataFrame:
    """Verdict on what stands before the first anchor: valid, reclassified or absent; flat items have none."""
    first = blocks(spark, sf_dir).where("source is not null").groupBy("item_id").agg(F.max(F.when(F.col("block") == 0, F.length("text"))).alias("n"), F.min("block").alias("low"))
    verdict = F.when(F.col("low") == -1, "reclassified").when(F.col("n") > 0, "valid").otherwise("absent")
    return first.select("item_id", verdict.alias("prelude"), F.coalesce("n", F.lit(0)).alias("n_chars"))


def filing_summary(spark, sf_dir: str) -> DataFrame:
    """Structured and flat items, blocks and characters of each filing."""
    by = blocks(spark, sf_dir).groupBy("filing_id", "item_id", "source").agg(F.count_if(F.col("block") != 0).alias("n_blocks"), F.sum(F.length("text")).alias("n_chars"))
    return by.groupBy("filing_id").agg(F.count("source").alias("n_structured"), F.count_if(F.col("source").isNull()).alias("n_flat"), F.sum("n_blocks").alias("n_blocks"), F.sum("n_chars").alias("n_chars"))


def unit_table(spark, sf_dir: str) -> DataFrame:
    return units(blocks(spark, sf_dir)).select("item_id", "block", "heading", F.md5("text").alias("text_md5"), F.md5("prelude").alias("prelude_md5"))


def chunk_table(spark, sf_dir: str) -> DataFrame:
    return chunked(units(blocks(spark, sf_dir)))


def content_counts(spark, sf_dir: str) -> DataFrame:
    """Content chunks of each filing without its marker; a filing whose corpus is empty is told before anything is written."""
    have = chunk_table(spark, sf_dir).groupBy("filing_id").agg(F.count("*").alias("n_chunks"))
    out = items(spark, sf_dir).select("filing_id").distinct().join(have, "filing_id", "left")
    return out.select("filing_id", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), F.col("n_chunks").isNull().alias("is_empty"))


CANON = "trim(regexp_replace(translate(nfc_normalize({0}), '‘’“”–—', '''''\"\"--'), '[" + SQL_SPACE.replace("{", "{{").replace("}", "}}") + "]+', ' ', 'g'))"
LINES = f"""SELECT *, {CANON.format("line")} AS canon, coalesce(sum(length(line) + 1) OVER (PARTITION BY item_id ORDER BY line_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS at_
  FROM (SELECT filing_id, item_id, length(text) AS n_chars, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_idx FROM ({ITEMS}))"""
_NOISE = " OR ".join([f"fold IN ({', '.join(repr(x.lower()) for x in NOISE)})", "fold = 'results for en 1'", f"n >= {REPEATS}", "heading = ''", *(f"regexp_matches(heading, '{x}')" for x in NOISE_SHAPES)])
CANDIDATES = f"""SELECT DISTINCT filing_id, level, heading, canon FROM (SELECT *, count(*) OVER (PARTITION BY filing_id, fold) AS n FROM (SELECT *, lower(canon) AS fold FROM (SELECT *, {CANON.format("heading")} AS canon
  FROM (SELECT filing_id, CAST(length(regexp_extract(line, '^(#{{1,6}}) (.+)$', 1)) AS INTEGER) AS level, {sql_strip("regexp_extract(line, '^(#{1,6}) (.+)$', 2)")} AS heading FROM ({MARKDOWN}) WHERE regexp_matches(line, '^(#{{1,6}}) (.+)$')))))
  WHERE level IN (3, 4) AND NOT ({_NOISE})"""
ANCHORS = f"""SELECT DISTINCT item_id, line_idx, at_, n_chars, CASE level WHEN 3 THEN 'markdown_h3' ELSE 'markdown_h4' END AS source FROM ({LINES}) l JOIN ({CANDIDATES}) c USING (filing_id, canon) WHERE canon <> ''"""
FALLBACK = f"""SELECT item_id, line_idx, at_, n_chars, 'text_fallback' AS source FROM (SELECT *, {sql_strip('line')} AS s, coalesce(lag(line) OVER w, '') AS before, first_value(nullif({sql_strip('line')}, '') IGNORE NULLS) OVER (PARTITION BY item_id ORDER BY line_idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after
  FROM ({LINES}) WINDOW w AS (PARTITION BY item_id ORDER BY line_idx)) WHERE length(s) BETWEEN 5 AND 120 AND NOT regexp_matches(s, '\\d{{3,}}') AND NOT regexp_matches(s, '^[\\d\\s]+$') AND NOT regexp_matches(s, '(?i)^item\\s+\\d+[a-c]?\\.?')
  AND NOT regexp_matches(s, '^\\(\\d+\\)') AND NOT regexp_matches(s, '[|$%]') AND NOT regexp_matches(s, '[.,;:]$') AND NOT regexp_matches(before, '[.!?][{SQL_SPACE}]*$') AND length(after) > 80"""
BOTH = f"SELECT * FROM ({ANCHORS}) UNION ALL SELECT * FROM ({FALLBACK})"
SOURCES = f"""SELECT item_id, arg_min(source, CASE source WHEN 'markdown_h3' THEN 1 WHEN 'markdown_h4' THEN 2 ELSE 3 END) AS source FROM
  (SELECT item_id, source, count(*) AS n, min(at_) AS f, max(n_chars) AS c FROM ({BOTH}) GROUP BY 1, 2) WHERE n >= 2 AND f <= {FIRST_ANCHOR} * c GROUP BY 1"""
BLOCKS = f"""SELECT filing_id, item_id, source, CASE WHEN block = 0 AND source IS NOT NULL AND length(text) > {PRELUDE_CHARS} THEN -1 ELSE block END AS block, heading, text FROM
  (SELECT filing_id, item_id, source, block, max(CASE WHEN mark THEN {sql_strip('line')} END) AS heading, {sql_strip("coalesce(string_agg(line, chr(10) ORDER BY line_idx) FILTER (WHERE NOT mark), '')")} AS text FROM
  (SELECT *, CAST(sum(CAST(mark AS INTEGER)) OVER (PARTITION BY item_id ORDER BY line_idx) AS INTEGER) AS block FROM
  (SELECT l.*, s.source, m.line_idx IS NOT NULL AS mark FROM ({LINES}) l LEFT JOIN ({SOURCES}) s ON l.item_id = s.item_id LEFT JOIN (SELECT DISTINCT item_id, source, line_idx FROM ({BOTH})) m ON m.item_id = l.item_id AND m.line_idx = l.line_idx AND m.source = s.source))
  GROUP BY filing_id, item_id, source, block)"""
UNITS = f"""SELECT filing_id, item_id, block, heading, text, CASE WHEN block <> 0 AND p <> '' THEN p END AS prelude FROM
  (SELECT *, max(CASE WHEN block = 0 AND source IS NOT NULL THEN text END) OVER (PARTITION BY item_id) AS p FROM ({BLOCKS})) WHERE block <> 0 OR source IS NULL OR text <> ''"""
CHUNKS = f"""SELECT filing_id, item_id, block, chunk_index, header_path, digest, concat('sec://', filing_id, '/', item_id % 12, '#', chunk_index) AS citation FROM (SELECT filing_id, item_id, block,
  CAST(row_number() OVER (PARTITION BY filing_id ORDER BY item_id, block, i) - 1 AS INTEGER) AS chunk_index, concat_ws(' / ', 'F' || filing_id, '2024', 'Item ' || item_id % 12 || '.', heading) AS header_path, md5(array_to_string(w[i * 462 + 1 : i * 462 + 512], ' ')) AS digest
  FROM (SELECT *, unnest(range(0, CAST(greatest(ceil((len(w) - 50) / 462.0), 1) AS BIGINT))) AS i FROM (SELECT *, string_split(text, ' ') AS w FROM ({UNITS}) WHERE text <> '')))"""

QUERIES = {
    "t7_canonical_lines": canonical_lines, "t8_heading_candidates": candidates, "t9_anchors": anchors, "t10_fallback_headings": fallbacks, "t11_detection_sources": sources, "t12_blocks": block_table, "t13_preludes": preludes,
    "t16_filing_summary": filing_summary, "c1_units": unit_table, "c3_chunk_index": chunk_table, "c10_content_counts": content_counts,
}
ORACLE_SQL = {
    "t7_canonical_lines": f"SELECT item_id, CAST(line_idx AS INTEGER) AS line_idx, CAST(at_ AS BIGINT) AS at, md5(canon) AS canon_md5 FROM ({LINES})",
    "t8_heading_candidates": CANDIDATES,
    "t9_anchors": f"SELECT item_id, CAST(line_idx AS INTEGER) AS line_idx, source FROM ({ANCHORS})",
    "t10_fallback_headings": f"SELECT item_id, CAST(line_idx AS INTEGER) AS line_idx FROM ({FALLBACK})",
    "t11_detection_sources": SOURCES,
    "t12_blocks": f"SELECT item_id, source, block, heading, md5(text) AS text_md5 FROM ({BLOCKS}) WHERE block <> 0 OR source IS NULL",
    "t13_preludes": f"""SELECT item_id, CASE WHEN low = -1 THEN 'reclassified' WHEN n > 0 THEN 'valid' ELSE 'absent' END AS prelude, CAST(coalesce(n, 0) AS INTEGER) AS n_chars
      FROM (SELECT item_id, max(CASE WHEN block = 0 THEN length(text) END) AS n, min(block) AS low FROM ({BLOCKS}) WHERE source IS NOT NULL GROUP BY 1)""",
    "t16_filing_summary": f"""SELECT filing_id, count(source) AS n_structured, count(*) FILTER (WHERE source IS NULL) AS n_flat, CAST(sum(b) AS BIGINT) AS n_blocks, CAST(sum(c) AS BIGINT) AS n_chars
      FROM (SELECT filing_id, item_id, source, count(*) FILTER (WHERE block <> 0) AS b, sum(length(text)) AS c FROM ({BLOCKS}) GROUP BY 1, 2, 3) GROUP BY 1""",
    "c1_units": f"SELECT item_id, block, heading, md5(text) AS text_md5, md5(prelude) AS prelude_md5 FROM ({UNITS})",
    "c3_chunk_index": CHUNKS,
    "c10_content_counts": f"SELECT f.filing_id, coalesce(n, 0) AS n_chunks, n IS NULL AS is_empty FROM (SELECT DISTINCT filing_id FROM ({ITEMS})) f LEFT JOIN (SELECT filing_id, count(*) AS n FROM ({CHUNKS}) GROUP BY 1) c ON f.filing_id = c.filing_id",
}
