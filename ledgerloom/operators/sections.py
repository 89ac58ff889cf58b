"""Item sections of filings: keys, boundaries, stubs, canonical order, listing, fetching, work lists.

The queries read sections that are derived from ``documents``: twelve documents are the sections of a filing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import SPACE, SQL_SPACE, bound, right_stripped, stripped
from ..sources import derived

#: The items of an annual report in their order, and their titles.
TITLES = {
    "1": "Business",
    "1a": "Risk Factors",
    "1b": "Unresolved Staff Comments",
    "1c": "Cybersecurity",
    "2": "Properties",
    "3": "Legal Proceedings",
    "4": "Mine Safety Disclosures",
    "5": "Market for Registrant's Common Equity, Related Stockholder Matters and Issuer Purchases of Equity Securities",
    "6": "[Reserved]",
    "7": "Management's Discussion and Analysis of Financial Condition and Results of Operations",
    "7a": "Quantitative and Qualitative Disclosures About Market Risk",
    "8": "Financial Statements and Supplementary Data",
    "9": "Changes in and Disagreements With Accountants on Accounting and Financial Disclosure",
    "9a": "Controls and Procedures",
    "9b": "Other Information",
    "9c": "Disclosure Regarding Foreign Jurisdictions that Prevent Inspections",
    "10": "Directors, Executive Officers and Corporate Governance",
    "11": "Executive Compensation",
    "12": "Security Ownership of Certain Beneficial Owners and Management and Related Stockholder Matters",
    "13": "Certain Relationships and Related Transactions, and Director Independence",
    "14": "Principal Accountant Fees and Services",
    "15": "Exhibits, Financial Statement Schedules",
    "16": "Form 10-K Summary",
}
KEYS = list(TITLES)
S = f"[{SPACE}]"
#: What points elsewhere instead of telling, in the first and in the wider set, as patterns of a class of white space and its complement.
POINTER_FORM = r"incorporated{s}+(?:\w+{s}+)?(?:in|into|to|by){s}+(?:\w+{s}+)?reference"
POINTER_FORMS = (POINTER_FORM, r"reference{s}+is{s}+made{s}+to", r"appears{s}+on{s}+pages?{s}+\d+", r"refer{s}+to{s}+the{s}+(?:{n}+{s}+){{1,6}}section")
POINTER = POINTER_FORM.format(s=S, n=f"[^{SPACE}]")
POINTERS = tuple(x.format(s=S, n=f"[^{SPACE}]") for x in POINTER_FORMS)
#: Where a sentence ends, a link, and marks that tell nothing.
SENTENCE_END, LINK, MARKS = rf"(?<=[.!?]){S}+(?=[^{SPACE}])", r"!?\[[^\]]*\]\([^)]*\)", rf"[{SPACE}\-|*]+"
FEW = 100
#: Input tokens of models.
MODELS = {"gemini-3.1-flash-lite": 1048576, "gpt-4o": 128000, "gpt-4o-mini": 128000, "gpt-5-mini": 272000, "gpt-5-nano": 272000}


def strict_key(raw: Column) -> Column:
    """``Item 1A.`` or ``1a`` -> ``1a``; null unless it is an item of the list."""
    key = F.lower(stripped(F.regexp_replace(F.regexp_replace(stripped(raw), rf"(?i)^{S}*item{S}+", ""), r"\.+$", "")))
    return F.when(key.isin(*KEYS), key)


def name_key(name: Column) -> Column:
    """Item in a section's name (``part_ii_item_7a``, ``Item 7A``) that is on the list, else null."""
    key = F.regexp_extract(F.lower(stripped(name)), rf"item[_{SPACE}]+([0-9]{{1,2}}[a-c]?)\b", 1)
    return F.when(key.isin(*KEYS), key)


def path_item(path: Column) -> Column:
    """First level of a header path that is an item, without its title; ``_unknown`` where none is."""
    levels = F.transform(F.split(path, " / "), lambda x: F.regexp_extract(stripped(x), r"^(Item \d+[A-Z]?(?:\(T\))?)\.?", 1))
    return F.coalesce(F.get(F.filter(levels, lambda x: x != ""), F.lit(0)), F.lit("_unknown"))


def _before(parts: Column, foreign: Column, text: Column) -> Column:
    """The parts before the first ``foreign`` one, stripped at the end; the text where there is none."""
    at = F.array_position(foreign, True)
    return F.when(at > 0, right_stripped(F.array_join(F.slice(parts, F.lit(1), (at - 1).cast("int")), ""))).otherwise(text)


def trim_to_item(text: Column, item: Column) -> Column:
    """Cut at the first later heading ``Item N.`` of another number; the first heading is the section's own. The text is only split, so no character of it is lost."""
    heading = rf"item{S}+(\d{{1,2}}[a-c]?){S}*\.(?!\d)"
    number = lambda s: F.lower(F.regexp_extract(s, rf"(?i)\A{heading}", 1))

    def cut(parts: Column) -> Column:
        own = F.when(number(F.get(parts, F.lit(0))) != "", 0).otherwise(1)
        return _before(parts, F.transform(parts, lambda s, k: (k > own) & (number(s) != F.lower(item))), F.array_join(parts, ""))

    return bound(F.split(text, rf"(?i)(?=i)(?<![A-Za-z])(?={heading})"), cut)


def trim_structural(text: Column, item: Column) -> Column:
    """Cut at the first heading of another item that stands as a heading: at the text's or a line's start, or glued to what
    is no letter, quote or bracket, or to ``PART IV``. A ``PART`` label left at the end goes too.

    The text is split before every ``Item N.``; whether one stands as a heading is told by the end of the part before it.
    """
    heading = rf"(?:Item|ITEM){S}+(\d{{1,2}}[a-cA-C]?){S}*\.(?!\d)"
    glued = rf"[^{SPACE}\p{{L}}\"'“”‘’(\[]\z|PART{S}+[IVX]+\z"

    def cut(parts: Column) -> Column:
        def foreign(s: Column, k: Column) -> Column:
            before = F.get(parts, k - 1)
            stands = (k == 0) | before.rlike(rf"\n[ \t]*+\z|{glued}") | ((k == 1) & before.rlike(r"\A[ \t]*+\z"))
            number = F.lower(F.regexp_extract(s, rf"\A{heading}", 1))
            return (number != "") & (number != F.lower(item)) & stands

        return _before(parts, F.transform(parts, foreign), F.array_join(parts, ""))

    out = bound(F.split(text, rf"(?=I)(?={heading})"), cut)
    return right_stripped(F.regexp_replace(right_stripped(out), rf"PART{S}+[IVX]+\z", ""))


def remaining(text: Column, pointers: tuple[str, ...] = (POINTER,)) -> Column:
    """Characters that tell something once sentences that point elsewhere, links and marks are gone."""
    kept = F.array_join(F.filter(F.split(text, SENTENCE_END), lambda s: ~s.rlike("(?i)" + "|".join(pointers))), " ")
    return F.length(F.regexp_replace(F.regexp_replace(kept, LINK, ""), MARKS, ""))


def stub(text: Column, pointers: tuple[str, ...] = (POINTER,)) -> Column:
    """Struct (is_stub, reason): reserved items, and those that are nothing but pointers: under 100 characters without their sentences, links and marks."""

    def of(text: Column) -> Column:
        reserved = text.rlike(rf"(?i)\[{S}*reserved{S}*\]") & (F.length(stripped(F.regexp_replace(text, rf"{S}+", " "))) < 80)
        # every pointer has one of these words
        points = bound(F.lower(text), lambda low: low.contains("refer") | low.contains("appears")) & text.rlike("(?i)" + "|".join(pointers))
        pointing = F.when(text.rlike("(?i)" + POINTER), "incorporated by reference from proxy statement").otherwise("cross-reference pointer stub")
        return F.when(reserved, "section marked as reserved/deprecated").when(points & (remaining(text, pointers) < FEW), pointing)

    return bound(bound(text, of), lambda reason: F.struct(reason.isNotNull().alias("is_stub"), reason.alias("reason")))


def parsed_items(sections: DataFrame) -> DataFrame:
    """(filing_id, item, ord, seq, text): of each filing's sections (filing_id, seq, name, text) the first of each known item that isn't empty or a stub, in canonical order."""
    own = sections.withColumn("item", name_key(F.col("name"))).where(F.col("item").isNotNull() & (stripped("text") != ""))
    told = bound(trim_structural(F.col("text"), F.col("item")), lambda t: F.struct(t.alias("text"), stub(t, POINTERS)["is_stub"].alias("is_stub")))
    # stubs are passed over in the aggregate: a filter before it would compute ``told`` again
    first = own.withColumn("told", told).groupBy("filing_id", "item").agg(F.min_by(F.struct("seq", "told.text"), F.when(~F.col("told.is_stub"), F.col("seq"))).alias("r")).where("r is not null")
    place = F.array_position(F.array(*map(F.lit, KEYS)), F.col("item")).cast("int")
    return first.select("filing_id", "item", place.alias("ord"), "r.seq", "r.text")


SECTIONS = """SELECT CAST(floor(doc_id / 12) AS BIGINT) AS filing_id, CAST(doc_id % 12 AS BIGINT) AS seq,
  CASE doc_id % 12 WHEN 0 THEN 'Item 1' WHEN 1 THEN 'part_i_item_1a' WHEN 2 THEN 'Item 7' WHEN 3 THEN 'part_ii_item_7' WHEN 4 THEN 'item 7A' WHEN 5 THEN 'Item 8'
    WHEN 6 THEN 'Item 9C' WHEN 7 THEN 'Item 11' WHEN 8 THEN 'part_iii_item_10' WHEN 9 THEN 'Item 14' WHEN 10 THEN 'signatures' ELSE 'Item 6' END AS name,
  CASE doc_id % 12 WHEN 0 THEN concat('Item 1. Business', chr(10), text) WHEN 1 THEN concat('ITEM 1A. RISK FACTORS', chr(10), text, chr(10), 'LineItem 3. stays')
    WHEN 2 THEN concat('Item 7. Discussion', chr(10), 'Reference is made to the section entitled Review.') WHEN 3 THEN concat('Item 7. Discussion', chr(10), text)
    WHEN 4 THEN concat('Item 7A. Risk', chr(10), text, chr(10), 'Item 7A. again', chr(10), 'Item 8. Statements', chr(10), text)
    WHEN 5 THEN concat('Item 8. Statements', chr(10), text, chr(10), 'See Item 1A. Risk Factors for more.')
    WHEN 6 THEN concat('Item 9C. Disclosure', chr(10), text, '53PART IIIItem 10. Directors', chr(10), text)
    WHEN 7 THEN concat('Item 11. Compensation', chr(10), 'The information is incorporated herein by reference to the proxy statement.Item 12. Ownership', chr(10), text)
    WHEN 8 THEN concat('Item 10. Directors', chr(10), 'Parts are incorporated by reference. ', text) WHEN 9 THEN '  ' WHEN 10 THEN text ELSE 'Item 6. [ Reserved ]' END AS text FROM documents"""
#: As SECTIONS; every other filing's names and the words of its headings and pointers stand apart by no-break spaces.
SECTIONS = f"""SELECT filing_id, seq, CASE WHEN filing_id % 2 = 1 THEN replace(name, ' ', chr(160)) ELSE name END AS name,
  CASE WHEN filing_id % 2 = 1 THEN replace(replace(replace(replace(text, 'Item ', concat('Item', chr(160))), 'ITEM ', concat('ITEM', chr(160))), 'incorporated ', concat('incorporated', chr(160))), 'is made', concat('is', chr(160), 'made')) ELSE text END AS text FROM ({SECTIONS})"""


def sections(spark, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, SECTIONS, "documents")


def keys(spark, sf_dir: str) -> DataFrame:
    """Each section's item by the strict form, by name and by header path."""
    s = sections(spark, sf_dir)
    path = F.concat_ws(" / ", F.lit("T"), "name", F.lit("x"))
    return s.select("filing_id", "seq", strict_key(F.col("name")).alias("strict"), name_key(F.col("name")).alias("by_name"), path_item(path).alias("by_path"))


def boundaries(trim):
    def query(spark, sf_dir: str) -> DataFrame:
        s = sections(spark, sf_dir).withColumn("item", name_key(F.col("name"))).where("item is not null")
        told = bound(trim(F.col("text"), F.col("item")), lambda t: F.struct(F.md5(t).alias("text_md5"), F.length(t).alias("n_chars")))
        return s.select("filing_id", "seq", told.alias("t")).select("filing_id", "seq", "t.*")

    return query


def stubs(spark, sf_dir: str) -> DataFrame:
    """Both classifiers on each section as trimmed to its item."""
    s = sections(spark, sf_dir).withColumn("item", name_key(F.col("name"))).where("item is not null")
    both = bound(trim_structural(F.col("text"), F.col("item")), lambda t: F.struct(stub(t).alias("one"), stub(t, POINTERS).alias("two")))
    s = s.select("filing_id", "seq", both.alias("b")).select("filing_id", "seq", "b.*")
    return s.select("filing_id", "seq", F.col("one.is_stub").alias("is_stub_1"), F.col("one.reason").alias("reason_1"), F.col("two.is_stub").alias("is_stub_2"), F.col("two.reason").alias("reason_2"))


def ordered_items(spark, sf_dir: str) -> DataFrame:
    return parsed_items(sections(spark, sf_dir)).select("filing_id", "item", "ord", "seq", F.md5("text").alias("text_md5"))


def empty_filings(spark, sf_dir: str) -> DataFrame:
    """Filings of which no item is left: rejected, nothing is stored."""
    s = sections(spark, sf_dir)
    found = s.groupBy("filing_id").agg(F.count("*").alias("n_sections"))
    return found.join(parsed_items(s).select("filing_id").distinct(), "filing_id", "left_anti")


def listing(spark, sf_dir: str) -> DataFrame:
    """One line a filing: its items in canonical order with their characters and stub reason."""
    s = sections(spark, sf_dir).withColumn("item", name_key(F.col("name"))).where("item is not null")
    first = s.groupBy("filing_id", "item").agg(F.min_by("text", "seq").alias("text"))
    told = bound(trim_to_item(F.col("text"), F.col("item")), lambda t: F.struct(F.length(t).alias("n"), stub(t)["reason"].alias("reason")))
    one = first.select("filing_id", "item", told.alias("t"), F.array_position(F.array(*map(F.lit, KEYS)), F.col("item")).alias("ord")).select("filing_id", "item", "t.*", "ord")
    by = one.groupBy("filing_id").agg(F.array_sort(F.collect_list(F.struct("ord", F.concat_ws(":", "item", F.col("n").cast("string"), F.coalesce("reason", F.lit("real"))).alias("line")))).alias("l"))
    return by.select("filing_id", F.array_join(F.transform("l", lambda x: x["line"]), ";").alias("items"))


def fetched(spark, sf_dir: str) -> DataFrame:
    """Requests for three items of each filing: the section's text, or why there is none; item 1c is new in 2023."""
    s = sections(spark, sf_dir)
    ask = s.select("filing_id").distinct().select("filing_id", (2018 + F.col("filing_id") % 8).cast("int").alias("fiscal_year"), F.explode(F.array(F.lit("1c"), F.lit("7a"), F.lit("11"))).alias("item"))
    have = s.withColumn("item", name_key(F.col("name"))).where("item is not null").groupBy("filing_id", "item").agg(F.min_by("text", "seq").alias("text"))
    out = ask.join(have, ["filing_id", "item"], "left")
    status = F.when(F.col("text").isNotNull(), "found").when((F.col("item") == "1c") & (F.col("fiscal_year") < 2023), "not yet required").otherwise("missing")
    return out.select("filing_id", "item", "fiscal_year", status.alias("status"), F.md5(trim_to_item(F.col("text"), F.col("item"))).alias("text_md5"))


def soft_cap(context: Column, fraction: float = 0.4) -> Column:
    """Characters of a section worth inlining: a share of the model's tokens, at four characters a token."""
    return F.floor(context * F.lit(fraction) * 4).cast("long")


def over_cap(spark, sf_dir: str, fraction: float = 0.01) -> DataFrame:
    """Items beyond each model's cap at ``fraction`` of its context; the list of models is fixed and small."""
    s = sections(spark, sf_dir).select("filing_id", "seq", F.length("text").alias("n"))
    models = F.array(*(F.struct(F.lit(k).alias("model"), F.lit(v).alias("context")) for k, v in MODELS.items()))
    each = s.select("filing_id", "seq", "n", F.inline(models))
    return each.where(F.col("n") > soft_cap(F.col("context"), fraction)).select("filing_id", "seq", "model", (F.col("n") - soft_cap(F.col("context"), fraction)).alias("over"))


def batch_report(spark, sf_dir: str) -> DataFrame:
    """Outcome of a batch in which every filing stands alone: its status, and from_cache where it was done before (even ids); counted."""
    s = sections(spark, sf_dir)
    good = parsed_items(s).select("filing_id").distinct().withColumn("ok", F.lit(True))
    by = s.groupBy("filing_id").agg(F.count("*").alias("n")).join(good, "filing_id", "left")
    status = F.when(F.col("ok") & (F.col("n") == 12), "success").otherwise("error")
    cached = (status == "success") & (F.col("filing_id") % 2 == 0)
    return by.groupBy(status.alias("status"), cached.alias("from_cache")).agg(F.count("*").alias("n_filings"), F.sum("n").alias("n_sections"))


W = f"[{SQL_SPACE}]"
_POINTERS = tuple(x.format(s=W, n=f"[^{SQL_SPACE}]") for x in POINTER_FORMS)


def sql_strip(x: str, ends: str = "both") -> str:
    return f"regexp_replace({x}, '{f'^{W}+|' if ends == 'both' else ''}{W}+$', '', 'g')"


_ITEM = f"regexp_extract(lower({sql_strip('name')}), 'item[_{SQL_SPACE}]+([0-9]{{1,2}}[a-c]?)\\b', 1)"
KEY = f"CASE WHEN {_ITEM} IN (" + ", ".join(f"'{k}'" for k in KEYS) + f") THEN {_ITEM} END"
ORD = "list_position([" + ", ".join(f"'{k}'" for k in KEYS) + "], item)"
KEYED = f"(SELECT * FROM (SELECT *, {KEY} AS item FROM ({SECTIONS})) WHERE item IS NOT NULL)"
_PARTS = {
    "one": (f"(?i)(^|[^A-Za-z])(item{W}+\\d{{1,2}}[a-c]?{W}*\\.)([^0-9]|$)", f"(?i)^item{W}+(\\d{{1,2}}[a-c]?)", 2),
    "two": (f"(^[ \\t]*|\\n[ \\t]*|[^{SQL_SPACE}A-Za-zÀ-ÿ\"''(\\[]|PART{W}+[IVX]+)((?:Item|ITEM){W}+\\d{{1,2}}[a-cA-C]?{W}*\\.)([^0-9]|$)", f"^(?:Item|ITEM){W}+(\\d{{1,2}}[a-cA-C]?)", 1),
}


def _sql_trim(which: str, source: str) -> str:
    heading, number, own = _PARTS[which]
    parts = f"SELECT *, string_split(regexp_replace(text, '{heading}', '\\1' || chr(1) || '\\2\\3', 'g'), chr(1)) AS p FROM {source}"
    at = f"SELECT *, coalesce(list_position(list_transform(p, lambda s, k: k > {own} AND lower(regexp_extract(s, '{number}', 1)) <> item), true), 0) AS cut FROM ({parts})"
    cut = f"SELECT * EXCLUDE (text, p, cut), CASE WHEN cut > 0 THEN {sql_strip("array_to_string(p[1:cut - 1], '')", 'right')} ELSE text END AS text FROM ({at})"
    if which == "two":
        bare = f"regexp_replace({sql_strip('text', 'right')}, 'PART{W}+[IVX]+$', '')"
        cut = f"SELECT * EXCLUDE (text), {sql_strip(bare, 'right')} AS text FROM ({cut})"
    return f"({cut})"


def sql_remaining(text: str, pointers: tuple[str, ...]) -> str:
    any_of = "(?i)" + "|".join(pointers)
    return f"length(regexp_replace(regexp_replace(array_to_string(list_filter(string_split(regexp_replace({text}, '([.!?]){W}+', '\\1' || chr(1), 'g'), chr(1)), lambda s: NOT regexp_matches(s, '{any_of}')), ' '), '!?\\[[^\\]]*\\]\\([^)]*\\)', '', 'g'), '[{SQL_SPACE}\\-|*]+', '', 'g'))"


def _sql_stub(name: str, pointers: tuple[str, ...]) -> str:
    any_of = "(?i)" + "|".join(pointers)
    left = sql_remaining("text", pointers)
    compact = f"trim(regexp_replace(text, '{W}+', ' ', 'g'))"
    return f"""CASE WHEN length({compact}) < 80 AND regexp_matches({compact}, '(?i)\\[\\s*reserved\\s*\\]') THEN 'section marked as reserved/deprecated'
      WHEN regexp_matches(text, '{any_of}') AND {left} < 100 THEN CASE WHEN regexp_matches(text, '(?i){_POINTERS[0]}') THEN 'incorporated by reference from proxy statement' ELSE 'cross-reference pointer stub' END END AS {name}"""


ITEMS_SQL = f"""SELECT filing_id, item, CAST({ORD} AS INTEGER) AS ord, seq, text FROM (SELECT *, row_number() OVER (PARTITION BY filing_id, item ORDER BY seq) AS n
  FROM (SELECT *, {_sql_stub("reason", _POINTERS)} FROM {_sql_trim("two", f"(SELECT * FROM {KEYED} WHERE {sql_strip('text')} <> '')")}) WHERE reason IS NULL) WHERE n = 1"""
FIRST = f"(SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY filing_id, item ORDER BY seq) AS n FROM {KEYED}) WHERE n = 1)"

QUERIES = {
    "t1_item_keys": keys, "t2_boundaries": boundaries(trim_to_item), "t3_structural_boundaries": boundaries(trim_structural), "t4_stubs": stubs, "t5_ordered_items": ordered_items, "t6_empty_filings": empty_filings,
    "t14_section_listing": listing, "t15_section_fetch": fetched, "t18_over_soft_cap": over_cap, "t20_batch_report": batch_report,
}
_KEY_LIST = ", ".join(f"'{k}'" for k in KEYS)
ORACLE_SQL = {
    "t1_item_keys": f"""SELECT filing_id, seq, CASE WHEN k IN ({_KEY_LIST}) THEN k END AS strict, {KEY} AS by_name,
      CASE WHEN regexp_matches(name, '^Item \\d+[A-Z]?') THEN regexp_extract(name, '^(Item \\d+[A-Z]?)', 1) ELSE '_unknown' END AS by_path
      FROM (SELECT *, lower(trim(regexp_replace(regexp_replace({sql_strip('name')}, '(?i)^item{W}+', ''), '\\.+$', ''))) AS k FROM ({SECTIONS}))""",
    "t2_boundaries": f"SELECT filing_id, seq, md5(text) AS text_md5, CAST(length(text) AS INTEGER) AS n_chars FROM {_sql_trim('one', KEYED)}",
    "t3_structural_boundaries": f"SELECT filing_id, seq, md5(text) AS text_md5, CAST(length(text) AS INTEGER) AS n_chars FROM {_sql_trim('two', KEYED)}",
    "t4_stubs": f"""SELECT filing_id, seq, reason_1 IS NOT NULL AS is_stub_1, reason_1, reason_2 IS NOT NULL AS is_stub_2, reason_2
      FROM (SELECT *, {_sql_stub("reason_1", _POINTERS[:1])}, {_sql_stub("reason_2", _POINTERS)} FROM {_sql_trim("two", KEYED)})""",
    "t5_ordered_items": f"SELECT filing_id, item, ord, seq, md5(text) AS text_md5 FROM ({ITEMS_SQL})",
    "t6_empty_filings": f"SELECT filing_id, count(*) AS n_sections FROM ({SECTIONS}) WHERE filing_id NOT IN (SELECT filing_id FROM ({ITEMS_SQL})) GROUP BY 1",
    "t14_section_listing": f"""SELECT filing_id, string_agg(item || ':' || length(text) || ':' || coalesce(reason, 'real'), ';' ORDER BY {ORD}) AS items
      FROM (SELECT *, {_sql_stub("reason", _POINTERS[:1])} FROM {_sql_trim("one", FIRST)}) GROUP BY 1""",
    "t15_section_fetch": f"""SELECT a.filing_id, a.item, CAST(2018 + a.filing_id % 8 AS INTEGER) AS fiscal_year,
      CASE WHEN text IS NOT NULL THEN 'found' WHEN a.item = '1c' AND 2018 + a.filing_id % 8 < 2023 THEN 'not yet required' ELSE 'missing' END AS status, md5(text) AS text_md5
      FROM (SELECT DISTINCT filing_id, unnest(['1c', '7a', '11']) AS item FROM ({SECTIONS})) a LEFT JOIN {_sql_trim("one", FIRST)} s ON a.filing_id = s.filing_id AND a.item = s.item""",
    "t18_over_soft_cap": "SELECT filing_id, seq, model, n - cap AS over FROM (SELECT filing_id, seq, length(text) AS n FROM (" + SECTIONS + ")), (VALUES " + ", ".join(f"('{k}', CAST(floor({v} * 0.01 * 4) AS BIGINT))" for k, v in MODELS.items()) + ") m(model, cap) WHERE n > cap",
    "t20_batch_report": f"""SELECT status, status = 'success' AND filing_id % 2 = 0 AS from_cache, count(*) AS n_filings, CAST(sum(n) AS BIGINT) AS n_sections FROM
      (SELECT filing_id, count(*) AS n, CASE WHEN count(*) = 12 AND filing_id IN (SELECT filing_id FROM ({ITEMS_SQL})) THEN 'success' ELSE 'error' END AS status FROM ({SECTIONS}) GROUP BY 1) GROUP BY 1, 2""",
}
