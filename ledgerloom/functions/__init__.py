"""Column functions: fiscal calendar, text measures, redaction, identifiers."""

from __future__ import annotations

from collections.abc import Callable
from unicodedata import category

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode has it, for the inside of a pattern's brackets; Java's own class knows ASCII's alone. The second is for DuckDB's patterns.
SPACE = r"\p{IsWhite_Space}\x1c-\x1f"
SQL_SPACE = r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


WHITE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
#: Spaces alone (Unicode's category Zs), which DuckDB's trim takes.
SPACES = "".join(c for c in WHITE if category(c) == "Zs")


def stripped(text: Column | str) -> Column:
    """``text`` without white space at its ends, of which alone it looks at more than one character."""
    return F.trim(text, F.lit(WHITE))


def right_stripped(text: Column | str) -> Column:
    return F.rtrim(text, F.lit(WHITE))


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)`` with ``value`` computed once, however often ``f`` names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def fiscal_year(period_end: Column, fye_month: Column) -> Column:
    return F.year(period_end) + F.when(F.month(period_end) > fye_month, 1).otherwise(0)


def fiscal_quarter(period_end: Column, fye_month: Column) -> Column:
    """Quarter 1-4; null where the month isn't a whole number of quarters before the year's end, or the end is no month."""
    ahead = F.pmod(fye_month - F.month(period_end), F.lit(12))
    return F.when(fye_month.between(1, 12) & (ahead % 3 == 0), (4 - ahead / 3).cast("int"))


def cjk_ratio(text: Column) -> Column:
    """Share of CJK ideographs among the characters that aren't white space; 0 for a text without any."""
    solid = F.regexp_replace(text, r"\s", "")
    return F.when(F.length(solid) > 0, F.length(F.regexp_replace(solid, "[^\\u4e00-\\u9fff\\u3400-\\u4dbf]", "")) / F.length(solid)).otherwise(0.0)


def citation(accession: Column, item: Column, index: Column) -> Column:
    return F.concat(F.lit("sec://"), accession, F.lit("/"), item, F.lit("#"), index.cast("string"))


def uuid5_dns(name: Column) -> Column:
    """Version 5 UUID of a name in the DNS namespace."""
    h = F.sha1(F.concat(F.unhex(F.lit("6ba7b8109dad11d180b400c04fd430c8")), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 8))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def item_key(heading: Column) -> Column:
    """``Item 1A. Risk Factors`` -> ``1a``; null where there is no item number."""
    key = F.lower(F.regexp_extract(heading, rf"(?i)^[{SPACE}]*item[{SPACE}]+(\d{{1,2}}[a-c]?)\b", 1))
    return F.when(key != "", key)


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


def contains_cjk(text: Column) -> Column:
    return text.rlike("[\\u4e00-\\u9fff\\u3400-\\u4dbf]")
