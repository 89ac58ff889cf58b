"""Table scans and keyed stores."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scan(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticker(raw: Column) -> Column:
    """Upper-cased stripped ticker; null where it isn't a valid one."""
    up = F.upper(F.trim(raw))
    return F.when(up.rlike(r"^[A-Z0-9][A-Z0-9.\-]*$"), up)


def latest_per_key(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Last write wins: one row per key, the one with the greatest ``order``; a map-side aggregate, no window."""
    rest = [c for c in df.columns if c not in key]
    best = df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return best.select(*key, *(F.col("_row")[c].alias(c) for c in rest))


NUMBER = r"(?i)^\s*[+-]?(?:(?:\d+(?:_\d+)*\.?(?:\d+(?:_\d+)*)?|\.\d+(?:_\d+)*)(?:e[+-]?\d+(?:_\d+)*)?|inf|infinity|nan)\s*$"


def number(cell: Column) -> Column:
    """The cell as a double, in the forms 12, 1_000, .5 and 2e3; null else."""
    return F.when(cell.rlike(NUMBER), F.regexp_replace(F.trim(cell), "_", "").try_cast("double"))


def auto_typed(cell: Column) -> dict[str, Column]:
    """A CSV cell's value as boolean, number or string: one of the typed columns; all are null for a null or empty cell. Blanks are a string."""
    some = cell.isNotNull() & (cell != "")
    flag = F.when(F.lower(cell).isin("true", "false"), F.lower(cell) == "true")
    value = F.when(flag.isNull(), number(cell))
    return {"as_bool": F.when(some, flag), "as_double": F.when(some, value), "as_string": F.when(some & flag.isNull() & value.isNull(), cell)}


def reject_reason(cell: Column, kind: str) -> Column:
    """Why a cell isn't of its declared kind (json, str, float, bool), else null; null and empty cells are of every kind."""
    good = {"json": F.try_parse_json(cell).isNotNull(), "str": F.lit(True), "float": number(cell).isNotNull(), "bool": F.lower(cell).isin("true", "false")}
    if kind not in good:
        raise ValueError(f"unknown column type: {kind}")
    return F.when(cell.isNotNull() & (cell != "") & ~good[kind], F.lit(f"not {kind}"))


BUCKETS = ("input", "expected", "metadata")


def mapped(mapping: dict[str, str]) -> dict[str, Column]:
    """Columns input, expected and metadata from source columns by target paths such as ``input.user.id``.

    A bucket with a path into it is an object, and a plain value for it is dropped. A bucket that nothing is mapped to is null.
    """
    tree: dict = {}
    objects = {t.split(".")[0] for t in mapping.values() if "." in t}
    for column, target in mapping.items():
        parts = target.split(".")
        if not target or any(not p or p != p.strip() for p in parts) or parts[0] not in BUCKETS:
            raise ValueError(f"invalid target: {target!r}")
        if len(parts) == 1 and parts[0] in objects:
            continue
        at = tree
        for p in parts[:-1]:
            at = at[p] if isinstance(at.get(p), dict) else at.setdefault(p, {}) if p not in at else at.update({p: {}}) or at[p]
        at[parts[-1]] = column
    build = lambda x: F.col(x) if isinstance(x, str) else F.struct(*(build(v).alias(k) for k, v in x.items()))
    return {b: build(tree[b]) if b in tree else F.lit(None).cast("string") for b in BUCKETS}


def dataset(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A CSV dataset with a header, all cells as text. A missing column or no row at all is an error; one file may hold line breaks in quotes."""
    rows = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', inferSchema=False, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    missing = [c for c in columns if c not in rows.columns]
    if missing:
        raise ValueError(f"CSV lacks columns: {', '.join(missing)}")
    if rows.isEmpty():
        raise ValueError("CSV has no rows")
    return rows


def save(rows: DataFrame, path: str, keys: list[str]) -> None:
    """Write a keyed store: the partitions of the keys in ``rows`` are replaced, others stay, so a rerun leaves no duplicate. One row a key."""
    rows.repartition(*keys).write.partitionBy(*keys).option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def bucketed(rows: DataFrame, keys: list[str], buckets: int = 16, name: str | None = None) -> DataFrame:
    """``rows`` as a table of the warehouse in ``buckets`` by hash of ``keys``, each sorted by them: tables of equal buckets join and group by the keys without a shuffle. Without a name it gets one of its own."""
    name = name or f"bucketed_{uuid.uuid4().hex}"
    rows.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys).format("parquet").saveAsTable(name)
    return rows.sparkSession.table(name)


def documented(df: DataFrame, comments: dict[str, str]) -> DataFrame:
    """``df`` with comments in its columns' metadata; every column needs one."""
    missing = [c for c in df.columns if c not in comments]
    if missing:
        raise ValueError(f"columns without a comment: {missing}")
    return df.select(*(F.col(c).alias(c, metadata={"comment": comments[c]}) for c in df.columns))


def schema_differences(one: DataFrame, other: DataFrame, apart: set[str]) -> list[tuple[str, str, str]]:
    """(column, type, comment) that only one of two tables has, but for the columns ``apart``."""
    rows = lambda d: {(f.name, f.dataType.simpleString(), f.metadata.get("comment", "")) for f in d.schema if f.name not in apart}
    return sorted(rows(one) ^ rows(other))


def derived(spark: SparkSession, sf_dir: str, sql: str, *names: str) -> DataFrame:
    """A query over some of the tables, which it names by themselves."""
    sql = sql.replace("{", "{{").replace("}", "}}")
    for name in names:
        sql = re.sub(rf"\b(FROM|JOIN) {name}\b", rf"\1 {{{name}}}", sql)
    return spark.sql(sql, **{name: scan(spark, sf_dir, name) for name in names})
