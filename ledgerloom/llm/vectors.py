"""Vectors as integers, for the operators that compare them exactly."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Components must be smaller than this, so that sums of squares of differences and inner products stay exact in 64 bits.
LIMIT = 1 << 27


def finite(v: Column | str) -> Column:
    """Whether a vector is not null and holds neither nulls nor non-finite components; an empty one holds none."""
    v = F.col(v) if isinstance(v, str) else v
    return F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def integers(v: Column | str, scale: int) -> Column:
    """floor(scale * x) of each component; one of ``LIMIT`` or more fails with a message that names it."""
    v = F.col(v) if isinstance(v, str) else v
    floor = lambda x: F.floor(x.cast("double") * float(scale))
    checked = lambda x: F.when(F.abs(x.cast("double") * float(scale)) < float(LIMIT), floor(x)).otherwise(F.raise_error(F.concat(F.lit("a component is too large for exact integers: "), x.cast("string"))))
    return F.transform(v, lambda x: checked(x).cast("int"))
