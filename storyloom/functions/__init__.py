"""Column functions: each takes and returns Columns and stays inside the JVM unless its docstring says otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def lit_strings(values) -> Column:
    """An array literal of strings."""
    return F.array(*[F.lit(v) for v in values])


def blank_to_null(c) -> Column:
    """The trimmed string, or NULL when nothing is left."""
    c = F.col(c) if isinstance(c, str) else c
    t = F.trim(c)
    return F.when(F.length(t) > 0, t)


def clip(c: Column, lo: float, hi: float) -> Column:
    """`c` limited to [lo, hi]; NULL stays NULL, which bare greatest/least would not keep."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(lo)), F.lit(hi)))
