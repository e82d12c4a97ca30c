"""Small helpers for array columns."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once for a row however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def shl(a: Column, n) -> Column:
    return F.call_function("shiftleft", a, F.lit(n) if isinstance(n, int) else n.cast("int"))


def shr(a: Column, n) -> Column:
    return F.call_function("shiftright", a, F.lit(n) if isinstance(n, int) else n.cast("int"))
