"""Aggregates with the language's NULL rules, as built-in partial aggregates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trimodel.errors import CompileError
from trimodel.functions.values import Value, number


def _or_null(v: Value) -> Column:
    """As float64, NULL staying NULL."""
    return F.when(v.col.isNotNull(), number(v)) if v.nullable else number(v)


def aggregate(name: str, args: list[Value], distinct: bool = False, by: Value | None = None) -> Column:
    """count: rows, whatever the argument (distinct: different values that aren't NULL). sum: 0 for NULL and for no rows.
    avg: over what isn't NULL. min: NULL if any is, NULL being the least. max: NULL only if all are. first, last: in the
    order of `by`."""
    name = name.lower()
    if name == "count":
        return F.count_distinct(*[a.col for a in args]) if distinct and args else F.count(F.lit(1))
    if len(args) != 1:
        raise CompileError(f"{name} takes one argument")
    a = args[0]
    if name == "sum":
        return F.coalesce(F.sum_distinct(number(a)) if distinct else F.sum(number(a)), F.lit(0.0))
    if name == "avg":
        return F.avg(_or_null(a)) if not distinct else F.try_divide(F.sum_distinct(_or_null(a)), F.count_distinct(_or_null(a)))
    if name == "min":
        return F.when(F.count(a.col) < F.count(F.lit(1)), F.lit(None)).otherwise(F.min(a.col)) if a.nullable else F.min(a.col)
    if name == "max":
        return F.max(a.col)
    if name in ("first", "last"):
        if by is None:
            raise CompileError(f"{name} needs an order ('by'): rows of a distributed table have none")
        return (F.min_by if name == "first" else F.max_by)(a.col, by.col)
    raise CompileError(f"unknown aggregate {name}")

