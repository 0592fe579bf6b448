"""`get` and `count` as DataFrame plans.

Filters and joins come below the sort, the sort below the projection (so a column that isn't returned still orders), and
`skip` goes before `take`. In a query with aliases or joins each table is a struct column under its alias; Catalyst
still prunes the unused fields of the structs from the scans.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trimodel.errors import CompileError
from trimodel.functions.compiler import Registry, Scope, compile_filter
from trimodel.lang import tree as t

JOINS = {"inner": "inner", "left": "left", "right": "right", "full": "full"}


def under(df: DataFrame, alias: str) -> DataFrame:
    """Each row as one struct column. The struct itself is never NULL, so an outer join's missing side is told apart."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(alias))


def alias_of(table: str, alias: str | None) -> str:
    return alias or table.rpartition(".")[2]


def compile_get(q: t.Get, table: Callable[[str], DataFrame], params: Mapping, functions: Registry) -> DataFrame:
    df = table(q.table)
    aliases: tuple[str, ...] = ()
    if q.alias or q.joins:
        aliases = (alias_of(q.table, q.alias),)
        df = under(df, aliases[0])
    for j in q.joins:
        name = alias_of(j.table, j.alias)
        if name in aliases:
            raise CompileError(f"two tables are named {name}; give one an alias")
        right = under(table(j.table), name)
        both = (*aliases, name)
        if j.kind == "cross":
            df = df.crossJoin(right)
        else:
            joined = Scope(df.schema.__class__([*df.schema.fields, *right.schema.fields]), both, params, functions)
            df = df.join(right, compile_filter(j.on, joined).col, JOINS[j.kind])
        aliases = both
    scope = Scope(df.schema, aliases, params, functions)
    if q.where is not None:
        df = df.filter(compile_filter(q.where, scope).col)
    if q.order:
        df = df.orderBy(*[sorted_by(o, scope) for o in q.order])
    if q.skip is not None:
        df = df.offset(whole(q.skip, scope))
    if q.take is not None:
        df = df.limit(whole(q.take, scope))
    if q.columns:
        df = df.select(*[scope.column(c.parts).col.alias(c.name) for c in q.columns])
    return df


def sorted_by(o: t.Order, scope: Scope):
    col = scope.column(o.path.parts).col
    nulls_first = not o.descending if o.nulls_first is None else o.nulls_first  # NULL is the smallest value
    if o.descending:
        return col.desc_nulls_first() if nulls_first else col.desc_nulls_last()
    return col.asc_nulls_first() if nulls_first else col.asc_nulls_last()


def whole(n: int | t.Param, scope: Scope) -> int:
    value = scope.param(n.key) if isinstance(n, t.Param) else n
    if type(value) is not int or value < 0:
        raise CompileError(f"take and skip need a whole number, not {value!r}")
    return value


def compile_count(q: t.Count, table: Callable[[str], DataFrame], params: Mapping, functions: Registry) -> DataFrame:
    df = table(q.table)
    if q.where is not None:
        df = df.filter(compile_filter(q.where, Scope(df.schema, (), params, functions)).col)
    return df.agg(F.count(F.lit(1)).alias("count"))
