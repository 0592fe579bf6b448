"""Mutations as pure transforms of a table's rows; the store decides what is written."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trimodel.functions.compiler import Registry, Scope, compile_filter, compile_value
from trimodel.functions.values import exact
from trimodel.lang import tree as t


def matched(df: DataFrame, where: t.Expr | None, params: Mapping = {}, functions: Registry = {}):  # noqa: B006
    """The condition as a column that is never NULL."""
    return F.lit(True) if where is None else exact(compile_filter(where, Scope(df.schema, (), params, functions))).col


def changed(df: DataFrame, where: t.Expr | None, values: t.Assignments, params: Mapping = {}, functions: Registry = {}) -> DataFrame:  # noqa: B006
    """All assignments in one projection, on the old row; a new column is NULL in rows that don't match."""
    scope, hit = Scope(df.schema, (), params, functions), matched(df, where, params, functions)
    new = {name: compile_value(e, scope) for name, e in values}
    out = []
    for f in df.schema.fields:
        col = F.col(f"`{f.name}`")
        out.append(F.when(hit, new[f.name].col.cast(f.dataType)).otherwise(col).alias(f.name) if f.name in new else col)
    out += [F.when(hit, value.col).alias(name) for name, value in new.items() if name not in df.columns]
    return df.select(*out)


def removed(df: DataFrame, where: t.Expr, params: Mapping = {}, functions: Registry = {}) -> DataFrame:  # noqa: B006
    return df.filter(~matched(df, where, params, functions))


def put(df: DataFrame, rows: DataFrame, key: str | None = None) -> DataFrame:
    """rows after df; with a key, rows of df whose key comes again make way."""
    if key is not None:
        df = df.join(rows.select(F.col(key).alias("_new")), F.col(f"`{key}`").eqNullSafe(F.col("_new")), "left_anti")
    return df.unionByName(rows, allowMissingColumns=True)
