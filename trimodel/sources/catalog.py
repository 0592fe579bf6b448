"""Namespaces, tables, columns, indexes and defaults: what DDL statements change and `describe` shows."""

from __future__ import annotations

import copy
import re
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trimodel.errors import CatalogError
from trimodel.functions.values import SPARK_TYPES
from trimodel.lang import tree as t
from trimodel.sources.store import Column, Index, Manifest, Table

NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]{0,63}")
PROTECTED = ("default", "system")
#: Columns that a model adds to its rows.
DOCUMENT = T.StructType([T.StructField("_id", T.StringType()), T.StructField("_revision", T.LongType()), T.StructField("_deleted", T.BooleanType()), T.StructField("_created_at", T.TimestampType()), T.StructField("_updated_at", T.TimestampType())])
KEYSPACE = T.StructType([T.StructField("_id", T.StringType()), T.StructField("_expires_at", T.LongType())])


def dump_expr(e: t.Expr | None) -> dict | None:
    """Constants, arrays of them and calls, as JSON."""
    if e is None:
        return None
    if isinstance(e, t.Literal):
        return {"literal": e.value}
    if isinstance(e, t.ArrayOf):
        return {"array": [dump_expr(i) for i in e.items]}
    if isinstance(e, t.Call):
        return {"call": e.name, "args": [dump_expr(a) for a in e.args]}
    if isinstance(e, t.Unary) and e.op == "-" and isinstance(e.operand, t.Literal):
        return {"literal": -e.operand.value}
    raise CatalogError("a default is a constant, an array of constants or a function call")


def load_expr(d: Mapping) -> t.Expr:
    if "literal" in d:
        return t.Literal(d["literal"])
    if "array" in d:
        return t.ArrayOf(tuple(load_expr(i) for i in d["array"]))
    return t.Call(d["call"], tuple(load_expr(a) for a in d["args"]))


def spark_type(name: str) -> T.DataType:
    return T._parse_datatype_string(SPARK_TYPES[name])


def _column(c: t.ColumnDef) -> Column:
    return Column(c.name, c.type, c.primary, c.unique, c.required, dump_expr(c.default))


def make_table(m: Manifest, name: str, q: t.MakeTable) -> Table:
    namespace = name.partition(".")[0]
    if namespace not in m.namespaces:
        raise CatalogError(f"no namespace {namespace}")
    if name in m.tables:
        raise CatalogError(f"table {name} exists")
    columns = [_column(c) for c in q.columns]
    if len({c.name for c in columns}) < len(columns):
        raise CatalogError("a column comes twice")
    if q.model == "relational" and not columns:
        raise CatalogError("a relational table needs fields")
    table = Table(name, q.model, columns, [], q.ttl, q.description)
    table.indexes = [Index(f"uniq_{c.name}", [c.name], True) for c in columns if c.unique]
    fields = [T.StructField(c.name, spark_type(c.type)) for c in columns]
    base = {"relational": [], "document": DOCUMENT.fields, "keyspace": KEYSPACE.fields}[q.model]
    table.schema = T.StructType([*base, *(f for f in fields if f.name not in {b.name for b in base})]).json()
    m.tables[name] = table
    return table


def find(m: Manifest, name: str) -> Table:
    if name not in m.tables:
        raise CatalogError(f"no table {name}")
    return m.tables[name]


def drop_table(m: Manifest, name: str) -> Table:
    find(m, name)
    return m.tables.pop(name)


def make_index(m: Manifest, name: str, q: t.MakeIndex) -> None:
    table = find(m, name)
    if any(i.name == q.name for i in table.indexes):
        raise CatalogError(f"index {q.name} exists")
    missing = set(q.columns) - {c.name for c in table.columns} if table.columns else set()
    if missing:
        raise CatalogError(f"no column {sorted(missing)[0]} in {name}")
    table.indexes.append(Index(q.name, list(q.columns), q.unique))


def drop_index(m: Manifest, name: str, q: t.DropIndex) -> None:
    table = find(m, name)
    if not any(i.name == q.name for i in table.indexes):
        raise CatalogError(f"no index {q.name} on {name}")
    table.indexes = [i for i in table.indexes if i.name != q.name]


def make_namespace(m: Manifest, q: t.MakeNamespace) -> None:
    if not NAME.fullmatch(q.name):
        raise CatalogError(f"bad namespace name {q.name!r}")
    if q.name in m.namespaces:
        raise CatalogError(f"namespace {q.name} exists")
    m.namespaces[q.name] = q.description


def drop_namespace(m: Manifest, q: t.DropNamespace) -> list[Table]:
    if q.name in PROTECTED:
        raise CatalogError(f"namespace {q.name} can't be dropped")
    if q.name not in m.namespaces:
        raise CatalogError(f"no namespace {q.name}")
    inside = [n for n in m.tables if n.startswith(f"{q.name}.")]
    if inside and not q.force:
        raise CatalogError(f"namespace {q.name} has tables; drop it with 'force'")
    del m.namespaces[q.name]
    return [m.tables.pop(n) for n in inside]


def alter(table: Table, steps, rows: DataFrame, default) -> tuple[Table, DataFrame]:
    """The table and its rows after the steps. default: a column's default as a Spark column."""
    table = copy.deepcopy(table)
    at = lambda name: next((c for c in table.columns if c.name == name), None)

    def need(name: str) -> Column:
        if at(name) is None:
            raise CatalogError(f"no column {name} in {table.name}")
        return at(name)

    for step, what in steps:
        if step == "add":
            if at(what.name) is not None or what.name in rows.columns:
                raise CatalogError(f"column {what.name} exists")
            column = _column(what)
            table.columns.append(column)
            rows = rows.withColumn(column.name, default(column).cast(spark_type(column.type)))
            if column.unique:
                table.indexes.append(Index(f"uniq_{column.name}", [column.name], True))
        elif step == "drop":
            if need(what).primary:
                raise CatalogError(f"{what} is in the primary key")
            table.columns = [c for c in table.columns if c.name != what]
            table.indexes = [i for i in table.indexes if what not in i.columns]
            rows = rows.drop(what)
        elif step == "rename":
            old, new = what
            if at(new) is not None:
                raise CatalogError(f"column {new} exists")
            need(old).name = new
            for i in table.indexes:
                i.columns = [new if c == old else c for c in i.columns]
            rows = rows.withColumnRenamed(old, new)
        elif step == "type":
            need(what[0]).type = what[1]
            rows = rows.withColumn(what[0], F.col(what[0]).try_cast(spark_type(what[1])))
        elif step == "default":
            need(what[0]).default = dump_expr(what[1])
        elif step == "no default":
            need(what[0]).default = None
        elif step in ("nullable", "required"):
            need(what[0]).required = step == "required"
    return table, rows


DESCRIBED = "table string, model string, position int, name string, data_type string, nullable boolean, is_primary boolean, is_unique boolean, default_value string, indexes array<string>"


def describe(spark, table: Table) -> DataFrame:
    """A row for each column."""
    unique = {i.columns[0] for i in table.indexes if i.unique and len(i.columns) == 1}
    declared = {c.name: c for c in table.columns}
    names = [c.name for c in table.columns] or [f.name for f in table.struct.fields]
    rows = []
    for k, n in enumerate(names):
        c = declared.get(n) or Column(n, "any", n == "_id")
        default = None if c.default is None else str(c.default.get("literal", c.default.get("call", c.default.get("array"))))
        rows.append((table.name, table.model, k, n, c.type, not (c.required or c.primary), c.primary, c.primary or n in unique, default, [i.name for i in table.indexes if n in i.columns]))
    return spark.createDataFrame(rows, DESCRIBED)


def list_tables(spark, m: Manifest, namespace: str | None = None) -> DataFrame:
    rows = [(n.partition(".")[0], n.partition(".")[2], t_.model, t_.description) for n, t_ in sorted(m.tables.items()) if namespace in (None, n.partition(".")[0])]
    return spark.createDataFrame(rows, "namespace string, name string, model string, description string")


def list_namespaces(spark, m: Manifest) -> DataFrame:
    return spark.createDataFrame(sorted(m.namespaces.items()), "name string, description string")
