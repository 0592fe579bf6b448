"""Results as flat tables, as key and value, or as documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def flatten_structs(df: DataFrame) -> DataFrame:
    """Every struct field as a column named by its dotted path."""

    def leaves(kind: T.StructType, path: tuple[str, ...]):
        for f in kind.fields:
            if isinstance(f.dataType, T.StructType):
                yield from leaves(f.dataType, (*path, f.name))
            else:
                yield (*path, f.name)

    return df.select(*[F.col(".".join(f"`{p}`" for p in path)).alias(".".join(path)) for path in leaves(df.schema, ())])


def as_documents(df: DataFrame) -> DataFrame:
    """One JSON text a row."""
    return df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("document"))


def as_key_values(df: DataFrame) -> DataFrame:
    """The row key, and the rest as JSON."""
    key = row_key(df.columns)
    rest = [F.col(f"`{c}`") for c in df.columns if c != key]
    return df.select(F.col(f"`{key}`").cast("string").alias("key"), (F.to_json(F.struct(*rest)) if rest else F.lit("{}")).alias("value"))


def row_key(columns: list[str]) -> str:
    """The column that identifies a row: `_id`, else `id`, else the first."""
    return next((c for c in ("_id", "id") if c in columns), columns[0])


def with_id(df: DataFrame) -> DataFrame:
    """The key as `_id` where rows have neither `_id` nor `id`."""
    return df if {"_id", "id"} & set(df.columns) else df.select(F.col(f"`{df.columns[0]}`").alias("_id"), "*")
