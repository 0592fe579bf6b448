"""Queries on streams: the compiled filter and projection of a `get`, on a streaming DataFrame."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame

from trimodel.errors import CompileError
from trimodel.lang import tree as t
from trimodel.lang.parser import parse
from trimodel.plans.query import compile_get


def on_stream(text: str, stream: DataFrame, params: Mapping = {}) -> DataFrame:  # noqa: B006
    """A `get` of one table without order, take or skip, applied to a stream."""
    (q,) = parse(text)
    if not isinstance(q, t.Get) or q.order or q.take is not None or q.skip is not None or q.joins:
        raise CompileError("a stream takes a 'get' with columns and 'where' only")
    return compile_get(q, lambda _: stream, params, {})
