"""Registered functions: native expressions, Arrow functions and Arrow aggregates, found after the built-in ones.

An aggregate of kind `states` has init, step, merge and finalize: each task folds its rows into one state a group, and
only states meet, so a group may be of any size. One of kind `aggregate` takes a group's values whole."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trimodel.errors import CompileError
from trimodel.functions.values import Value


@dataclass(frozen=True)
class Registered:
    """takes: Spark type names of the arguments. kind: native (columns to a column), arrow or aggregate (series),
    or states (call has init(), step(state, series...), merge(state, state) and finalize(state))."""

    name: str
    call: Callable
    takes: tuple[str, ...]
    returns: str
    kind: str = "arrow"
    deterministic: bool = True

    def __post_init__(self):
        if self.kind not in ("native", "arrow", "aggregate", "states"):
            raise CompileError(f"no such kind of function: {self.kind}")

    @property
    def type(self) -> T.DataType:
        return T._parse_datatype_string(self.returns)

    def column(self, args: list[Value]):
        if len(args) != len(self.takes):
            raise CompileError(f"{self.name} takes {len(self.takes)} arguments, not {len(args)}")
        columns = [a.col.cast(kind) for a, kind in zip(args, self.takes, strict=True)]
        if self.kind == "native":
            return self.call(*columns)
        return self._wrapped()(*columns)

    def _wrapped(self):
        call = self.call
        if self.kind == "aggregate":

            def whole(first: pd.Series) -> float:
                return call(first)

            return F.pandas_udf(whole, self.returns)
        if len(self.takes) == 1:

            def one(first: pd.Series) -> pd.Series:
                return call(first)

            made = F.pandas_udf(one, self.returns)
        else:

            def several(*series: pd.Series) -> pd.Series:
                return call(*series)

            made = F.pandas_udf(several, self.returns)
        return made if self.deterministic else made.asNondeterministic()

    def grouped(self, df: DataFrame, by: list[str], columns: tuple[str, ...], most: int = 50_000) -> DataFrame:
        """The aggregate by keys as tm_out. most: groups a task holds before it hands their states on."""
        call, keys = self.call, T.StructType([df.schema[c] for c in by])
        rows = df.select(*by, *[F.col(c).cast(kind).alias(f"tm_{k}") for k, (c, kind) in enumerate(zip(columns, self.takes, strict=True))])
        partial = T.StructType([*keys.fields, T.StructField("tm_state", T.BinaryType())])

        def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            states: dict = {}

            def out() -> pd.DataFrame:
                found = pd.DataFrame([k for k in states], columns=by) if by else pd.DataFrame(index=range(len(states)))
                found["tm_state"] = [pickle.dumps(v) for v in states.values()]
                return found

            for b in batches:
                groups = b.groupby(by, dropna=False, sort=False) if by else [((), b)]
                for key, part in groups:
                    key = tuple(None if pd.isna(x) else x for x in (key if isinstance(key, tuple) else (key,)))
                    states[key] = call.step(states[key] if key in states else call.init(), *[part[f"tm_{k}"] for k in range(len(columns))])
                if len(states) >= most:
                    yield out()
                    states.clear()
            if states:
                yield out()

        def finish(key: tuple, found: pd.DataFrame) -> pd.DataFrame:
            state = call.init()
            for s in found["tm_state"]:
                state = call.merge(state, pickle.loads(s))
            return pd.DataFrame([(*key, call.finalize(state))], columns=[*by, "tm_out"])

        schema = T.StructType([*keys.fields, T.StructField("tm_out", self.type)])
        return rows.mapInPandas(fold, partial).groupBy(*by).applyInPandas(finish, schema)

    def __call__(self, args: list[Value]) -> Value:
        if self.kind in ("aggregate", "states"):
            raise CompileError(f"{self.name} is an aggregate")
        return Value(self.column(args), self.type)
