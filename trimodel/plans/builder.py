"""The plan API: what the language has no words for, with its semantics.

    session.table("orders").where("o_totalprice > 1000").group_by("o_custkey").agg(total=("sum", "o_totalprice"))

Every method returns a new relation; `df` is the lazy DataFrame.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trimodel.errors import CompileError
from trimodel.functions.aggregates import aggregate
from trimodel.functions.compiler import Registry, Scope, compile_filter, compile_value, expression
from trimodel.functions.values import Value
from trimodel.lang import tree as t
from trimodel.plans.query import JOINS, sorted_by, under, whole

#: Names of join strategies and Spark's hints for them.
STRATEGIES = {"hash": "shuffle_hash", "broadcast": "broadcast", "merge": "merge", "nested_loop": "shuffle_replicate_nl"}


@dataclass(frozen=True)
class Relation:
    df: DataFrame
    aliases: tuple[str, ...] = ()
    keys: tuple[str, ...] | None = None
    params: Mapping = field(default_factory=dict)
    functions: Registry = field(default_factory=dict)

    @property
    def scope(self) -> Scope:
        return Scope(self.df.schema, self.aliases, self.params, self.functions)

    def _with(self, df: DataFrame, **more) -> Relation:
        return replace(self, df=df, **more)

    def _value(self, e: t.Expr | str) -> Value:
        return compile_value(expression(e), self.scope)

    def bind(self, *positional: object, **named: object) -> Relation:
        return replace(self, params={**self.params, **{k + 1: p for k, p in enumerate(positional)}, **named})

    def alias(self, name: str) -> Relation:
        if self.aliases:
            raise CompileError("the relation has an alias already")
        return self._with(under(self.df, name), aliases=(name,))

    def where(self, condition: t.Expr | str) -> Relation:
        return self._with(self.df.filter(compile_filter(expression(condition), self.scope).col))

    def select(self, *paths: str, **computed: t.Expr | str) -> Relation:
        columns = [self._value(p).col.alias(p) for p in paths] + [self._value(e).col.alias(n) for n, e in computed.items()]
        return self._with(self.df.select(*columns), aliases=())

    def project(self, *names: str) -> Relation:
        """The columns of these names that there are."""
        return self._with(self.df.select(*[F.col(f"`{n}`") for n in names if n in self.df.columns]))

    def join(self, other: Relation, on: t.Expr | str | None = None, kind: str = "inner", strategy: str | None = None) -> Relation:
        """strategy: hash, broadcast, merge or nested_loop; without one Spark chooses by size."""
        if not (self.aliases and other.aliases):
            raise CompileError("both sides of a join need an alias")
        right = other.df.hint(STRATEGIES[strategy]) if strategy else other.df
        if kind == "cross" or on is None:
            if kind not in ("cross", "inner"):
                raise CompileError(f"a {kind} join needs a condition")
            return self._with(self.df.crossJoin(right), aliases=self.aliases + other.aliases)
        both = Scope(type(self.df.schema)([*self.df.schema.fields, *other.df.schema.fields]), self.aliases + other.aliases, self.params, self.functions)
        return self._with(self.df.join(right, compile_filter(expression(on), both).col, JOINS[kind]), aliases=both.aliases)

    def group_by(self, *keys: str) -> Relation:
        return replace(self, keys=keys)

    def agg(self, **aggregates: tuple | str) -> Relation:
        """name=("sum", expression), ("first", expression, order expression), ("count",) or "count"; a trailing
        "distinct" counts, sums or averages different values. Without group_by, one row."""
        columns = []
        for name, spec in aggregates.items():
            function, *args = (spec,) if isinstance(spec, str) else spec
            distinct = bool(args) and args[-1] == "distinct"
            values = [self._value(a) for a in (args[:-1] if distinct else args)]
            ordered = function in ("first", "last") and len(values) > 1
            columns.append(aggregate(function, values[:1] if ordered else values, distinct, values[1] if ordered else None).alias(name))
        groups = [self._value(k).col.alias(k) for k in self.keys or ()]
        if not columns:
            return self._with(self.df.select(*groups).distinct(), keys=None, aliases=())
        return self._with(self.df.groupBy(*groups).agg(*columns), keys=None, aliases=())

    def distinct(self) -> Relation:
        return self._with(self.df.distinct())

    def order_by(self, *terms: str) -> Relation:
        """Terms as in `order by`: "path", "path desc", "path desc nulls first"."""
        from trimodel.lang.parser import parse

        orders = parse(f"get from t order by {', '.join(terms)}")[0].order
        return self._with(self.df.orderBy(*[sorted_by(o, self.scope) for o in orders]))

    def top(self, n: int, *terms: str) -> Relation:
        """The first n in the order: one pass with n rows a task, and no full sort."""
        return self.order_by(*terms).take(n)

    def skip(self, n: int) -> Relation:
        return self._with(self.df.offset(whole(n, self.scope)))

    def take(self, n: int) -> Relation:
        return self._with(self.df.limit(whole(n, self.scope)))

    def between(self, column: str, low: object, high: object) -> Relation:
        """A key range scan, both ends included."""
        return self.where(t.Binary("and", t.Binary(">=", t.Path((column,)), t.Literal(low)), t.Binary("<=", t.Path((column,)), t.Literal(high))))

    def lookup(self, column: str, value: object) -> Relation:
        """An exact match on a key or an indexed column: a filter that the scan prunes by."""
        return self.where(t.Binary("=", t.Path((column,)), t.Literal(value)))

    def prefix(self, column: str, text: str) -> Relation:
        return self._with(self.df.filter(F.startswith(self._value(column).col, F.lit(text))))

    def flatten(self) -> Relation:
        """Structs as columns named by their dotted path."""
        from trimodel.operators.shape import flatten_structs

        return self._with(flatten_structs(self.df), aliases=())

    def count(self) -> Relation:
        return self._with(self.df.agg(F.count(F.lit(1)).alias("count")), aliases=())
