"""Syntax-tree expressions to typed columns."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trimodel.errors import CompileError
from trimodel.functions import builtins
from trimodel.functions import values as v
from trimodel.lang import tree as t
from trimodel.lang.parser import parse_expression

DUALS = {"=": "!=", "!=": "=", "<": ">=", ">=": "<", ">": "<=", "<=": ">"}
Registry = Mapping[str, Callable[[list[v.Value]], v.Value]]


def member(value: v.Value, name: str) -> v.Value:
    """A field of a struct, map or JSON text; NULL if there is none."""
    if value.is_(T.StructType):
        if name in value.type.names:
            f = value.type[name]
            return v.Value(value.col.getField(name), f.dataType, True)
    elif value.is_(T.MapType):
        return v.Value(F.try_element_at(value.col, F.lit(name)), value.type.valueType)
    elif value.is_(T.VariantType):
        return v.Value(F.try_variant_get(value.col, f"$.{name}", "string"), T.StringType())
    elif value.is_(T.StringType):
        return v.Value(F.get_json_object(value.col, f"$.{name}"), T.StringType())
    return v.literal(None)


@dataclass
class Scope:
    """Names of a row. Without aliases its columns are the table's; with them each alias is a struct of a table's."""

    schema: T.StructType
    aliases: tuple[str, ...] = ()
    params: Mapping = field(default_factory=dict)
    functions: Registry = field(default_factory=dict)

    def column(self, parts: tuple[str, ...]) -> v.Value:
        if self.aliases:
            for size in (2, 1):  # a table may be named with its namespace
                if ".".join(parts[:size]) in self.aliases and len(parts) >= size:
                    return self._down(self._top(".".join(parts[:size])), parts[size:])
            return self._down(self._top(self.aliases[0]), parts)  # an unqualified name is the base table's
        return self._down(self._top(parts[0]), parts[1:]) if parts[0] in self.schema.names else v.literal(None)

    def _top(self, name: str) -> v.Value:
        f = self.schema[name]
        return v.Value(F.col(f"`{name}`"), f.dataType, f.nullable)

    @staticmethod
    def _down(value: v.Value, parts: tuple[str, ...]) -> v.Value:
        for k, name in enumerate(parts):
            if value.is_(T.StringType):
                return v.Value(F.get_json_object(value.col, "$." + ".".join(parts[k:])), T.StringType())
            value = member(value, name)
        return value

    def param(self, key: int | str) -> object:
        if key not in self.params:
            raise CompileError(f"parameter ${key} isn't bound")
        return self.params[key]


def like_pattern(pattern: str) -> str:
    """`%` is any run of characters, `_` any one; nothing escapes; ASCII letters match in either case."""
    return r"(?is)\A" + "".join({"%": ".*", "_": "."}.get(c, re.sub(r"([^\w\s]|_)", r"\\\1", c)) for c in pattern) + r"\z"


def _valid_regex(pattern: str) -> bool:
    spark = SparkSession.getActiveSession()
    try:
        if spark is None:
            re.compile(pattern)
        else:
            spark.sparkContext._jvm.java.util.regex.Pattern.compile(pattern)
    except Exception:  # a bad pattern matches nothing
        return False
    return True


def compile_value(e: t.Expr, scope: Scope) -> v.Value:
    """The value of an expression; booleans are in exact form."""
    match e:
        case t.Literal(value):
            return v.literal(value)
        case t.Param(key):
            return v.literal(scope.param(key))
        case t.Path(parts):
            return scope.column(parts)
        case t.Unary("-", operand):
            inner = compile_value(operand, scope)
            return v.literal(-inner.const) if inner.known and type(inner.const) in (int, float) else v.Value(-v.number(inner), T.DoubleType(), False)
        case t.Binary("+" | "-" | "*" | "/" | "%" as op, left, right):
            return _arithmetic(op, compile_value(left, scope), compile_value(right, scope))
        case t.Unary() | t.Binary():
            return v.exact(compile_filter(e, scope))
        case t.Call(name, args):
            return _call(name, [compile_value(a, scope) for a in args], scope)
        case t.Case(branches, otherwise, operand):
            return _case(branches, otherwise, operand, scope)
        case t.ArrayOf(items):
            found = [compile_value(i, scope) for i in items]
            kind = v.common(found)
            const = [i.const for i in found] if all(i.known for i in found) else v.NONE
            return v.Value(F.array(*[i.col.cast(kind) if i.type != kind else i.col for i in found]), T.ArrayType(kind), False, const)
        case t.ObjectOf(fields):
            found = {name: compile_value(x, scope) for name, x in sorted(fields, key=lambda f: f[0])}
            if not found:
                return v.Value(F.create_map().cast("map<string,string>"), T.MapType(T.StringType(), T.StringType()), False)
            return v.Value(F.struct(*[x.col.alias(n) for n, x in found.items()]), T.StructType([T.StructField(n, x.type) for n, x in found.items()]), False)
    raise CompileError(f"no such expression: {e!r}")


def compile_filter(e: t.Expr, scope: Scope) -> v.Value:
    """The truth of an expression in filter form: NULL stands for false."""
    match e:
        case t.Binary("and" | "or" as op, left, right):
            a, b = compile_filter(left, scope), compile_filter(right, scope)
            return v.Value(a.col & b.col if op == "and" else a.col | b.col, T.BooleanType(), a.nullable or b.nullable)
        case t.Unary("not", operand):
            return _negated(operand, scope)
        case t.Unary("is null", operand):
            return v.equal(compile_value(operand, scope), v.literal(None))
        case t.Unary("is not null", operand):
            return v.unequal(compile_value(operand, scope), v.literal(None))
        case t.Binary(op, left, right) if op in OPERATORS:
            return OPERATORS[op](compile_value(left, scope), compile_value(right, scope))
    return v.truthy(compile_value(e, scope))


def _negated(e: t.Expr, scope: Scope) -> v.Value:
    """`not e`, with the negation moved inwards so that comparisons stay comparisons."""
    match e:
        case t.Unary("not", inner):
            return compile_filter(inner, scope)
        case t.Binary("and" | "or" as op, left, right):
            return compile_filter(t.Binary("or" if op == "and" else "and", t.Unary("not", left), t.Unary("not", right)), scope)
        case t.Binary(op, left, right) if op in DUALS:
            return compile_filter(t.Binary(DUALS[op], left, right), scope)
    return v.boolean(~v.exact(compile_filter(e, scope)).col)


def _arithmetic(op: str, a: v.Value, b: v.Value) -> v.Value:
    x, y = v.number(a), v.number(b)
    if op == "/":
        return v.Value(F.try_divide(x, y), T.DoubleType(), True)
    if op == "%":
        return v.Value(F.try_mod(x, y), T.DoubleType(), True)
    return v.Value({"+": x + y, "-": x - y, "*": x * y}[op], T.DoubleType(), False)


def _has(a: v.Value, b: v.Value) -> v.Value:
    if a.is_(T.StringType) and b.is_(T.StringType):
        return v.Value(F.contains(a.col, b.col), T.BooleanType(), a.nullable or b.nullable)
    if a.is_(T.ArrayType):
        return _in(b, a)
    return v.boolean(F.lit(False))


def _in(a: v.Value, b: v.Value) -> v.Value:
    if not b.is_(T.ArrayType):
        return v.boolean(F.lit(False))
    if b.known and isinstance(b.const, list) and len(b.const) and None not in b.const and not a.is_(T.NullType):
        same = [x for x in b.const if v.comparable(a, v.literal(x))]
        return v.Value(a.col.isin(same), T.BooleanType(), a.nullable) if same else v.boolean(F.lit(False))
    inner = v.Value(F.lit(None), b.type.elementType)
    if not (a.is_(T.NullType) or isinstance(b.type.elementType, T.NullType) or v.comparable(a, inner)):
        return v.boolean(F.lit(False))
    return v.Value(F.exists(b.col, lambda x: v.equal(v.Value(x, b.type.elementType), a).col), T.BooleanType(), b.nullable)


def _like(a: v.Value, b: v.Value) -> v.Value:
    if not (a.is_(T.StringType) and b.is_(T.StringType)):
        return v.boolean(F.lit(False))
    if b.known:
        return v.Value(a.col.rlike(like_pattern(b.const)), T.BooleanType(), a.nullable)
    quoted = F.regexp_replace(b.col, r"([^\w\s%])", r"\\$1")
    pattern = F.concat(F.lit(r"(?is)\A"), F.replace(F.replace(quoted, F.lit("%"), F.lit(".*")), F.lit("_"), F.lit(".")), F.lit(r"\z"))
    return v.Value(F.rlike(a.col, pattern), T.BooleanType(), True)


def _edge(test: Callable) -> Callable[[v.Value, v.Value], v.Value]:
    def build(a: v.Value, b: v.Value) -> v.Value:
        if not (a.is_(T.StringType) and b.is_(T.StringType)):
            return v.boolean(F.lit(False))
        return v.Value(test(F.lower(a.col), F.lower(b.col)), T.BooleanType(), a.nullable or b.nullable)

    return build


def _matches(a: v.Value, b: v.Value) -> v.Value:
    if not (a.is_(T.StringType) and b.is_(T.StringType)) or b.known and not _valid_regex(b.const):
        return v.boolean(F.lit(False))
    return v.Value(F.rlike(a.col, b.col), T.BooleanType(), a.nullable or b.nullable)


OPERATORS: dict[str, Callable[[v.Value, v.Value], v.Value]] = {
    "=": v.equal, "!=": v.unequal, "<": v.less, ">": lambda a, b: v.less(b, a), "<=": v.at_most, ">=": lambda a, b: v.at_most(b, a),
    "has": _has, "in": _in, "like": _like, "starts": _edge(F.startswith), "ends": _edge(F.endswith), "matches": _matches,
}


def _call(name: str, args: list[v.Value], scope: Scope) -> v.Value:
    f = builtins.BUILTINS.get(name.lower())
    if f is not None:
        builtins.check(f, args)
        return f.build(args)
    if name in scope.functions:
        return scope.functions[name](args)
    raise CompileError(f"unknown function {name}")


def _case(branches, otherwise, operand, scope: Scope) -> v.Value:
    subject = compile_value(operand, scope) if operand is not None else None
    results = [compile_value(r, scope) for _, r in branches] + [compile_value(otherwise, scope) if otherwise is not None else v.literal(None)]
    kind = v.common(results)
    cast = [r.col.cast(kind) if r.type != kind else r.col for r in results]
    out = None
    for (condition, _), result in zip(branches, cast, strict=False):
        test = compile_filter(condition, scope) if subject is None else v.equal(subject, compile_value(condition, scope))
        out = F.when(test.col, result) if out is None else out.when(test.col, result)
    return v.Value(out.otherwise(cast[-1]), kind, any(r.nullable for r in results))


def expression(e: t.Expr | str) -> t.Expr:
    return parse_expression(e) if isinstance(e, str) else e
