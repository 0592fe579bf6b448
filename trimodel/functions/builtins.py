"""The scalar functions, each as a builder of a native expression, with arity and literal argument types checked."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import functions as F
from pyspark.sql import types as T

from trimodel.errors import CompileError
from trimodel.functions.values import NUMBERS, SPARK_TYPES, TYPE_NAMES, Value, common, equal, number

TEXT, NUM, TIME, ANY = "text", "number", "time", "any"


@dataclass(frozen=True)
class Function:
    """takes: the kinds of arguments, the last one repeating up to `most`."""

    name: str
    build: Callable[[list[Value]], Value]
    takes: tuple[str, ...]
    least: int
    most: int | None
    aliases: tuple[str, ...] = ()
    deterministic: bool = True


BUILTINS: dict[str, Function] = {}


def define(name: str, takes: tuple[str, ...] = (), least: int | None = None, most: int | None = -1, aliases: tuple[str, ...] = ()):
    def add(build: Callable[[list[Value]], Value]):
        f = Function(name, build, takes, len(takes) if least is None else least, len(takes) if most == -1 else most, aliases)
        BUILTINS.update(dict.fromkeys((name, *aliases), f))
        return build

    return add


def check(f: Function, args: list[Value]) -> None:
    if len(args) < f.least or f.most is not None and len(args) > f.most:
        raise CompileError(f"{f.name} takes {f.least}{'' if f.most == f.least else f' to {f.most}' if f.most else ' or more'} arguments, not {len(args)}")
    for k, a in enumerate(args):
        kind = f.takes[min(k, len(f.takes) - 1)] if f.takes else ANY
        wrong = kind == TEXT and not a.is_(T.StringType) or kind == NUM and not a.is_(*NUMBERS)
        if a.known and a.const is not None and wrong:
            raise CompileError(f"argument {k + 1} of {f.name} must be a {kind}")


def _text(v: Value) -> F.Column:
    """The column if it is text, else NULL."""
    return v.col if v.is_(T.StringType) else F.lit(None).cast("string")


def _string(col, nullable: bool = True) -> Value:
    return Value(col, T.StringType(), nullable)


def _double(col, nullable: bool = False) -> Value:
    return Value(col, T.DoubleType(), nullable)


define("upper", (TEXT,), aliases=("uppercase",))(lambda a: _string(F.upper(_text(a[0]))))
define("lower", (TEXT,), aliases=("lowercase",))(lambda a: _string(F.lower(_text(a[0]))))
define("trim", (TEXT,))(lambda a: _string(F.regexp_replace(_text(a[0]), r"(?U)^\s+|\s+$", "")))
define("replace", (TEXT, TEXT, TEXT))(lambda a: _string(F.replace(_text(a[0]), _text(a[1]), _text(a[2]))))


@define("length", (ANY,), aliases=("len",))
def _length(a: list[Value]) -> Value:
    """UTF-8 bytes of a text, elements of an array."""
    col = F.octet_length(a[0].col) if a[0].is_(T.StringType, T.BinaryType) else F.size(a[0].col) if a[0].is_(T.ArrayType) else F.lit(None)
    col = F.when(a[0].col.isNotNull(), col) if a[0].is_(T.ArrayType) else col
    return Value(col.cast("bigint"), T.LongType())


@define("concat", (TEXT,), least=2, most=None)
def _concat(a: list[Value]) -> Value:
    """NULL and what isn't text is skipped."""
    return _string(F.concat_ws("", *[v.col for v in a if v.is_(T.StringType)]) if any(v.is_(T.StringType) for v in a) else F.lit(""), False)


@define("substring", (TEXT, NUM, NUM), least=2, aliases=("substr",))
def _substring(a: list[Value]) -> Value:
    """From a 0-based place, in characters; negative numbers count as 0."""
    start = F.greatest(number(a[1]).cast("int"), F.lit(0)) + 1
    size = F.greatest(number(a[2]).cast("int"), F.lit(0)) if len(a) > 2 else F.length(_text(a[0]))
    return _string(F.substring(_text(a[0]), start, size))


define("abs", (NUM,))(lambda a: _double(F.abs(number(a[0]))))
define("floor", (NUM,))(lambda a: _double(F.floor(number(a[0])).cast("double")))
define("ceil", (NUM,), aliases=("ceiling",))(lambda a: _double(F.ceil(number(a[0])).cast("double")))
define("sqrt", (NUM,))(lambda a: _double(F.sqrt(number(a[0]))))
define("pow", (NUM, NUM), aliases=("power",))(lambda a: _double(F.pow(number(a[0]), number(a[1]))))


@define("round", (NUM, NUM), least=1)
def _round(a: list[Value]) -> Value:
    digits = int(a[1].const) if len(a) > 1 and a[1].known and a[1].const is not None else 0
    if len(a) > 1 and not a[1].known:
        raise CompileError("round takes a constant number of digits")
    return _double(F.round(number(a[0]), digits).cast("double"))


@define("coalesce", (ANY,), least=1, most=None)
def _coalesce(a: list[Value]) -> Value:
    kind = common(a)
    return Value(F.coalesce(*[v.col.cast(kind) if v.type != kind else v.col for v in a]), kind, all(v.nullable for v in a))


define("ifnull", (ANY, ANY), aliases=("nvl",))(lambda a: _coalesce(a))


@define("nullif", (ANY, ANY))
def _nullif(a: list[Value]) -> Value:
    """Types must be equal for the values to be."""
    if type(a[0].type) is not type(a[1].type):
        return a[0]
    return Value(F.when(~equal(a[0], a[1]).col, a[0].col), a[0].type)


define("now", (), aliases=("current_timestamp",))(lambda a: Value(F.current_timestamp(), T.TimestampType(), False))
define("date", (TIME,))(lambda a: Value(F.to_date(a[0].col), T.DateType()))
define("time", (TIME,))(lambda a: _string(F.date_format(a[0].col.cast("timestamp") if a[0].is_(T.StringType) else a[0].col, "HH:mm:ss.SSSSSS")))
define("year", (TIME,))(lambda a: Value(F.year(a[0].col).cast("bigint"), T.LongType()))
define("month", (TIME,))(lambda a: Value(F.month(a[0].col).cast("bigint"), T.LongType()))
define("day", (TIME,))(lambda a: Value(F.dayofmonth(a[0].col).cast("bigint"), T.LongType()))


def type_name(kind: T.DataType) -> str:
    return TYPE_NAMES.get(type(kind), kind.simpleString())


@define("typeof", (ANY,), aliases=("type",))
def _typeof(a: list[Value]) -> Value:
    name = F.lit(type_name(a[0].type))
    return _string(F.when(a[0].col.isNull(), "null").otherwise(name) if a[0].nullable else name, False)


@define("cast", (ANY, TEXT))
def _cast(a: list[Value]) -> Value:
    name = a[1].const if a[1].known else None
    names = {"int": "int32", "bigint": "int64", "text": "string", "double": "float64", "boolean": "bool", "timestamp": "datetime", "float": "float64"}
    kind = SPARK_TYPES.get(names.get(str(name).lower(), str(name).lower()))
    if kind is None:
        raise CompileError(f"cast to unknown type {name!r}")
    return Value(a[0].col.try_cast(kind), T._parse_datatype_string(kind))


define("uuid", (), aliases=("uuid_generate", "gen_uuid", "gen_random_uuid"))(lambda a: _string(F.expr("uuid()"), False))


@define("field", (ANY, TEXT))
def _field(a: list[Value]) -> Value:
    """A member of a struct value; NULL if there is none. What `f(x).name` stands for."""
    from trimodel.functions.compiler import member

    return member(a[0], str(a[1].const))
