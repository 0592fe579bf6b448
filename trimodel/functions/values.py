"""Typed columns and the value rules of the language: truth, numbers, equality and order.

NULL is an ordinary, smallest value, so comparisons are two-valued. Two forms of a predicate exist. In *filter* form it
may be NULL where the answer is false, which keeps it a plain comparison that reaches the Parquet scan. In *exact* form
it is never NULL; that form is used wherever the value is projected, negated or counted.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NONE = object()
INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
NUMBERS = (*INTEGERS, T.FloatType, T.DoubleType, T.DecimalType)
NUMERIC_TEXT = r"^[+-]?(?:\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?|(?i:inf|infinity|nan))$"
#: Fixed names of types, as `typeof` gives them.
TYPE_NAMES = {
    T.BooleanType: "bool", T.ByteType: "int32", T.ShortType: "int32", T.IntegerType: "int32", T.LongType: "int64", T.FloatType: "float32", T.DoubleType: "float64", T.DecimalType: "float64",
    T.StringType: "string", T.BinaryType: "binary", T.TimestampType: "datetime", T.TimestampNTZType: "datetime", T.DateType: "date", T.ArrayType: "array", T.StructType: "object", T.MapType: "object", T.NullType: "null", T.VariantType: "any",
}
SPARK_TYPES = {
    "bool": "boolean", "int32": "int", "int64": "bigint", "float32": "float", "float64": "double", "string": "string", "binary": "binary", "datetime": "timestamp", "date": "date",
    "time": "string", "uuid": "string", "objectid": "string", "object": "string", "array": "string",
}


@dataclass(frozen=True)
class Value:
    """A column with its type, whether it can be NULL, and its constant, if it is one."""

    col: Column
    type: T.DataType
    nullable: bool = True
    const: object = NONE

    def is_(self, *kinds: type) -> bool:
        return isinstance(self.type, kinds)

    @property
    def known(self) -> bool:
        return self.const is not NONE


# A variant is a document's value whose type differs from row to row: it compares as what it holds.


def _kind(v: Value) -> Column:
    """number, string, boolean or other, of a variant's value."""
    kind = F.schema_of_variant(v.col)
    return F.when(kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), "number").when(kind == "STRING", "string").when(kind == "BOOLEAN", "boolean").otherwise("other")


def _held(v: Value, kind: str) -> Column:
    return F.try_variant_get(v.col, "$", {"number": "double"}.get(kind, kind))


def _class(v: Value) -> str:
    return "number" if v.is_(*NUMBERS) else "string" if v.is_(T.StringType) else "boolean" if v.is_(T.BooleanType) else "other"


def _equal_variant(a: Value, b: Value) -> Value:
    """Equal values of one kind, or both NULL."""
    if not a.is_(T.VariantType):
        a, b = b, a
    if b.is_(T.VariantType):
        alike = (_kind(a) == _kind(b)) & F.when(_kind(a) == "number", _held(a, "number") == _held(b, "number")).otherwise(_held(a, "string") == _held(b, "string"))
    else:
        kind = _class(b)
        alike = F.lit(False) if kind == "other" else (_kind(a) == kind) & (_held(a, kind) == (b.col.cast("double") if kind == "number" else b.col))
    return boolean(F.when(a.col.isNull() | b.col.isNull(), a.col.isNull() & b.col.isNull()).otherwise(F.coalesce(alike, F.lit(False))))


def _less_variant(a: Value, b: Value, most: bool) -> Value:
    """a < b, or with `most` a <= b: texts beside texts as texts, all else as numbers; NULL is the least."""
    text = lambda v: _held(v, "string") if v.is_(T.VariantType) else v.col
    is_text = lambda v: _kind(v) == "string" if v.is_(T.VariantType) else F.lit(_class(v) == "string")
    order = lambda x, y: x <= y if most else x < y
    both = is_text(a) & is_text(b)
    plain = F.when(both, order(text(a), text(b)) if "other" not in (_class(a), _class(b)) or a.is_(T.VariantType) and b.is_(T.VariantType, T.StringType) or b.is_(T.VariantType) and a.is_(T.StringType) else F.lit(False)).otherwise(order(number(a), number(b)))
    return boolean(F.when(a.col.isNull(), F.lit(True) if most else b.col.isNotNull()).when(b.col.isNull(), False).otherwise(F.coalesce(plain, F.lit(False))))


def literal(value: object) -> Value:
    kinds = {bool: T.BooleanType(), int: T.LongType(), float: T.DoubleType(), str: T.StringType(), bytes: T.BinaryType()}
    if value is None:
        return Value(F.lit(None), T.NullType(), True, None)
    if type(value) in kinds:
        return Value(F.lit(value).cast(kinds[type(value)]) if type(value) is int else F.lit(value), kinds[type(value)], False, value)
    if isinstance(value, (list, tuple)):
        items = [literal(v) for v in value]
        return Value(F.array(*[i.col for i in items]), T.ArrayType(items[0].type if items else T.NullType()), False, list(value))
    if isinstance(value, dict):
        fields = {k: literal(value[k]) for k in sorted(value)}
        return Value(F.struct(*[v.col.alias(k) for k, v in fields.items()]), T.StructType([T.StructField(k, v.type) for k, v in fields.items()]), False)
    import datetime

    kind = T.TimestampType() if isinstance(value, datetime.datetime) else T.DateType() if isinstance(value, datetime.date) else None
    if kind is None:
        raise TypeError(f"no literal for {type(value).__name__}")
    return Value(F.lit(value), kind, False, value)


def boolean(col: Column) -> Value:
    return Value(col, T.BooleanType(), False)


def exact(v: Value) -> Value:
    """v with NULL as false."""
    return boolean(F.coalesce(v.col, F.lit(False))) if v.nullable else v


def truthy(v: Value) -> Value:
    """In filter form: not false, zero, empty or NULL."""
    if v.is_(T.NullType):
        return boolean(F.lit(False))
    if v.is_(T.VariantType):
        held = F.when(_kind(v) == "boolean", _held(v, "boolean")).when(_kind(v) == "string", F.length(_held(v, "string")) > 0).when(_kind(v) == "number", _held(v, "number") != 0)
        return boolean(F.coalesce(held, v.col.isNotNull()))
    if v.is_(T.BooleanType):
        return v
    if v.is_(*NUMBERS):
        return Value(v.col != 0, T.BooleanType(), v.nullable)
    if v.is_(T.StringType, T.BinaryType):
        return Value(F.length(v.col) > 0, T.BooleanType(), v.nullable)
    if v.is_(T.ArrayType, T.MapType):
        return Value(F.size(v.col) > 0, T.BooleanType(), v.nullable)
    return boolean(v.col.isNotNull())


def number(v: Value) -> Column:
    """As float64: texts are parsed, NULL and what is no number are 0."""
    if v.is_(T.DoubleType) and not v.nullable:
        return v.col
    if v.is_(*NUMBERS, T.BooleanType):
        plain = v.col.cast("double")
        return F.coalesce(plain, F.lit(0.0)) if v.nullable else plain
    if v.is_(T.VariantType):
        text = _held(v, "string")
        return F.coalesce(F.when(_kind(v).isin("number", "boolean") | ((_kind(v) == "string") & text.rlike(NUMERIC_TEXT)), _held(v, "number")), F.lit(0.0))
    if v.is_(T.StringType):
        return F.when(v.col.rlike(NUMERIC_TEXT), v.col.try_cast("double")).otherwise(F.lit(0.0))
    return F.lit(0.0)


def comparable(a: Value, b: Value) -> bool:
    temporal = (T.TimestampType, T.TimestampNTZType, T.DateType)
    both = lambda *kinds: a.is_(*kinds) and b.is_(*kinds)
    return both(*NUMBERS) or both(T.StringType) or both(T.BooleanType) or both(T.BinaryType) or both(*temporal) or a.type == b.type


def _sides(a: Value, b: Value) -> tuple[Column, Column]:
    """Columns to compare natively: an integer beside a float counts as a double."""
    if a.is_(*NUMBERS) and b.is_(*NUMBERS) and a.is_(*INTEGERS) != b.is_(*INTEGERS):
        return a.col.cast("double"), b.col.cast("double")
    return a.col, b.col


def equal(a: Value, b: Value) -> Value:
    if a.is_(T.NullType) or b.is_(T.NullType):
        other = b if a.is_(T.NullType) else a
        return boolean(F.lit(True) if other.is_(T.NullType) else other.col.isNull())
    if a.is_(T.VariantType) or b.is_(T.VariantType):
        return _equal_variant(a, b)
    if not comparable(a, b):
        return boolean(a.col.isNull() & b.col.isNull() if a.nullable and b.nullable else F.lit(False))
    left, right = _sides(a, b)
    return boolean(left.eqNullSafe(right) if a.nullable or b.nullable else left == right)


def unequal(a: Value, b: Value) -> Value:
    return boolean(~equal(a, b).col)


def less(a: Value, b: Value) -> Value:
    """a < b in filter form."""
    if b.is_(T.NullType):
        return boolean(F.lit(False))
    if a.is_(T.NullType):
        return boolean(b.col.isNotNull() if b.nullable else F.lit(True))
    if a.is_(T.VariantType) or b.is_(T.VariantType):
        return _less_variant(a, b, False)
    left, right = _sides(a, b) if comparable(a, b) else (number(a), number(b))
    plain = left < right
    if a.nullable:
        plain = plain | (a.col.isNull() & b.col.isNotNull() if b.nullable else a.col.isNull())
    return Value(plain, T.BooleanType(), a.nullable or b.nullable)


def at_most(a: Value, b: Value) -> Value:
    """a <= b in filter form."""
    if a.is_(T.NullType):
        return boolean(F.lit(True))
    if b.is_(T.NullType):
        return boolean(a.col.isNull() if a.nullable else F.lit(False))
    if a.is_(T.VariantType) or b.is_(T.VariantType):
        return _less_variant(a, b, True)
    left, right = _sides(a, b) if comparable(a, b) else (number(a), number(b))
    plain = left <= right
    return Value(plain | a.col.isNull() if a.nullable else plain, T.BooleanType(), a.nullable or b.nullable)


def common(values: list[Value]) -> T.DataType:
    """The type that holds all values: the widest number, or else the first type that isn't NULL."""
    kinds = [v.type for v in values if not v.is_(T.NullType)]
    if not kinds:
        return T.NullType()
    if all(isinstance(k, NUMBERS) for k in kinds) and len({type(k) for k in kinds}) > 1:
        if all(isinstance(k, INTEGERS) for k in kinds):
            return T.LongType()
        return T.FloatType() if all(isinstance(k, (T.IntegerType, T.FloatType)) for k in kinds) else T.DoubleType()
    return kinds[0]
