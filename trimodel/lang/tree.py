"""The syntax tree: immutable dataclasses for expressions and statements."""

from __future__ import annotations

from dataclasses import dataclass, field


class Expr:
    """An expression."""


@dataclass(frozen=True)
class Literal(Expr):
    value: object


@dataclass(frozen=True)
class Path(Expr):
    """A column, or a dotted path into one."""

    parts: tuple[str, ...]

    @property
    def name(self) -> str:
        return ".".join(self.parts)


@dataclass(frozen=True)
class Param(Expr):
    """A positional (int, from 1) or named (str) parameter."""

    key: int | str


@dataclass(frozen=True)
class Binary(Expr):
    op: str
    left: Expr
    right: Expr


@dataclass(frozen=True)
class Unary(Expr):
    """op: `not`, `-`, `is null` or `is not null`."""

    op: str
    operand: Expr


@dataclass(frozen=True)
class Call(Expr):
    name: str
    args: tuple[Expr, ...]


@dataclass(frozen=True)
class Case(Expr):
    """Simple (with an operand) or searched."""

    branches: tuple[tuple[Expr, Expr], ...]
    otherwise: Expr | None = None
    operand: Expr | None = None


@dataclass(frozen=True)
class ArrayOf(Expr):
    items: tuple[Expr, ...]


@dataclass(frozen=True)
class ObjectOf(Expr):
    fields: tuple[tuple[str, Expr], ...]


@dataclass(frozen=True)
class Order:
    path: Path
    descending: bool = False
    nulls_first: bool | None = None


@dataclass(frozen=True)
class Join:
    kind: str
    table: str
    alias: str | None
    on: Expr | None


@dataclass(frozen=True)
class Get:
    table: str
    alias: str | None = None
    columns: tuple[Path, ...] = ()
    joins: tuple[Join, ...] = ()
    where: Expr | None = None
    order: tuple[Order, ...] = ()
    take: int | Param | None = None
    skip: int | Param | None = None


@dataclass(frozen=True)
class Count:
    table: str
    where: Expr | None = None


@dataclass(frozen=True)
class Describe:
    table: str


Assignments = tuple[tuple[str, Expr], ...]


@dataclass(frozen=True)
class Put:
    table: str
    values: Assignments


@dataclass(frozen=True)
class Change:
    table: str
    where: Expr | None
    values: Assignments


@dataclass(frozen=True)
class Remove:
    table: str
    where: Expr


@dataclass(frozen=True)
class ColumnDef:
    name: str
    type: str = "string"
    primary: bool = False
    unique: bool = False
    required: bool = False
    default: Expr | None = None


@dataclass(frozen=True)
class MakeTable:
    name: str
    model: str = "relational"
    columns: tuple[ColumnDef, ...] = ()
    ttl: int | None = None
    description: str | None = None
    quiet: bool = False


@dataclass(frozen=True)
class MakeIndex:
    name: str
    table: str
    columns: tuple[str, ...]
    unique: bool = False
    quiet: bool = False


@dataclass(frozen=True)
class MakeNamespace:
    name: str
    description: str | None = None
    quiet: bool = False


@dataclass(frozen=True)
class DropTable:
    name: str
    quiet: bool = False


@dataclass(frozen=True)
class DropIndex:
    name: str
    table: str
    quiet: bool = False


@dataclass(frozen=True)
class DropNamespace:
    name: str
    force: bool = False
    quiet: bool = False


@dataclass(frozen=True)
class Alter:
    """steps: (`add`, ColumnDef), (`drop`, name), (`rename`, (old, new)), (`rename table`, name), or
    (`default` | `no default` | `nullable` | `required` | `type`, (column, value))."""

    table: str
    steps: tuple[tuple[str, object], ...] = field(default_factory=tuple)


@dataclass(frozen=True)
class Use:
    namespace: str


@dataclass(frozen=True)
class Transaction:
    """verb: begin, commit or rollback."""

    verb: str
