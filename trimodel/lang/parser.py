"""Tokens to statements: recursive descent for clauses, operator precedence by table for expressions.

Words are matched by their place, so a word such as `text` or `date` is a keyword only where a clause expects one and
may otherwise name a column. Beyond the basic language: `count ... where`, `in`, `not`, `is [not] null`, unary minus,
`%`, `case`, dotted paths and `nulls first|last` in `order by`, and parameters in `take` and `skip`.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache, reduce

from trimodel.errors import QuerySyntaxError
from trimodel.lang import tree as t
from trimodel.lang.tokens import Token, tokenize

#: Left-associative operators by precedence, the loosest first.
LEVELS = (("or",), ("and",), ("=", "!="), ("<", ">", "<=", ">=", "has", "contains", "like", "starts", "ends", "matches", "in", "is"), ("+", "-"), ("*", "/", "%"))
RANK = {op: k for k, ops in enumerate(LEVELS) for op in ops}
VERBS = ("get", "count", "describe", "put", "change", "remove", "make", "drop", "use", "begin", "commit", "rollback")
CLAUSES = ("join", "inner", "left", "right", "full", "cross", "on", "where", "order", "take", "skip", "as")
#: Fixed names: type words and the types they stand for.
TYPES = {
    "int": "int32", "bigint": "int64", "text": "string", "decimal": "float32", "double": "float64", "date": "datetime", "datetime": "datetime", "timestamp": "datetime",
    "time": "time", "boolean": "bool", "bool": "bool", "binary": "binary", "uuid": "uuid", "map": "object", "list": "array",
}
CONSTRAINTS = ("primary", "unique", "required", "default")


class _Stop(Exception):
    def __init__(self, at: Token, message: str):
        self.error = (at.line, at.column, message)


class Parser:
    def __init__(self, tokens: list[Token]):
        self.tokens, self.at = tokens, 0

    # tokens

    @property
    def now(self) -> Token:
        return self.tokens[self.at]

    def fail(self, message: str) -> _Stop:
        return _Stop(self.now, message)

    def step(self) -> Token:
        token = self.now
        self.at = min(self.at + 1, len(self.tokens) - 1)
        return token

    def is_(self, *words: str) -> bool:
        return self.now.kind == "word" and self.now.text in words

    def take(self, *words: str) -> str | None:
        return self.step().text if self.is_(*words) else None

    def need(self, word: str) -> None:
        if not self.take(word):
            raise self.fail(f"expected '{word}'")

    def op(self, text: str) -> bool:
        if self.now.kind == "op" and self.now.text == text:
            self.step()
            return True
        return False

    def need_op(self, text: str) -> None:
        if not self.op(text):
            raise self.fail(f"expected '{text}'")

    def kind(self, kind: str) -> bool:
        if self.now.kind == kind:
            self.step()
            return True
        return False

    def lines(self) -> None:
        while self.kind("newline"):
            pass

    def name(self) -> str:
        if self.now.kind != "word":
            raise self.fail("expected a name")
        return self.step().text

    def integer(self) -> int:
        if self.now.kind != "number" or not self.now.text.isdigit():
            raise self.fail("expected a whole number")
        return int(self.step().text)

    def string(self) -> str:
        if self.now.kind != "string":
            raise self.fail("expected a string")
        return self.step().text

    def comma_list(self, item: Callable):
        out = [item()]
        while self.op(","):
            out.append(item())
        return tuple(out)

    def block(self, item: Callable) -> list:
        """An indented block with an item on each line."""
        self.lines()
        if not self.kind("indent"):
            raise self.fail("expected an indented block")
        out = []
        self.lines()
        while self.now.kind not in ("dedent", "end"):
            out.append(item())
            self.lines()
        self.kind("dedent")
        return out

    def table_name(self) -> str:
        first = self.name()
        return f"{first}.{self.name()}" if self.op(".") else first

    def path(self) -> t.Path:
        parts = [self.name()]
        while self.op("."):
            parts.append(self.name())
        return t.Path(tuple(parts))

    # statements

    def program(self) -> tuple[list, list]:
        out, errors = [], []
        self.lines()
        while self.now.kind != "end":
            try:
                out.append(self.statement())
                if self.now.kind not in ("newline", "end", "dedent") and self.tokens[self.at - 1].kind != "dedent":
                    raise self.fail(f"unexpected '{self.now.text}'")
            except _Stop as stop:
                errors.append(stop.error)
                while self.now.kind != "end" and not (self.tokens[self.at - 1].kind in ("newline", "dedent") and self.is_(*VERBS)):
                    self.step()
            while self.now.kind in ("newline", "dedent"):
                self.step()
        return out, errors

    def statement(self):
        verb = self.take(*VERBS)
        if verb is None:
            raise self.fail(f"expected a statement, found '{self.now.text}'")
        if verb in ("begin", "commit", "rollback"):
            return t.Transaction(verb)
        return getattr(self, f"_{verb}")()

    def _get(self):
        columns = () if self.is_("from") and self.tokens[self.at + 1].kind == "word" else self.comma_list(self.path)
        self.need("from")
        found: dict = {"table": self.table_name(), "columns": columns, "joins": []}
        if self.take("as"):
            found["alias"] = self.name()
        self._clauses(found)
        if self.now.kind == "newline":
            mark = self.at
            self.lines()
            if self.kind("indent"):
                while self.now.kind not in ("dedent", "end"):
                    before = self.at
                    self._clauses(found)
                    self.lines()
                    if self.at == before:
                        raise self.fail(f"unexpected '{self.now.text}'")
                self.kind("dedent")
            else:
                self.at = mark
        joins = found.pop("joins")
        for j in joins:
            if j["kind"] != "cross" and j["on"] is None:
                raise self.fail(f"the join with {j['table']} needs an 'on'")
        return t.Get(joins=tuple(t.Join(**j) for j in joins), **found)

    def _clauses(self, found: dict) -> None:
        while self.now.kind == "word":
            if kind := self.take("inner", "left", "right", "full", "cross", "join"):
                if kind != "join":
                    self.need("join")
                join = {"kind": "inner" if kind == "join" else kind, "table": self.table_name(), "alias": None, "on": None}
                if self.take("as"):
                    join["alias"] = self.name()
                found["joins"].append(join)
            elif self.take("on"):
                if not found["joins"]:
                    raise self.fail("'on' without a join")
                found["joins"][-1]["on"] = self.expression()
            elif self.take("where"):
                found["where"] = self._condition()
            elif self.take("order"):
                self.need("by")
                found["order"] = self.comma_list(self._order)
            elif verb := self.take("take", "skip"):
                found[verb] = self._param() if self.now.kind == "param" else self.integer()
            else:
                return

    def _condition(self) -> t.Expr:
        if self.now.kind != "newline":
            return self.expression()
        lines = self.block(self.expression)
        if not lines:
            raise self.fail("expected a condition")
        return reduce(lambda a, b: t.Binary("and", a, b), lines)

    def _order(self) -> t.Order:
        path = self.path()
        way = self.take("asc", "desc")
        nulls = None
        if self.take("nulls"):
            nulls = {"first": True, "last": False}.get(self.take("first", "last") or "")
            if nulls is None:
                raise self.fail("expected 'first' or 'last'")
        return t.Order(path, way == "desc", nulls)

    def _count(self):
        self.take("from")
        return t.Count(self.table_name(), self._condition() if self.take("where") else None)

    def _describe(self):
        return t.Describe(self.table_name())

    def _assignment(self) -> tuple[str, t.Expr]:
        name = self.name()
        if self.now.kind == "newline":
            return name, t.ObjectOf(tuple(self.block(self._assignment)))
        for sign in ("+", "-"):
            if self.op(f"{sign}="):
                return name, t.Binary(sign, t.Path((name,)), self.expression())
        self.need_op("=")
        return name, self.expression()

    def _assignments(self) -> t.Assignments:
        return tuple(self.block(self._assignment)) if self.now.kind == "newline" else self.comma_list(self._assignment)

    def _put(self):
        self.need("into")
        return t.Put(self.table_name(), self._assignments())

    def _change(self):
        if self.is_("table") and self.tokens[self.at + 1].kind == "word" and self.tokens[self.at + 1].text != "where":
            self.step()
            return self._alter()
        table = self.table_name()
        where = self._condition() if self.take("where") else None
        return t.Change(table, where, self._assignments())

    def _remove(self):
        self.need("from")
        table = self.table_name()
        self.need("where")
        return t.Remove(table, self._condition())

    def _use(self):
        return t.Use(self.name())

    # definitions

    def _type(self) -> str:
        if self.op("["):
            self.name()
            self.need_op("]")
            return "array"
        return TYPES.get(self.step().text, "string") if self.now.kind == "word" and self.now.text not in CONSTRAINTS else "string"

    def _column(self) -> t.ColumnDef:
        found: dict = {"name": self.name(), "type": self._type()}
        while word := self.take(*CONSTRAINTS):
            if word == "primary":
                self.need("key")
            found[word] = self.expression() if word == "default" else True
        return t.ColumnDef(**found)

    def _unless(self, *words: str) -> bool:
        """`if not exists` or `if exists`: whether it is there."""
        if not self.take("if"):
            return False
        for w in words:
            self.need(w)
        return True

    def _make(self):
        if self.take("table"):
            return self._make_table()
        if self.take("namespace"):
            quiet, name = self._unless("not", "exists"), self.name()
            return t.MakeNamespace(name, self.string() if self.take("description") else None, quiet)
        unique = bool(self.take("unique"))
        self.need("index")
        quiet, name = self._unless("not", "exists"), self.name()
        self.need("on")
        table = self.table_name()
        self.need_op("(")
        columns = self.comma_list(self.name)
        self.need_op(")")
        return t.MakeIndex(name, table, columns, unique, quiet)

    def _make_table(self):
        found: dict = {"quiet": self._unless("not", "exists"), "name": self.table_name()}

        def clause():
            if self.take("as"):
                found["model"] = self.take("relational", "document", "keyspace")
                if found["model"] is None:
                    raise self.fail("expected 'relational', 'document' or 'keyspace'")
            elif self.take("fields"):
                found["columns"] = tuple(self.block(self._column))
            elif self.take("ttl"):
                found["ttl"] = self.integer()
            elif self.take("description"):
                found["description"] = self.string()
            else:
                raise self.fail("expected 'as', 'fields', 'ttl' or 'description'")

        self.block(clause)
        return t.MakeTable(**found)

    def _drop(self):
        what = self.take("index", "table", "namespace")
        if what == "index":
            quiet, name = self._unless("exists"), self.name()
            self.need("on")
            return t.DropIndex(name, self.table_name(), quiet)
        if what == "table":
            quiet = self._unless("exists")
            return t.DropTable(self.table_name(), quiet)
        if what == "namespace":
            quiet, name = self._unless("exists"), self.name()
            return t.DropNamespace(name, bool(self.take("force")), quiet)
        raise self.fail("expected 'table', 'index' or 'namespace'")

    def _alter(self):
        table, steps = self.table_name(), []

        def renamed():
            old = self.name()
            self.need("to")
            return "rename", (old, self.name())

        def altered():
            column = self.name()
            if self.take("remove"):
                self.need("default")
                return "no default", (column, None)
            if self.take("set"):
                self.need("default")
                return "default", (column, self.expression())
            if self.take("type"):
                return "type", (column, self._type())
            if word := self.take("nullable", "required"):
                return word, (column, None)
            raise self.fail("expected 'set default', 'remove default', 'nullable', 'required' or 'type'")

        def clause():
            if self.take("add"):
                steps.extend(("add", c) for c in self.block(self._column))
            elif self.take("drop"):
                steps.extend(("drop", c) for c in self.block(self.name))
            elif self.take("rename"):
                steps.extend([("rename table", self.name())] if self.take("to") else self.block(renamed))
            elif self.take("alter"):
                steps.extend(self.block(altered))
            else:
                raise self.fail("expected 'add', 'drop', 'rename' or 'alter'")

        if self.is_("rename"):
            clause()
        else:
            self.block(clause)
        return t.Alter(table, tuple(steps))

    # expressions

    def expression(self, least: int = 0) -> t.Expr:
        left = self._operand()
        while self.now.kind in ("op", "word") and (rank := RANK.get(self.now.text, -1)) >= least:
            op = self.step().text
            if op == "is":
                negated = bool(self.take("not"))
                self.need("null")
                left = t.Unary("is not null" if negated else "is null", left)
                continue
            left = t.Binary("has" if op == "contains" else op, left, self.expression(rank + 1))
        return left

    def _operand(self) -> t.Expr:
        out = self._primary()
        while self.now.kind == "op" and self.now.text == "." and isinstance(out, (t.Path, t.Call)):
            self.step()
            name = self.name()
            out = t.Path((*out.parts, name)) if isinstance(out, t.Path) else t.Call("field", (out, t.Literal(name)))
        return out

    def _param(self) -> t.Param:
        text = self.step().text[1:]
        return t.Param(int(text) if text.isdigit() else text)

    def _primary(self) -> t.Expr:
        token = self.now
        if token.kind == "string":
            return t.Literal(self.step().text)
        if token.kind == "number":
            text = self.step().text
            return t.Literal(int(text) if text.isdigit() else float(text))
        if token.kind == "param":
            return self._param()
        if self.op("("):
            inner = self.expression()
            self.need_op(")")
            return inner
        if self.op("-"):
            return t.Unary("-", self.expression(RANK["*"]))
        if self.op("["):
            items = () if self.now.text == "]" and self.now.kind == "op" else self.comma_list(self.expression)
            self.need_op("]")
            return t.ArrayOf(items)
        if self.op("{"):

            def pair():
                name = self.name()
                self.need_op("=")
                return name, self.expression()

            fields = () if self.now.text == "}" and self.now.kind == "op" else self.comma_list(pair)
            self.need_op("}")
            return t.ObjectOf(fields)
        if token.kind != "word":
            raise self.fail("expected an expression")
        follows = self.tokens[self.at + 1]
        if token.text in ("true", "false", "null"):
            self.step()
            return t.Literal({"true": True, "false": False, "null": None}[token.text])
        if token.text == "not" and (follows.kind in ("word", "number", "string", "param") or follows.text in ("(", "-", "[", "{")):
            self.step()
            return t.Unary("not", self.expression(RANK["="]))
        if token.text == "case" and follows.kind in ("word", "number", "string", "param"):
            self.step()
            return self._case()
        name = self.step().text
        if self.op("("):
            args = () if self.now.text == ")" and self.now.kind == "op" else self.comma_list(self.expression)
            self.need_op(")")
            return t.Call(name, args)
        return t.Path((name,))

    def _case(self) -> t.Case:
        operand = None if self.is_("when") else self.expression()
        branches = []
        while self.take("when"):
            condition = self.expression()
            self.need("then")
            branches.append((condition, self.expression()))
        otherwise = self.expression() if self.take("else") else None
        self.need("end")
        return t.Case(tuple(branches), otherwise, operand)


@lru_cache(maxsize=500)
def parse(text: str) -> tuple:
    """The statements of a text. Raises QuerySyntaxError with all errors found."""
    tokens, errors = tokenize(text)
    statements, more = Parser(tokens).program()
    if errors or more:
        raise QuerySyntaxError(errors + more)
    return tuple(statements)


def parse_expression(text: str) -> t.Expr:
    tokens, errors = tokenize(text)
    parser = Parser(tokens)
    try:
        out = parser.expression()
        if parser.now.kind not in ("newline", "end"):
            raise parser.fail(f"unexpected '{parser.now.text}'")
    except _Stop as stop:
        raise QuerySyntaxError([*errors, stop.error]) from None
    if errors:
        raise QuerySyntaxError(errors)
    return out
