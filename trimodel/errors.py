"""Errors of the engine."""

from __future__ import annotations


class TrimodelError(Exception):
    """Any error of the engine."""


class QuerySyntaxError(TrimodelError):
    """One or more syntax errors of a text; `errors` lists (line, column, message)."""

    def __init__(self, errors: list[tuple[int, int, str]]):
        self.errors = errors
        super().__init__("; ".join(f"line {line}, column {column}: {message}" for line, column, message in errors))


class CompileError(TrimodelError):
    """A statement that can't be turned into a plan: unknown function, wrong arity, unbound parameter."""


class CatalogError(TrimodelError):
    """An unknown or already existing namespace, table, column or index."""


class ConstraintError(TrimodelError):
    """A row that breaks `required`, `unique`, a key or a revision."""


class TransactionError(TrimodelError):
    """A misplaced begin, commit or rollback, a write in a read-only transaction, or a write conflict."""


class CardinalityError(TrimodelError):
    """A query that should give one row gave another number."""
