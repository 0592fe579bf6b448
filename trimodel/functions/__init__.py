"""Expressions: static types, operators, built-in and registered functions, aggregates."""
