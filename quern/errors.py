"""Errors of parsing and binding."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Position:
    """Offset, line and column (both from 1) in a statement's text."""

    pos: int
    line: int
    col: int


class QuernError(Exception):
    pass


class ParseError(QuernError):
    def __init__(self, message: str, position: Position):
        super().__init__(f"{message} (line {position.line}, column {position.col})")
        self.message, self.position = message, position


class BindError(QuernError):
    pass


class TableNotFoundError(BindError):
    pass


class ColumnNotFoundError(BindError):
    pass


class TypeMismatchError(BindError):
    pass


class InvalidQueryError(BindError):
    pass


class CorruptTableError(QuernError):
    """A stored table's files do not fit together."""
