"""Expressions as Spark columns."""

from __future__ import annotations

import math
import operator

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.binder import type_of
from ..sql import grammar as g
from ..types import TableSchema, Type

_COMPARE = {"=": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}
_FLIPPED = {"=": "=", "!=": "!=", "<": ">", "<=": ">=", ">": "<", ">=": "<="}


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def literal(e: g.Literal, as_type: Type | None = None) -> Column:
    """A typed literal: whole numbers are never read as ordinals, nor fractions as decimals."""
    return F.lit(e.value).cast((as_type if e.type is Type.NULL and as_type else e.type).spark)


def _pushable(op: str, column: g.Expression, value: g.Expression, schema: TableSchema) -> g.Binary | None:
    """A whole-number column against a fraction, as a comparison with a whole number, which Parquet statistics can answer."""
    if not isinstance(column, g.ColumnRef) or not isinstance(value, g.Literal) or value.type is not Type.DOUBLE:
        return None
    if schema.column(column.name).type is not Type.INT64 or not abs(value.value) < 1 << 53:
        return None
    if value.value == math.floor(value.value):
        return g.Binary(op, column, g.Literal(int(value.value), Type.INT64))
    if op in ("<", "<="):
        return g.Binary("<=", column, g.Literal(math.floor(value.value), Type.INT64))
    if op in (">", ">="):
        return g.Binary(">=", column, g.Literal(math.ceil(value.value), Type.INT64))
    return None


def column(e: g.Expression, schema: TableSchema) -> Column:
    if isinstance(e, g.Literal):
        return literal(e)
    if isinstance(e, g.ColumnRef):
        return quoted(e.name)
    if isinstance(e, g.IsNull):
        c = column(e.operand, schema)
        return c.isNotNull() if e.negated else c.isNull()
    if isinstance(e, g.Not):
        return ~_boolean(e.operand, schema)
    if e.op in ("AND", "OR"):
        return (operator.and_ if e.op == "AND" else operator.or_)(_boolean(e.left, schema), _boolean(e.right, schema))
    better = _pushable(e.op, e.left, e.right, schema) or _pushable(_FLIPPED[e.op], e.right, e.left, schema)
    if better and better != e:
        return column(better, schema)
    kinds = [type_of(x, schema) for x in (e.left, e.right)]
    sides = [literal(x, other) if isinstance(x, g.Literal) and x.type is Type.NULL and other is not Type.NULL else column(x, schema) for x, other in zip((e.left, e.right), reversed(kinds), strict=True)]
    if kinds == [Type.NULL, Type.NULL]:
        return F.lit(None).cast("boolean")
    return _COMPARE[e.op](*sides)


def _boolean(e: g.Expression, schema: TableSchema) -> Column:
    return literal(e, Type.BOOLEAN) if isinstance(e, g.Literal) else column(e, schema)
