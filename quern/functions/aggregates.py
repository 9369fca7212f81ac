"""The five aggregates. Nulls are skipped; over no values COUNT is 0 and the others are null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import TypeMismatchError
from ..types import Type

_FUNCTIONS = {"COUNT": F.count, "SUM": F.sum, "AVG": F.avg, "MIN": F.min, "MAX": F.max}


def result_type(kind: str, argument: Type) -> Type:
    if kind == "COUNT":
        return Type.INT64
    if not argument.numeric:
        raise TypeMismatchError(f"{kind} needs a number")
    return Type.DOUBLE if kind == "AVG" else argument


def aggregate(kind: str, argument: Column) -> Column:
    return _FUNCTIONS[kind](argument)
