"""Bound SELECTs to DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.relational import aggregated, filtered, grouped, limited, projected
from .binder import BoundSelect
from .ranges import key_range


def compile_select(s: BoundSelect, catalog, sorted_groups: bool = False) -> DataFrame:
    keys = key_range(s.where, s.schema.key.name) if s.schema.key else None
    df = filtered(catalog.dataframe(s.table, keys), s.where, s.schema)
    if s.group_by:
        df = grouped(df, s.items, s.group_by, s.order_by, s.schema, sorted_groups)
    elif s.aggregates:
        df = aggregated(df, s.items, s.schema)
    else:
        df = projected(df, s.items, s.order_by, s.schema)
    return limited(df, s.limit)
