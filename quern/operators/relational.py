"""Projection, filter, aggregation, ordering and limit.

Everything stays a lazy plan of built-in operators: pruning, pushdown, partial aggregation and top-k are the engine's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidQueryError
from ..functions.aggregates import aggregate
from ..functions.expressions import column, quoted
from ..plans.binder import Item, columns_of
from ..sql import grammar as g
from ..types import TableSchema


def filtered(df: DataFrame, where: g.Expression | None, schema: TableSchema) -> DataFrame:
    return df if where is None else df.filter(column(where, schema))


def _value(i: Item, schema: TableSchema) -> Column:
    return column(i.expression, schema)


def _sort(c: Column, descending: bool) -> Column:
    """Nulls count as larger than everything: last ascending, first descending."""
    return c.desc_nulls_first() if descending else c.asc_nulls_last()


def _keys(order: tuple[g.OrderItem, ...], value) -> list[Column]:
    return [_sort(value(o.expression), o.descending) for o in order if not isinstance(o.expression, g.Literal)]


def projected(df: DataFrame, items: tuple[Item, ...], order: tuple[g.OrderItem, ...], schema: TableSchema) -> DataFrame:
    """Items of every row, ordered by values of the input row, which need not be selected."""
    keys = _keys(order, lambda e: column(e, schema))
    if keys:
        df = df.orderBy(*keys)
    return df.select(*[_value(i, schema).alias(i.name) for i in items])


def aggregated(df: DataFrame, items: tuple[Item, ...], schema: TableSchema) -> DataFrame:
    """One row, even of no rows."""
    return df.agg(*[aggregate(i.kind, _value(i, schema)).alias(f"__a{n}") for n, i in enumerate(items)]).toDF(*[i.name for i in items])


def grouped(df: DataFrame, items: tuple[Item, ...], groups: tuple[g.Expression, ...], order: tuple[g.OrderItem, ...], schema: TableSchema, ascending: bool = False) -> DataFrame:
    """One row a group, null being a group of its own. An order by anything but the groups takes the value of the group's row of least key. ascending: by the groups, nulls last, where no order is given."""
    out = df.select("*", *[column(e, schema).alias(f"__g{n}") for n, e in enumerate(groups)])
    names = [f"__g{n}" for n in range(len(groups))]
    aggs = [aggregate(i.kind, _value(i, schema)).alias(f"__a{n}") for n, i in enumerate(items) if i.kind]
    sorts: list[tuple[str | g.Expression, bool]] = []
    for k, o in enumerate(order):
        if isinstance(o.expression, g.Literal):
            continue
        if o.expression in groups:
            sorts.append((f"__g{groups.index(o.expression)}", o.descending))
        elif columns_of(o.expression) <= {e.name for e in groups if isinstance(e, g.ColumnRef)}:
            sorts.append((o.expression, o.descending))
        elif schema.key is None:
            raise InvalidQueryError("an order by other values than the groups needs a keyed table")
        else:
            aggs.append(F.min_by(column(o.expression, schema), quoted(schema.key.name)).alias(f"__s{k}"))
            sorts.append((f"__s{k}", o.descending))
    out = out.groupBy(*names).agg(*aggs) if aggs else out.select(*names).distinct()
    if ascending and not order:
        sorts = [(n, False) for n in names]
    if sorts:
        # Group columns under their own names again, for expressions over them.
        own = {e.name: F.col(f"__g{n}") for n, e in enumerate(groups) if isinstance(e, g.ColumnRef)}
        out = out.withColumns({k: c for k, c in own.items() if k not in out.columns}) if own else out
        out = out.orderBy(*[_sort(F.col(s) if isinstance(s, str) else column(s, schema), d) for s, d in sorts])
    return out.select(*[F.col(f"__a{n}" if i.kind else f"__g{groups.index(i.expression)}").alias(i.name) for n, i in enumerate(items)])


#: The most rows that a plan's own limit can hold.
_PLAN_LIMIT = (1 << 31) - 1


def limited(df: DataFrame, n: int | None) -> DataFrame:
    """The first n rows. A limit beyond what a plan can hold is exact too: rows are counted first, and only if there are more are they numbered one by one."""
    if n is None:
        return df
    if n <= _PLAN_LIMIT:
        return df.limit(n)
    return df if df.count() <= n else numbered_cut(df, n)


def numbered_cut(df: DataFrame, n: int) -> DataFrame:
    """The first n rows for any n. No built-in operator numbers rows over all partitions in order without moving them to one."""
    rows = df.rdd.zipWithIndex().filter(lambda x: x[1] < n).map(lambda x: x[0])
    return df.sparkSession.createDataFrame(rows, df.schema)
