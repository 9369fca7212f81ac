"""Column types, table schemas and their Spark counterparts."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import Enum

from pyspark.sql import types as T

from .errors import ColumnNotFoundError, InvalidQueryError

INT64_MIN, INT64_MAX = -(1 << 63), (1 << 63) - 1


class Type(Enum):
    INT64 = "INT64"
    DOUBLE = "DOUBLE"
    STRING = "STRING"
    #: In expressions only.
    BOOLEAN = "BOOLEAN"
    NULL = "NULL"

    @property
    def numeric(self) -> bool:
        return self in (Type.INT64, Type.DOUBLE)

    @property
    def spark(self) -> T.DataType:
        return _SPARK[self]


_SPARK = {Type.INT64: T.LongType(), Type.DOUBLE: T.DoubleType(), Type.STRING: T.StringType(), Type.BOOLEAN: T.BooleanType(), Type.NULL: T.NullType()}
_PYTHON = {Type.INT64: int, Type.DOUBLE: float, Type.STRING: str}


@dataclass(frozen=True)
class Column:
    name: str
    type: Type
    is_key: bool = False
    nullable: bool = True

    def accepts(self, value: object) -> bool:
        """Whether a value may be stored: the exact type, no coercion, nulls where allowed."""
        if value is None:
            return self.nullable and not self.is_key
        return type(value) is _PYTHON[self.type] and (self.type is not Type.INT64 or INT64_MIN <= value <= INT64_MAX)


@dataclass(frozen=True)
class TableSchema:
    """Columns in order. A keyed table has one INT64 key, not nullable, in first place; other sources may have none."""

    columns: tuple[Column, ...]
    _index: dict[str, int] = field(init=False, repr=False, compare=False)

    def __post_init__(self):
        object.__setattr__(self, "_index", {c.name: i for i, c in enumerate(self.columns)})

    @classmethod
    def keyed(cls, columns) -> TableSchema:
        schema = cls(tuple(columns))
        if not schema.columns:
            raise InvalidQueryError("a table needs a column")
        if len(schema._index) < len(schema.columns):
            raise InvalidQueryError("column names must be unique")
        keys = [i for i, c in enumerate(schema.columns) if c.is_key]
        if len(keys) != 1:
            raise InvalidQueryError("a table needs exactly one key")
        key = schema.columns[keys[0]]
        if key.type is not Type.INT64:
            raise InvalidQueryError("the key must be INT64")
        if key.nullable:
            raise InvalidQueryError("the key cannot be nullable")
        if keys[0] != 0:
            raise InvalidQueryError("the key must be the first column")
        return schema

    @property
    def key(self) -> Column | None:
        return next((c for c in self.columns if c.is_key), None)

    @property
    def names(self) -> list[str]:
        return [c.name for c in self.columns]

    @property
    def size(self) -> int:
        return len(self.columns)

    def index(self, name: str) -> int:
        """Place of a column; names are case-sensitive."""
        if name not in self._index:
            raise ColumnNotFoundError(f"no column {name}")
        return self._index[name]

    def column(self, name: str) -> Column:
        return self.columns[self.index(name)]

    def accepts(self, row) -> bool:
        return len(row) == len(self.columns) and all(c.accepts(v) for c, v in zip(self.columns, row, strict=True))

    @property
    def spark(self) -> T.StructType:
        return T.StructType([T.StructField(c.name, c.type.spark, c.nullable, {"key": True} if c.is_key else None) for c in self.columns])

    def to_json(self) -> list[dict]:
        return [{"name": c.name, "type": c.type.value, "key": c.is_key, "nullable": c.nullable} for c in self.columns]

    @classmethod
    def from_json(cls, rows: list[dict]) -> TableSchema:
        return cls.keyed(Column(r["name"], Type(r["type"]), r["key"], r["nullable"]) for r in rows)


class SchemaBuilder:
    """Adds columns one by one; columns are nullable unless said otherwise."""

    def __init__(self):
        self._columns: list[Column] = []

    def add_column(self, name: str, type: Type, is_key: bool = False, nullable: bool = True) -> SchemaBuilder:
        if any(c.name == name for c in self._columns):
            raise InvalidQueryError(f"column {name} is there already")
        if is_key and any(c.is_key for c in self._columns):
            raise InvalidQueryError("there is a key already")
        self._columns.append(Column(name, type, is_key, nullable))
        return self

    def build(self) -> TableSchema:
        return TableSchema.keyed(self._columns)
