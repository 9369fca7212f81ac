"""Tables by name: keyed ones under a root folder, and registered DataFrames or Parquet files."""

from __future__ import annotations

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import InvalidQueryError, TableNotFoundError
from .functions.expressions import quoted
from .plans.ranges import KeyRange
from .sources.files import Store
from .sources.keyed import KeyedTable
from .sources.manifest import Config
from .types import Column, TableSchema, Type


class Registered:
    """A DataFrame under the dialect's types."""

    def __init__(self, df: DataFrame, key: str | None = None):
        fields = [(f, *_converted(f)) for f in df.schema.fields]
        fields = [(f, c, t) for f, c, t in fields if t is not None]
        self.schema = TableSchema(tuple(Column(f.name, t, f.name == key, f.name != key) for f, _, t in fields))
        self._df = df.select(*[c.alias(f.name) for f, c, _ in fields])

    def dataframe(self, keys: KeyRange | None = None) -> DataFrame:
        if keys and keys.empty:
            return self._df.sparkSession.createDataFrame([], self._df.schema)
        return self._df


def _converted(f: T.StructField) -> tuple[SparkColumn | None, Type | None]:
    """Whole numbers become INT64, fractions DOUBLE, times INT64 microseconds; other types but strings have no counterpart and are left out."""
    c, kind = quoted(f.name), f.dataType
    if isinstance(kind, T.LongType):
        return c, Type.INT64
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType)):
        return c.cast("long"), Type.INT64
    if isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
        return c.cast("double"), Type.DOUBLE
    if isinstance(kind, T.StringType):
        return c, Type.STRING
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(c), Type.INT64
    if isinstance(kind, T.TimestampNTZType):
        # Without a zone: as if in UTC, whatever the session's zone is.
        day = F.unix_date(c.cast("date")).cast("long") * 86_400_000_000
        second = F.hour(c) * 3600 + F.minute(c) * 60
        return day + second.cast("long") * 1_000_000 + (F.extract(F.lit("SECOND"), c) * 1_000_000).cast("long"), Type.INT64
    return None, None


class Catalog:
    def __init__(self, spark: SparkSession, root: str | None = None, config: Config | None = None):
        self.spark, self.root, self.config = spark, root.rstrip("/") if root else None, config or Config()
        self._tables: dict[str, KeyedTable | Registered] = {}

    def create_table(self, name: str, schema: TableSchema) -> KeyedTable:
        """A new keyed table, or one that an earlier session left under the root with the same schema."""
        if name in self._tables:
            raise InvalidQueryError(f"table {name} is there already")
        if self.root is None:
            raise InvalidQueryError("this catalog has no folder for tables")
        if len({n.lower() for n in schema.names}) < schema.size:
            raise InvalidQueryError("stored columns cannot differ in case only")
        path = f"{self.root}/{name}"
        if Store(self.spark).exists(f"{path}/schema.json"):
            table = KeyedTable.open(self.spark, path, self.config)
            if table.schema != schema:
                raise InvalidQueryError(f"table {name} is stored with another schema")
        else:
            table = KeyedTable(self.spark, path, schema, self.config)
        self._tables[name] = table
        return table

    def open_table(self, name: str) -> KeyedTable:
        """A stored table, with the schema it was created with."""
        if self.root is None or not Store(self.spark).exists(f"{self.root}/{name}/schema.json"):
            raise TableNotFoundError(f"no table {name}")
        self._tables[name] = table = KeyedTable.open(self.spark, f"{self.root}/{name}", self.config)
        return table

    def register(self, name: str, df: DataFrame, key: str | None = None) -> None:
        if name in self._tables:
            raise InvalidQueryError(f"table {name} is there already")
        self._tables[name] = Registered(df, key)

    def register_parquet(self, name: str, path: str, key: str | None = None) -> None:
        self.register(name, self.spark.read.parquet(path), key)

    def table_exists(self, name: str) -> bool:
        return name in self._tables

    def table(self, name: str) -> KeyedTable | Registered:
        if name not in self._tables:
            raise TableNotFoundError(f"no table {name}")
        return self._tables[name]

    def schema_of(self, name: str) -> TableSchema:
        return self.table(name).schema

    def dataframe(self, name: str, keys: KeyRange | None = None) -> DataFrame:
        return self.table(name).dataframe(keys)

    def insert(self, name: str, row: tuple) -> None:
        table = self.table(name)
        if not isinstance(table, KeyedTable):
            raise InvalidQueryError(f"table {name} cannot be written")
        table.insert(row)

    def wait_for_compaction(self, name: str) -> None:
        table = self.table(name)
        if isinstance(table, KeyedTable):
            table.wait_for_compaction()

    def close(self) -> None:
        for table in self._tables.values():
            if isinstance(table, KeyedTable):
                table.close()
