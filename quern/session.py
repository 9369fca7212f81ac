"""Statements in, DataFrames out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from .catalog import Catalog
from .plans.binder import Binder, BoundCreate, BoundInsert
from .plans.compiler import compile_select
from .sources.manifest import Config
from .sql.grammar import parse


@dataclass(frozen=True)
class CreateTableResult:
    table: str


@dataclass(frozen=True)
class InsertResult:
    inserted_rows: int


class Engine:
    """engine.sql(text): a DataFrame for SELECT, a small result for CREATE TABLE and INSERT."""

    def __init__(self, spark: SparkSession, root: str | None = None, config: Config | None = None, catalog: Catalog | None = None):
        self.spark, self.catalog = spark, catalog or Catalog(spark, root, config)
        #: Give groups in ascending order, nulls last, where a statement names no order; a sort more.
        self.sorted_groups = False

    def sql(self, text: str) -> DataFrame | CreateTableResult | InsertResult:
        bound = Binder(self.catalog).bind(parse(text))
        if isinstance(bound, BoundCreate):
            self.catalog.create_table(bound.table, bound.schema)
            return CreateTableResult(bound.table)
        if isinstance(bound, BoundInsert):
            self.catalog.insert(bound.table, bound.row)
            return InsertResult(1)
        return compile_select(bound, self.catalog, self.sorted_groups)

    def run(self, script: str) -> list:
        """Statements one after another, split at the line ends that follow a semicolon."""
        return [self.sql(s.strip() + ";") for s in script.strip().rstrip(";").split(";\n") if s.strip()]

    def close(self) -> None:
        self.catalog.close()
