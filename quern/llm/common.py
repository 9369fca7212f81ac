"""Pieces shared by the corpus operators: word rules, shared tables, small Column helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a maximal run of bytes other than these six.
SPACES = " \t\n\x0b\f\r"
NOT_SPACE = r"[^\x20\x09-\x0D]"
SPACE_RUN = r"[\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a temporary one is set if all runs on this machine; else it is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="quern-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/quern-{spark.sparkContext.applicationId}"


def bounded_batches(df: DataFrame, most: str = "8m") -> DataFrame:
    """Limit what passes to Python at once by bytes too: long texts would else fill memory by their number alone."""
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", most)
    return df


def hash_sample(df: DataFrame, total: int, wanted: int, *columns: str) -> DataFrame:
    """The 2 * wanted rows, of `total`, whose hash of these columns is least (all if there are fewer), in that order in one partition; only about these are moved."""
    h = F.pmod(F.xxhash64(*columns), F.lit(1 << 40))
    if total > 8 * wanted:
        # All but about 4 * wanted rows go where they are read.
        df = df.filter(h < int((1 << 40) * 4 * wanted / total))
    return df.orderBy(h, *columns).limit(2 * wanted)


#: Shuffle files of a stored table are deleted once it is written.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Rows of a few numbers that one task writes, where their number is known.
FILE_ROWS = 100_000


def stored(df: DataFrame, compression: str = "snappy", group: int | None = None, rows: int | None = None) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: cuts the lineage and survives lost executors. compression: "none" for columns that are compressed already; the
    codecs keep buffers of a page's size outside the heap, which large values make large. group: bytes of a row group, for large values; writers and readers hold one at a time, which
    else is 128 MB, and a page has a hundred values at least. rows: at most so many, if that is known, of a few numbers each; few rows then take few tasks and files, whatever the
    number of shuffle partitions."""
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // FILE_ROWS)))
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    for scope in _scopes:
        scope.append(path)
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.options(**({} if group is None else {"parquet.block.size": group, "parquet.page.size.row.check.min": 1})).parquet(path, compression=compression)
    finally:
        spark.conf.unset(_CLEAN) if before is None else spark.conf.set(_CLEAN, before)
    return spark.read.schema(df.schema).parquet(path)


def partition_keys(spark: SparkSession, parts: int) -> list[int]:
    """One whole number (int) for each of `parts` partitions that repartition(parts, key) sends to it: numbers 0, 1, .. would meet by chance, three or four in one task."""
    found, tried = {}, 0
    while len(found) < parts:
        ids = spark.range(tried, tried + 16 * parts).select(F.col("id").cast("int").alias("k"))
        tried += 16 * parts
        for r in ids.groupBy(F.pmod(F.hash("k"), F.lit(parts)).alias("p")).agg(F.min("k").alias("k")).collect():  # a row a partition
            found.setdefault(r.p, r.k)
    return [found[p] for p in range(parts)]


def delete(spark: SparkSession, path: str) -> None:
    """Delete a file or folder on any store that Hadoop's file systems reach."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


_scopes: list[list[str]] = []


@contextmanager
def discarded(spark: SparkSession) -> Iterator[None]:
    """Delete the tables that stored() writes meanwhile, at the end; nothing may read them later."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            delete(spark, path)


def cleanup(spark: SparkSession) -> None:
    """Delete the tables that stored() wrote in this application; results that still read them become invalid."""
    delete(spark, shared_dir(spark))


def running(df: DataFrame, order: list[Column], **values: Column) -> DataFrame:
    """df, stored, with a column per value: its sum over all rows up to this one, in an order that tells all rows apart. The sums are made by ranges of the order and added up by range, so no task sees
    all rows."""
    names = [f"__o{k}" for k in range(len(order))]
    kept = df.withColumns(dict(zip(names, order, strict=True)) | {f"__v_{k}": v for k, v in values.items()})
    kept = stored(kept.repartitionByRange(*[F.col(n).asc_nulls_last() for n in names]).withColumn("__range", F.spark_partition_id()))
    whole = kept.groupBy("__range").agg(*[F.sum(f"__v_{k}").alias(f"__all_{k}") for k in values])  # a row a partition
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    whole = whole.select("__range", *[F.coalesce(F.sum(f"__all_{k}").over(before), F.lit(0)).alias(f"__before_{k}") for k in values])
    inside = Window.partitionBy("__range").orderBy(*[F.col(n).asc_nulls_last() for n in names]).rowsBetween(Window.unboundedPreceding, 0)
    out = kept.withColumns({f"__sum_{k}": F.sum(f"__v_{k}").over(inside) for k in values}).join(F.broadcast(whole), "__range")
    return out.select(*df.columns, *[(F.col(f"__sum_{k}") + F.col(f"__before_{k}")).alias(k) for k in values])


#: Copies of a row that are made from one array.
STEP = 1 << 16


def repeated(df: DataFrame, times: Column, number: str) -> DataFrame:
    """df with each row as many times as told, and the copies' numbers from 0; arrays stay short however many copies there are."""
    out = df.withColumn("__times", times.cast("long")).filter("__times > 0")
    out = out.withColumn("__chunk", F.explode(F.sequence(F.lit(0), F.floor((F.col("__times") - 1) / STEP))))
    to = F.least((F.col("__chunk") + 1) * STEP, F.col("__times")) - 1
    return out.withColumn(number, F.explode(F.sequence(F.col("__chunk") * STEP, to))).drop("__times", "__chunk")


def let(value: Column, body) -> Column:
    """Evaluate value once and hand it to body as a lambda variable (Catalyst would inline a projected column)."""
    return F.transform(F.array(value), body)[0]


def word_array(text: Column) -> Column:
    """The words of a text; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_RUN, -1), lambda w: w != "")


def word_count(text: Column) -> Column:
    """Number of words (long), without building them: word starts are non-spaces after a space or at the start."""
    return F.coalesce(F.regexp_count(text, F.lit(NOT_SPACE + "+")), F.lit(0)).cast("long")
