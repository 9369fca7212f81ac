"""Hilbert-curve sharding.

Metadata columns are quantised to a few bits each, the grid cell's index on the Hilbert curve orders the rows, and
equal runs of that order become shards, so that each shard's files cover a small box in every dimension and readers
can prune by any of them.

Every coordinate rises with its column's values, so that a range of coordinates is a range of values, as file statistics hold it: source, language and stretches of doc_ids are cut
where their values reach further equal shares of the rows, sizes at powers of two.

No global sort is needed. Rows are counted by cell, then by (cell, salt); the counts give each such bin its offset on the curve,
and a row's rank is its bin's offset plus its number in the bin. The salt, a hash of the row, splits cells of more than CELL_ROWS rows (a hot source), so no task
sees more than about so many.

Defined cases: null source, lang, doc_id or text are values of their own (grid coordinate 0; text counts 0 bytes);
an empty table gives no rows; repeated rows each get a slot of their own; other columns pass through, and one that is named like a column added here comes back as
input_<name>.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, running, stored

BITS = 4
TOP = 2**BITS - 1
#: doc_ids are cut at multiples of this.
STRETCH = 256
CELL_ROWS = 100_000
ADDED = ["size", "text_crc32", "curve", "shard", "slot"]


def cuts(values: DataFrame, parts: int = TOP) -> list:
    """The least value of each part of the one column's values that fills up a further equal share of the rows, ascending; nulls do not count. Values are counted before they are put in order."""
    counts = stored(values.toDF("v").filter("v is not null").groupBy("v").agg(F.count("*").alias("n")))
    total = counts.agg(F.sum("n")).first()[0]
    if not total:
        return []
    part = F.least(F.expr(f"({parts} * (upto - n)) div {total}"), F.lit(parts - 1))
    rows = running(counts, [F.col("v")], upto=F.col("n")).groupBy(part.alias("part")).agg(F.min("v").alias("v")).orderBy("part").collect()  # `parts` rows at most
    return [r.v for r in rows]


def coordinate(c: Column, at: list) -> Column:
    """How many of the ascending cuts are not above the value; 0 for null."""
    out = F.lit(0)
    for k, v in enumerate(at):
        out = F.when(c >= F.lit(v), k + 1).otherwise(out)
    return out.cast("int")


def dimensions(rows: DataFrame, size: Column) -> list[Column]:
    """Grid coordinates: source, language, size, and stretches of doc_ids."""
    stretch = F.floor(F.col("doc_id") / STRETCH)
    return [
        coordinate(F.col("source"), cuts(rows.select("source"))),
        coordinate(F.col("lang"), cuts(rows.select("lang"))),
        F.least(F.length(F.bin(size)) - 1, F.lit(TOP)).cast("int"),
        coordinate(stretch, cuts(rows.select(stretch))),
    ]


def hilbert_index(coords: list[Column], bits: int = BITS) -> Column:
    """Index on the Hilbert curve of a grid point (Skilling's transposition, AIP Conf. Proc. 707, 2004)."""
    n = len(coords)
    steps = F.array(*[F.struct(F.lit(1 << b).alias("q"), F.lit(i).alias("i")) for b in range(bits - 1, 0, -1) for i in range(n)])

    def undo(x: Column, s: Column) -> Column:
        q, i = s["q"], s["i"]
        here = F.get(x, i)
        swap = (F.get(x, F.lit(0)).bitwiseXOR(here)).bitwiseAND(q - 1)
        inverted = here.bitwiseAND(q) != 0
        return F.transform(
            x,
            lambda v, j: F.when((j == 0) & inverted, v.bitwiseXOR(q - 1)).when(~inverted & ((j == 0) | (j == i)) & (i != 0), v.bitwiseXOR(swap)).otherwise(v),
        )

    tops = F.array(*[F.lit(1 << b) for b in range(bits - 1, 0, -1)])
    places = F.array(*[F.struct(F.lit(b).alias("b"), F.lit(i).alias("i")) for b in range(bits - 1, -1, -1) for i in range(n)])

    def gray(x: Column) -> Column:
        return F.transform(x, lambda _, j: F.aggregate(F.slice(x, 1, j + 1), F.lit(0), lambda a, v: a.bitwiseXOR(v)))

    def flip(g: Column) -> Column:
        last = F.get(g, F.lit(n - 1))
        return F.aggregate(tops, F.lit(0), lambda t, q: F.when(last.bitwiseAND(q) != 0, t.bitwiseXOR(q - 1)).otherwise(t))

    def interleaved(g: Column) -> Column:
        bit = lambda p, t: F.call_function("getbit", F.get(g, p["i"]).bitwiseXOR(t), p["b"]).cast("int")
        return let(flip(g), lambda t: F.aggregate(places, F.lit(0), lambda h, p: h * 2 + bit(p, t)))

    # Each step is bound to a variable; written inside one another they would be evaluated again at every use.
    return let(F.aggregate(steps, F.array(*coords), undo), lambda x: let(gray(x), interleaved))


def hilbert_shards(docs: DataFrame, shards: int = 16) -> DataFrame:
    """docs with size, text_crc32, curve (index), shard and slot; shard sizes in rows differ by one at most."""
    own, names = set(docs.columns), {}
    for c in docs.columns:
        if c in ADDED:
            new = f"input_{c}"
            while new in own:
                new = f"input_{new}"
            own.add(new)
            names[c] = new
    kept = [names.get(c, c) for c in docs.columns]
    # The input's columns travel under names of their own, so none of them meets a name used here.
    carried = {f"__in{k}": n for k, n in enumerate(kept)}
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(docs.columns, carried, strict=True)], "doc_id", "source", "lang", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    dims = dimensions(rows, F.col("size"))
    n = len(dims)
    cell = F.lit(0)
    for d in dims:
        cell = cell * 2**BITS + d
    rows = rows.withColumns({"__cell": cell, "__hash": F.crc32(F.concat_ws(":", "doc_id", "text_crc32", "source").cast("binary"))})

    # Stored, so that no filter on the curve index is moved below the count and evaluated for every row.
    cells = stored(rows.groupBy("__cell").agg(F.count("*").alias("__n")))
    coords = [F.shiftright("__cell", BITS * (n - 1 - i)).bitwiseAND(TOP).cast("int") for i in range(n)]
    cells = stored(cells.select("__cell", hilbert_index(coords).alias("curve"), F.ceil(F.col("__n") / CELL_ROWS).alias("__salts")))
    # 2^(4 BITS) = 65,536 cells at most.
    rows = rows.join(F.broadcast(cells), "__cell").withColumn("__salt", F.pmod("__hash", "__salts")).drop("__salts", "__hash")
    bins = stored(rows.groupBy("__cell", "curve", "__salt").agg(F.count("*").alias("__n")))
    total = bins.agg(F.sum("__n")).first()[0] or 1
    offsets = running(bins, [F.col("curve"), F.col("__salt")], __upto=F.col("__n")).select("__cell", "__salt", (F.col("__upto") - F.col("__n")).alias("__offset"))

    order = Window.partitionBy("__cell", "__salt").orderBy("doc_id", "text_crc32", "size")
    rank = F.col("__offset") + F.row_number().over(order) - 1
    out = rows.join(offsets, ["__cell", "__salt"]).withColumn("__rank", rank)
    out = out.withColumn("shard", F.expr(f"(__rank * {shards}) div {total}").cast("int"))
    out = out.withColumn("slot", F.col("__rank") - F.expr(f"(shard * {total} + {shards - 1}) div {shards}"))
    return out.select(*[F.col(k).alias(n) for k, n in carried.items()], *ADDED)


def write_shards(sharded: DataFrame, path: str, files: int = 4) -> None:
    """One folder per shard, of about so many files, in curve order, whose statistics hold short ranges of each column."""
    shards = sharded.agg(F.max("shard")).first()[0]
    sharded.repartitionByRange(files * ((shards or 0) + 1), "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op1(docs: DataFrame) -> DataFrame:
    return hilbert_shards(docs.select("doc_id", "text", "source", "lang")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve"
    )
