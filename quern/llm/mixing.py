"""Mixing sources to target weights by entropy balancing.

Among all document rates w_i in [0, 2], the mix takes those closest (in relative entropy) to one copy each that give every
source its target number of words: w_i = min(2, exp(lambda_s * size_i / mean_s)). The multipliers minimise the convex dual,
one dimension per source, and are found by Newton steps, safeguarded by a bracket. Every step is one aggregation over the
histogram (source, size, count), which is all that the dual sees; its sums are decimals, so reruns agree bit for bit. Steps go on until every
source is within TOLERANCE of its target; if they do not get there, that is an error.

Rates become copies by floor(rate + u + shift): u is a hash of the row, shift a per-source number chosen in two
histogram passes so that the words taken come as near to the target as one row allows. A few last passes change one
row per source each, the one whose size best matches what is still missing. Rows equal in source, doc_id and text are numbered, and the number is part of the
hash, so that each is a row of its own in all this.

A row's copies thus follow from its source, size, hash and a list of a few changed rows: mix() evaluates them where a text is read and moves no text. Only rows that
occur more than once are set aside, to be numbered.

Defined cases: null text has size 0 (such documents have rate 1); null source is a source of its own, last in order; a null doc_id is a value like others; an
empty table gives no rows; repeated rows count each; mix() returns all columns of its input as they are, whatever their names, mixed() only reads doc_id, source and text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import repeated, running, stored, word_count

WEIGHTS = (5, 2, 1)
TOTAL = 1.5
MOST = 2
NEWTON_STEPS = 200
TOLERANCE = 1e-7
LAST_PASSES = 5
#: Per-source tables, and lists of repeated rows, of up to this many rows (some 10 MB) are broadcast.
BROADCAST_ROWS = 100_000
BINS = 1024


def _exact(c: Column) -> Column:
    return F.sum(c.cast("decimal(28,6)")).cast("double")


def _small(t: DataFrame) -> DataFrame:
    """t (stored), to be broadcast if it has few rows, as counted here; else it is joined by a shuffle."""
    return F.broadcast(t) if t.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else t


def targets(sizes: DataFrame) -> DataFrame:
    """__s, source_size, docs, target, __full, from (__s, source, source_size, docs), one row per source."""
    t = running(sizes, [F.col("source")], __place=F.lit(1))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.pmod(F.col("__place") - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
    t = stored(t.withColumn("__weight", weight.cast("double")).withColumn("__cap", F.col("source_size") * MOST))
    all_size, all_weight = t.agg(F.sum("source_size"), F.sum("__weight")).first()
    budget = (all_size or 0) * TOTAL
    # Sources in the order in which a rising level fills them: those that a level beyond their own cap would fill are full.
    t = running(t, [F.col("__cap") / F.col("__weight"), F.col("__s")], __caps=F.col("__cap"), __weights=F.col("__weight"))
    level = (F.lit(budget) - (F.col("__caps") - F.col("__cap"))) / (F.lit(all_weight or 0.0) - F.col("__weights") + F.col("__weight"))
    t = stored(t.withColumn("__full", F.col("__cap") <= level * F.col("__weight")))
    capped, free = t.agg(F.sum(F.when(F.col("__full"), F.col("__cap"))), F.sum(F.when(~F.col("__full"), F.col("__weight")))).first()
    target = F.when(F.col("__full"), F.col("__cap").cast("double")).otherwise(F.lit((budget - (capped or 0)) / (free or 1.0)) * F.col("__weight"))
    return t.select("__s", "source_size", "docs", target.alias("target"), "__full")


def rate() -> Column:
    return F.when(F.col("__full"), F.lit(float(MOST))).otherwise(F.least(F.lit(float(MOST)), F.exp(F.least(F.col("__lambda") * F.col("__x"), F.lit(50.0)))))


def multipliers(histogram: DataFrame, goals: DataFrame) -> DataFrame:
    """goals with __lambda, __mean: the dual's optimum for each source."""
    mean = F.greatest(F.try_divide(F.col("source_size").cast("double"), F.col("docs")), F.lit(1e-9))
    state = goals.withColumns({"__mean": mean, "__lambda": F.lit(0.0), "__low": F.lit(-1e6), "__high": F.lit(1e6)})
    names = state.columns
    for _ in range(NEWTON_STEPS):
        at = histogram.join(state, "__s").withColumn("__x", F.col("size") / F.col("__mean")).withColumn("__w", rate())
        words = F.col("size") * F.col("__n") * F.col("__w")
        sums = at.groupBy(*names).agg(_exact(words).alias("__got"), _exact(F.when(F.col("__w") < MOST, words * F.col("__x")).otherwise(0)).alias("__slope"))
        off = F.col("__got") - F.col("target")
        low = F.when(off < 0, F.greatest("__low", "__lambda")).otherwise(F.col("__low"))
        high = F.when(off > 0, F.least("__high", "__lambda")).otherwise(F.col("__high"))
        newton = F.col("__lambda") - F.try_divide(off, F.col("__slope"))
        # A bracket end still at its start is no midpoint: step out by doubling instead.
        middle = F.when(F.col("__h") >= 1e6, F.greatest(F.col("__lambda") * 2, F.lit(1.0))).when(F.col("__l") <= -1e6, F.least(F.col("__lambda") * 2, F.lit(-1.0))).otherwise((F.col("__l") + F.col("__h")) / 2)
        done = F.col("__full") | (F.abs(off) <= TOLERANCE * F.col("target"))
        state = sums.withColumns({"__l": low, "__h": high, "__new": newton, "__done": done})
        inside = (F.col("__new") > F.col("__l")) & (F.col("__new") < F.col("__h")) & (F.abs(F.col("__new") - F.col("__lambda")) <= 4 + F.abs("__lambda"))
        step = F.when(F.col("__done"), F.col("__lambda")).when(F.coalesce(inside, F.lit(False)), F.col("__new")).otherwise(middle)
        state = stored(state.select(*[c for c in names if c not in ("__lambda", "__low", "__high")], step.alias("__lambda"), F.col("__l").alias("__low"), F.col("__h").alias("__high"), "__done"))
        if not state.filter(~F.col("__done")).head(1):
            return state.select("__s", "source_size", "target", "__full", "__mean", "__lambda")
        state = state.select(*names)
    raise RuntimeError("entropy balancing did not converge")


def _shift(rows: DataFrame, goals: DataFrame) -> DataFrame:
    """__s, __shift: where the words of the flips up to it come nearest to the target."""
    flips = rows.filter(~F.col("__full") & (F.col("size") > 0)).select("__s", "size", F.explode(F.array(1 - F.col("__v"), 2 - F.col("__v"))).alias("__at"))
    flips = flips.withColumn("__bin", F.least(F.greatest(F.floor((F.col("__at") + 1) * (BINS // 2)), F.lit(-1)), F.lit(BINS)))
    by_bin = Window.partitionBy("__s").orderBy("__bin")
    coarse = flips.groupBy("__s", "__bin").agg(F.sum("size").alias("__words")).withColumn("__to", F.sum("__words").over(by_bin)).join(goals.select("__s", "target"), "__s")
    coarse = coarse.filter(F.col("__to") >= F.col("target")).groupBy("__s").agg(F.min_by(F.struct("__bin", (F.col("__to") - F.col("__words")).alias("before"), "target"), "__bin").alias("__c"))
    coarse = stored(coarse.select("__s", F.col("__c.__bin").alias("__bin"), F.col("__c.before").alias("__before"), F.col("__c.target").alias("target")))
    width = 2.0 / BINS
    left = F.col("__bin") * width - 1
    fine = flips.join(_small(coarse), ["__s", "__bin"]).withColumn("__fine", F.floor((F.col("__at") - left) / width * BINS * BINS))
    fine = fine.groupBy("__s", "__bin", "__before", "target", "__fine").agg(F.sum("size").alias("__words"))
    to = F.col("__before") + F.sum("__words").over(Window.partitionBy("__s").orderBy("__fine"))
    fine = fine.withColumn("__to", to)
    ends = F.explode(F.array(F.struct((F.abs(F.col("__to") - F.col("target"))).alias("off"), (left + (F.col("__fine") + 1) * width / BINS / BINS).alias("at")), F.struct(F.abs(F.col("__to") - F.col("__words") - F.col("target")).alias("off"), (left + F.col("__fine") * width / BINS / BINS).alias("at"))))
    return fine.select("__s", ends.alias("__e")).groupBy("__s").agg(F.min("__e").alias("__e")).select("__s", F.col("__e.at").alias("__shift"))


def _source() -> Column:
    return F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), F.col("source").cast("string")))


def _key(s: Column) -> Column:
    return F.xxhash64(s, F.col("doc_id"), F.col("text"), F.lit(7))


def _u() -> Column:
    """Of row __j of those with one key; the first row's is the key's own."""
    h = F.when(F.col("__j") == 0, F.col("__key")).otherwise(F.xxhash64("__key", "__j"))
    return F.pmod(h, F.lit(1 << 40)) / float(1 << 40)


@dataclass
class Mix:
    """What decides a row's copies. rows: __key, doc_id, __j, size, __s, rate, copies, .. of every row; sources: __s, source_size, target, __full, __mean, __lambda, __shift;
    changed: __key, __j, __by: what the last passes added; twice: the keys of more than one row."""

    rows: DataFrame
    sources: DataFrame
    changed: DataFrame
    twice: DataFrame


def balanced(docs: DataFrame) -> Mix:
    rows = docs.select("doc_id", "source", "text").withColumn("__s", _source()).select("doc_id", "source", "__s", word_count(F.col("text")).alias("size"), _key(F.col("__s")).alias("__key"))
    classes = stored(rows.groupBy("__key", "__s", "source", "doc_id", "size").agg(F.count("*").alias("__m")))
    histogram = stored(classes.groupBy("__s", "source", "size").agg(F.sum("__m").alias("__n")))
    sizes = histogram.groupBy("__s", "source").agg(F.sum(F.col("size") * F.col("__n")).alias("source_size"), F.sum("__n").alias("docs"))
    goals = stored(multipliers(histogram, stored(targets(stored(sizes)))))
    small = _small(goals)
    rows = repeated(classes, F.col("__m"), "__j").join(small, "__s").withColumn("__x", F.col("size") / F.col("__mean")).withColumn("rate", rate()).withColumn("__v", F.col("rate") + _u())
    rows = stored(rows.select("doc_id", "__s", "__key", "__j", "size", "source_size", "target", "__full", "rate", "__v"))
    shift = stored(_shift(rows, goals))
    goals = stored(goals.join(_small(shift), "__s", "left").withColumn("__shift", F.coalesce("__shift", F.lit(0.0))))
    rows = stored(rows.join(_small(goals.select("__s", "__shift")), "__s").withColumn("copies", _copies()).drop("__v", "__shift"))
    changed = []
    for _ in range(LAST_PASSES):
        short = stored(rows.groupBy("__s").agg((F.first("target") - F.sum(F.col("copies") * F.col("size"))).alias("__short")).filter(F.abs("__short") >= 1))
        fit = rows.join(_small(short), "__s").filter((F.col("size") > 0) & (F.col("size") < 2 * F.abs("__short")) & F.when(F.col("__short") > 0, F.col("copies") < MOST).otherwise(F.col("copies") > 0))
        best = fit.groupBy("__s").agg(F.min(F.struct(F.abs(F.abs("__short") - F.col("size")).alias("off"), "__key", "__j", F.signum("__short").cast("int").alias("by"))).alias("__b"))
        best = stored(best.select(F.col("__b.__key").alias("__key"), F.col("__b.__j").alias("__j"), F.col("__b.by").alias("__by")))
        if not best.head(1):
            break
        changed.append(best)
        rows = stored(rows.join(_small(best), ["__key", "__j"], "left").withColumn("copies", F.col("copies") + F.coalesce("__by", F.lit(0))).drop("__by"))
    none = docs.sparkSession.createDataFrame([], "__key long, __j long, __by int")
    for best in changed:
        none = none.unionByName(best)
    changed = stored(none.groupBy("__key", "__j").agg(F.sum("__by").cast("int").alias("__by")))
    twice = stored(classes.groupBy("__key").agg(F.sum("__m").alias("__m")).filter("__m > 1").select("__key"))
    return Mix(rows, goals, changed, twice)


def _copies() -> Column:
    return F.when(F.col("__full"), MOST).otherwise(F.least(F.greatest(F.floor(F.col("__v") + F.col("__shift")), F.lit(0)), F.lit(MOST))).cast("int")


def mixed(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies, rate, one row per document."""
    return balanced(docs).rows.withColumn("taken", F.col("copies") * F.col("size"))


def mix(docs: DataFrame) -> DataFrame:
    """docs with each row repeated as often as the mix takes it."""
    m = balanced(docs.select("doc_id", "source", "text"))
    names = docs.columns
    # The input's columns travel in one struct, so none of them meets a name used here.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("__row")).withColumns({"__s": F.when(F.col("__row.source").isNull(), "n").otherwise(F.concat(F.lit("s"), F.col("__row.source").cast("string")))})
    rows = rows.withColumn("__key", F.xxhash64("__s", "__row.doc_id", "__row.text", F.lit(7)))
    one = rows.withColumn("__j", F.lit(0).cast("long"))
    if m.twice.head(1):
        twice = _small(m.twice)
        one = one.join(twice, "__key", "left_anti")
        # Rows of one key are numbered by partition and by place in it, as stored: no task sees more than a partition of them.
        many = stored(rows.join(twice, "__key", "left_semi").withColumns({"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id()}))
        parts = many.groupBy("__key", "__part").agg(F.count("*").alias("__n"))
        before = F.sum("__n").over(Window.partitionBy("__key").orderBy("__part")) - F.col("__n")
        place = F.row_number().over(Window.partitionBy("__key", "__part").orderBy("__at")) - 1
        many = many.withColumn("__place", place).join(parts.withColumn("__before", before), ["__key", "__part"])
        one = one.unionByName(many.withColumn("__j", F.col("__before") + F.col("__place")).select(*one.columns))
    out = one.join(_small(m.sources.select("__s", "__full", "__mean", "__lambda", "__shift")), "__s")
    out = out.withColumn("__x", word_count(F.col("__row.text")) / F.col("__mean")).withColumn("__v", rate() + _u())
    out = out.join(_small(m.changed), ["__key", "__j"], "left").withColumn("__copies", _copies() + F.coalesce("__by", F.lit(0)))
    return repeated(out.select("__row", "__copies"), F.col("__copies"), "__i").select(*[F.col("__row")[c].alias(c) for c in names])


def op2(docs: DataFrame) -> DataFrame:
    return mixed(docs).select("doc_id", "size", "source_size", "target", "taken", "copies", "rate")
