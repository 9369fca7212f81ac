"""Quality selection by importance resampling.

Two generative models over hashed word n-grams (one and two words, lower-cased, BUCKETS buckets) are counted: the target from documents labelled good,
the raw one from all documents. A document's log weight is the sum over its n-grams of the log ratio of the two; adding Gumbel noise and keeping the
k largest samples k rows without replacement in proportion to their weights (Xie et al., 2023).

The target may be fitted on TARGET_DOCS labelled documents at most, those of least hash; the raw counts cover all documents. Both models are arrays of
BUCKETS numbers whatever the input. k is the labelled share of good documents times the number of documents, unless given. The threshold of the top k is found
exactly by histogram passes and a ranking of the few classes of equal rows that are left between them.

Defined cases: null or wordless texts have weight 0; a null doc_id draws its noise as a value of its own; rows that are equal draw equal noise, and of those at
the threshold as many stay as make exactly k; other ties there go by doc_id; with no good label the target equals the raw model; an empty table gives no rows; columns other than
doc_id and text are not read, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textvec
from .common import bounded_batches, repeated, stored

BUCKETS = 1 << 16
TARGET_DOCS = 20_000
SMOOTHING = 0.5
BINS = 1 << 16
#: Classes of equal rows that one task puts in order.
LAST_CLASSES = 1 << 16


def _grams(w: textvec.Words) -> tuple[np.ndarray, np.ndarray]:
    """(text index, bucket) of every word and every pair of words in a row."""
    h, at = w.hashes, w.text
    pair = np.flatnonzero(at[1:] == at[:-1])
    two = textvec.mix(h[pair] * textvec._BASE + h[pair + 1])
    mask = np.uint64(BUCKETS - 1)
    return np.concatenate([at, at[pair]]), np.concatenate([h & mask, two & mask]).astype(np.int64)


def _counted(batches):
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for w in textvec.words((None, t) for t in batch.column(0).to_pylist()):
            total += np.bincount(_grams(w)[1], minlength=BUCKETS)
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])


def counts(docs: DataFrame) -> np.ndarray:
    """Counts by bucket: tasks sum their own texts first, so BUCKETS rows a task are shuffled and BUCKETS numbers come back."""
    rows = docs.select("text").mapInArrow(_counted, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(BUCKETS)
    out[rows.bucket.to_numpy(np.int64)] = rows.n
    return out


def log_ratio(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    good = labels.filter("quality = 1 and doc_id is not null").select("doc_id").distinct().orderBy(F.xxhash64("doc_id")).limit(TARGET_DOCS)
    raw = counts(docs)
    target = counts(docs.join(F.broadcast(good), "doc_id", "left_semi"))  # TARGET_DOCS ids at most
    if not target.sum():
        return np.zeros(BUCKETS)
    p, q = (np.log(c + SMOOTHING) - np.log(c.sum() + SMOOTHING * BUCKETS) for c in (target, raw))
    return p - q


def _scored(shared):
    def run(batches):
        ratio = shared.value
        for batch in batches:
            n, score = [], []
            for w in textvec.words((None, t) for t in batch.column(1).to_pylist()):
                at, bucket = _grams(w)
                n.append(np.bincount(at, minlength=len(w.rows)))
                score.append(np.bincount(at, ratio[bucket], len(w.rows)).astype(np.float64))
            if n:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(n)), pa.array(np.concatenate(score))], ["doc_id", "n_grams", "log_weight"])

    return run


def top(rows: DataFrame, key: str, k: int) -> DataFrame:
    """rows with kept: exactly k of them (all if there are fewer), those of largest key; equal keys go by doc_id, nulls first, then by n_grams. rows have doc_id, n_grams and other columns that follow from these.

    Equal rows are one class with a count, so of the class at the threshold as many are kept as are wanted. The class is found by histograms over the key, and where very many keys are equal over doc_id and
    n_grams, until few classes are left, which one task puts in order.
    """
    names = rows.columns
    classes = stored(rows.groupBy(*names).agg(F.count("*").alias("__n")))
    total = classes.agg(F.sum("__n")).first()[0] or 0
    if k >= total:
        return rows.withColumn("kept", F.lit(True))
    if k <= 0:
        return rows.withColumn("kept", F.lit(False))
    place = [-F.col(key).cast("double"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))), F.col("n_grams").cast("long")]
    rest, before, few = classes, 0, False  # before: rows in front of `rest`
    for value in place:
        while not few:
            low, high, count = rest.agg(F.min(value), F.max(value), F.count("*")).first()
            few = count <= LAST_CLASSES
            if few or low == high:
                break
            bin_ = F.least(F.floor((value.cast("double") - float(low)) / ((float(high) - float(low)) / BINS)), F.lit(BINS - 1))
            found = rest.groupBy(bin_.alias("b")).agg(F.sum("__n").alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi")).orderBy("b").collect()  # BINS rows at most
            for r in found:
                if before + r.n >= k:
                    rest = rest.filter(value.between(r.lo, r.hi))
                    break
                before += r.n
            if len(found) == 1:
                break
    order = F.struct(*[v.alias(f"p{i}") for i, v in enumerate(place)])
    last = rest.select(order.alias("at"), "__n", F.sum("__n").over(Window.orderBy(order)).alias("to")).filter(F.col("to") >= k - before).orderBy("at").first()
    here = F.struct(*[F.lit(v).cast(kind).alias(f"p{i}") for i, (v, kind) in enumerate(zip(last["at"], ("double", "long", "long"), strict=True))])
    wanted = k - before - (last["to"] - last["__n"])
    kept = F.when(order < here, F.col("__n")).when(order == here, F.lit(wanted)).otherwise(0)
    out = repeated(classes.withColumn("__kept", kept), F.col("__n"), "__i")
    return out.select(*names, (F.col("__i") < F.col("__kept")).alias("kept"))


def resampled(docs: DataFrame, labels: DataFrame, k: int | None = None, seed: int = 5) -> DataFrame:
    """doc_id, n_grams, log_weight, gumbel_key, kept of every row."""
    ratio = log_ratio(bounded_batches(docs), labels)
    shared = docs.sparkSession.sparkContext.broadcast(ratio)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scored(shared), "doc_id long, n_grams long, log_weight double")
    u = (F.pmod(F.xxhash64("doc_id", "n_grams", "log_weight", F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    rows = stored(rows.withColumn("gumbel_key", F.col("log_weight") - F.log(-F.log(u))))
    if k is None:
        share = labels.agg(F.avg("quality")).first()[0]
        k = round(rows.count() * (1.0 if share is None else share))
    return top(rows, "gumbel_key", k)


def op5(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return resampled(docs, labels)
