"""Quality rules with host-level verdicts.

Each document is measured and judged by its own rules. Failures are then aggregated by host (the `source` column), each
host's failure rate is shrunk towards the corpus by a beta prior fitted to all hosts (method of moments), and documents
of hosts whose shrunk rate is too high are rejected too.

All measures are built-in array and string functions over the whole text, so the text is read once and never shuffled;
only (doc_id, host, measures) meet the host table. Trigrams are compared by 64-bit hashes within one text.

Defined cases: null text has no words (so it fails); a null host is a host of its own; an empty table gives no rows;
repeated rows count each; kept() returns all columns of its input as they are, whatever their names, measured() and judged() those that are not named like a column they add.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NOT_SPACE, SPACES, let, stored, word_array

#: Characters counted as symbols.
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A host is rejected if its shrunk failure rate is above this.
MAX_HOST_RATE = 0.5
#: Weight of the prior in documents when the hosts' rates do not spread (all equal, or a single host).
FLAT_PRIOR = 100.0


def _covered(grams: Column) -> Column:
    """Words in trigram windows that occur twice or more; grams: the windows' hashes in order."""
    tagged = F.array_sort(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def starts(s: Column) -> Column:
        repeated = F.filter(s, lambda e, k: (F.get(s, k - 1)["h"] == e["h"]) | (F.get(s, k + 1)["h"] == e["h"]))
        return F.array_sort(F.transform(repeated, lambda e: e["i"]))

    def total(p: Column) -> Column:
        reach = F.transform(p, lambda i, k: F.least(F.coalesce(F.get(p, k + 1) - i, F.lit(3)), F.lit(3)))
        return F.aggregate(reach, F.lit(0), lambda a, b: a + b)

    return let(let(tagged, starts), total)


def _words(text: Column) -> Column:
    """struct(n_words, n_repeat_words)"""

    def measure(w: Column) -> Column:
        n = F.size(w)
        grams = F.when(n < 3, F.array().cast("array<bigint>")).otherwise(
            F.transform(F.slice(w, 1, F.greatest(n - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
        )
        repeats = let(grams, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(_covered(g)))
        return F.struct(n.cast("long").alias("n"), repeats.cast("long").alias("r"))

    return let(word_array(text), measure)


def measured(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and base_failed."""
    text = F.coalesce(F.col("text"), F.lit(""))
    chars = F.char_length(text)
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(NOT_SPACE))
    out = docs.withColumns(
        {
            "__w": _words(text),
            "word_chars": F.char_length(F.translate(text, SPACES, "")).cast("long"),
            "n_symbols": (chars - F.char_length(F.translate(text, SYMBOLS, ""))).cast("long"),
            "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        }
    )
    out = out.withColumns({"n_words": F.col("__w.n"), "n_repeat_words": F.col("__w.r")}).drop("__w")
    return out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


def host_rates(failures: DataFrame) -> DataFrame:
    """host, docs, failed, rate: posterior mean under a beta prior fitted to the hosts' rates, each host weighing its documents.

    failures has host and base_failed. The prior's mean m is the corpus's rate; its weight solves the moment equation
    Var = m (1 - m) / (weight + 1) after the binomial noise is taken off the observed spread.
    """
    hosts = stored(failures.groupBy("host").agg(F.count("*").alias("docs"), F.sum(F.col("base_failed").cast("long")).alias("failed")))
    got = hosts.agg(F.sum("docs"), F.sum(F.col("docs") * F.col("docs")), F.count("*"), F.sum("failed"), F.sum(F.pow("failed", F.lit(2)) / F.col("docs"))).first()
    if not got[0]:
        return hosts.select("host", "docs", "failed", F.lit(0.0).alias("host_rate"))
    n, squares, k, failed, ratio = map(float, got)
    # Between-host variance as in a one-way analysis of variance with unequal group sizes.
    m, scale = failed / n, n - squares / n
    between = (ratio - n * m * m - (k - 1) * m * (1 - m)) / scale if scale > 0 else 0.0
    weight = max(m * (1 - m) / between - 1, 1.0) if between > 0 and 0 < m < 1 else FLAT_PRIOR
    rate = (F.col("failed") + weight * m) / (F.col("docs") + weight)
    return hosts.select("host", "docs", "failed", rate.alias("host_rate"))


def judged(docs: DataFrame, host: str = "source", rates: DataFrame | None = None) -> DataFrame:
    """docs with the measures, host_rate and kept; rates as from host_rates(), made from docs if not given."""
    rows = docs if "base_failed" in docs.columns else measured(docs)
    if rates is None:
        rates = host_rates(rows.select(F.col(host).alias("host"), "base_failed"))
    out = rows.join(rates.select(F.col("host").alias("__host"), "host_rate"), F.col(host).eqNullSafe(F.col("__host")), "left").drop("__host")
    return out.withColumn("kept", ~F.col("base_failed") & (F.coalesce("host_rate", F.lit(0.0)) <= MAX_HOST_RATE))


def kept(docs: DataFrame, host: str = "source") -> DataFrame:
    """The documents that pass their own rules and whose host passes, with the columns of docs. Texts are measured once: rows that fail leave only their host behind."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = measured(docs.select(row.alias("__row"), F.col(host).alias("host"), "text")).select("host", "base_failed", F.when(~F.col("base_failed"), F.col("__row")).alias("__row"))
    rows = stored(rows)
    rates = host_rates(rows.select("host", "base_failed"))
    return judged(rows, "host", rates).filter("kept").select(*[F.col("__row")[c].alias(c) for c in docs.columns])


def op3(docs: DataFrame) -> DataFrame:
    rows = stored(measured(docs.select("doc_id", "source", "text")).drop("text"))
    return judged(rows).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
