"""Benchmark decontamination by greedy string tiling.

Words are compared in a normal form: case folded by Unicode, accents composed, punctuation and symbols stripped from both ends.
A document and a benchmark item that share a seed (a run of MIN_WORDS words) are tiled: the longest common runs of unmarked words are found by running Karp-Rabin hashes over both, verified, marked and never used again, until none of MIN_WORDS words is left. The
share of the item's words under tiles is the coverage; since tiles may lie in any order, passages cut up and reordered are found too.

Coverage of a share of an item takes tiles, each of MIN_WORDS words or more, so a share of its seeds must occur in the document: with T of P seeds at least, one of any P - T + 1. Only so many of an
item's seeds, those that the fewest items hold, are looked up; an opening that all items share pairs no document with them. Of the pairs found, those whose shared seeds cover too few
words of the item in all are not tiled. Both filters are exact for items that are covered to the limit; others count as not covered.

A benchmark of up to BROADCAST_BYTES is sent to all executors and each row is decided where it is read, without a shuffle or a join. A larger one stays a table: documents' seeds are
first tested against a bitmap of BITMAP_BITS, those that pass are joined with the items' by seed, and the candidate texts meet their items by blocks, each text once for up to ITEM_BLOCK items.
Both ways give the same rows.

Defined cases: null or wordless texts match nothing; a word of punctuation or symbols alone is none; items of fewer than MIN_WORDS words match only texts of just these words; items that are equal
are one; a null doc_id or repeated rows are judged each by itself; an empty benchmark or table gives coverage 0 or no rows; other columns pass through as they are, whatever their names.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textvec
from .common import bounded_batches, running, stored

MIN_WORDS = 5
#: A document is contaminated if this share of an item's words is covered.
COVERAGE = 0.5
#: A benchmark of up to this many bytes is sent to the executors.
BROADCAST_BYTES = 8 << 20
BITMAP_BITS = 27
ITEM_BLOCK = 200
#: Verdicts up to this number are broadcast (16 bytes and the tiles each).
BROADCAST_ROWS = 100_000

_VERDICT = "struct<item:long,coverage:double,tiles:array<array<int>>,items:int,place:long>"
_BASE = np.uint64(0xD1342543DE82EF95)


@cache
def _marks() -> np.ndarray:
    """Which code points are punctuation or symbols."""
    return np.array([unicodedata.category(chr(c))[0] in "PS" for c in range(0x110000)])


def _is_mark(data: np.ndarray) -> np.ndarray:
    """Which bytes of UTF-8 belong to punctuation or symbols."""
    out = np.append(_marks()[:128], np.zeros(128, bool))[data]
    lead = np.flatnonzero(data >= 0xC0)
    size = 2 + (data[lead] >= 0xE0) + (data[lead] >= 0xF0)
    code = data[lead].astype(np.int64) & (0x7F >> size)
    for k in range(1, 4):
        code = np.where(k < size, code << 6 | data[np.minimum(lead + k, len(data) - 1)] & 63, code)
    mark = _marks()[code]
    lead, size = lead[mark], size[mark]
    for k in range(4):
        out[lead[k < size] + k] = True
    return out


def words(pairs: Iterable[tuple[object, str | None]], limit: int = textvec.CHUNK) -> Iterator[textvec.Words]:
    """textvec.words in the normal form."""
    folded = ((row, unicodedata.normalize("NFC", (text or "").casefold())) for row, text in pairs)
    for w in textvec.words(folded, lower=False, hashed=False, limit=limit):
        n, mark = len(w.data), _is_mark(w.data)
        at = np.arange(n)
        ahead = np.minimum.accumulate(np.where(mark, n, at)[::-1])[::-1]
        back = np.maximum.accumulate(np.where(mark, -1, at))
        start, end = ahead[w.start], back[w.end - 1] + 1
        some = start < w.end
        w.start, w.end = start[some], end[some]
        w.first = np.searchsorted(w.start, w.bounds)
        w.hashes = textvec.span_hashes(textvec.prefix_hashes(w.data), w.start, w.end)
        yield w


def _prefix(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums p and powers b: the Karp-Rabin value of words i .. i + s - 1 is (p[i + s] - p[i]) * b[n - i]."""
    n = len(h)
    b = np.full(n + 1, _BASE, np.uint64)
    b[0] = 1
    b = np.multiply.accumulate(b)
    p = np.zeros(n + 1, np.uint64)
    np.cumsum(h * b[:n], out=p[1:])
    return p, b


def tile(doc: np.ndarray, item: np.ndarray, least: int, at: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """Tiles (start in doc, start in item, length) in the order marked. at: places in doc where a match may start; all if not given."""
    n, m = len(doc), len(item)
    least = max(1, min(least, m))
    if n < least:
        return []
    at = np.arange(n - least + 1) if at is None else at
    free_d, free_t = np.ones(n + 1, bool), np.ones(m + 1, bool)
    free_d[n] = free_t[m] = False
    (pd, bd), (pt, bt) = _prefix(doc), _prefix(item)
    top = max(n, m)
    shift = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(top, _BASE, np.uint64)]))
    tiles: list[tuple[int, int, int]] = []
    s = min(n, m)
    while True:
        # Places where s words in a row are free.
        busy_d, busy_t = np.concatenate([[0], np.cumsum(~free_d[:n])]), np.concatenate([[0], np.cumsum(~free_t[:m])])
        d = at[at + s <= n]
        d = d[busy_d[d + s] == busy_d[d]]
        t = np.arange(m - s + 1)
        t = t[busy_t[t + s] == busy_t[t]]
        found = []
        if len(d) and len(t):
            hd, ht = (pd[d + s] - pd[d]) * shift[top - d], (pt[t + s] - pt[t]) * shift[top - t]
            order = np.argsort(ht, kind="stable")
            lo, hi = np.searchsorted(ht[order], hd, "left"), np.searchsorted(ht[order], hd, "right")
            for k in np.flatnonzero(hi > lo):
                i = int(d[k])
                for j in t[order[lo[k] : hi[k]]].tolist():
                    if not np.array_equal(doc[i : i + s], item[j : j + s]):
                        continue
                    length = s
                    while free_d[i + length] and free_t[j + length] and doc[i + length] == item[j + length]:
                        length += 1
                    found.append((-length, i, j))
        if not found:
            if s == least:
                return tiles
            s = max(least, s // 2)
            continue
        for neg, i, j in sorted(found):
            if free_d[i : i - neg].all() and free_t[j : j - neg].all():
                free_d[i : i - neg] = False
                free_t[j : j - neg] = False
                tiles.append((i, j, -neg))


def runs(h: np.ndarray, least: int) -> np.ndarray:
    """Hash of each run of `least` words."""
    n = len(h) - least + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = h[:n].copy()
    for k in range(1, least):
        out = textvec.mix(out * textvec._BASE + h[k : n + k])
    return out


def looked_up(words: int, least: int, limit: float) -> int:
    """How many of an item's seeds must be looked up, so that one of them occurs in each text that covers the item to the limit."""
    return (words - least + 1) - -(-max(1, math.ceil(limit * words - 1e-9)) // least) + 1


def judged(h: np.ndarray, seeds: np.ndarray, items: Iterable[tuple[int, int | None, np.ndarray, np.ndarray]], least: int, limit: float):
    """(item, coverage, tiles, items covered to the limit, place) of the item that a text of words h and seeds covers most, the first one if several; items: (place, id, words, seeds) in order of place."""
    best, count = (None, 0.0, [], 0), 0
    for place, item, words_, own in items:
        if len(words_) < least:
            tiles = [(0, 0, len(words_))] if np.array_equal(h, words_) else []
        else:
            order = np.sort(own)
            at = np.flatnonzero(order[np.minimum(np.searchsorted(order, seeds), len(order) - 1)] == seeds)
            edge = np.zeros(len(words_) + 1, np.int64)
            shared = np.flatnonzero(np.isin(own, seeds[at]))
            np.add.at(edge, shared, 1)
            np.add.at(edge, shared + least, -1)
            if (np.cumsum(edge) > 0).sum() < limit * len(words_):
                continue
            tiles = tile(h, words_, least, at)
        coverage = sum(x[2] for x in tiles) / len(words_)
        if tiles and coverage >= limit:
            count += 1
            if coverage > best[1]:
                best = (item, coverage, tiles, place)
    return *best[:3], count, best[3]


class Items:
    """All items, in (id, text) order."""

    def __init__(self, rows: list[tuple[int | None, str | None]], least: int, limit: float):
        self.least, self.limit, self.rows, self.short = least, limit, [], {}
        for w in words(rows):
            for i, row in enumerate(w.rows):
                h = w.hashes[w.first[i] : w.first[i + 1]].copy()
                if len(h):
                    if len(h) < least:
                        self.short.setdefault(h.tobytes(), []).append(len(self.rows))
                    self.rows.append((len(self.rows), row, h, runs(h, least)))
        own = [np.unique(r[3]) for r in self.rows]
        seed, n = np.unique(np.concatenate(own), return_counts=True) if own else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        index = []
        for place, _, h, r in self.rows:
            if len(r):
                order = np.lexsort((r, n[np.searchsorted(seed, r)]))
                some = np.unique(r[order[: looked_up(len(h), least, limit)]])
                index.append((some, np.full(len(some), place)))
        h, item = (np.concatenate(x) for x in zip(*index, strict=True)) if index else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        order = np.argsort(h, kind="stable")
        self.seeds, self.item = h[order], item[order]

    def best(self, w: textvec.Words):
        """judged() for each text of w."""
        out = []
        r = runs(w.hashes, self.least)
        lo = np.searchsorted(self.seeds, r)
        hit = np.flatnonzero(self.seeds[np.minimum(lo, len(self.seeds) - 1)] == r) if len(self.seeds) else np.zeros(0, np.int64)
        for i in range(len(w.rows)):
            first, end = w.first[i], w.first[i + 1]
            last = end - self.least + 1  # seeds of this text begin before
            mine = hit[np.searchsorted(hit, first) : np.searchsorted(hit, last)] if last > first else hit[:0]
            found = list(self.short.get(w.hashes[first:end].tobytes(), [])) if end - first < self.least else []
            if len(mine):
                s = np.unique(r[mine])
                a, b = np.searchsorted(self.seeds, s, "left"), np.searchsorted(self.seeds, s, "right")
                found = np.unique(np.concatenate([self.item[x:y] for x, y in zip(a, b, strict=True)])).tolist()
            out.append(judged(w.hashes[first:end], r[first:last] if last > first else r[:0], (self.rows[k] for k in found), self.least, self.limit) if found else (None, 0.0, [], 0, 0))
        return out


def _verdicts(found: list[tuple]) -> pa.StructArray:
    kinds = ("item", pa.int64()), ("coverage", pa.float64()), ("tiles", pa.list_(pa.list_(pa.int32()))), ("items", pa.int32()), ("place", pa.int64())
    return pa.StructArray.from_arrays([pa.array([x[k] for x in found], kind) for k, (_, kind) in enumerate(kinds)], fields=[pa.field(*k) for k in kinds])


def _tiled(shared):
    def run(batches):
        items = shared.value
        for batch in batches:
            best = [x for w in words((None, t) for t in batch.column(batch.num_columns - 1).to_pylist()) for x in items.best(w)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], _verdicts(best)], [*batch.schema.names[:-1], "__found"])

    return run


def _seeds(least: int, limit: float):
    """(place, id, text, seed, ..) of items: all seeds of each, with how many of them are looked up; a short item is one seed of all its words, plus 1."""

    def run(batches):
        for batch in batches:
            place, text = batch.column("place").to_pylist(), batch.column("text").to_pylist()
            for w in words(zip(place, text, strict=True)):
                out = []
                for i, row in enumerate(w.rows):
                    h = w.hashes[w.first[i] : w.first[i + 1]]
                    r = runs(h, min(least, len(h))) if len(h) else np.zeros(0, np.uint64)
                    if len(h) < least:
                        r = r + np.uint64(1)
                    out.append((np.full(len(r), row), r, np.full(len(r), looked_up(len(h), least, limit) if len(h) >= least else 1)))
                p, r, k = (np.concatenate(x) for x in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(p, pa.int64()), pa.array(r.view(np.int64)), pa.array(k, pa.int64())], ["place", "seed", "wanted"])

    return run


def _probed(shared, least: int):
    """(key1, key2, text, seeds) of texts with seeds that the bitmap holds."""

    def run(batches):
        bits = shared.value
        for batch in batches:
            held = []
            rows = zip(*(batch.column(c).to_pylist() for c in ("key1", "key2", "text")), strict=True)
            for w in words(((a, b, t), t) for a, b, t in rows):
                for i, row in enumerate(w.rows):
                    h = w.hashes[w.first[i] : w.first[i + 1]]
                    if not len(h):
                        continue
                    r = np.unique(runs(h, least)) if len(h) >= least else runs(h, len(h)) + np.uint64(1)
                    at = r & np.uint64((1 << BITMAP_BITS) - 1)
                    r = r[bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1 > 0]
                    if len(r):
                        held.append((*row, r.view(np.int64)))
            if held:
                a, b, t, r = zip(*held, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(t), pa.array(r, pa.list_(pa.int64()))], ["key1", "key2", "text", "seeds"])

    return run


def _met(least: int, limit: float):
    """(key1, key2, found) of each block, from rows (key1, key2, block, place, item, text) in that order, the text itself first, with no place."""

    def run(batches):
        now, h, seeds, items = None, None, None, []

        def done():
            return *now[:2], judged(h, seeds, items, least, limit)

        for batch in batches:
            out = []
            for *key, place, item, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                w = next(words([(None, text)]))
                if place is None:
                    if key != now:
                        if now is not None:
                            out.append(done())
                        now, h, seeds, items = key, w.hashes, runs(w.hashes, least), []
                    continue
                if key != now:
                    raise RuntimeError("a text is missing")
                items.append((place, item, w.hashes, runs(w.hashes, least)))
            if out:
                yield _blocks(out)
        if now is not None:
            yield _blocks([done()])

    return run


def _blocks(out: list[tuple]) -> pa.RecordBatch:
    a, b, found = zip(*out, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), _verdicts(found)], ["key1", "key2", "found"])


def _keys(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("key1"), F.xxhash64(F.lit(7), text).alias("key2")]


def _joined(docs: DataFrame, items: DataFrame, least: int, limit: float) -> DataFrame:
    """(key1, key2, __found) of the texts that cover an item to the limit, by joins; items: item_id, text, distinct."""
    spark = docs.sparkSession
    items = stored(running(items, [F.col("item_id"), F.col("text")], place=F.lit(1)))
    seeds = items.select("place", "text").mapInArrow(_seeds(least, limit), "place long, seed long, wanted long")
    holders = seeds.select("place", "seed").distinct().groupBy("seed").agg(F.count("*").alias("holders"))
    rarest = F.row_number().over(Window.partitionBy("place").orderBy("holders", "seed"))
    index = stored(seeds.join(holders, "seed").withColumn("r", rarest).filter(F.col("r") <= F.col("wanted")).select("seed", "place").distinct())
    # One bit per value of the low bits of a seed: 2^(BITMAP_BITS - 6) rows at most.
    low = F.col("seed").bitwiseAND((1 << BITMAP_BITS) - 1)
    rows = index.select(F.shiftright(low, 6).alias("word"), F.expr("shiftleft(1L, cast(seed & 63 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
    bits = np.zeros(1 << (BITMAP_BITS - 6), np.int64)
    bits[rows.word.to_numpy(np.int64)] = rows.bits.to_numpy(np.int64)
    shared = spark.sparkContext.broadcast(bits.view(np.uint8))
    texts = docs.select(*_keys(F.col("text")), "text").mapInArrow(_probed(shared, least), "key1 long, key2 long, text string, seeds array<long>")
    texts = stored(texts.dropDuplicates(["key1", "key2"]))
    pairs = stored(texts.select("key1", "key2", F.explode("seeds").alias("seed")).join(index, "seed").select("key1", "key2", "place").distinct())
    blocks = pairs.groupBy("key1", "key2").agg(F.ceil(F.count("*") / ITEM_BLOCK).alias("blocks"))
    dealt = stored(pairs.join(blocks, ["key1", "key2"]).select("key1", "key2", F.pmod(F.xxhash64("place"), "blocks").cast("int").alias("block"), "place"))
    none = F.lit(None).cast("long")
    heads = dealt.select("key1", "key2", "block").distinct().join(texts.select("key1", "key2", "text"), ["key1", "key2"]).select("key1", "key2", "block", none.alias("place"), none.alias("item"), "text")
    rows = heads.union(dealt.join(items.select("place", "item_id", "text"), "place").select("key1", "key2", "block", "place", "item_id", "text"))
    met = rows.repartition("key1", "key2", "block").sortWithinPartitions("key1", "key2", "block", F.col("place").asc_nulls_first())
    found = met.mapInArrow(_met(least, limit), f"key1 long, key2 long, found {_VERDICT}").filter("found.items > 0")
    best = F.max(F.struct("found.coverage", (-F.col("found.place")).alias("first"), "found")).alias("best")
    whole = found.groupBy("key1", "key2").agg(best, F.sum("found.items").cast("int").alias("items"))
    return stored(whole.select("key1", "key2", F.col("best.found").withField("items", F.col("items")).alias("__found")))


def tiled(docs: DataFrame, benchmark: DataFrame, keep: list[str] | None = None, least: int = MIN_WORDS, limit: float = COVERAGE) -> DataFrame:
    """Columns __in0, __in1, .. (those of docs that are named in keep, or all) and __found of each row: item (the one covered most), coverage, tiles ([start in text, start in item, length] in words), items (how many are
    covered to the limit), place; coverage is 0 if no item is covered to the limit."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter(F.col("text").isNotNull()).distinct()
    size = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    carried = [F.col(f"`{c}`").alias(f"__in{k}") for k, c in enumerate(docs.columns if keep is None else keep)]
    if size <= BROADCAST_BYTES:
        rows = items.orderBy(F.col("item_id").asc_nulls_last(), "text").collect()  # BROADCAST_BYTES at most
        shared = docs.sparkSession.sparkContext.broadcast(Items([(r[0], r[1]) for r in rows], least, limit))
        out = bounded_batches(docs).select(*carried, "text")
        return out.mapInArrow(_tiled(shared), T.StructType([*out.schema.fields[:-1], T.StructField("__found", T._parse_datatype_string(_VERDICT))]))
    found = _joined(bounded_batches(docs), items, least, limit)
    few = found.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    keyed = docs.select(*carried, *_keys(F.col("text")))
    out = keyed.join(F.broadcast(found) if few else found, ["key1", "key2"], "left")
    return out.select(*keyed.columns[:-2], F.coalesce("__found", F.lit(None).cast(_VERDICT)).alias("__found"))


def _limit(limit: float) -> Column:
    return F.coalesce(F.col("__found.coverage") >= limit, F.lit(False))


def decontaminated(docs: DataFrame, benchmark: DataFrame, least: int = MIN_WORDS, limit: float = COVERAGE) -> DataFrame:
    """The documents that cover no item to the limit."""
    kept = tiled(docs, benchmark, None, least, limit).filter(~_limit(limit))
    return kept.select(*[F.col(f"__in{k}").alias(c) for k, c in enumerate(docs.columns)])


def op7(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    out, bad = tiled(docs, benchmark, ["doc_id"]), _limit(COVERAGE)
    return out.select(
        F.col("__in0").alias("doc_id"), F.when(bad, F.col("__found.item")).alias("item_id"), F.coalesce("__found.coverage", F.lit(0.0)).alias("coverage"),
        F.when(bad, F.size("__found.tiles")).otherwise(0).alias("n_tiles"), F.coalesce("__found.items", F.lit(0)).alias("n_items"), bad.alias("contaminated"), (~bad).alias("kept"),
    )
