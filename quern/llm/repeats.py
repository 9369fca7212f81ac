"""Removal of repeated passages, exact to the byte, by suffix sorting.

A byte goes if a LENGTH-byte string that covers it also starts earlier: in a document of smaller doc_id, or before in the same document.

Suffixes that may be equal must meet in one shard. Every LENGTH-byte window is assigned the least hash among its GRAM-byte strings (its anchor; winnowing,
Schleimer et al. 2003), which equal windows share; neighbouring windows mostly share theirs too, so a text falls into blocks of windows with one anchor, of about
2 / (LENGTH - GRAM) a byte. First, blocks are dealt by anchor, as hashes: every block that is equal to an earlier one goes, and anchors whose
blocks differ are left (the edges of repeated passages). Of these, each distinct block's text is fetched once, and shards of them, without the stretches in which every window's hash is the
only one of its kind, are sorted by induced suffix sorting with common-prefix values (suffix_sort.py): runs of suffixes that share LENGTH bytes are equal windows, and all but the earliest go.
Last, the removed spans are merged by document.

The sort works in files: text, types, names, both inductions' queues and results of more than suffix_sort.MEMORY entries, which a shard of SHARD_BYTES has, so a shard may be far larger than memory; shards are kept
small for the sake of parallel tasks. The blocks of an anchor that has more than SHARD_BYTES of them are cut into parts, by the windows' distance to
the anchor: windows of nearby distances all hold the bytes they share (their core), so equal ones have equal cores, and parts are dealt by core. Parts of a core that still has too many
are cut into single windows, which meet only equal ones. Of equal parts that one task reads at once only the first is dealt.

Documents without repeats are never moved: their digests come from a scan. Anchors travel as packed arrays.

Equality of whole blocks is by two 64-bit hashes, of the anchor and of the block. Where rows repeat a doc_id, or have none, all rows are first numbered in
(doc_id, text) order, so of equal rows each after the first loses what repeats.

Defined cases: null text is empty; texts under LENGTH bytes lose nothing; a null doc_id comes before all others; an empty table gives no rows; columns other than doc_id and text are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import suffix_sort, textvec
from .common import bounded_batches, partition_keys, stored
from .packing import packed as _pack
from .packing import unpacked as _unpack

LENGTH = 100
GRAM = 32
DEALT_BYTES = 24 << 20
SHARD_BYTES = 2 << 20
BATCH_BYTES = 48 << 20
SPLIT_BYTES = 1 << 20
BROADCAST_IDS = 1_000_000
TRIM_WINDOWS = 1 << 22
_DEALT = "dest int, payload binary"
_FOUND = ["doc", "begin", "end", "kind", "anchor"]


def _window_least(v: np.ndarray, w: int) -> np.ndarray:
    """Least of each w values in a row, by doubling."""
    n, have = len(v) - w + 1, 1
    while 2 * have <= w:
        v = np.minimum(v[: len(v) - have], v[have:])
        have *= 2
    return np.minimum(v[:n], v[w - have : w - have + n])


def blocks(data: np.ndarray, bounds: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """(text, first window, end of the last, anchor hash, block hash) of all blocks of the texts data[bounds[i] : bounds[i + 1] - 1]."""
    empty = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    if len(data) < length:
        return empty
    prefix = textvec.prefix_hashes(data)
    h = textvec.run_hashes(prefix, gram)
    # Half the hash decides, then the place, the same way wherever a text stands.
    low = np.uint64(0xFFFFFFFF)
    key = h & ~low
    key |= np.arange(len(h), dtype=np.uint64)
    least = _window_least(key, length - gram + 1)
    least &= low
    start = np.arange(len(least))
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[: len(least)]
    inside = np.flatnonzero(start + length < bounds[text + 1])
    if not len(inside):
        return empty
    a, t = least[inside].astype(np.int64), text[inside]
    new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (t[1:] != t[:-1])]))
    begin, end = inside[new], inside[np.append(new[1:], len(inside)) - 1] + length
    return t[new], begin, end, h[a[new]], textvec.span_hashes(prefix, begin, end)


def _dealt(keys: list[int], length: int, gram: int):
    """Anchors' blocks, packed by the partition of their anchor; dest is its key."""
    parts = len(keys)

    def flush(held: list):
        doc, begin, size, anchor, block = (np.concatenate(x) for x in zip(*(h[1] for h in held), strict=True))
        ids = np.concatenate([h[0] for h in held])
        # Of equal blocks here only the first is dealt: a passage that a third of all documents share is a row a batch, not a row a document.
        order = np.lexsort((begin, ids[doc], block, anchor))
        again = np.concatenate([[False], (anchor[order][1:] == anchor[order][:-1]) & (block[order][1:] == block[order][:-1])])[: len(order)]
        known, order = order[again], order[~again]
        found = []
        if len(known):
            found.append((keys[int(ids[0]) % parts], _pack((ids[doc[known]], begin[known].astype(np.int32), (begin + size)[known].astype(np.int32)))))
        doc, begin, size, anchor, block = (x[order] for x in (doc, begin, size, anchor, block))
        # Anchors are least values, so they are mixed before they are dealt.
        dest = ((textvec.mix(anchor) >> np.uint64(33)) * np.uint64(parts) >> np.uint64(31)).astype(np.int64)
        order = np.argsort(dest.astype(np.uint16) if parts < 1 << 16 else dest, kind="stable")
        cut = np.searchsorted(dest[order], np.arange(parts + 1))
        for p in range(parts):
            mine = order[cut[p] : cut[p + 1]]
            if len(mine):
                own, back = np.unique(doc[mine], return_inverse=True)
                # The low half of the anchor's hash is enough: a chance meeting only adds a candidate.
                found.append((keys[p], _pack((ids[own], back.astype(np.min_scalar_type(len(own))), begin[mine].astype(np.min_scalar_type(int(begin[mine].max()))), size[mine].astype(np.uint16), anchor[mine].astype(np.uint32), block[mine]))))
        return pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int32()), pa.array([f[1] for f in found], pa.binary())], ["dest", "payload"])

    def run(batches):
        held, total, docs = [], 0, 0
        for batch in batches:
            pairs = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            for rows, data, bounds in textvec.buffers(pairs):
                t, begin, end, anchor, block = blocks(data, bounds, length, gram)
                held.append((np.array(rows, np.int64), (t + docs, begin - bounds[t], end - begin, anchor, block)))
                docs += len(rows)
                total += len(data)
                if total > BATCH_BYTES:
                    yield flush(held)
                    held, total, docs = [], 0, 0
        if held:
            yield flush(held)

    return run


def _compared(batches):
    """Per block that matters: kind 0, equal to an earlier one; kind 1, first of its kind under an anchor with others."""

    def one(payloads: list[bytes]):
        got = [_unpack(p) for p in payloads]
        for doc, begin, end in (g for g in got if len(g) == 3):
            none = np.zeros(len(doc), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(begin), pa.array(end), pa.array(none.astype(np.int32)), pa.array(none)], _FOUND)
        got = [g for g in got if len(g) > 3]
        if not got:
            return
        doc = np.concatenate([g[0][g[1]] for g in got])
        begin, size, anchor, block = (np.concatenate([g[k] for g in got]).astype(kind) for k, kind in ((2, np.int64), (3, np.int64), (4, np.uint64), (5, np.uint64)))
        order = np.lexsort((begin, doc, block, anchor))
        a, b = anchor[order], block[order]
        other = np.concatenate([[True], a[1:] != a[:-1]])
        first = other | np.concatenate([[True], b[1:] != b[:-1]])
        group = np.cumsum(other) - 1
        kinds = np.bincount(group, first)
        keep = ~first | (kinds[group] > 1)
        o = order[keep]
        yield pa.RecordBatch.from_arrays(
            [pa.array(doc[o]), pa.array(begin[o].astype(np.int32)), pa.array((begin + size)[o].astype(np.int32)), pa.array(first[keep].astype(np.int32)), pa.array(anchor[o].astype(np.int64))], _FOUND
        )

    now, held = None, []
    for batch in batches:
        for dest, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if dest != now and held:
                yield from one(held)
                held = []
            now = dest
            held.append(payload)
    if held:
        yield from one(held)


def _cut(batches):
    """The texts of the wanted blocks: (key, doc, begin, bytes) from rows (doc, text, wanted)."""
    for batch in batches:
        out = []
        for doc, text, wanted in zip(batch.column("doc").to_pylist(), batch.column("text").to_pylist(), batch.column("wanted").to_pylist(), strict=True):
            raw = (text or "").encode("utf-8", "surrogatepass")
            out += [(w["key"], doc, w["begin"], raw[w["begin"] : w["end"]]) for w in wanted]
        if out:
            s, d, b, r = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(s, pa.int64()), pa.array(d, pa.int64()), pa.array(b, pa.int32()), pa.array(r, pa.binary())], ["key", "doc", "begin", "raw"])


def _split(length: int, gram: int, step: int):
    """Parts of blocks, from rows (doc, begin, raw), each of windows whose distances to the anchor lie in one range of `step`. kind 0: equal to an earlier part, raw null; kind 1: the first of its kind here."""

    def flush(held: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        seen, out = set(), []
        at = np.arange(length - gram + 1)
        for doc, begin, raw in sorted(held):
            data = np.frombuffer(raw, np.uint8)
            # The anchor of the first window, and so of all: as in blocks().
            anchor = int((textvec.span_hashes(textvec.prefix_hashes(data[:length]), at, at + gram) >> np.uint64(32)).argmin())
            prefix, s, windows = textvec.prefix_hashes(data), 0, len(raw) - length + 1
            while s < windows:
                core = anchor - (anchor - s) // step * step
                e = min(windows, core + 1)
                part = raw[s : e - 1 + length]
                # Equal parts of one range: the distance counts as the same bytes may stand at another one.
                kind = (anchor - s, part)
                key = textvec.span_hashes(prefix, np.array([core]), np.array([core - step + 1 + length])) + np.uint64((anchor - s) // step)
                out.append((int(kind not in seen), int(textvec.mix(key).view(np.int64)[0]), doc, begin + s, begin + s + len(part), None if kind in seen else part))
                seen.add(kind)
                s = e
        k, key, d, b, e, r = zip(*out, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(key, pa.int64()), pa.array(d, pa.int64()), pa.array(b, pa.int32()), pa.array(e, pa.int32()), pa.array(r, pa.binary())], ["kind", "key", "doc", "begin", "end", "raw"])

    def run(batches):
        held, total = [], 0
        for batch in batches:
            for doc, begin, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append((doc, begin, raw))
                total += len(raw)
                if total > SPLIT_BYTES:
                    yield flush(held)
                    held, total = [], 0
        if held:
            yield flush(held)

    return run


def _inside(sizes: np.ndarray, length: int) -> np.ndarray:
    """Places of all windows inside texts of such sizes, which lie end to end with a byte after each."""
    count = np.maximum(sizes - length + 1, 0)
    return np.repeat(np.cumsum(sizes + 1) - sizes - 1 - np.cumsum(count) + count, count) + np.arange(count.sum())


class _Shard:
    """Texts laid end to end in a scratch file, as symbols: bytes plus 2, a 1 after each text, a 0 at the end."""

    def __init__(self, length: int | None = None):
        self.file, self.docs, self.begins, self.sizes = tempfile.TemporaryFile(prefix="quern-"), [], [], []
        self.held, self.size, self.stretches = [], 0, []
        self.length, self.windows, self.hashes = length, 0, []

    def add(self, doc: int, begin: int, raw: bytes) -> None:
        self.held.append(raw)
        self.size += len(raw)
        self.docs.append(doc)
        self.begins.append(begin)
        self.sizes.append(len(raw))
        if self.size > 1 << 18:
            self._write()

    def _write(self) -> None:
        if self.held:
            data, sizes = np.frombuffer(b"\0".join(self.held) + b"\0", np.uint8), np.array([len(r) for r in self.held], np.int64)
            if self.length:
                at = _inside(sizes, self.length)
                self.windows += len(at)
                self.hashes = [*self.hashes, textvec.run_hashes(textvec.prefix_hashes(data), self.length)[at]] if self.windows <= TRIM_WINDOWS else []
            x = data.astype(np.int16)
            x += 2
            x[np.cumsum(sizes + 1) - 1] = 1
            x.tofile(self.file)
            self.stretches.append(len(self.held))
        self.held, self.size = [], 0

    def trimmed(self) -> _Shard:
        """The same texts, cut down to the stretches that hold windows of which another may be equal: windows of a hash of their own are equal to none. Shards of more than TRIM_WINDOWS stay as they are."""
        self._write()
        if self.windows > TRIM_WINDOWS or not self.windows:
            return self
        h = np.concatenate(self.hashes)
        order = np.argsort(h)
        h = h[order]
        same = np.flatnonzero(h[1:] == h[:-1])
        twice = np.zeros(len(h), bool)
        twice[order[same]] = twice[order[same + 1]] = True
        del h, order
        self.file.seek(0)
        out, text, window = _Shard(), 0, 0
        for n in self.stretches:
            sizes = np.array(self.sizes[text : text + n], np.int64)
            raw = (np.fromfile(self.file, np.int16, int(sizes.sum()) + n) - 2).astype(np.uint8).tobytes()
            at, ends = _inside(sizes, self.length), np.cumsum(sizes + 1)
            at, window = at[twice[window : window + len(at)]], window + len(at)
            if len(at):
                which = np.searchsorted(ends, at, "right")
                # Windows that overlap stay in one piece.
                new = np.flatnonzero(np.concatenate([[True], (at[1:] >= at[:-1] + self.length) | (which[1:] != which[:-1])]))
                which, begin, end = which[new], at[new], at[np.append(new[1:], len(at)) - 1] + self.length
                shift = begin - (ends - sizes - 1)[which]
                for i, k, b, e in zip((which + text).tolist(), shift.tolist(), begin.tolist(), end.tolist(), strict=True):
                    out.add(self.docs[i], self.begins[i] + k, raw[b:e])
            text += n
        return out

    def text(self) -> np.ndarray:
        self._write()
        np.zeros(1, np.int16).tofile(self.file)
        self.file.flush()
        return np.asarray(np.memmap(self.file, np.int16, "r"))


def later_windows(t: np.ndarray, bounds: np.ndarray, length: int, memory: int = suffix_sort.MEMORY) -> np.ndarray:
    """Marks the places in the texts t[bounds[i] : bounds[i + 1] - 1] whose window also starts in an earlier place."""
    sa, lcp = suffix_sort.suffix_array(t, memory)
    n = len(t)
    marks = suffix_sort.array(n, memory, bool)
    step = min(memory, 1 << 19)
    for i in range(0, n, step):
        marks[i : i + step] = False
    # A run of neighbours that share `length` symbols is one window's occurrences: all are marked but the least. Windows that leave their text hold a 1 and are left out.
    open_, least = False, -1
    for i in range(0, n, step):
        at, joins = np.asarray(sa[i : i + step], np.int64), lcp[i : i + step] >= length
        run = np.cumsum(~joins)  # 0 goes on from the stretch before
        inner = np.append(joins[1:], i + step < n and lcp[i + step] >= length)
        member = (joins | inner) & (bounds[np.minimum(np.searchsorted(bounds, at, "right"), len(bounds) - 1)] - 1 - at >= length)
        marks[at[member]] = True
        if joins[0] and open_:
            least = min(least, int(at[run == 0].min()))
        if run[-1] > 0 or not joins[0]:
            if open_:
                marks[least] = False
            begin = np.flatnonzero(~joins)
            low = np.minimum.reduceat(at, begin)
            marks[low[:-1]] = False
            open_, least = bool(inner[-1]), int(low[-1])
            if not open_:
                marks[least] = False
        elif not inner[-1]:
            marks[least] = False
            open_ = False
    return marks


def _sorted_out(length: int, memory: int = suffix_sort.MEMORY):
    """Spans (doc, begin, end) of windows that also start earlier among the rows (key, doc, begin, raw) of a partition, which is a shard, in (doc, begin) order; texts go to a file as they come."""

    def one(shard: _Shard):
        bounds = np.append(0, np.cumsum(np.array(shard.sizes, np.int64) + 1))
        marks = later_windows(shard.text(), bounds, length, memory)
        docs, begins = np.array(shard.docs, np.int64), np.array(shard.begins, np.int64)
        step = min(memory, 1 << 19)
        for i in range(0, len(marks), step):
            # Runs of windows one after another inside one text; a run that two stretches share is two spans, which are merged with all others.
            at = np.flatnonzero(marks[i : i + step]) + i
            if not len(at):
                continue
            text = np.searchsorted(bounds, at, "right") - 1
            new = np.concatenate([[True], (at[1:] != at[:-1] + 1) | (text[1:] != text[:-1])])
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(at)) - 1
            which = text[first]
            shift = begins[which] - bounds[which]
            yield pa.RecordBatch.from_arrays([pa.array(docs[which]), pa.array((at[first] + shift).astype(np.int32)), pa.array((at[last] + shift + length).astype(np.int32))], ["doc", "begin", "end"])

    def run(batches):
        shard = None
        for batch in batches:
            for _, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                shard = shard or _Shard(length)
                shard.add(*row)
        if shard:
            shard = shard.trimmed()
            if shard.docs:
                yield from one(shard)

    return run


def _removed(batches):
    """n_bytes, n_removed, n_spans, kept_sha256 and the spans from rows (doc, text, spans); null spans are none."""
    for batch in batches:
        out = []
        for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            raw = (text or "").encode("utf-8", "surrogatepass")
            merged: list[list[int]] = []
            for s in sorted((x["begin"], x["end"]) for x in spans or ()):
                if merged and s[0] <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], s[1])
                else:
                    merged.append(list(s))
            digest, at = hashlib.sha256(), 0
            for s, e in merged:
                digest.update(raw[at:s])
                at = e
            digest.update(raw[at:])
            out.append((len(raw), sum(e - s for s, e in merged), len(merged), digest.hexdigest(), merged))
        if out:
            n, r, k, d, m = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), pa.array(n, pa.int64()), pa.array(r, pa.int64()), pa.array(k, pa.int64()), pa.array(d), pa.array(m, pa.list_(pa.list_(pa.int32())))],
                ["doc", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"],
            )


def removals(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc, begin, end (bytes): spans that repeat, not merged; doc_ids must be unique and not null."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc"), "text")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(4, -(-size // DEALT_BYTES))
    long_ = rows.filter(F.octet_length("text") >= length)
    found = long_.mapInArrow(_dealt(partition_keys(docs.sparkSession, parts), length, gram), _DEALT).repartition(parts, "dest").sortWithinPartitions("dest").mapInArrow(_compared, "doc long, begin int, end int, kind int, anchor long")
    found = stored(found)
    edges = found.filter("kind = 1")
    sizes = edges.groupBy("anchor").agg(F.sum(F.col("end") - F.col("begin")).alias("bytes"))
    hot = stored(sizes.filter(F.col("bytes") > SHARD_BYTES).select("anchor"))  # at most one a SHARD_BYTES
    spans = found.filter("kind = 0").select("doc", "begin", "end")
    shards = _shards(edges, F.col("end") - F.col("begin"))
    if not shards:
        return spans

    def cut(edges: DataFrame) -> DataFrame:
        wanted = stored(edges.groupBy("doc").agg(F.collect_list(F.struct(F.col("anchor").alias("key"), "begin", "end")).alias("wanted")))  # at most one text's blocks in a row
        return _among(wanted, long_, "left_semi").join(wanted, "doc").select("doc", "text", "wanted").mapInArrow(_cut, "key long, doc long, begin int, raw binary")

    def sorted_out(rows: DataFrame, shards: int) -> DataFrame:
        return rows.repartition(shards, "key").sortWithinPartitions("doc", "begin").mapInArrow(_sorted_out(length), "doc long, begin int, end int")

    if not hot.head(1):
        return spans.union(sorted_out(cut(edges), shards))
    hot, cold = hot.withColumnRenamed("anchor", "key"), stored(cut(edges))  # texts are read once for both
    rows = cold.join(F.broadcast(hot), "key", "left_semi").select("doc", "begin", "raw")
    spans = spans.union(sorted_out(cold.join(F.broadcast(hot), "key", "left_anti"), shards))
    for step in ((length - gram) // 8 + 1, 1):
        parts = stored(rows.mapInArrow(_split(length, gram, step), "kind int, key long, doc long, begin int, end int, raw binary"))
        spans = spans.union(parts.filter("kind = 0").select("doc", "begin", "end"))
        parts = parts.filter("kind = 1")
        if step > 1:
            heavy = stored(parts.groupBy("key").agg(F.sum(F.octet_length("raw")).alias("bytes")).filter(F.col("bytes") > SHARD_BYTES).select("key"))
            rows = parts.join(F.broadcast(heavy), "key", "left_semi").select("doc", "begin", "raw")
            parts = parts.join(F.broadcast(heavy), "key", "left_anti")
        shards = _shards(parts, F.octet_length("raw"))
        if shards:
            spans = spans.union(sorted_out(parts.select("key", "doc", "begin", "raw"), shards))
    return spans


def _among(found: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """The rows whose doc is one of found's (how: left_semi) or is not (left_anti). Of more than BROADCAST_IDS a table of bits, by hash, is sent instead of the ids: then some others count as found's too, the same ones for both."""
    ids, n = found.select("doc"), found.count()
    if n <= BROADCAST_IDS:
        return rows.join(F.broadcast(ids), "doc", how)
    h = F.xxhash64("doc")
    word, bit = F.pmod(h, F.lit(max(1, min(BROADCAST_IDS, n // 8)))), F.shiftrightunsigned(h, 58).cast("int")
    bits = ids.select(word.alias("__word"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("__bit")).groupBy("__word").agg(F.bit_or("__bit").alias("__bits"))
    return rows.join(F.broadcast(bits), (word == F.col("__word")) & (F.call_function("shiftright", F.col("__bits"), bit).bitwiseAND(F.lit(1).cast("long")) == 1), how)


def _shards(rows: DataFrame, size: Column) -> int:
    """How many shards rows of such sizes fill; 0 if there are none."""
    total = rows.agg(F.sum(size)).first()[0]
    return max(4, -(-total // SHARD_BYTES)) if total else 0


def deduplicated(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans of every row."""
    rows = bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    uneven = rows.groupBy("doc_id").count().filter("doc_id is null or count > 1").limit(1).count()
    if uneven:
        return _with_repeats(rows, length, gram)
    spans = stored(removals(rows, length, gram).groupBy("doc").agg(F.collect_list(F.struct("begin", "end")).alias("spans")))  # one text's spans in a row
    return _applied(rows, spans)


def _applied(rows: DataFrame, spans: DataFrame) -> DataFrame:
    rows = rows.withColumnRenamed("doc_id", "doc")
    hit = _among(spans, rows, "left_semi").join(spans, "doc", "left").select("doc", "text", "spans")
    hit = hit.mapInArrow(_removed, "doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<array<int>>").withColumnRenamed("doc", "doc_id")
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rest = _among(spans, rows, "left_anti").select(
        F.col("doc").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2(text, 256).alias("kept_sha256"), F.array().cast("array<array<int>>").alias("spans")
    )
    return hit.unionByName(rest)


def _with_repeats(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """Rows are numbered in (doc_id, text) order, nulls first, by a range-partitioned sort; the numbers stand in for doc_ids."""
    dealt = stored(rows.repartitionByRange("doc_id", "text").sortWithinPartitions("doc_id", "text").withColumn("__n", F.monotonically_increasing_id()))
    out = deduplicated(dealt.select(F.col("__n").alias("doc_id"), "text"), length, gram)
    return out.withColumnRenamed("doc_id", "__n").join(dealt.select("__n", "doc_id"), "__n").drop("__n")


def op4(docs: DataFrame) -> DataFrame:
    return deduplicated(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
