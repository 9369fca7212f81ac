"""Language-model scores by Katz backoff over word trigrams.

    P(w | a, b) = D3(c(a,b,w)) / c(a,b)       if (a, b, w) was seen in training
                = backoff(a,b) P(w | b)       otherwise (P(w | b) itself where (a, b) was never seen)
    P(w | b)    = D2(c(b,w)) / c(b)           if (b, w) was seen
                = backoff(b) P(w)             otherwise (P(w) itself where b was never seen)
    P(w)        = D1(c(w)) / N                for a training word; the mass left over is the probability of an unknown word

D is the Good-Turing discounted count, by counts up to K, fitted at each order from the counts of counts; larger counts lose HELD of one count, so every context
keeps some mass. backoff(a,b) = (1 - sum of seen P(. | a,b)) / (1 - sum of P(. | b) over the same words), and likewise for backoff(b), so each distribution, unknown word
included, sums to one.

Tables, all written to the shared folder:

  streams   the documents' tokens in batches of BATCH_TOKENS, coded by each batch's own words
  counts    trigram counts, partitioned by their middle word b. A partition holds all that a word in the middle decides: c(a,b,w), c(b,w), c(a,b) and c(b), which is also the
            word's own count, as each token but the end is once in the middle
  backoff   of a row a word: c(b) and backoff(b), from the mass left at b and the probabilities of the words seen after it, summed by key
  answers   per batch and partition: the counts and weights that the batch's trigrams asked for

Each distinct trigram of a batch is one question, dealt to its partition; the partition first counts all questions (by their training occurrences), then answers them from
its table: the trigram's count and its context's, or, where it was not seen, backoff(a,b), c(b,w) and c(b). Batches meet their answers and evaluate the
recursion for every token. Questions travel as at most one message a batch and GROUP partitions, in rows of PIECE bytes, answers as one row a batch and partition; the former in COUNT_ROUNDS, the latter in ROUNDS.

A word with more tokens than a partition should hold is split by the word before it, a pair with as many by the word after it too. What such a word's parts know in
common only (c(b), c(b,w), and for such pairs their context's sums) is added up by key and joined back. Words and pairs are found by counting, in whole batches.

crc32 of the doc_id's text modulo 5 marks the held-out documents, which are not counted.

Defined cases: null text is empty (one end token); a null doc_id counts as the empty string in the fold rule; repeated rows count each; an
empty table gives no rows; with no training document, all words are unknown; columns other than doc_id and text are not read, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textvec
from .common import bounded_batches, partition_keys, stored
from .packing import packed, spread, squeezed, unpacked

K = 5
HELD = 0.1
END, BOS = np.uint64(1), np.uint64(2)
BATCH_TOKENS = 2_200_000
#: Batches are evaluated in so many rounds, one after another, so that a round's shuffle takes little room.
ROUNDS = 4
#: Groups of partitions are counted in so many rounds, for the same reason; each round reads the streams anew.
COUNT_ROUNDS = 2
#: Weights of answers travel as whole numbers of this unit (7e-12).
UNIT = 2.0**-37
#: Bytes of text whose tokens a partition of the tables should hold.
PART_BYTES = 4 << 20
#: A frequent word's own partition may hold the tokens of so many others before it is split.
UNIT_PARTS = 4
#: Freed bytes that are kept while a batch is dealt.
DEALING_BYTES = 32 << 20
#: Rows that are worked on at a time where arrays as long as a batch would else be made on the way.
STEP = 1 << 18
#: Bytes of a message that travel in one row: twice as many are under half a region of the JVM's heap, which larger arrays would fill with whole regions.
PIECE = 192 << 10
#: Bytes of the stored tables' row groups.
ROW_GROUP = 4 << 20
#: Partitions that one task counts, one after another; questions are dealt to such groups, as they share words.
GROUP = 12


def is_training(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 5 != 1


# Batches of tokens


@dataclass
class Batch:
    """Documents and their tokens, as places in the ascending hashes `words`; the first two words are END and BOS."""

    ids: np.ndarray
    nulls: np.ndarray
    size: np.ndarray
    train: np.ndarray
    words: np.ndarray
    code: np.ndarray

    @classmethod
    def of(cls, ids: list, hashes: np.ndarray, size: np.ndarray) -> Batch:
        words, code = _unique(hashes)
        return cls(
            np.array([0 if i is None else i for i in ids], np.int64), np.array([i is None for i in ids]), size, np.array([is_training(i) for i in ids]),
            np.insert(words, 1, BOS), (code + (code > 0)).astype(np.int32),
        )

    def pack(self) -> bytes:
        words, code = _coded(self.words, self.code)
        return packed((self.ids, np.packbits(self.nulls), squeezed(self.size), np.packbits(self.train), words, squeezed(code[self.code])))

    @classmethod
    def unpack(cls, payload: bytes) -> Batch:
        ids, nulls, size, train, words, code = unpacked(payload)
        words, place = _placed(words)
        return cls(ids, np.unpackbits(nulls, count=len(ids)).astype(bool), spread(size), np.unpackbits(train, count=len(ids)).astype(bool), words, place[spread(code)])

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.size), dtype=np.int32), self.size)

    def context(self) -> tuple[np.ndarray, np.ndarray]:
        """(word before the one before, word before) of every token."""
        start = np.cumsum(self.size) - self.size
        out = []
        last = self.code
        for _ in range(2):
            now = np.empty_like(last)
            now[1:] = last[:-1]
            now[start] = 1
            out.append(now)
            last = now
        return out[1], out[0]

    def questions(self, deal: Deal) -> tuple[Trigrams, np.ndarray, np.ndarray]:
        """(distinct trigrams, their partitions, each token's trigram)"""
        a, b = self.context()
        t, back = Trigrams.distinct(self.words, a, b, self.code)
        return t, deal.parts_of(t), back


#: So many of the most used words are coded by rank, the rest by place.
TOP_WORDS = 4096


def _coded(words: np.ndarray, *used: np.ndarray) -> tuple[tuple, np.ndarray]:
    """(the words packed: the most used ones, and differences of the rest; the code of each): codes of running text are small numbers mostly."""
    n = sum(np.bincount(x, minlength=len(words)) for x in used)
    top = np.argsort(-n, kind="stable")[:TOP_WORDS]
    rest = np.ones(len(words), bool)
    rest[top] = False
    code = np.empty(len(words), np.int32)
    code[top] = np.arange(len(top))
    code[rest] = np.arange(len(top), len(words))
    rest = words[rest]
    return (words[top], squeezed(rest - np.append(np.zeros(1, np.uint64), rest[:-1])[: len(rest)])), code


def _placed(packed_words: tuple) -> tuple[np.ndarray, np.ndarray]:
    """(words ascending, the place of each code)"""
    top, rest = packed_words
    rest = np.cumsum(spread(rest).view(np.uint64), dtype=np.uint64)
    # The rest ascend: the most used ones are merged into them.
    order = np.argsort(top)
    at = np.searchsorted(rest, top[order]) + np.arange(len(top))
    is_rest = np.ones(len(top) + len(rest), bool)
    is_rest[at] = False
    words, place = np.empty(len(is_rest), np.uint64), np.empty(len(is_rest), np.int32)
    words[at], words[is_rest] = top[order], rest
    place[order], place[len(top) :] = at, np.flatnonzero(is_rest)
    return words, place


def _joined(high: np.ndarray, low: np.ndarray, bits: int) -> np.ndarray:
    out = high.astype(np.int64)
    out <<= bits
    out |= low
    return out


def _parted(key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(low, high) of what _joined() took, with no more than 31 low bits; high in key's own place."""
    low = key.astype(np.int32)
    low &= (1 << bits) - 1
    key >>= bits
    return low, key


def _unique(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the distinct values, ascending; which of them each is, as int32) of whole numbers from 0 on. Each value is sorted with its place in one word of 64 bits, several times faster than places
    by values; what does not fit are the value's lowest bits, and where values differ in these only, places are sorted by values."""
    if not len(key):
        return key, np.zeros(0, np.int32)
    size, kind = len(key), key.dtype
    bits = np.uint64(max(1, (size - 1).bit_length()))
    lost = np.uint64(max(0, int(key.max()).bit_length() + int(bits) - 64))
    order = key.view(np.uint64) >> lost
    if not lost:
        del key
    order <<= bits
    for i in range(0, size, STEP):
        order[i : i + STEP] |= np.arange(i, min(i + STEP, size), dtype=np.uint64)
    order.sort()
    new = np.ones(size, bool)
    for i in range(1, size, STEP):
        new[i : i + STEP] = (order[i : i + STEP] ^ order[i - 1 : min(i - 1 + STEP, size - 1)]) >> bits != 0
    value = None if lost else order[new] >> bits
    order &= (np.uint64(1) << bits) - np.uint64(1)
    order = order.view(np.int64)
    if lost:
        value = key[order]
        if not np.array_equal(new[1:], value[1:] != value[:-1]):
            order = np.argsort(key)
            value = key[order]
            np.not_equal(value[1:], value[:-1], out=new[1:])
        value = value[new]
    rank = np.cumsum(new, dtype=np.int32)
    rank -= 1
    back = np.empty(size, np.int32)
    back[order] = rank
    return value.view(kind), back


def _order(x: np.ndarray, upto: int) -> np.ndarray:
    """Places in ascending order of values below `upto`, equal ones as they come."""
    return np.argsort(x.astype(np.uint16) if upto <= 1 << 16 else x, kind="stable")


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where a run of rows that are equal in all columns begins."""
    if not len(columns[0]):
        return np.zeros(0, np.int64)
    new = np.zeros(len(columns[0]), bool)
    new[0] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _summed(x: np.ndarray, start: np.ndarray) -> np.ndarray:
    return np.add.reduceat(x, start) if len(start) else np.zeros(0, x.dtype)


@dataclass
class Trigrams:
    """Distinct trigrams (a, b, w), as places in `words`, in the order of (b, w, a)."""

    words: np.ndarray
    a: np.ndarray
    b: np.ndarray
    w: np.ndarray

    @classmethod
    def distinct(cls, words: np.ndarray, a: np.ndarray, b: np.ndarray, w: np.ndarray) -> tuple[Trigrams, np.ndarray]:
        """(the distinct ones, which of them each row is)"""
        bits = max(1, (len(words) - 1).bit_length())
        pair, at = _unique(_joined(b, w, bits))
        key, back = _unique(_joined(at, a, bits))
        del at
        a, key = _parted(key, bits)
        w, pair = _parted(pair[key], bits)
        return cls(words, a, pair.astype(np.int32), w), back

    def __len__(self) -> int:
        return len(self.a)

    def take(self, rows: np.ndarray) -> Trigrams:
        return Trigrams(self.words, self.a[rows], self.b[rows], self.w[rows])

    def pack(self, times: np.ndarray) -> bytes:
        some = np.zeros(len(self.words), bool)
        for x in (self.a, self.b, self.w):
            some[x] = True
        place = np.cumsum(some, dtype=np.int32) - 1
        a, b, w = place[self.a], place[self.b], place[self.w]
        words, code = _coded(self.words[some], a, w)
        new = np.zeros(len(a), bool)
        new[_starts(b, w)] = True
        return packed((words, squeezed(np.diff(b, prepend=0)), squeezed(np.where(new, code[w] + 1, 0)), squeezed(code[a]), squeezed(times)))

    @classmethod
    def unpack(cls, payload: bytes) -> tuple[Trigrams, np.ndarray]:
        words, b, w, a, times = unpacked(payload)
        words, place = _placed(words)
        w = spread(w)
        new = np.flatnonzero(w)
        w = np.repeat(w[new] - 1, np.diff(np.append(new, len(w))))
        return cls(words, place[spread(a)], np.cumsum(spread(b)).astype(np.int32), place[w]), spread(times)


@dataclass
class Deal:
    """Which partition a trigram goes to. A frequent word has partitions of its own, numbered from `parts` on: `units` of them, by the word before, and for frequent pairs by the word after it too."""

    parts: int
    hot: np.ndarray  # ascending
    first: np.ndarray
    units: np.ndarray
    pairs: np.ndarray  # hashes, ascending

    @classmethod
    def of(cls, parts: int, words: list[tuple[int, float]], pairs: list[tuple[int, int]]) -> Deal:
        """words: (hash, how many partitions its tokens would fill); pairs: (word, word after)."""
        words = sorted((np.uint64(h & (1 << 64) - 1), load) for h, load in words)
        units = np.array([max(1, int(np.ceil(load / UNIT_PARTS))) for _, load in words], np.int64)
        a, b = (np.array([x[k] & (1 << 64) - 1 for x in pairs], np.uint64) for k in (0, 1))
        return cls(parts, np.array([h for h, _ in words], np.uint64), parts + np.cumsum(units) - units, units, np.sort(_pair(a, b)))

    @property
    def all(self) -> int:
        return self.parts + int(self.units.sum())

    @property
    def groups(self) -> int:
        return -(-self.all // GROUP)

    def split(self, part: int) -> np.uint64 | None:
        """The word of which this partition holds a part only."""
        k = int(np.searchsorted(self.first, part, "right")) - 1 if part >= self.parts else -1
        return self.hot[k] if k >= 0 and self.units[k] > 1 else None

    @property
    def split_words(self) -> np.ndarray:
        return self.hot[self.units > 1]

    def parts_of(self, t: Trigrams) -> np.ndarray:
        home = ((textvec.mix(t.words) >> np.uint64(33)) * np.uint64(self.parts) >> np.uint64(31)).astype(np.int32)
        out = home[t.b]
        if len(self.hot):
            which = np.full(len(t.words), -1)
            which[np.isin(t.words, self.hot)] = np.searchsorted(self.hot, t.words[np.isin(t.words, self.hot)])
            for i in range(0, len(t), STEP):
                rows = i + np.flatnonzero(which[t.b[i : i + STEP]] >= 0)
                k, a = which[t.b[rows]], t.words[t.a[rows]]
                by = textvec.mix(a + np.uint64(9))
                more = np.isin(_pair(a, t.words[t.b[rows]]), self.pairs)
                by = np.where(more, textvec.mix(by + t.words[t.w[rows]]), by)
                out[rows] = self.first[k] + ((by >> np.uint64(11)) % self.units[k].astype(np.uint64)).astype(np.int64)
        return out


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return textvec.mix(a * textvec._BASE + b)


def _signed(h) -> np.ndarray:
    return np.ascontiguousarray(h, np.uint64).view(np.int64)


_HOT = pa.list_(pa.struct([("a", pa.int64()), ("h", pa.int64()), ("n", pa.int64())]))
_STREAM = "batch long, tokens long, payload binary, hot array<struct<a:long,h:long,n:long>>"


def _structs(kind: pa.DataType, *columns: np.ndarray) -> pa.Array:
    """One list of structs, for one row."""
    fields = [kind.value_type.field(k) for k in range(kind.value_type.num_fields)]
    rows = pa.StructArray.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], fields=fields)
    return pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows)


def _streamed(share: float):
    """Rows of the streams; hot: words that are this share of a batch's tokens, with a null, and such pairs (a, h)."""

    def flush(number: int, ids: list, tokens: list, sizes: list) -> pa.RecordBatch:
        hashes = np.concatenate(tokens)
        tokens.clear()
        b = Batch.of(ids, hashes, np.concatenate(sizes))
        del hashes
        least = max(share * len(b.code), 2)
        before2, before = b.context()
        n = np.bincount(before, minlength=len(b.words))
        hot = np.flatnonzero(n >= least)
        mine = (n >= least)[before]
        pair, count = np.unique(before2[mine].astype(np.int64) << 32 | before[mine], return_counts=True)
        pair, count = pair[count >= least], count[count >= least]
        first = pa.concat_arrays([pa.nulls(len(hot), pa.int64()), pa.array(_signed(b.words[pair >> 32]))])
        second = _signed(np.concatenate([b.words[hot], b.words[pair & 0xFFFFFFFF]]))
        return pa.RecordBatch.from_arrays(
            [pa.array([number]), pa.array([len(b.code)]), pa.array([b.pack()], pa.binary()), _structs(_HOT, first, second, np.concatenate([n[hot], count]))], ["batch", "tokens", "payload", "hot"]
        )

    def run(batches):
        number = TaskContext.get().partitionId() << 20
        ids, tokens, sizes, total = [], [], [], 0
        for batch in batches:
            for w in textvec.words(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                hashes = np.where(w.hashes <= BOS, w.hashes + np.uint64(3), w.hashes)
                hashes = np.insert(hashes, w.first[1:], END)
                if ids and total + len(hashes) > BATCH_TOKENS:
                    yield flush(number, ids, tokens, sizes)
                    textvec.release()
                    number += 1
                    ids, tokens, sizes, total = [], [], [], 0
                ids += w.rows
                tokens.append(hashes)
                sizes.append(np.diff(w.first) + 1)
                total += len(hashes)
        if ids:
            yield flush(number, ids, tokens, sizes)

    return run


_MESSAGES = "dest int, batch long, piece int, payload binary"


def _dealt(deal: Deal, keys: dict[int, int]):
    """Each batch's questions to the groups of partitions that have a key, by group, in pieces."""

    def run(batches):
        for batch in batches:
            for number, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with textvec.held(DEALING_BYTES):
                    b = Batch.unpack(payload)
                    t, part, back = b.questions(deal)
                    times, doc = np.zeros(len(t), np.int32), b.doc
                    for i in range(0, len(back), STEP):
                        np.add.at(times, back[i : i + STEP], b.train[doc[i : i + STEP]].astype(np.int32))
                    del b, back, doc
                    group = part // GROUP
                    del part
                    wanted = np.zeros(deal.groups, bool)
                    wanted[list(keys)] = True
                    order = np.flatnonzero(wanted[group])
                    order = order[_order(group[order], deal.groups)]
                    cut = np.searchsorted(group[order], np.arange(deal.groups + 1))
                    some = np.flatnonzero(np.diff(cut))
                    for g in some:
                        mine = order[cut[g] : cut[g + 1]]
                        message = t.take(mine).pack(times[mine])
                        for i in range(0, len(message), 8 * PIECE):
                            found = [message[j : j + PIECE] for j in range(i, min(i + 8 * PIECE, len(message)), PIECE)]
                            n = len(found)
                            piece = np.arange(i // PIECE, i // PIECE + n)
                            yield pa.RecordBatch.from_arrays([pa.array([keys[g]] * n, pa.int32()), pa.array([number] * n, pa.int64()), pa.array(piece, pa.int32()), pa.array(found, pa.binary())], ["dest", "batch", "piece", "payload"])

    return run


def _groups(batches) -> Iterator[tuple]:
    """(key, rows) of the runs of rows with one first column, from rows in its order; the rest of each row as a tuple."""
    now, held = None, []
    for batch in batches:
        for key, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and key != now:
                yield now, held
                held = []
            now = key
            held.append(tuple(rest))
    if held:
        yield now, held


def _messages(batches) -> Iterator[tuple[int, int, bytes]]:
    """(dest, batch, payload) from rows (dest, batch, piece, payload) in this order."""
    now, held = None, []
    for batch in batches:
        for dest, number, _, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and (dest, number) != now:
                yield *now, b"".join(held)
                held = []
            now = dest, number
            held.append(payload)
    if held:
        yield *now, b"".join(held)


# Counts and constants


def discounts(n: np.ndarray) -> np.ndarray:
    """d_1 .. d_K from n[r], the number of events seen r times (Katz 1987), kept inside (0, 1)."""
    r = np.arange(1, K + 1)
    plain = (r - 0.5) / r
    if not n[1] or (K + 1) * n[K + 1] >= n[1]:
        return plain
    a = (K + 1) * n[K + 1] / n[1]
    with np.errstate(divide="ignore", invalid="ignore"):
        d = ((r + 1) * n[r + 1] / (r * n[r]) - a) / (1 - a)
    return np.clip(np.where(np.isfinite(d), d, plain), 0.05, 0.99)


@dataclass
class Constants:
    n: int  # training tokens
    v: int  # different ones
    docs: int
    d: list[np.ndarray]  # discounts of orders 1 to 3
    unknown: float
    split: dict[int, int]  # c(b) of the words that are split

    def star(self, order: int, c: np.ndarray) -> np.ndarray:
        """Discounted counts of order n; 0 for 0."""
        c = np.asarray(c)
        small = np.append(0.0, self.d[order - 1] * np.arange(1, K + 1))
        return np.where(c > K, c - HELD, small[np.minimum(c, K)])

    def star_column(self, order: int, c: Column) -> Column:
        out = c - HELD
        for r in range(K, 0, -1):
            out = F.when(c == r, F.lit(float(self.d[order - 1][r - 1] * r))).otherwise(out)
        return out

    def p(self, c: np.ndarray) -> np.ndarray:
        """P(w) by c(w)."""
        return np.where(np.asarray(c) > 0, self.star(1, c) / max(self.n, 1), self.unknown)


def _tally(c: np.ndarray) -> np.ndarray:
    """Numbers of events seen 0, 1, .. K + 1 times, and more often."""
    return np.bincount(np.minimum(c, K + 2).astype(np.int64), minlength=K + 3)


_COUNTED = "part int, counts binary, asks binary, stats array<long>, pairs array<struct<h:long,w:long,n:long>>, hot array<struct<a:long,h:long,w:long,n:long>>"
_PAIRS = pa.list_(pa.struct([("h", pa.int64()), ("w", pa.int64()), ("n", pa.int64())]))
_TRIPLES = pa.list_(pa.struct([("a", pa.int64()), ("h", pa.int64()), ("w", pa.int64()), ("n", pa.int64())]))


def _counted(deal: Deal, keys: dict[int, int]):
    """Each partition's table with the batches' questions as places in it, from rows (dest, batch, piece, payload). pairs, hot: of split words, what their partitions know in part."""

    def one(part: int, words: np.ndarray, messages: list[tuple]) -> pa.RecordBatch | None:
        numbers, got = [], []
        for batch, abw, n, cut in messages:
            mine = slice(cut[part % GROUP], cut[part % GROUP + 1])
            if mine.start < mine.stop:
                numbers.append(batch)
                got.append((*(x[mine] for x in abw), n[mine]))
        if not got:
            return None
        *abw, times = (np.concatenate(x) for x in zip(*got, strict=True))
        cut = np.cumsum([len(x[3]) for x in got])[:-1]
        del got
        t, back = Trigrams.distinct(words, *abw)
        del abw
        c3 = np.bincount(back, times, len(t)).astype(np.int64)
        asks = packed([(batch, squeezed(np.diff(x, prepend=0))) for batch, x in zip(numbers, np.split(back, cut), strict=True)])
        del back

        pair, word = _starts(t.b, t.w), _starts(t.b)
        c2, c1 = _summed(c3, pair), _summed(c3, word)
        real = words[t.b[word]] != BOS
        ends = int(c3[words[t.w] == END].sum())
        none = np.zeros(0, np.int64)
        known, triples = (none,) * 3, (none,) * 4
        if deal.split(part) is None:
            n1, n2 = _tally(c1[real]), _tally(c2)
            own = [int(c1[real].sum()), int((c1[real] > 0).sum()), int((c1[real] > K).sum())]
        else:
            n1, n2, own = np.zeros(K + 3, np.int64), np.zeros(K + 3, np.int64), [0, 0, 0]
            # Also pairs that are only asked for: other partitions may have seen them.
            known = _signed(words[t.b[pair]]), _signed(words[t.w[pair]]), c2
            some = np.flatnonzero((c3 > 0) & np.isin(_pair(words[t.a], words[t.b]), deal.pairs))
            triples = _signed(words[t.a[some]]), _signed(words[t.b[some]]), _signed(words[t.w[some]]), c3[some]
        stats = [*n1.tolist(), *n2.tolist(), *_tally(c3).tolist(), *own, ends]
        return pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int32()), pa.array([t.pack(c3)], pa.binary()), pa.array([asks], pa.binary()), pa.array([stats], pa.list_(pa.int64())), _structs(_PAIRS, *known), _structs(_TRIPLES, *triples)],
            ["part", "counts", "asks", "stats", "pairs", "hot"],
        )

    def run(batches):
        groups = {key: group for group, key in keys.items()}
        for key, rows in groupby(_messages(batches), itemgetter(0)):
            group, messages, hashes = groups[key], [], []
            for _, batch, payload in rows:
                t, n = Trigrams.unpack(payload)
                place = (deal.parts_of(t) - group * GROUP).astype(np.uint8)
                order = np.argsort(place, kind="stable")
                cut = np.searchsorted(place[order], np.arange(GROUP + 1))
                messages.append((batch, tuple(x[order] for x in (t.a, t.b, t.w)), n[order].astype(np.min_scalar_type(int(n.max()))), cut))
                hashes.append(t.words)
                del t, n, place, order, payload
            words = np.concatenate(hashes)
            words.sort()
            words = words[_starts(words)]
            for (_, abw, *_), h in zip(messages, hashes, strict=True):
                place = np.searchsorted(words, h).astype(np.int32)
                for x in abw:
                    x[:] = place[x]
            del hashes
            for part in range(group * GROUP, (group + 1) * GROUP):
                row = one(part, words, messages)
                textvec.release()
                if row is not None:
                    yield row
            del messages, abw, x

    return run


def constants(counts: DataFrame, totals: DataFrame | None) -> Constants:
    """From the partitions' counts of counts; totals: (h, w, n) of the split words."""
    size = 3 * (K + 3) + 4
    x = np.array([v or 0 for v in counts.agg(*[F.sum(F.col("stats")[k]) for k in range(size)]).first()], np.int64)
    n1, n2, n3 = (x[k * (K + 3) : (k + 1) * (K + 3)].copy() for k in range(3))
    n, v, top, docs = (int(y) for y in x[3 * (K + 3) :])
    split = {}
    if totals is not None:
        split = {r.h: r.n for r in totals.groupBy("h").agg(F.sum("n").alias("n")).collect()}  # a row a split word: fewer than there are partitions
        for r in totals.groupBy(F.least("n", F.lit(K + 2)).alias("r")).count().collect():
            n2[r.r] += r["count"]
    more = [c for h, c in split.items() if h != int(BOS)] + ([docs] if docs else [])
    n1 = n1 + _tally(np.array(more, np.int64))
    n, v, top = n + sum(more), v + len(more), top + sum(c > K for c in more)
    d = [discounts(np.asarray(c, float)) for c in (n1, n2, n3)]
    left = ((1 - d[0]) * np.arange(1, K + 1) * n1[1 : K + 1]).sum() + HELD * top
    return Constants(n, v, docs, d, float(left / n) if n else 1.0, split)


class Table:
    """A partition's counts with what follows from them; rows of a pair (b, w), a context (a, b) or a word b are runs or groups of the trigrams."""

    def __init__(self, payload: bytes, known: Constants, totals: dict[int, int] | None = None):
        self.t, self.c3 = Trigrams.unpack(payload)
        t, words = self.t, self.t.words
        self.pair, self.word = _starts(t.b, t.w), _starts(t.b)
        self.pair_of = np.repeat(np.arange(len(self.pair)), np.diff(np.append(self.pair, len(t))))
        self.word_of = np.repeat(np.arange(len(self.word)), np.diff(np.append(self.word, len(t))))
        self.b, self.w = words[t.b[self.word]], words[t.w[self.pair]]
        self.c2, self.c1 = _summed(self.c3, self.pair), _summed(self.c3, self.word)
        if totals is not None:
            self.c2 = np.array([totals.get(x, 0) for x in _signed(self.w).tolist()], np.int64)
            self.c1 = np.array([known.split.get(x, 0) for x in _signed(self.b).tolist()], np.int64)
        bits = max(1, (len(words) - 1).bit_length())
        key, self.context_of = _unique(_joined(self.word_of, t.a, bits))
        self.context_word, self.context_a = key >> bits, words[key & ((1 << bits) - 1)]
        self.cx = np.bincount(self.context_of, self.c3, len(key)).astype(np.int64)
        self.known = known

    def backoff(self) -> np.ndarray:
        """log10 of each context's weight; 0 where it was not seen."""
        seen = self.c3 > 0
        s3, s2 = self.known.star(3, self.c3), self.known.star(2, self.c2[self.pair_of])
        n = len(self.cx)
        return weights(self.cx, np.bincount(self.context_of, s3, n), self.c1[self.context_word], np.bincount(self.context_of, np.where(seen, s2, 0.0), n))


def _fixed(weight: np.ndarray) -> tuple[int, tuple]:
    """(the least, multiples of UNIT above it)"""
    x = np.rint(weight / UNIT).astype(np.int64)
    low = int(x.min()) if len(x) else 0
    return low, squeezed(x - low)


def _floating(x: tuple[int, tuple]) -> np.ndarray:
    return (spread(x[1]) + x[0]) * UNIT


def weights(n, star, below, below_star) -> np.ndarray:
    """log10 of (1 - star / n) / (1 - below_star / below) where n > 0, else 0."""
    n, below = np.asarray(n, float), np.asarray(below, float)
    some = n > 0
    one = np.where(some, n, 1.0)
    two = np.where(some, below, 1.0)
    with np.errstate(divide="ignore", invalid="ignore"):
        out = np.log10((one - star) / one) - np.log10((two - below_star) / two)
    return np.where(some, out, 0.0)


def _masses(deal: Deal, known: Constants):
    """(h, n, star, low): per word its count, the sum of its pairs' discounted counts, and P of words seen after it, in so far as this partition knows them."""

    def run(batches):
        for batch in batches:
            for part, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                split = deal.split(part) is not None
                table = Table(payload, known, {} if split else None)
                t, words = table.t, table.t.words
                seen = np.flatnonzero((table.cx > 0) & (table.b[table.context_word] != BOS))
                if split:
                    seen = seen[~np.isin(_pair(table.context_a[seen], table.b[table.context_word[seen]]), deal.pairs)]
                h, at = _unique(table.context_a[seen])
                columns = [(h, np.zeros(len(h), np.int64), np.zeros(len(h)), np.bincount(at, known.p(table.c1[table.context_word[seen]]), len(h)))]
                if not split:
                    word = table.word_of[table.pair]
                    n = len(table.word)
                    end = np.bincount(word, (table.w == END) & (table.c2 > 0), n) * known.p(np.array([known.docs]))
                    columns.append((words[t.b[table.word]], table.c1, np.bincount(word, known.star(2, table.c2), n), end))
                h, n, star, low = (np.concatenate(c) for c in zip(*columns, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(_signed(h)), pa.array(n, pa.int64()), pa.array(star, pa.float64()), pa.array(low, pa.float64())], ["h", "n", "star", "low"])

    return run


_ANSWERED = "kind int, part int, batch long, payload binary, need array<long>"


def _answered(deal: Deal, known: Constants, contexts: dict[tuple[int, int], float]):
    """kind 0: the partition's context weights; 1: a batch's answers; need: words whose own weights a batch needs. contexts: (n, log10 weight) of frequent pairs."""

    def one(part: int, counts: bytes, asks: bytes, totals: list | None):
        split = deal.split(part) is not None
        table = Table(counts, known, {x["w"]: x["n"] for x in totals or []} if split else None)
        weight, cx = table.backoff(), table.cx
        if split and contexts:
            for k in np.flatnonzero(np.isin(_pair(table.context_a, table.b[table.context_word]), deal.pairs)).tolist():
                cx[k], weight[k] = contexts.get((int(_signed(table.context_a[k : k + 1])[0]), int(_signed(table.b[table.context_word[k : k + 1]])[0])), (0, 0.0))
        yield 0, None, packed(weight.astype(np.float32)), []
        for batch, places in unpacked(asks):
            at = np.cumsum(spread(places))
            c3, context, word = table.c3[at], table.context_of[at], table.word_of[at]
            new = _starts(word)
            miss = np.flatnonzero(c3 == 0)
            c2 = table.c2[table.pair_of[at[miss]]]
            bare = word[miss][(c2 == 0) & (table.c1[word[miss]] > 0)]
            answer = squeezed(c3), squeezed(np.where(c3 > 0, cx[context], 0)), squeezed(table.c1[word[new]]), squeezed(c2), _fixed(weight[context[miss]])
            yield 1, batch, packed(answer), _signed(table.b[np.flatnonzero(np.bincount(bare))]).tolist()

    def run(batches):
        for batch in batches:
            for part, counts, asks, totals in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                kind, number, payload, need = zip(*one(part, counts, asks, totals), strict=True)
                textvec.release()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(kind, pa.int32()), pa.array([part] * len(kind), pa.int32()), pa.array(number, pa.int64()), pa.array(payload, pa.binary()), pa.array(need, pa.list_(pa.int64()))],
                    ["kind", "part", "batch", "payload", "need"],
                )

    return run


_SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
_WEIGHTS = "array<struct<h:long,weight:double>>"


def _evaluated(deal: Deal, known: Constants):
    """Scores, from rows (batch, kind, part, payload, weights) in (batch, kind) order: 0 the batch, 1 answers, 2 weights of words."""

    def one(rows: list[tuple]) -> pa.RecordBatch:
        b = Batch.unpack(next(p for kind, _, p, _ in rows if kind == 0))
        t, part, back = b.questions(deal)
        order = _order(part, deal.all).astype(np.int32)
        cut = np.append(0, np.cumsum(np.bincount(part, minlength=deal.all)))
        del part
        value, c1 = np.zeros(len(t)), np.zeros(len(b.words), np.int64)
        c1[0] = known.docs
        bare = []
        for kind, p, payload, _ in rows:
            if kind != 1:
                continue
            mine = order[cut[p] : cut[p + 1]]
            c3, cx, own, c2, weight = unpacked(payload)
            c3, own = spread(c3), spread(own)
            hit, miss = np.flatnonzero(c3), np.flatnonzero(c3 == 0)
            value[mine[hit]] = np.log10(known.star(3, c3[hit])) - np.log10(spread(cx)[hit])
            word = t.b[mine[_starts(t.b[mine])]]
            c1[word] = own
            miss, c2 = mine[miss], spread(c2)
            value[miss] = _floating(weight)
            two = c2 > 0
            value[miss[two]] += np.log10(known.star(2, c2[two])) - np.log10(c1[t.b[miss[two]]])
            bare.append(miss[~two])
        bare = np.concatenate(bare) if bare else np.zeros(0, np.int64)
        if len(bare):
            lower = np.zeros(len(b.words))
            for kind, _, _, found in rows:
                if kind == 2:
                    h, x = np.array([f["h"] for f in found], np.int64).view(np.uint64), np.array([f["weight"] for f in found])
                    lower[np.searchsorted(b.words, h)] = x
            value[bare] += lower[t.b[bare]] + np.log10(known.p(c1[t.w[bare]]))
        n, doc = len(b.ids), b.doc
        base = np.log10(c1 + 0.5) - np.log10(known.n + 0.5 * (known.v + 1))
        del order
        sums = [np.bincount(doc, x[at], n) for x, at in ((c1 > 0, b.code), (base, b.code), (value, back))]
        return pa.RecordBatch.from_arrays(
            [pa.array(b.ids, mask=b.nulls), pa.array(~b.train), pa.array(b.size, pa.int64()), pa.array(sums[0].astype(np.int64)), pa.array(np.full(n, known.n, np.int64)), pa.array(sums[1]), pa.array(sums[2])],
            ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    def run(batches):
        for _, rows in _groups(batches):
            yield one(rows)
            textvec.release()

    return run


@dataclass
class Model:
    """The stored tables. counts: part, counts (Trigrams.unpack), asks. answers: kind 0 rows hold the log10 weights of a partition's contexts, in the order of Table. backoff: h, n, weight of each word."""

    deal: Deal
    known: Constants
    streams: DataFrame
    counts: DataFrame
    answers: DataFrame
    backoff: DataFrame


def _frequent(streams: DataFrame, parts: int) -> Deal:
    """Words with a quarter of a partition's tokens have partitions of their own."""
    tokens = streams.agg(F.sum("tokens")).first()[0] or 0
    least = tokens / parts / 4
    hot = streams.select(F.explode("hot").alias("x")).groupBy("x.a", "x.h").agg(F.sum("x.n").alias("n")).filter(F.col("n") >= least).collect()  # 4 * parts words and pairs at most
    return Deal.of(parts, [(r.h, r.n * parts / tokens) for r in hot if r.a is None], [(r.a, r.h) for r in hot if r.a is not None])


def model(docs: DataFrame) -> Model:
    """Count the training documents' trigrams, and answer what all documents ask."""
    docs = bounded_batches(docs, "2m").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(4, -(-size // PART_BYTES))
    streams = stored(docs.mapInArrow(_streamed(0.125 / parts), _STREAM), "none", ROW_GROUP)
    deal = _frequent(streams, parts)
    counts = []
    for k in range(min(COUNT_ROUNDS, deal.groups)):
        groups = range(k, deal.groups, COUNT_ROUNDS)
        keys = dict(zip(groups, partition_keys(docs.sparkSession, len(groups)), strict=True))
        dealt = streams.select("batch", "payload").mapInArrow(_dealt(deal, keys), _MESSAGES).repartition(len(groups), "dest").sortWithinPartitions("dest", "batch", "piece")
        counts.append(stored(dealt.mapInArrow(_counted(deal, keys), _COUNTED), "none", ROW_GROUP))
    counts = reduce(DataFrame.union, counts)

    some = len(deal.split_words) > 0
    partial = counts.select("part", F.explode("pairs").alias("x")).select("part", "x.h", "x.w", "x.n")
    totals = stored(partial.groupBy("h", "w").agg(F.sum("n").alias("n")).filter("n > 0")) if some else None
    known = constants(counts, totals)

    # Weights of words.
    masses = counts.select("part", "counts").mapInArrow(_masses(deal, known), "h long, n long, star double, low double")
    contexts = {}
    if some:
        star = known.star_column(2, F.col("n"))
        end = F.sum(F.when(F.col("w") == int(END), F.lit(float(known.p(np.array([known.docs]))[0]))).otherwise(0.0))
        masses = masses.unionByName(totals.groupBy("h").agg(F.sum("n").alias("n"), F.sum(star).alias("star"), end.alias("low")))
        # Contexts of frequent pairs: what their partitions hold, added up; as many rows as there are such pairs.
        triples = counts.select(F.explode("hot").alias("x")).select("x.a", "x.h", "x.w", F.col("x.n").alias("m")).join(totals, ["h", "w"])
        sums = triples.groupBy("a", "h").agg(F.sum("m").alias("m"), F.sum(known.star_column(3, F.col("m"))).alias("s3"), F.sum(star).alias("s2")).collect()
        below = np.array([known.split[r.h] for r in sums], np.int64)
        weight = weights([r.m for r in sums], np.array([r.s3 for r in sums]), below, np.array([r.s2 for r in sums]))
        contexts = {(r.a, r.h): (r.m, float(w)) for r, w in zip(sums, weight, strict=True)}
        low = [r for r in sums if r.h != int(BOS)]
        none, p = np.zeros(len(low)), known.p(np.array([known.split[r.h] for r in low], np.int64))
        # A table of Arrow: rows as a list would start more Python workers, which stay.
        low = pa.table([pa.array([r.a for r in low], pa.int64()), pa.array(none, pa.int64()), pa.array(none, pa.float64()), pa.array(p, pa.float64())], ["h", "n", "star", "low"])
        masses = masses.unionByName(docs.sparkSession.createDataFrame(low))
    sums = masses.groupBy("h").agg(F.sum("n").alias("n"), F.sum("star").alias("star"), F.sum("low").alias("low")).filter("n > 0")
    backoff = stored(sums.select("h", "n", (F.log10((F.col("n") - F.col("star")) / F.col("n")) - F.log10(1 - F.col("low"))).alias("weight")))

    rows = counts.select("part", "counts", "asks")
    empty = F.lit(None).cast("array<struct<w:long,n:long>>")
    if some:
        whole = partial.select("part", "h", "w").join(totals, ["h", "w"]).groupBy("part").agg(F.collect_list(F.struct("w", "n")).alias("totals"))  # a partition's own pairs
        split = [p for p in range(deal.parts, deal.all) if deal.split(p) is not None]
        mine = rows.filter(F.col("part") >= deal.parts).filter(F.col("part").isin(split)).join(whole, "part", "left")
        rows = rows.filter(~F.col("part").isin(split)).withColumn("totals", empty).unionByName(mine.select("part", "counts", "asks", "totals"))
    else:
        rows = rows.withColumn("totals", empty)
    answers = stored(rows.mapInArrow(_answered(deal, known, contexts), _ANSWERED), "none", ROW_GROUP)
    return Model(deal, known, streams, counts, answers, backoff)


def evaluated(m: Model) -> DataFrame:
    """Every document's scores, from the stored tables."""
    out = [stored(_round(m, k)) for k in range(ROUNDS)]
    return reduce(DataFrame.union, out)


def _round(m: Model, k: int) -> DataFrame:
    mine = F.pmod(F.shiftright("batch", 20) + F.col("batch"), F.lit(ROUNDS)) == k
    streams, answers = m.streams.filter(mine), m.answers.filter("kind = 1").filter(mine)
    need = answers.select("batch", F.explode("need").alias("h")).distinct().join(m.backoff, "h").groupBy("batch").agg(F.collect_list(F.struct("h", "weight")).alias("weights"))  # words of one batch
    none = F.lit(None).cast(_WEIGHTS).alias("weights")
    rows = streams.select("batch", F.lit(0).alias("kind"), F.lit(None).cast("int").alias("part"), "payload", none)
    rows = rows.union(answers.select("batch", "kind", "part", "payload", none))
    rows = rows.union(need.select("batch", F.lit(2).alias("kind"), F.lit(None).cast("int"), F.lit(None).cast("binary"), F.col("weights").cast(_WEIGHTS)))
    n = max(1, streams.count())
    return rows.repartition(2 * n, "batch").sortWithinPartitions("batch", "kind", "part").mapInArrow(_evaluated(m.deal, m.known), _SCORED)


def scored(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    return evaluated(model(docs))


def op6(docs: DataFrame) -> DataFrame:
    return scored(docs)
