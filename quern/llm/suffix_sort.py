"""Suffix arrays with common-prefix values by induced sorting in external memory.

The scheme is that of Bingmann, Fischer and Osipov (Inducing Suffix and LCP Arrays in External Memory, 2013): suffixes are L or S by whether they are larger or smaller
than the next one; the S suffixes that follow an L one (S*) split the text into pieces, whose names make a shorter text that is sorted by recursion, and the order of the
S* suffixes then induces first all L, then all S suffixes. Both inductions run over a disk-backed priority queue keyed by first symbol and arrival: a suffix, once its rank
comes up, sends its left neighbour, with its common-prefix value, to that neighbour's bucket. The common-prefix value of two entries that follow each other in a bucket is one more than
the least value scanned between their parents, kept on a stack of minima.

Nothing is as large as the text in memory: the text, its types and runs, pieces, names, seeds, induced sequences and results of more than `memory` entries are files, read and written in stretches (text
symbols of suffixes in hand by place); queues hold `memory` entries and keep the rest in files; pieces are named by distribution into groups that fit. All files are unlinked scratch of
the task. Only texts of at most `base` pieces are sorted by doubling, in memory.

Steps are numpy operations over as many buckets at a time as do not feed one another: with a large alphabet, as names are, some root of it; a bucket that feeds itself is taken in rounds.
"""

from __future__ import annotations

import tempfile

import numpy as np

MEMORY = 1 << 19
BASE = 1 << 18
FAR = np.int64(1) << 60
#: Parts of a queue's range of buckets.
FAN = 256


def array(n: int, memory: int, dtype=np.int32) -> np.ndarray:
    """An array of n entries: in a file if they are more than memory."""
    if n <= memory:
        return np.empty(n, dtype)
    with tempfile.TemporaryFile(prefix="quern-") as f:
        return np.asarray(np.memmap(f, dtype, "w+", shape=(n,)))  # a plain view of the mapped file


def _stretches(n: int, memory: int):
    step = max(1, min(memory, 1 << 19))
    return ((i, min(i + step, n)) for i in range(0, n, step))


class DiskQueue:
    """Entries (bucket, suffix, common prefix), taken in order of bucket and arrival; monotone: nothing arrives below what was taken.

    The range of buckets is split into FAN parts. Arrivals are kept by part, beyond `memory` in files, and put in order when their part comes up: a part of one bucket is read piece by piece, one that is
    too large becomes a queue of its own.
    """

    def __init__(self, memory: int, low: int, high: int):
        self.memory, self.low, self.high = memory, low, high
        self.width = max(1, -(-(high - low) // FAN))
        self.parts: dict[int, list] = {}
        self.count: dict[int, int] = {}
        self.size, self.now, self.inner = 0, -1, None
        self._set(np.zeros((3, 0), np.int64))

    def _set(self, x: np.ndarray) -> None:
        self.x, self.at = x, 0

    def push(self, bucket: np.ndarray, suffix: np.ndarray, lcp: np.ndarray) -> None:
        """bucket ascending."""
        if not len(bucket):
            return
        x = np.empty((3, len(bucket)), np.int64)
        x[0], x[1], x[2] = bucket, suffix, lcp
        part = (x[0] - self.low) // self.width
        if part[0] < self.now:
            self._unload()
        cut = [0, *((part[1:] != part[:-1]).nonzero()[0] + 1).tolist(), len(part)]
        for i, j in zip(cut[:-1], cut[1:], strict=True):
            p, y = int(part[i]), x[:, i:j]
            if p == self.now and self.inner is not None:
                self.inner.push(*y)
            elif p == self.now and self.width > 1:
                both = np.concatenate([self.x[:, self.at :], y], 1)
                self._set(both[:, np.argsort(both[0], kind="stable")])
            else:
                self.parts.setdefault(p, []).append(y)
                self.count[p] = self.count.get(p, 0) + y.shape[1]
                self.size += y.shape[1]
        if self.size > self.memory:
            self._spill()

    def _spill(self) -> None:
        file, at = tempfile.TemporaryFile(prefix="quern-"), 0
        for p in sorted(self.parts):
            for k, y in enumerate(self.parts[p]):
                if isinstance(y, np.ndarray):
                    y.tofile(file)
                    self.parts[p][k] = (file, at, y.shape[1])
                    at += y.nbytes
        file.flush()
        self.size = 0

    def _unload(self) -> None:
        """Put the current part back, as something comes before it."""
        rest = self.x[:, self.at :]
        front = [self.inner] if self.inner is not None else [rest] if rest.shape[1] else []
        if front:
            self.parts[self.now] = front + self.parts.get(self.now, [])
            self.count[self.now] = self.count.get(self.now, 0) + rest.shape[1]
            self.size += rest.shape[1]
        self.inner, self.now = None, -1
        self._set(np.zeros((3, 0), np.int64))

    def _read(self, piece) -> np.ndarray:
        if isinstance(piece, np.ndarray):
            self.size -= piece.shape[1]
            return piece
        file, at, n = piece
        file.seek(at)
        return np.fromfile(file, np.int64, 3 * n).reshape(3, n)

    def _load(self) -> bool:
        """Make the next entries current; False if there are none."""
        while self.at == self.x.shape[1]:
            if self.inner is not None:
                if self.inner._load():
                    return True
                self.inner = None
            if self.width == 1 and self.parts.get(self.now):
                self._set(self._read(self.parts[self.now].pop(0)))
                continue
            if not any(self.parts.values()):
                return False
            self.parts = {p: y for p, y in self.parts.items() if y}
            self.now = min(self.parts)
            n = self.count.pop(self.now, 0)
            if self.width == 1:
                continue
            pieces = self.parts.pop(self.now)
            if n > self.memory or isinstance(pieces[0], DiskQueue):
                low = self.low + self.now * self.width
                self.inner = pieces.pop(0) if isinstance(pieces[0], DiskQueue) else DiskQueue(self.memory, low, min(low + self.width, self.high))
                for piece in pieces:
                    y = self._read(piece)
                    self.inner.push(*y[:, np.argsort(y[0], kind="stable")])
                continue
            y = np.concatenate([self._read(piece) for piece in pieces], 1)
            self._set(y[:, np.argsort(y[0], kind="stable")])
        return True

    def least(self) -> int | None:
        """The bucket of the next entry."""
        if not self._load():
            return None
        return self.inner.least() if self.inner is not None else int(self.x[0, self.at])

    def reach(self) -> int:
        """Up to which bucket the entries that take() can give are all that there are, after least()."""
        if self.inner is not None:
            return self.inner.reach()
        low = self.low + self.now * self.width
        return low if self.width == 1 and self.parts.get(self.now) else low + self.width

    def take(self, high: int, most: int) -> np.ndarray:
        """Up to `most` next entries of buckets below high, as far as they are current; give_back() undoes it in part."""
        if not self._load():
            return np.zeros((3, 0), np.int64)
        if self.inner is not None:
            return self.inner.take(high, most)
        end = min(self.at + int(np.searchsorted(self.x[0, self.at :], high)), self.at + most)
        out = self.x[:, self.at : end]
        self.at = end
        return out

    def give_back(self, n: int) -> None:
        """The last n entries of the take just before."""
        if self.inner is not None:
            self.inner.give_back(n)
        else:
            self.at -= n


class _Minima:
    """Least value scanned since a time, for many times at once."""

    def __init__(self, symbols: int, memory: int):
        self.time, self.times, self.values = 0, np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.last = array(symbols, memory, np.int64)  # when each bucket last got an entry
        for i, j in _stretches(symbols, memory):
            self.last[i:j] = -1

    def sent(self, lcp: np.ndarray, at: np.ndarray, to: np.ndarray) -> np.ndarray:
        """Scan lcp; entries at[k] (ascending inside a bucket) send to bucket to[k] (ascending). Returns their common-prefix values."""
        n, m = len(lcp), len(at)
        low = np.empty(m, np.int64)
        if m:
            new = np.empty(m, bool)
            new[0] = True
            np.not_equal(to[1:], to[:-1], out=new[1:])
            first = new.nonzero()[0]
            if len(first) < m:
                inner = (~new).nonzero()[0]
                pairs = np.empty(2 * len(inner), np.int64)
                pairs[0::2], pairs[1::2] = at[inner - 1] + 1, at[inner] + 1
                wide = np.empty(n + 1, np.int64)
                wide[:n], wide[n] = lcp, FAR
                low[inner] = np.minimum.reduceat(wide, pairs)[0::2]
            here, last = np.minimum.accumulate(lcp)[at[first]], self.last[to[first]]
            since = self.times.searchsorted(last, "right")
            kept = since < len(self.values)
            here[kept] = np.minimum(here[kept], self.values[since[kept]])
            here[last < 0] = -1
            low[first] = here
        if n:
            # Minima of what follows: entries below all later ones.
            back = np.minimum.accumulate(lcp[::-1])[::-1]
            below = np.empty(n, bool)
            below[n - 1] = True
            np.less(lcp[:-1], back[1:], out=below[:-1])
            keep = below.nonzero()[0]
            old = int(self.values.searchsorted(back[0]))  # values rise
            self.times = np.concatenate([self.times[:old], self.time + keep])
            self.values = np.concatenate([self.values[:old], lcp[keep]])
        self.last[to] = self.time + at  # the last one of a bucket stays
        self.time += n
        return low + 1


def _types(t: np.ndarray, memory: int) -> tuple[np.ndarray, np.ndarray]:
    """(is S, run length from each place on)"""
    n = len(t)
    is_s, run = array(n, memory, bool), array(n, memory)
    symbol, up, length = -1, True, 0  # of the place after the stretch
    for i, j in reversed(list(_stretches(n, memory))):
        x = np.append(np.asarray(t[i:j], np.int64), symbol)
        ends = np.flatnonzero(x[1:] != x[:-1])
        rise = x[ends + 1] > x[ends]
        if j == n:
            rise[-1] = True
        sizes = np.diff(np.append(-1, ends))
        a, b = np.repeat(rise, sizes), np.repeat(ends, sizes) - np.arange(sizes.sum()) + 1
        tail = len(x) - 1 - len(a)  # goes on in the next stretch
        is_s[i:j] = np.append(a, np.full(tail, up))
        run[i:j] = np.append(b, length + np.arange(tail, 0, -1))
        symbol, up, length = int(x[0]), bool(is_s[i]), int(run[i])
    return is_s, run


def _stars(is_s: np.ndarray, memory: int) -> np.ndarray:
    n = len(is_s)
    find = lambda i, j: np.flatnonzero(is_s[max(i, 1) : j] & ~is_s[max(i, 1) - 1 : j - 1]) + max(i, 1)
    total = sum(len(find(i, j)) for i, j in _stretches(n, memory))
    out, at = array(total, memory), 0
    for i, j in _stretches(n, memory):
        found = find(i, j)
        out[at : at + len(found)] = found
        at += len(found)
    return out


class _Names:
    """Ranks of the S* pieces (from one S* place to the next, both included) by their symbols. Where one piece ends, at an S symbol, and another goes on with the same symbol, that one's is L, so
    the ended piece is the larger."""

    def __init__(self, t: np.ndarray, star: np.ndarray, memory: int):
        self.t, self.star, self.memory = t, star, memory
        self.bits = int(max(t[i:j].max() for i, j in _stretches(len(t), memory)) + 1).bit_length()
        self.per = max(1, 63 // self.bits)
        self.names, self.next = array(len(star), memory), 0
        whole = array(len(star), memory)
        for i, j in _stretches(len(star), memory):
            whole[i:j] = np.arange(i, j)
        self._sort(whole, 0)

    def _size(self, i: np.ndarray) -> np.ndarray:
        """Symbols of pieces; the last one is the text's end alone."""
        after = np.minimum(i + 1, len(self.star) - 1)
        return np.where(i + 1 < len(self.star), self.star[after].astype(np.int64) - self.star[i] + 1, 1)

    def _keys(self, i: np.ndarray, done: int) -> np.ndarray:
        place, size = self.star[i].astype(np.int64) + done, self._size(i) - done
        key = np.zeros(len(i), np.int64)
        for k in range(self.per):
            symbol = np.asarray(self.t[np.minimum(place + k, len(self.t) - 1)], np.int64)
            key = key << self.bits | np.where(k < size, symbol, (1 << self.bits) - 1)
        return key

    def _sort(self, pieces: np.ndarray, done: int) -> None:
        """Name the pieces, which are equal in their first `done` symbols and above all named before."""
        n, limit = len(pieces), max(self.memory, 4)
        if n <= limit:
            self._in_memory(np.asarray(pieces, np.int64), done)
            return
        some = np.sort(self._keys(np.asarray(pieces[:: max(1, n // 4096)], np.int64), done))
        pick = some[:: max(1, len(some) * limit // (4 * n))]
        # Groups by key: those between two picked keys, and each picked key alone.
        pick = np.unique(pick)
        group = lambda i, j: 2 * np.searchsorted(pick, k := self._keys(np.asarray(pieces[i:j], np.int64), done), "left") + np.isin(k, pick)
        counts = sum(np.bincount(group(i, j), minlength=2 * len(pick) + 1) for i, j in _stretches(n, self.memory))
        files = [array(int(c), self.memory // max(1, len(counts))) for c in counts]
        at = np.zeros(len(counts), np.int64)
        for i, j in _stretches(n, self.memory):
            g, x = group(i, j), np.asarray(pieces[i:j])
            order = np.argsort(g, kind="stable")
            cut = np.searchsorted(g[order], np.arange(len(counts) + 1))
            for k in np.flatnonzero(np.diff(cut)):
                y = x[order[cut[k] : cut[k + 1]]]
                files[k][at[k] : at[k] + len(y)] = y
                at[k] += len(y)
        for k, f in enumerate(files):
            if not len(f):
                continue
            if k % 2 == 0:
                self._sort(f, done)
            elif int(self._size(np.asarray(f[:1], np.int64))[0]) < done + self.per:
                # All of one key, which they end in: equal.
                for i, j in _stretches(len(f), self.memory):
                    self.names[f[i:j]] = self.next
                self.next += 1
            else:
                self._sort(f, done + self.per)
            files[k] = None

    def _in_memory(self, pieces: np.ndarray, done: int) -> None:
        size = self._size(pieces)
        name, open_ = np.zeros(len(pieces), np.int64), np.arange(len(pieces))
        while len(open_):
            key = self._keys(pieces[open_], done)
            order = np.lexsort((key, name[open_]))
            o, k = name[open_][order], key[order]
            other = np.concatenate([[True], o[1:] != o[:-1]])
            begin = np.flatnonzero(other | np.concatenate([[True], k[1:] != k[:-1]]))
            group = np.flatnonzero(other)
            # Names keep gaps: a group's members move up by the number of those before them.
            base = np.repeat(group, np.diff(np.append(group, len(o))))
            same = np.diff(np.append(begin, len(o)))
            name[open_[order]] = o + np.repeat(begin, same) - base
            done += self.per
            rest = open_[order][np.repeat(same > 1, same)]
            open_ = rest[size[rest] >= done]  # one that ended just here is above those that go on
        found, back = np.unique(name, return_inverse=True)
        self.names[pieces] = back + self.next
        self.next += len(found)


def _doubling(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, common prefixes of neighbours) of a text in memory."""
    n = len(r)
    ranks, h = [np.unique(r, return_inverse=True)[1].astype(np.int64)], 1
    while ranks[-1].max() < n - 1:
        a = ranks[-1]
        b = np.zeros(n, np.int64)
        b[: n - h] = a[h:] + 1
        ranks.append(np.unique(a * (n + 1) + b, return_inverse=True)[1])
        h *= 2
    sa = np.argsort(ranks[-1], kind="stable")
    lcp, i, j = np.zeros(n, np.int64), sa[:-1].copy(), sa[1:].copy()
    for k in range(len(ranks) - 1, -1, -1):
        inside = (i < n) & (j < n)
        step = np.where(inside & (ranks[k][np.minimum(i, n - 1)] == ranks[k][np.minimum(j, n - 1)]) & (np.maximum(i, j) + (1 << k) <= n), 1 << k, 0)
        lcp[1:] += step
        i += step
        j += step
    return sa, lcp


class _Seeds:
    """The S* suffixes in order, each with its common prefix with the one before."""

    def __init__(self, t: np.ndarray, star: np.ndarray, order: np.ndarray, common: np.ndarray, memory: int):
        n, m = len(t), len(star)
        self.suffix, self.lcp = array(m, memory), array(m, memory)
        place = lambda k: np.where(k < m, star[np.minimum(k, m - 1)], n).astype(np.int64)
        for s, e in _stretches(m, memory):
            now = np.asarray(order[s:e], np.int64)
            self.suffix[s:e] = star[now]
            before = np.asarray(order[max(s - 1, 0) : e - 1] if s else np.append(order[0], order[: e - 1]), np.int64)
            i, j = star[before].astype(np.int64), star[now].astype(np.int64)
            # From equal names to equal symbols: the shared pieces' lengths, and what the first different pieces share.
            value = place(np.minimum(now + np.asarray(common[s:e], np.int64), m)) - j
            open_ = np.arange(0 if s else 1, e - s)
            while len(open_):
                a, b = i[open_] + value[open_], j[open_] + value[open_]
                open_ = open_[(np.maximum(a, b) < n) & (t[np.minimum(a, n - 1)] == t[np.minimum(b, n - 1)])]
                value[open_] += 1
            if not s:
                value[0] = 0
            self.lcp[s:e] = value

    def __len__(self) -> int:
        return len(self.suffix)

    def get(self, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        return np.asarray(self.suffix[i:j], np.int64), np.asarray(self.lcp[i:j], np.int64)


class _Induced:
    """A sequence in the making; read backwards it feeds the second induction."""

    def __init__(self, n: int, memory: int):
        self.suffix, self.lcp, self.n = array(n, memory), array(n, memory), 0

    def add(self, suffix: np.ndarray, lcp: np.ndarray) -> None:
        self.suffix[self.n : self.n + len(suffix)] = suffix
        self.lcp[self.n : self.n + len(suffix)] = lcp
        self.n += len(suffix)

    def __len__(self) -> int:
        return self.n

    def get(self, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        """From the end; the value is that with the entry above."""
        a, b = self.n - j, self.n - i
        above = np.asarray(self.lcp[a + 1 : b + 1], np.int64) if b < self.n else np.append(np.asarray(self.lcp[a + 1 : b], np.int64), 0)
        return np.asarray(self.suffix[a:b], np.int64)[::-1], above[::-1]


def _induce(t: np.ndarray, is_s: np.ndarray, run: np.ndarray, symbols: int, want_s: bool, given, memory: int, emit) -> None:
    """Scan the given suffixes and those induced, bucket by bucket, rising for L and falling for S suffixes; in a bucket the induced ones come first. emit(suffix, value with the one scanned before, whether given)."""
    key = (lambda x: symbols - 1 - np.asarray(x, np.int64)) if want_s else (lambda x: np.asarray(x, np.int64))
    queue, minima, most = DiskQueue(memory, 0, symbols), _Minima(symbols, memory), max(2, min(memory, 1 << 18))
    if want_s:
        queue.push(key([0]), np.array([len(t) - 1]), np.zeros(1, np.int64))

    def bucket_of(i: int) -> int:
        return int(key(t[given.get(i, i + 1)[0]])[0])

    def upto(i: int, high: int) -> int:
        """How many are given below a bucket, `most` more than i at most."""
        low, end = i, min(i + most, len(given))
        while low < end:
            mid = (low + end) // 2
            low, end = (mid + 1, end) if bucket_of(mid) < high else (low, mid)
        return low

    def targets(suffix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero((suffix > 0) & (is_s[np.maximum(suffix - 1, 0)] == want_s))
        return at, key(t[suffix[at] - 1])

    def scan(suffix, lcp, given_, at, to) -> None:
        emit(suffix, lcp, given_)
        by = np.argsort(to, kind="stable")
        at, to = at[by], to[by]
        queue.push(to, suffix[at] - 1, minima.sent(lcp, at, to))

    done, width = 0, 1
    while True:
        low = first_in = queue.least()
        if done < len(given):
            b = bucket_of(done)
            low = b if low is None else min(low, b)
        if low is None:
            return
        high = min(low + width, symbols)
        if first_in is not None:
            high = min(high, max(queue.reach(), low)) if first_in == low or queue.reach() > low else min(high, first_in)
        x = queue.take(high, most) if first_in is not None else np.zeros((3, 0), np.int64)
        if x.shape[1] == most:
            high = max(int(x[0, -1]), low)  # perhaps not all of the last bucket
        if high > low:
            keep = int(np.searchsorted(x[0], high))
            queue.give_back(x.shape[1] - keep)
            x = x[:, :keep]
            upper = upto(done, high)
            if upper - done == most:
                high = max(bucket_of(upper - 1), low)
                upper = upto(done, high)
                keep = int(np.searchsorted(x[0], high))
                queue.give_back(x.shape[1] - keep)
                x = x[:, :keep]
        if high > low:
            suffix, lcp = given.get(done, upper)
            bucket = np.concatenate([x[0] * 2, key(t[suffix]) * 2 + 1])
            order = np.argsort(bucket, kind="stable")
            bucket, given_ = bucket[order] >> 1, (bucket[order] & 1).astype(bool)
            suffix, lcp = np.concatenate([x[1], suffix])[order], np.concatenate([x[2], lcp])[order]
            same = np.append(False, bucket[1:] == bucket[:-1])
            joint = np.flatnonzero(given_ & ~(same & np.append(False, given_[:-1])))
            lcp[joint] = np.where(same[joint], np.minimum(run[suffix[joint - 1]], run[suffix[joint]]), 0)
            at, to = targets(suffix)
            fed = to[to < high]
            stop = int(fed.min()) if len(fed) else high
            if stop > low:
                width = min(width * 2, 1 << 16) if stop == high else 2 * (stop - low) + 200
                keep = int(np.searchsorted(bucket, stop))
                queue.give_back(int((~given_[keep:]).sum()))
                done += int(given_[:keep].sum())
                some = int(np.searchsorted(at, keep))
                scan(suffix[:keep], lcp[:keep], given_[:keep], at[:some], to[:some])
                continue
            queue.give_back(x.shape[1])
        elif x.shape[1]:
            queue.give_back(x.shape[1])
        # One bucket that feeds itself, or is too large to be taken at once: in rounds.
        width, last = max(1, width // 2), -1
        while queue.least() == low:
            x = queue.take(low + 1, most)
            scan(x[1], x[2], np.zeros(x.shape[1], bool), *targets(x[1]))
            last = int(x[1, -1])
        first = True
        while done < len(given) and bucket_of(done) == low:
            end = upto(done, low + 1)
            suffix, lcp = given.get(done, end)
            if first:
                lcp = lcp.copy()
                lcp[0] = 0 if last < 0 else min(run[last], run[suffix[0]])
            scan(suffix, lcp, np.ones(len(suffix), bool), *targets(suffix))
            done, first = end, False


def suffix_array(t: np.ndarray, memory: int = MEMORY, base: int = BASE) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, common-prefix values with the one before) of t, whose last symbol is 0 and occurs once."""
    n = len(t)
    if n == 1:
        return np.zeros(1, np.int64), np.zeros(1, np.int64)
    symbols = int(max(t[i:j].max() for i, j in _stretches(n, memory))) + 1
    is_s, run = _types(t, memory)
    star = _stars(is_s, memory)
    names = _Names(t, star, memory)
    m = len(star)
    if names.next == m:
        order, common = array(m, memory), array(m, memory)
        for i, j in _stretches(m, memory):
            order[names.names[i:j]] = np.arange(i, j)
            common[i:j] = 0
    elif m <= base:
        order, common = _doubling(np.asarray(names.names, np.int64))
    else:
        order, common = suffix_array(names.names, memory, base)
    seeds = _Seeds(t, star, order, common, memory)
    del names, star, order, common
    ls = _Induced(n, memory)

    def keep_l(suffix: np.ndarray, lcp: np.ndarray, given: np.ndarray) -> None:
        ls.add(suffix[~given], lcp[~given])

    _induce(t, is_s, run, symbols, False, seeds, memory, keep_l)
    del seeds
    out_s, out_l = array(n, memory), array(n, memory)
    end, below = n, 0

    def keep_all(suffix: np.ndarray, lcp: np.ndarray, given: np.ndarray) -> None:
        # Falling: each one's value is that with its neighbour above, so it is the neighbour's own.
        nonlocal end
        if end < n:
            out_l[end] = lcp[0]
        out_s[end - len(suffix) : end] = suffix[::-1]
        out_l[end - len(suffix) + 1 : end] = lcp[1:][::-1]
        end -= len(suffix)
        out_l[end] = below

    _induce(t, is_s, run, symbols, True, ls, memory, keep_all)
    return out_s, out_l
