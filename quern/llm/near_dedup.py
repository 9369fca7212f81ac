"""MinHash near-duplicates by a multi-index Hamming join.

Every text's set of word shingles gets a signature of CHUNKS * WIDTH symbols, each 16 bits of a MinHash value. Two sets of
similarity J differ in a symbol with probability 1 - J, so all pairs within a signature distance D are wanted. By pigeonhole,
two signatures with at most D = CHUNKS * (ERRORS + 1) - 1 unequal symbols have a chunk with at most ERRORS of them: indexing every chunk once for
each choice of ERRORS symbols left out finds all such pairs. At J = 0.8 the distance has mean 25 and deviation 4.5; D is 49. EXTRA more symbols of 8 bits sharpen the
estimate for pairs found: of all 381, 76 differ at J = 0.8, with deviation 7.8, and pairs of more than FAR unequal ones are left out,
which at J = 0.8 loses a sixth (4e-8) of what the distance loses (2.4e-7).

Equal sets become one class first, so groups of copies cost one entry; a class is named by a hash of its set, and its text is that of its least doc_id. Inside an index bucket no pairs are listed: each member is linked
to the bucket's least one (a star); of these links each member's most frequent one is confirmed on the full sets first, then those that are not connected yet, and
components of what was confirmed are formed. Then only buckets whose members
still lie in different components are looked at again. First, documents leave them that can have no partner there: the elements that a document shares with no other of these documents are
counted, and if less than the wanted share of its set is left, no intersection is large enough. This is done until few leave. So a template filled in differently each time is not compared in pairs.
Those that stay are compared in blocks of bounded size, for pairs across components within distance D; these are confirmed
on the full sets. Documents of the pairs found meet by connected regions, each text once for each pair of blocks. A pair is only reported by the first of the buckets that hold both. Every pair within D is thus either confirmed, refused or already connected.

Rows travel as (key, id); texts are only fetched for documents of some candidate pair, a star's leader once for up to STAR_BLOCK members. Nothing is collected on the driver.

Defined cases: null or wordless texts have an empty set and are linked with nothing; a text of fewer words than a shingle has
one element, all its words; a null doc_id is linked with nothing and kept; rows that repeat a doc_id are linked with one another, whatever their texts, and share one verdict; an empty table
gives no rows; columns other than doc_id and text are not read, and deduplicated() returns them as they are, whatever their names.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graph, textvec
from .common import bounded_batches, stored

CHUNKS, WIDTH, ERRORS = 25, 5, 1
SYMBOLS = CHUNKS * WIDTH
DISTANCE = CHUNKS * (ERRORS + 1) - 1
EXTRA = 256
FAR = 120
PATTERNS = list(combinations(range(WIDTH), WIDTH - ERRORS))
#: Members of a bucket that one task compares with one another.
BLOCK = 2000
#: Members that meet one copy of their leader's text.
STAR_BLOCK = 500
#: Rounds in which documents without a possible partner leave.
LEAVING_ROUNDS = 3
#: Documents of a region whose sets one task holds, twice.
REGION_BLOCK = 500
#: Ids up to this number are broadcast (8 MB) to fetch their texts; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000

_RNG = np.random.default_rng(9)
_MULTIPLY = _RNG.integers(0, 1 << 62, SYMBOLS + EXTRA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FLIP = _RNG.integers(0, 1 << 63, SYMBOLS + EXTRA, dtype=np.uint64)


def _sets(w: textvec.Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    return textvec.distinct_sets(*textvec.shingles(w, n), len(w.rows))


def signatures(bounds: np.ndarray, values: np.ndarray) -> np.ndarray:
    """uint8 array (sets, 2 * SYMBOLS + EXTRA): the long symbols' bytes, then the short ones; rows of empty sets are 0."""
    full = np.flatnonzero(np.diff(bounds))
    long_, short = np.zeros((len(bounds) - 1, SYMBOLS), np.uint16), np.zeros((len(bounds) - 1, EXTRA), np.uint8)
    if len(full):
        for k in range(SYMBOLS + EXTRA):
            low = textvec.mix(np.minimum.reduceat((values ^ _FLIP[k]) * _MULTIPLY[k], bounds[full]))
            if k < SYMBOLS:
                long_[full, k] = (low >> np.uint64(48)).astype(np.uint16)
            else:
                short[full, k - SYMBOLS] = (low >> np.uint64(56)).astype(np.uint8)
    return np.concatenate([long_.view(np.uint8), short], 1)


def _sums(bounds: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sizes, two sums of the elements' hashes) of each set."""
    sizes = np.diff(bounds)
    full = np.flatnonzero(sizes)
    c = np.zeros((2, len(sizes)), np.uint64)
    if len(full):
        c[0, full] = np.add.reduceat(textvec.mix(values), bounds[full])
        c[1, full] = np.add.reduceat(textvec.mix(values ^ _FLIP[0]), bounds[full])
    return sizes, c[0], c[1]


def _names(sizes: np.ndarray, c1: np.ndarray, c2: np.ndarray) -> np.ndarray:
    """A number for each set."""
    return textvec.mix(textvec.mix(c1) + textvec.mix(c2 + sizes.astype(np.uint64)) * textvec._BASE).view(np.int64)


def _signed(n: int):
    def run(batches):
        for batch in batches:
            pairs = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            for w in textvec.words(pairs):
                bounds, values = _sets(w, n)
                sums = _sums(bounds, values)
                sig = [x.tobytes() for x in signatures(bounds, values)]
                yield pa.RecordBatch.from_arrays([pa.array(w.rows, pa.int64()), pa.array(sums[0], pa.int64()), pa.array(_names(*sums)), pa.array(sig, pa.binary())], ["doc_id", "n_shingles", "rep", "sig"])

    return run


def _matrices(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(long symbols, short symbols)"""
    x = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, 2 * SYMBOLS + EXTRA)
    return np.ascontiguousarray(x[:, : 2 * SYMBOLS]).view(np.uint16), x[:, 2 * SYMBOLS :]


def _near(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Which rows are within DISTANCE, and FAR on the whole."""
    far = (a[0] != b[0]).sum(1)
    out = far <= DISTANCE
    some = np.flatnonzero(out)
    pick = lambda x: x[some] if len(x) == len(far) else x
    out[some] = far[some] + (pick(a[1]) != pick(b[1])).sum(1) <= FAR
    return out


def _index_keys(batches):
    """(key, rep) for every chunk and every choice of ERRORS symbols left out."""
    n = len(PATTERNS)
    for batch in batches:
        for part in (batch.slice(i, 2000) for i in range(0, batch.num_rows, 2000)):
            rep, sig = part.column(0), _matrices(part.column(1))[0].astype(np.uint64)
            keys = np.empty((len(rep), CHUNKS * n), np.uint64)
            for c in range(CHUNKS):
                for j, symbols in enumerate(PATTERNS):
                    h = np.full(len(rep), c * n + j, np.uint64)
                    for s in symbols:
                        h = textvec.mix(h * textvec._BASE + sig[:, c * WIDTH + s])
                    # The low byte tells the chunk and the choice.
                    keys[:, c * n + j] = (h & ~np.uint64(255)) | np.uint64(c * n + j)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64).ravel()), pa.array(np.repeat(rep.to_numpy(), keys.shape[1]))], ["key", "rep"])


def _stars(batches):
    """From rows in (key, rep) order: (key null, a, b) star links, and (key, a, null) for the members of buckets of three or more."""
    last, leader, second, seen = None, 0, 0, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        key, rep = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        begin = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        carried = last is not None and key[0] == last
        lead, sec = rep[begin].copy(), rep[np.minimum(begin + 1, len(rep) - 1)].copy()
        place = np.arange(len(key)) - begin[group]
        if carried:
            place[group == 0] += seen
            lead[0] = leader
            sec[0] = second if seen > 1 else rep[0]
        link = place > 0
        third = place == 2
        many = place >= 2
        a = np.unique(np.stack([lead[group][link], rep[link]], 1), axis=0)
        k = np.concatenate([key[third], key[third], key[many]])
        m = np.concatenate([lead[group][third], sec[group][third], rep[many]])
        yield pa.RecordBatch.from_arrays(
            [pa.concat_arrays([pa.nulls(len(a), pa.int64()), pa.array(k)]), pa.array(np.concatenate([a[:, 0], m])), pa.concat_arrays([pa.array(a[:, 1]), pa.nulls(len(k), pa.int64())])],
            ["key", "a", "b"],
        )
        last, leader, second, seen = key[-1], lead[-1], sec[-1], int(place[-1]) + 1


def _close(batches):
    """Keep the pairs (a, b, na, nb, sa, sb) whose signatures are within DISTANCE."""
    for batch in batches:
        if batch.num_rows:
            ok = _near(_matrices(batch.column("sa")), _matrices(batch.column("sb")))
            yield batch.select(["a", "b"]).filter(pa.array(ok))


def _first_bucket(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Number of the first index entry that rows of a share with b, for ERRORS = 1."""
    off = (a != b).reshape(-1, CHUNKS, WIDTH)
    chunk = (off.sum(2) <= ERRORS).argmax(1)
    inside = off[np.arange(len(off)), chunk]
    # PATTERNS[j] leaves out symbol WIDTH - 1 - j; without an error the first one is shared.
    return chunk * len(PATTERNS) + np.where(inside.any(1), WIDTH - 1 - inside.argmax(1), 0)


def _elements(n: int):
    """(rep, h) for every element of every text's set."""

    def run(batches):
        for batch in batches:
            for w in textvec.words(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                bounds, values = _sets(w, n)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(w.rows, np.int64), np.diff(bounds))), pa.array(values.view(np.int64))], ["rep", "h"])

    return run


def _across(percent: int):
    """From rows in (key, lo, hi) order: pairs of different roots within DISTANCE, of blocks lo and hi or inside one block, as (a, others); and (a, root) for
    each document in such a pair, root being the least one it is connected with here."""

    def found(t: pa.Table):
        rep, root, n, common, block = (t.column(c).to_numpy() for c in ("rep", "root", "n", "common", "block"))
        sig = _matrices(t.column("sig").combine_chunks())
        lo, hi, key = (t.column(c)[0].as_py() for c in ("lo", "hi", "key"))
        # One end of each pair is not in the largest component here.
        roots, count = np.unique(root, return_counts=True)
        main = root == roots[count.argmax()]
        group = np.arange(len(rep))
        for i in np.flatnonzero(~main):
            ok = (root != root[i]) & (100 * np.minimum(n, n[i]) >= percent * np.maximum(n, n[i]))
            # Two sets share at most what either shares with anyone.
            ok &= (100 + percent) * np.minimum(common, common[i]) >= percent * (n + n[i])
            ok[: i + 1] &= main[: i + 1]
            if lo != hi:
                ok &= block != block[i]
            j = np.flatnonzero(ok)
            if len(j):
                j = j[_near((sig[0][j], sig[1][j]), (sig[0][i : i + 1], sig[1][i : i + 1]))]
            if len(j):
                j = j[_first_bucket(sig[0][j], sig[0][i : i + 1]) == key & 255]
            if len(j):
                group[np.isin(group, np.append(group[j], group[i]))] = min(group[i], group[j].min())
                yield int(rep[i]), rep[j].tolist(), None
        for i in np.flatnonzero(np.bincount(group, minlength=len(rep))[group] > 1):
            yield int(rep[i]), None, int(rep[group == group[i]].min())

    def done(t: pa.Table) -> pa.RecordBatch:
        a, others, root = zip(*got, strict=True) if (got := list(found(t))) else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(others, pa.list_(pa.int64())), pa.array(root, pa.int64())], ["a", "others", "root"])

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            t = pa.concat_tables([held, t]) if held is not None else t
            ids = np.stack([t.column(c).to_numpy() for c in ("key", "lo", "hi")], 1)
            cut = np.concatenate([[0], np.flatnonzero((ids[1:] != ids[:-1]).any(1)) + 1, [len(ids)]])
            for s, e in zip(cut[:-2], cut[1:-1], strict=True):
                yield done(t.slice(s, e - s))
            held = t.slice(cut[-2])
        if held is not None:
            yield done(held)

    return run


def _home(ids, blocks: int) -> np.ndarray:
    return (textvec.mix(np.asarray(ids, np.int64).view(np.uint64)) % np.uint64(blocks)).astype(np.int64)


_MET = "region long, lo int, hi int, id long, text string, others array<long>"


def _to_blocks(batches):
    """Documents (others null) go to all pairs of blocks with their own, lists of pairs to the pair that holds them."""
    for batch in batches:
        rows = []
        for region, blocks, i, text, others in zip(*(batch.column(c).to_pylist() for c in ("region", "blocks", "id", "text", "others")), strict=True):
            own = int(_home([i], blocks)[0])
            if others is None:
                rows += [(region, min(own, g), max(own, g), i, text, None) for g in range(blocks)]
            else:
                home = _home(others, blocks)
                rows += [(region, min(own, int(g)), max(own, int(g)), i, None, np.array(others)[home == g].tolist()) for g in np.unique(home)]
        if rows:
            cols = list(zip(*rows, strict=True))
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["region", "lo", "hi", "id", "text", "others"])


def _met(n: int, percent: int):
    """Confirmed links from rows in (region, lo, hi) order, documents before lists; one pair of blocks' sets are held at a time."""

    def run(batches):
        now, sets = None, {}
        for batch in batches:
            out = []
            for region, lo, hi, i, text, others in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (region, lo, hi) != now:
                    now, sets = (region, lo, hi), {}
                if others is None:
                    sets[i] = _sets(next(textvec.words([(0, text)])), n)[1]
                    continue
                mine = sets[i]
                for j in others:
                    both = len(np.intersect1d(mine, sets[j], assume_unique=True))
                    if 100 * both >= percent * (len(mine) + len(sets[j]) - both):
                        out.append((min(i, j), max(i, j)))
            a = np.array(out, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(a[:, 0]), pa.array(a[:, 1])], ["a", "b"])

    return run


def _confirmed(n: int, percent: int):
    """Links (a, b) whose full sets are similar enough, from rows (a, k, b, text) in that order, b null for the leader a itself."""

    def run(batches):
        now, held = None, None
        for batch in batches:
            out = []
            for a, k, b, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                mine = _sets(next(textvec.words([(0, text)])), n)[1]
                if b is None:
                    now, held = (a, k), mine
                    continue
                if now != (a, k):
                    raise RuntimeError("a leader is missing")
                both = len(np.intersect1d(held, mine, assume_unique=True))
                if 100 * both >= percent * (len(held) + len(mine) - both):
                    out.append((a, b))
            x = np.array(out, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1])], ["a", "b"])

    return run


def _of_class(n: int):
    """Keep the rows (rep, text) whose text belongs to the class rep."""

    def run(batches):
        for batch in batches:
            keep = []
            for rep, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                w = next(textvec.words([(0, text)]))
                keep.append(rep == int(_names(*_sums(*_sets(w, n)))[0]))
            yield batch.filter(pa.array(keep, pa.bool_()))

    return run


class Texts:
    """Texts of classes."""

    def __init__(self, docs: DataFrame, reps: DataFrame, n: int):
        self.docs, self.reps, self.n = docs.select("doc_id", "text"), reps, n
        #: Whether a doc_id is the least one of several classes: its rows have different texts then.
        self.mixed = bool(reps.groupBy("doc").count().filter("count > 1").head(1))
        self.repeats = self.mixed or bool(self.docs.groupBy("doc_id").count().filter("count > 1").head(1))

    def of(self, ids: DataFrame) -> DataFrame:
        """(id, text) of the classes ids (id, distinct)."""
        wanted = stored(ids.join(self.reps.select(F.col("rep").alias("id"), "doc"), "id"))
        few = wanted.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
        rows = self.docs.join(F.broadcast(wanted) if few else wanted, F.col("doc_id") == F.col("doc")).select("id", "text")
        if self.mixed:
            rows = rows.mapInArrow(_of_class(self.n), "id long, text string")
        # Rows of one class and doc_id are alike.
        return rows.dropDuplicates(["id"]) if self.repeats else rows


def links(texts: Texts, n: int, percent: int, same: DataFrame) -> DataFrame:
    """(id, root) of the classes texts.reps (rep, doc, n_shingles, sig) that are linked, directly or not, with others; same: links (a, b) that hold anyway."""
    ends = texts.reps.select("rep", F.col("n_shingles").alias("n"), "sig")
    total = texts.reps.count()

    def verify(pairs: DataFrame) -> DataFrame:
        side = lambda x: ends.select(F.col("rep").alias(x), F.col("n").alias(f"n{x}"), F.col("sig").alias(f"s{x}"))
        sized = pairs.join(side("b"), "b").join(side("a"), "a").filter(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
        most = pairs.count()
        near = stored(sized.mapInArrow(_close, "a long, b long").distinct(), rows=most)
        blocks = near.groupBy("a").agg(F.ceil(F.count("*") / STAR_BLOCK).alias("blocks"))
        dealt = stored(near.join(blocks, "a").select("a", F.pmod(F.xxhash64("b"), "blocks").cast("int").alias("k"), "b"), rows=most)
        found = texts.of(dealt.select(F.col("a").alias("id")).union(dealt.select("b")).distinct())
        leaders = dealt.select("a", "k").distinct().join(found, F.col("id") == F.col("a")).select("a", "k", F.lit(None).cast("long").alias("b"), "text")
        rows = leaders.union(dealt.join(found, F.col("id") == F.col("b")).select("a", "k", "b", "text"))
        return stored(rows.repartition("a", "k").sortWithinPartitions("a", "k", F.col("b").asc_nulls_first()).mapInArrow(_confirmed(n, percent), "a long, b long"))

    keys = ends.select("rep", "sig").mapInArrow(_index_keys, "key long, rep long")
    stars = stored(keys.repartition("key").sortWithinPartitions("key", "rep").mapInArrow(_stars, "key long, a long, b long"))
    tried = stored(stars.filter(F.col("key").isNull()).groupBy("a", "b").agg(F.count("*").alias("shared")))
    # First each member with the leader it shares most entries with; then what pairs are left between components.
    nearest = stored(tried.groupBy("b").agg(F.max(F.struct("shared", (-F.col("a")).alias("a"))).alias("__m")).select((-F.col("__m.a")).alias("a"), "b"), rows=total)
    first = verify(nearest).union(same)
    linked = stored(graph.components(first, rows=first.count()), rows=total)
    linked = _joined(linked, verify(_apart(tried.select("a", "b").join(nearest, ["a", "b"], "left_anti"), linked)), total)

    # Buckets of three or more whose members are not all connected yet.
    members = stars.filter(F.col("key").isNotNull()).select("key", F.col("a").alias("rep")).distinct()
    members = members.join(linked.select(F.col("id").alias("rep"), "root"), "rep", "left").select("key", "rep", F.coalesce("root", "rep").alias("root"))
    members, mixed = _mixed(stored(members))
    elements = stored(texts.of(members.select(F.col("rep").alias("id")).distinct()).mapInArrow(_elements(n), "rep long, h long"))
    common = None
    for _ in range(LEAVING_ROUNDS):
        inside = stored(members.select("rep").distinct(), rows=total)
        before = inside.count()
        here = elements.join(inside, "rep", "left_semi")
        alone = here.groupBy("h").agg(F.count("*").alias("__c"), F.min("rep").alias("rep")).filter("__c = 1").groupBy("rep").agg(F.count("*").alias("__alone"))
        common = ends.join(inside, "rep", "left_semi").join(alone, "rep", "left").select("rep", "n", "sig", (F.col("n") - F.coalesce("__alone", F.lit(0))).alias("common"))
        # An intersection is at least `percent` of either set.
        common = stored(common.filter(100 * F.col("common") >= percent * F.col("n")))
        members, mixed = _mixed(stored(members.join(common.select("rep"), "rep", "left_semi")))
        if 10 * (before - common.count()) <= before:
            break
    open_ = members.join(mixed.select("key", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks")), "key")
    open_ = open_.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).withColumn("__g", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    open_ = open_.join(common, "rep").select("key", F.least("block", "__g").alias("lo"), F.greatest("block", "__g").alias("hi"), "block", "rep", "root", "n", "common", "sig")
    across = open_.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "rep").mapInArrow(_across(percent), "a long, others array<long>, root long")
    across = stored(across)
    if not across.head(1):
        return linked
    # Documents in such pairs meet by regions of connected ones, once for each pair of blocks, not once for each pair.
    pairs = across.filter("others is null").select("a", F.col("root").alias("b"))
    region = graph.components(pairs, rows=pairs.count())
    blocks = region.groupBy("root").agg(F.ceil(F.count("*") / REGION_BLOCK).cast("int").alias("blocks"))
    region = stored(region.join(blocks, "root").select("id", F.col("root").alias("region"), "blocks"), rows=total)
    found = texts.of(region.select("id").distinct()).withColumn("others", F.lit(None).cast("array<long>"))
    lists = across.filter("others is not null").select(F.col("a").alias("id"), F.lit(None).cast("string").alias("text"), "others")
    rows = found.select("id", "text", "others").union(lists).join(region, "id").select("region", "blocks", "id", "text", "others")
    met = rows.mapInArrow(_to_blocks, _MET).repartition("region", "lo", "hi").sortWithinPartitions("region", "lo", "hi", F.col("others").isNotNull(), "id")
    return _joined(linked, stored(met.mapInArrow(_met(n, percent), "a long, b long").distinct()), total)


def _mixed(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, buckets) of the buckets whose members (key, rep, root) have different roots."""
    mixed = members.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("m")).filter("lo < hi")
    mixed = stored(mixed.select("key", "m"))
    return stored(members.join(mixed.select("key"), "key", "left_semi")), mixed


def _rooted(pairs: DataFrame, linked: DataFrame) -> DataFrame:
    """pairs with ra, rb: the roots of a and b."""
    root = lambda x: linked.select(F.col("id").alias(x), F.col("root").alias(f"r{x}"))
    return pairs.join(root("b"), "b", "left").join(root("a"), "a", "left").select("a", "b", F.coalesce("ra", "a").alias("ra"), F.coalesce("rb", "b").alias("rb"))


def _apart(pairs: DataFrame, linked: DataFrame) -> DataFrame:
    """The pairs that are not connected yet."""
    return stored(_rooted(pairs, linked).filter("ra <> rb").select("a", "b"))


def _joined(linked: DataFrame, found: DataFrame, total: int) -> DataFrame:
    """linked, at most total rows, after the links found (stored) are added."""
    tops = stored(graph.components(_rooted(found, linked).select(F.col("ra").alias("a"), F.col("rb").alias("b")), rows=found.count()), rows=total)
    moved = linked.join(tops.select(F.col("id").alias("root"), F.col("root").alias("top")), "root", "left").select("id", F.coalesce("top", "root").alias("root"))
    return stored(moved.union(tops).groupBy("id").agg(F.min("root").alias("root")), rows=total)


def clusters(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row."""
    docs = bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = stored(docs.mapInArrow(_signed(n), "doc_id long, n_shingles long, rep long, sig binary"))
    full = signed.filter((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    total = signed.count()
    classes = stored(full.groupBy("rep").agg(F.min("doc_id").alias("doc")), rows=total)
    reps = classes.join(full.select("rep", F.col("doc_id").alias("doc"), "n_shingles", "sig"), ["rep", "doc"]).dropDuplicates(["rep"])
    # Classes of one doc_id are linked; ends of stars, so no pairs are listed.
    several = full.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("__last")).filter(F.col("a") < F.col("__last"))
    same = stored(full.select("doc_id", F.col("rep").alias("b")).join(several, "doc_id").filter(F.col("a") < F.col("b")).select("a", "b").distinct(), rows=total)
    linked = links(Texts(docs, stored(reps), n), n, percent, same)
    roots = classes.join(linked.select(F.col("id").alias("rep"), "root"), "rep", "left").select("rep", "doc", F.coalesce("root", "rep").alias("root"))
    least = roots.groupBy("root").agg(F.min("doc").alias("__least"))
    roots = stored(roots.join(least, "root").select("rep", "__least"), rows=total)
    out = signed.select("doc_id", "n_shingles", "rep").join(roots, "rep", "left")
    root = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("__least")).otherwise(F.col("doc_id"))
    rows = out.select("doc_id", "n_shingles", root.alias("component_id"))
    if same.head(1):
        # Rows without words share the verdict of their doc_id's other rows.
        both = stored(rows)
        verdict = both.filter("doc_id is not null").groupBy("doc_id").agg(F.min("component_id").alias("__c"))
        rows = both.join(verdict, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("__c", "component_id").alias("component_id"))
    return rows.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def deduplicated(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """docs with one document of each group, the one of least doc_id; rows that repeat a doc_id stay or go together."""
    gone = stored(clusters(docs, n, percent).filter(~F.col("kept")).select(F.col("doc_id").alias("__doc")).distinct())
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return docs.select(row.alias("__row")).join(gone, F.col("__row.doc_id") == F.col("__doc"), "left_anti").select(*[F.col("__row")[c].alias(c) for c in docs.columns])


def op9(docs: DataFrame) -> DataFrame:
    return clusters(docs.select("doc_id", "text"), 2, 80)
