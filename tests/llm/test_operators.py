"""Operators against brute force on the smallest test tables."""

import collections
import hashlib
import math
import re
import tracemalloc
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quern.llm import common, decontaminate, graph, importance, katz, mixing, near_dedup, quality_rules, repeats, sharding, suffix_sort, textvec, token_output, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def lowered(text):
    return WORD.findall((text or "").translate(LOWER))


def test_sharding(docs, pandas_docs):
    out = sharding.op1(docs).toPandas()
    n = len(out)
    sizes = out.groupby("shard").size()
    assert sizes.max() - sizes.min() <= 1 and list(sizes.index) == list(range(16)) and sizes.sum() == n
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in out.groupby("shard"))
    assert out.sort_values(["shard", "slot"]).curve.is_monotonic_increasing
    want = {i: (len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in zip(pandas_docs.doc_id, pandas_docs.text)}
    assert {r.doc_id: (r.size, r.text_crc32) for r in out.itertuples()} == want


def test_sharding_prunes_by_every_dimension(spark, data, tmp_path):
    import pyarrow.parquet as pq

    docs = spark.read.parquet(f"{data}/../sf0.1/documents.parquet").select("doc_id", "source", "lang", "text")
    sharding.write_shards(sharding.hilbert_shards(docs), str(tmp_path / "s"))
    names = ["source", "lang", "size", "doc_id"]
    ranges = []
    for f in (tmp_path / "s").rglob("*.parquet"):
        m = pq.read_metadata(f)
        at = {m.schema.column(k).name: k for k in range(m.num_columns)}
        groups = [[m.row_group(g).column(at[c]).statistics for g in range(m.num_row_groups)] for c in names]
        ranges.append([(min(x.min for x in g), max(x.max for x in g)) for g in groups])
    rows = docs.select("source", "lang", (F.octet_length("text") + 1).alias("size"), "doc_id").sample(0.02, 1).collect()
    assert len(ranges) >= 48 and len(rows) > 100
    read = {c: np.mean([sum(r[k][0] <= x[k] <= r[k][1] for r in ranges) / len(ranges) for x in rows]) for k, c in enumerate(names)}
    # Share of the files that an equality predicate has to read; unsharded it is all of them.
    assert max(read.values()) < 0.85 and np.prod(list(read.values())) < 0.06, read


def test_sharding_splits_large_cells(spark, monkeypatch):
    monkeypatch.setattr(sharding, "CELL_ROWS", 10)
    rows = [(i % 60, f"text {i % 7}", "en", "one") for i in range(300)]
    out = sharding.op1(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).toPandas()
    sizes = out.groupby("shard").size()
    assert sizes.max() - sizes.min() <= 1 and all(sorted(g.slot) == list(range(len(g))) for _, g in out.groupby("shard"))
    assert out.sort_values(["shard", "slot"]).curve.is_monotonic_increasing


def test_sharding_keeps_columns_of_its_own_names(spark):
    df = spark.createDataFrame([(1, "ab", "en", "s", "a", "b", "c", "d", 3)], "doc_id long, text string, lang string, source string, size string, shard string, __rank string, input_size string, slot long")
    r = sharding.hilbert_shards(df).first().asDict()
    assert r["size"] == 3 and r["shard"] == 0 and r["slot"] == 0 and r["__rank"] == "c" and r["input_size"] == "d" and r["input_input_size"] == "a" and r["input_shard"] == "b" and r["input_slot"] == 3


def test_hilbert_curve(spark):
    grid = spark.range(4**3).select(*[F.shiftright("id", 2 * k).bitwiseAND(3).cast("int").alias(f"x{k}") for k in range(3)])
    rows = grid.select("*", sharding.hilbert_index([F.col("x0"), F.col("x1"), F.col("x2")], 2).alias("h")).orderBy("h").collect()
    assert [r.h for r in rows] == list(range(64))
    assert all(sum(abs(a[k] - b[k]) for k in range(3)) == 1 for a, b in zip(rows, rows[1:], strict=False))


def test_mixing(docs, pandas_docs):
    out = mixing.op2(docs).toPandas()
    again = mixing.op2(docs).toPandas()
    assert out.sort_values("doc_id").taken.tolist() == again.sort_values("doc_id").taken.tolist()
    out = out.merge(pandas_docs[["doc_id", "source", "text"]], on="doc_id")
    assert (out["size"] == out.text.map(lambda t: len(WORD.findall(t)))).all()
    assert (out.taken <= 2 * out["size"]).all()
    by = out.groupby("source").agg(size=("size", "sum"), target=("target", "first"), taken=("taken", "sum")).sort_index()
    weights, free = np.array([(5, 2, 1)[k % 3] for k in range(len(by))], float), np.ones(len(by), bool)
    target = np.zeros(len(by))
    while True:
        target[free] = (1.5 * by["size"].sum() - target[~free].sum()) * weights[free] / weights[free].sum()
        over = free & (target > 2 * by["size"].to_numpy())
        if not over.any():
            break
        target[over], free = 2 * by["size"].to_numpy()[over], free & ~over
    assert np.allclose(by.target, target)
    assert (abs(by.taken - by.target) <= 0.02 * by.target).all()


def test_mixing_rates_by_a_plain_solver(docs):
    out = mixing.mixed(docs).toPandas()
    for (source_size, target), g in out.groupby(["source_size", "target"]):
        x = g["size"] / (source_size / len(g))
        if target >= 2 * source_size:
            assert (g.rate == 2).all()
            continue
        words_at = lambda lam: (np.minimum(2.0, np.exp(np.minimum(lam * x, 50))) * g["size"]).sum()  # noqa: E731, B023
        low, high = -1e3, 1e3
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (mid, high) if words_at(mid) < target else (low, mid)
        assert abs((g.rate * g["size"]).sum() - target) <= 1e-6 * target
        assert np.allclose(g.rate, np.minimum(2.0, np.exp(low * x)), atol=1e-5)


def test_mixing_of_equal_rows(spark):
    # Of 300 rows that are equal in all columns, as many are taken as the target wants, and none more than twice.
    rows = [(1, "w " * 100, "a")] * 300 + [(i, "w " * (20 + i % 50), "a") for i in range(2, 62)] + [(100 + i, "v " * 90, "b") for i in range(400)] + [(None, None, None)] * 5 + [(None, "x y", None)] * 40
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    out = mixing.op2(df).toPandas()
    assert len(out) == len(rows) and (out.taken <= 2 * out["size"]).all()
    for _, g in out.groupby("source_size"):
        assert abs(g.taken.sum() - g.target.iloc[0]) <= max(0.01 * g.target.iloc[0], 100)
    again = mixing.op2(df.repartition(3)).toPandas()
    key = ["source_size", "size", "taken"]
    assert sorted(map(tuple, out[key].to_numpy().tolist())) == sorted(map(tuple, again[key].to_numpy().tolist()))
    # The mix itself takes the same numbers of copies.
    text = {r[1]: n for n, r in enumerate(dict.fromkeys(rows))}
    got = mixing.mix(df).toPandas()
    assert len(text) and len(got) == int((out.copies).sum()) and (got.doc_id == 1).sum() == int(out[(out.doc_id == 1)].copies.sum())


def test_partition_keys(spark):
    for parts in (1, 7, 60):
        keys = common.partition_keys(spark, parts)
        df = spark.createDataFrame([(k,) for k in keys], "k int").repartition(parts, "k").select("k", F.spark_partition_id().alias("p"))
        assert {r.k: r.p for r in df.collect()} == {k: p for p, k in enumerate(keys)}


def test_running_sums(spark):
    df = spark.range(200).selectExpr("(id * 37) % 101 AS k", "id AS tie", "id % 7 AS n")
    rows = sorted(df.collect(), key=lambda r: (r.k, r.tie))
    got = {(r.k, r.tie): r.upto for r in common.running(df, [F.col("k"), F.col("tie")], upto=F.col("n")).collect()}
    total = 0
    for r in rows:
        total += r.n
        assert got[r.k, r.tie] == total


def test_quality_rules(docs, pandas_docs):
    out = quality_rules.op3(docs).toPandas().set_index("doc_id")
    for i, text in zip(pandas_docs.doc_id, pandas_docs.text):
        w, r = WORD.findall(text), out.loc[i]
        at, hit = collections.defaultdict(list), set()
        for k in range(len(w) - 2):
            at[tuple(w[k : k + 3])].append(k)
        for places in at.values():
            if len(places) > 1:
                hit |= {p + j for p in places for j in range(3)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit))
        assert r.base_failed == (len(w) < 50 or 100 * len(hit) > 50 * len(w))
    assert not (out.kept & out.base_failed).any()


def test_hosts(spark):
    # A host that fails almost always is rejected as a whole, a small one with one failure is not.
    good, bad = " ".join(f"w{i}" for i in range(60)), "short"
    rows = [(i, good, "good") for i in range(50)] + [(100 + i, bad if i else good, "bad") for i in range(40)] + [(200, bad, None), (201, good, None), (202, good, None), (203, good, None)]
    out = {r.doc_id: r.kept for r in quality_rules.op3(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(out[i] for i in range(50)) and not out[100] and out[201] and not out[200]


@pytest.mark.parametrize("memory,base", [(1 << 20, 1 << 20), (1 << 20, 1), (3, 1), (50, 5)])
def test_suffix_sort(memory, base):
    r = np.random.default_rng(1)
    for k in range(120):
        t = r.integers(1, r.integers(2, 7), r.integers(1, 60))
        t = np.append(np.tile(t[:8], 5) if k % 3 == 0 else t, 0)
        want = sorted(range(len(t)), key=lambda i: t[i:].tolist())
        common_ = [0] * len(t)
        for j in range(1, len(t)):
            a, b = t[want[j - 1] :], t[want[j] :]
            m = min(len(a), len(b))
            common_[j] = int(np.argmin(np.append(a[:m] == b[:m], False)))
        sa, lcp = suffix_sort.suffix_array(t, memory, base)
        assert sa.tolist() == want and lcp.tolist() == common_
    # Two letters with ends between, so that many pieces begin alike and end at different places.
    t = np.append(r.choice([1, 5, 6], 4000, p=[0.05, 0.6, 0.35]), 0)
    sa, _ = suffix_sort.suffix_array(t, memory, base)
    b = t.tolist()
    assert sa.tolist() == sorted(range(len(b)), key=lambda i: b[i:])


def test_suffix_sort_far_beyond_memory(tmp_path):
    # Twenty-five times as many symbols as entries may be in memory, four levels of recursion, and never as much memory as one array of longs of its length.
    import tracemalloc

    r, memory = np.random.default_rng(2), 20_000
    words_ = ["".join(r.choice(list("abcdefghij"), r.integers(2, 9))) for _ in range(3000)]
    text = " ".join(words_[i] for i in r.zipf(1.3, 200_000) % 3000)[:500_000].encode()
    text = text + text[1000:1400] + b"tail" + text[5000:5300]
    np.append(np.frombuffer(text, np.uint8).astype(np.int16) + 2, np.int16(0)).tofile(tmp_path / "t")
    t, levels, one = np.memmap(tmp_path / "t", np.int16, "r"), [], suffix_sort.suffix_array

    def noted(t, memory, base):
        levels.append(len(t))
        return one(t, memory, base)

    suffix_sort.suffix_array = noted
    try:
        tracemalloc.start()
        sa, lcp = noted(t, memory, 4000)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
        suffix_sort.suffix_array = one
    assert isinstance(sa.base, np.memmap) and len(levels) >= 3 and peak < 8 * len(t), (levels, peak)
    full = text + b"\0"
    assert (np.bincount(sa, minlength=len(t)) == 1).all()
    for j in r.integers(1, len(t), 3000):
        a, b = int(sa[j - 1]), int(sa[j])
        k = int(lcp[j])
        assert full[a : a + k] == full[b : b + k] and full[a + k] < full[b + k] if b + k < len(text) and a + k < len(text) else a + k >= len(text)


def brute_repeats(rows, length):
    seen, out = set(), {}
    for i, text in rows:
        raw = (text or "").encode()
        cover = np.zeros(len(raw), bool)
        for a in range(len(raw) - length + 1):
            s = raw[a : a + length]
            if s in seen:
                cover[a : a + length] = True
            seen.add(s)
        kept = np.frombuffer(raw, np.uint8)[~cover].tobytes()
        out[i] = len(raw), int(cover.sum()), int((np.diff(np.append(0, cover.astype(int))) == 1).sum()), hashlib.sha256(kept).hexdigest()
    return out


def test_repeats(docs, pandas_docs, monkeypatch):
    monkeypatch.setattr(repeats, "DEALT_BYTES", 100_000)
    monkeypatch.setattr(repeats, "SHARD_BYTES", 20_000)
    want = brute_repeats(zip(pandas_docs.doc_id, pandas_docs.text, strict=True), 100)
    for parts in (1, 5):  # in one batch, and in five that meet by anchor
        out = repeats.op4(docs.repartition(parts, "doc_id")).collect()
        assert {r.doc_id: tuple(r)[1:] for r in out} == want


def test_repeats_under_a_hot_anchor(spark, monkeypatch, tmp_path):
    # One passage between many different ones: all blocks at its edges are different and have its anchors.
    shard = 8000
    monkeypatch.setattr(repeats, "SHARD_BYTES", shard)
    one = repeats._sorted_out

    def noted(length, memory=400):
        run, folder = one(length, memory), str(tmp_path)

        def count(batches):
            import tempfile

            import pyarrow as pa

            held = [pa.Table.from_batches([b]) for b in batches]
            with tempfile.NamedTemporaryFile("w", dir=folder, delete=False) as f:
                f.write(str(sum(len(raw) for t in held for raw in t.column("raw").to_pylist())))
            yield from run(b for t in held for b in t.to_batches())

        return count

    monkeypatch.setattr(repeats, "_sorted_out", noted)
    r = np.random.default_rng(8)
    text = lambda n: "".join(r.choice(list("abcdefgh ")) for _ in range(n))
    passage, ends = text(125), [text(9) for _ in range(6)]
    rows = [(i, text(110) + ends[i % 6] + passage + ends[i % 5] + text(60)) for i in range(400)]
    out = repeats.deduplicated(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).drop("spans").collect()
    assert {x.doc_id: tuple(x)[1:] for x in out} == brute_repeats(rows, 100)
    assert 0 < max(int(f.read_text()) for f in tmp_path.iterdir()) < 3 * shard


def test_repeats_of_few_letters(spark, monkeypatch):
    one = repeats._sorted_out
    monkeypatch.setattr(repeats, "_sorted_out", lambda length: one(length, 50))
    r = np.random.default_rng(3)
    rows = [(i, "".join(r.choice(list("ab"), r.integers(0, 400)))) for i in range(40)] + [(40, "a" * 500), (41, "b" + "a" * 300), (42, "ab" * 200)]
    out = repeats.deduplicated(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 20, 8).drop("spans").collect()
    assert {x.doc_id: tuple(x)[1:] for x in out} == brute_repeats(rows, 20)


def test_repeats_in_many_documents(spark, monkeypatch):
    # More documents with repeats than ids are broadcast: no join deals all texts out.
    monkeypatch.setattr(repeats, "BROADCAST_IDS", 40)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        r = np.random.default_rng(5)
        text = lambda n: "".join(r.choice(list("abcdefgh ")) for _ in range(n))
        shared = [text(180) for _ in range(30)]
        rows = [(i, text(40) + shared[i % 30] + text(60) if i % 5 == 0 else text(250)) for i in range(500)]
        out = repeats.deduplicated(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).drop("spans")
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert {x.doc_id: tuple(x)[1:] for x in out.collect()} == brute_repeats(rows, 100)
        assert plan.count("BroadcastHashJoin") >= 2 and not re.search(r"SortMergeJoin[^\n]*Left(Semi|Anti)", plan)
        df, found = spark.createDataFrame(rows, "doc long, text string"), spark.createDataFrame([(i,) for i in range(0, 500, 5)], "doc long")
        some, others = ({x.doc for x in repeats._among(found, df, how).collect()} for how in ("left_semi", "left_anti"))
        assert set(range(0, 500, 5)) <= some and len(some) < 250 and some | others == set(range(500)) and not some & others
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_repeats_sorts_what_may_repeat(monkeypatch):
    import pyarrow as pa

    sizes, whole = [], suffix_sort.suffix_array
    monkeypatch.setattr(suffix_sort, "suffix_array", lambda t, memory: sizes.append(len(t)) or whole(t, memory))
    r = np.random.default_rng(6)
    text = lambda n: r.integers(97, 123, n).astype(np.uint8).tobytes()
    shared = text(150)
    raws = [text(130) for _ in range(40)] + [text(200) + shared, shared + text(90), text(99)]
    batch = pa.RecordBatch.from_arrays([pa.array([0] * 43, pa.int64()), pa.array(range(43), pa.int64()), pa.array(range(7, 50), pa.int32()), pa.array(raws, pa.binary())], ["key", "doc", "begin", "raw"])
    assert [tuple(x.values()) for b in repeats._sorted_out(100)([batch]) for x in b.to_pylist()] == [(41, 48, 198)]
    assert sizes == [2 * 151 + 1]
    monkeypatch.setattr(repeats, "TRIM_WINDOWS", 100)
    assert [tuple(x.values()) for b in repeats._sorted_out(100)([batch]) for x in b.to_pylist()] == [(41, 48, 198)]
    assert sizes[1:] == [sum(len(x) + 1 for x in raws) + 1]


def test_importance(spark, data):
    docs, labels = (spark.read.parquet(f"{data}/../sf0.01/{t}.parquet") for t in ("documents", "labels"))
    out = importance.op5(docs, labels).toPandas().merge(labels.toPandas(), on="doc_id")
    assert out[out.quality == 1].kept.mean() > 0.95 and out[out.quality == 0].kept.mean() < 0.35


def test_importance_by_brute_force(docs, pandas_docs, labels):
    one = lambda w: int(textvec.span_hashes(textvec.prefix_hashes(np.frombuffer(w, np.uint8)), np.array([0]), np.array([len(w)]))[0])
    seen = {}
    grams = {}
    for i, text in zip(pandas_docs.doc_id, pandas_docs.text, strict=True):
        h = [seen.setdefault(w, one(w.encode())) for w in lowered(text)]
        two = textvec.mix(np.array(h[:-1], np.uint64) * textvec._BASE + np.array(h[1:], np.uint64)) if len(h) > 1 else np.zeros(0, np.uint64)
        grams[i] = [x % importance.BUCKETS for x in [*h, *map(int, two)]]
    good = {r.doc_id for r in labels.filter("quality = 1").collect()}
    raw, target = collections.Counter(x for g in grams.values() for x in g), collections.Counter(x for i, g in grams.items() if i in good for x in g)
    sizes = {id(c): sum(c.values()) + importance.SMOOTHING * importance.BUCKETS for c in (raw, target)}
    share = lambda c, x: math.log((c[x] + importance.SMOOTHING) / sizes[id(c)])
    ratio = {x: share(target, x) - share(raw, x) for x in raw}
    out = {r.doc_id: r for r in importance.op5(docs, labels).collect()}
    for i, g in grams.items():
        assert out[i].n_grams == len(g) and math.isclose(out[i].log_weight, sum(ratio[x] for x in g), rel_tol=1e-9, abs_tol=1e-6)
    k = round(len(out) * np.mean([r.quality for r in labels.collect()]))
    best = sorted(out.values(), key=lambda r: (-r.gumbel_key, r.doc_id))[:k]
    assert {r.doc_id for r in out.values() if r.kept} == {r.doc_id for r in best}
    # The noise is standard Gumbel: mean 0.577, variance pi^2 / 6.
    noise = np.array([r.gumbel_key - r.log_weight for r in out.values()])
    assert abs(noise.mean() - 0.5772) < 5 * 1.2825 / len(noise) ** 0.5 and 0.5 < noise.var() / (math.pi**2 / 6) < 2


@pytest.mark.parametrize("last", [1 << 16, 2])
def test_top_is_exact(spark, monkeypatch, last):
    monkeypatch.setattr(importance, "BINS", 8)
    monkeypatch.setattr(common, "STEP", 3)
    monkeypatch.setattr(importance, "LAST_CLASSES", last)
    r = np.random.default_rng(0)
    rows = [(None if i % 50 == 0 else int(i % 120), int(i % 3), float(x)) for i, x in enumerate(np.round(r.normal(size=200), 1))] + [(7, 1, 0.1)] * 20 + [(None, 1, 0.3)] * 9
    df = spark.createDataFrame(rows, "doc_id long, n_grams long, k double")
    order = lambda x: (-x[2], -math.inf if x[0] is None else x[0], x[1])
    for k in (0, 1, 17, 90, 100, 110, len(rows) - 1, len(rows), 500):
        out = importance.top(df, "k", k).collect()
        assert collections.Counter(tuple(x)[:3] for x in out) == collections.Counter(rows)
        assert collections.Counter(tuple(x)[:3] for x in out if x.kept) == collections.Counter(sorted(rows, key=order)[:k])


class BruteKatz:
    """Trigram backoff as the docstring of katz.py defines it."""

    def __init__(self, texts, train):
        self.c = [collections.Counter() for _ in range(3)]
        for i in train:
            w = ["<s>", "<s>", *texts[i]]
            self.c[0].update(texts[i])
            self.c[1].update(zip(w[1:], w[2:], strict=False))
            self.c[2].update(zip(w, w[1:], w[2:], strict=False))
        self.n = sum(self.c[0].values())
        self.d = []
        for counts in self.c:
            n = collections.Counter(min(x, katz.K + 2) for x in counts.values())
            self.d.append(katz.discounts(np.array([n[r] for r in range(katz.K + 3)], float)))
        self.unknown = 1 - sum(self.star(0, x) for x in self.c[0].values()) / self.n
        self.total, self.left, self.low = collections.Counter(), collections.Counter(), collections.Counter()
        for order in (1, 2):
            for g, x in self.c[order].items():
                self.total[g[:-1]] += x
                self.left[g[:-1]] += self.star(order, x)
            for g in self.c[order]:
                self.low[g[:-1]] += self.p(g[1:])

    def star(self, order, c):
        return c * self.d[order][c - 1] if c <= katz.K else c - katz.HELD

    def p(self, g):
        """Of the last word of g after the others."""
        if len(g) == 1:
            return self.star(0, self.c[0][g[0]]) / self.n if g[0] in self.c[0] else self.unknown
        if g in self.c[len(g) - 1]:
            return self.star(len(g) - 1, self.c[len(g) - 1][g]) / self.total[g[:-1]]
        h = g[:-1]
        return (1 - self.left[h] / self.total[h]) / (1 - self.low[h]) * self.p(g[1:]) if h in self.total else self.p(g[1:])


def check_katz(rows, out):
    texts = {i: [*lowered(t), "</s>"] for i, t in rows}
    k = BruteKatz(texts, [i for i in texts if zlib.crc32(str(i).encode()) % 5 != 1])
    c1 = k.c[0]
    for h in list(k.total)[:3] + [x for x in k.total if len(x) == 2][:3] + [("never", "never"), ("never",)]:
        assert math.isclose(sum(k.p((*h, w)) for w in c1) + k.p((*h, None)), 1, abs_tol=1e-9)
    assert len(out) == len(texts)
    for r in out:
        w = texts[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(w), sum(x in c1 for x in w), k.n, zlib.crc32(str(r.doc_id).encode()) % 5 == 1)
        assert math.isclose(r.base_score, sum(math.log10((c1[x] + 0.5) / (k.n + 0.5 * (len(c1) + 1))) for x in w), rel_tol=1e-9)
        padded = ["<s>", "<s>", *w]
        assert math.isclose(r.score, sum(math.log10(k.p(g)) for g in zip(padded, padded[1:], padded[2:], strict=False)), rel_tol=1e-9)


def test_katz(docs, pandas_docs, monkeypatch):
    monkeypatch.setattr(katz, "PART_BYTES", 60_000)
    monkeypatch.setattr(katz, "BATCH_TOKENS", 20_000)
    check_katz(list(zip(pandas_docs.doc_id.tolist(), pandas_docs.text, strict=True)), katz.op6(docs).collect())


@pytest.mark.parametrize("hot", [1, 2])
def test_katz_splits_hot_words(spark, monkeypatch, hot):
    # A word that is most of the text, with itself as the most frequent pair.
    monkeypatch.setattr(katz, "PART_BYTES", 400)
    monkeypatch.setattr(katz, "UNIT_PARTS", 1)
    monkeypatch.setattr(katz, "BATCH_TOKENS", 500)
    r = np.random.default_rng(hot)
    rows = [(i, " ".join("a" if r.random() < 0.3 * hot else str(r.choice(["b", "c", f"x{r.integers(40)}"])) for _ in range(r.integers(0, 60)))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    m = katz.model(df)
    assert len(m.deal.split_words) and len(m.deal.pairs)
    check_katz(rows, katz.evaluated(m).collect())


def test_katz_counts_in_rounds(docs, pandas_docs, monkeypatch):
    # No shuffle holds the questions to all partitions at once.
    monkeypatch.setattr(katz, "PART_BYTES", 10_000)
    monkeypatch.setattr(katz, "BATCH_TOKENS", 20_000)
    tables, one = [], katz.stored

    def noted(df, *compression):
        out = one(df, *compression)
        if "asks" in df.columns:
            tables.append({r.part for r in out.select("part").collect()})
        return out

    monkeypatch.setattr(katz, "stored", noted)
    m = katz.model(docs)
    assert len(tables) == katz.COUNT_ROUNDS > 1 and sum(map(len, tables)) == len(set().union(*tables))
    assert m.deal.groups > 4 and max(map(len, tables)) < 0.7 * sum(map(len, tables))
    check_katz(list(zip(pandas_docs.doc_id.tolist(), pandas_docs.text, strict=True)), katz.evaluated(m).collect())


def test_katz_distinct_values(monkeypatch):
    """Places are sorted within the values' own words; only values that differ in nothing but bits that find no room are sorted by places."""
    r, sorts, plain = np.random.default_rng(0), [], np.argsort
    monkeypatch.setattr(np, "argsort", lambda *a, **b: sorts.append(1) or plain(*a, **b))
    hashes, near = r.integers(0, 1 << 64, 5000, dtype=np.uint64), np.arange(3, dtype=np.uint64) | np.uint64(1 << 63)
    for key, slow in ((np.zeros(0, np.int64), 0), (np.array([7]), 0), (r.integers(0, 1 << 36, 9999), 0), (r.integers(0, 50, 9999), 0), (r.choice(hashes, 30000), 0), (r.choice(near, 4000), 1), (np.append(r.choice(hashes, 99), near), 1)):
        sorts.clear()
        value, back = katz._unique(key)
        assert len(sorts) == slow
        want = np.unique(key, return_inverse=True)
        assert value.dtype == key.dtype and value.tolist() == want[0].tolist() and back.tolist() == want[1].tolist()


def test_katz_words_by_use():
    r = np.random.default_rng(1)
    for n in (0, 1, katz.TOP_WORDS, 9000):
        words = np.unique(r.integers(0, 1 << 64, n, dtype=np.uint64))
        used = r.integers(0, max(n, 1), 4 * n)
        packed, code = katz._coded(words, used)
        got, place = katz._placed(packed)
        assert got.tolist() == words.tolist() and place[code].tolist() == list(range(n))


def katz_batch(tokens, words, docs=50):
    r = np.random.default_rng(3)
    hashes = np.unique(r.integers(3, 1 << 64, words, dtype=np.uint64))
    hashes = hashes[(len(hashes) * r.random(tokens) ** 3).astype(np.int64)]
    hashes[tokens // docs - 1 :: tokens // docs] = katz.END
    return katz.Batch.of(list(range(docs)), hashes, np.full(docs, tokens // docs))


def test_katz_messages_in_pieces(monkeypatch):
    # Rows of questions stay small, and come together again, in the order of their keys.
    monkeypatch.setattr(katz, "PIECE", 1000)
    monkeypatch.setattr(katz, "GROUP", 2)
    b = katz_batch(20_000, 3000)
    deal = katz.Deal.of(8, [(int(b.words[5]), 9.0)], [(int(b.words[5]), int(b.words[5]))])
    keys = {g: 10 + g for g in range(deal.groups) if g != 1}
    rows = [r for payload in (b.pack(), katz_batch(500, 90).pack()) for out in katz._dealt(deal, keys)([pa.record_batch([[7 if len(payload) > 9999 else 8], [payload]], ["batch", "payload"])]) for r in out.to_pylist()]
    assert max(len(r["payload"]) for r in rows) == 1000 and max(r["piece"] for r in rows) > 8
    rows.sort(key=lambda r: (r["dest"], r["batch"], r["piece"]))
    t, part, back = b.questions(deal)
    times, seen = np.bincount(back, b.train[b.doc], len(t)), 0
    # Rows come by twos, so messages go over batches' ends.
    for dest, batch, payload in katz._messages(pa.RecordBatch.from_pylist(rows[i : i + 2]) for i in range(0, len(rows), 2)):
        got, n = katz.Trigrams.unpack(payload)
        if batch == 7:
            mine = np.flatnonzero(part // 2 == dest - 10)
            for x in "abw":
                assert got.words[getattr(got, x)].tolist() == t.words[getattr(t, x)[mine]].tolist()
            assert n.tolist() == times[mine].tolist()
        seen += 1
    assert seen == len({(r["dest"], r["batch"]) for r in rows}) and list(katz._messages([])) == []


def test_katz_deals_in_little_memory():
    # A batch is dealt with at most so many bytes a token at once, besides the messages themselves; arrays of a batch's length are 4 or 8 each.
    b = katz_batch(1_000_000, 60_000)
    deal = katz.Deal.of(40, [(int(h), 3.0) for h in b.words[2:40]], [])
    rows, keys = [pa.record_batch([[7], [b.pack()]], ["batch", "payload"])], {g: g for g in range(0, deal.groups, katz.COUNT_ROUNDS)}
    tracemalloc.start()
    for _ in katz._dealt(deal, keys)(rows):
        pass
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 57 * len(b.code)


def test_stored_row_groups(spark):
    # Large values go into row groups of the size that is asked for, so that neither writers nor readers hold a file's values at once.
    df = spark.range(0, 40, 1, 1).select("id", F.expr("cast(repeat(uuid(), 3000) as binary)").alias("payload"))
    out = common.stored(df, "none", 1 << 20)
    meta = [pq.read_metadata(f.removeprefix("file://")) for f in out.inputFiles()]
    sizes = [m.row_group(k).total_byte_size for m in meta for k in range(m.num_row_groups)]
    assert len(sizes) >= 4 and max(sizes) < 1.3 * (1 << 20) and out.count() == 40


def test_katz_tables(spark, docs, pandas_docs):
    # The stored tables hold the model: distributions from them sum to one.
    m = katz.model(docs)
    texts = {i: [*lowered(t), "</s>"] for i, t in zip(pandas_docs.doc_id, pandas_docs.text, strict=True)}
    k = BruteKatz(texts, [i for i in texts if zlib.crc32(str(i).encode()) % 5 != 1])
    h = lambda w: int({"<s>": katz.BOS, "</s>": katz.END}[w] if w in ("<s>", "</s>") else next(textvec.words([(0, w)])).hashes[0])
    got = {}
    for r in m.counts.collect():
        t, n = katz.Trigrams.unpack(bytes(r.counts))
        got |= {(int(t.words[a]), int(t.words[b]), int(t.words[w])): x for a, b, w, x in zip(t.a, t.b, t.w, n.tolist(), strict=True) if x}
    assert got == {tuple(map(h, g)): x for g, x in k.c[2].items()}
    weight = {r.h & (1 << 64) - 1: (r.n, r.weight) for r in m.backoff.collect()}
    for b in list(x for x in k.total if len(x) == 1)[:200]:
        assert weight[h(b[0])][0] == k.total[b]
        assert math.isclose(weight[h(b[0])][1], math.log10((1 - k.left[b] / k.total[b]) / (1 - k.low[b])), rel_tol=1e-9, abs_tol=1e-12)


def test_tiling():
    a = np.arange(1, 21, dtype=np.uint64)
    assert decontaminate.tile(a, a, 5) == [(0, 0, 20)]
    swapped = np.concatenate([a[10:], a[:10]])
    assert sorted(decontaminate.tile(swapped, a, 5)) == [(0, 10, 10), (10, 0, 10)]
    assert decontaminate.tile(a[:4], a, 5) == []
    assert decontaminate.tile(np.concatenate([a[:7], a[:12]]), a[:12], 5) == [(7, 0, 12)]


def test_decontamination(spark, docs, pandas_docs, data):
    bench = spark.read.parquet(f"{data}/benchmark.parquet")
    items = {r.item_id: " ".join(lowered(r.text)) for r in bench.collect()}
    whole = {i for i, t in zip(pandas_docs.doc_id, pandas_docs.text) if any(f" {x} " in f" {' '.join(lowered(t))} " for x in items.values())}
    out = decontaminate.op7(docs, bench).collect()
    assert whole and whole <= {r.doc_id for r in out if r.contaminated}
    words = items[3].split()
    half = len(words) // 2
    moved = spark.createDataFrame([(1, " ".join([*words[half:], "other", *words[:half]])), (2, " ".join(words[:5]))], "doc_id long, text string")
    assert [r.contaminated for r in decontaminate.op7(moved, bench).orderBy("doc_id").collect()] == [True, False]


def brute_tiling(doc, item, least=5):
    """Coverage by the longest matches first, word by word."""
    used_d, used_t, total = set(), set(), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(doc)):
            for j in range(len(item)):
                k = 0
                while i + k < len(doc) and j + k < len(item) and doc[i + k] == item[j + k] and i + k not in used_d and j + k not in used_t:
                    k += 1
                best = max(best, (k, -i, -j))
        if best[0] < least:
            return total / len(item)
        k, i, j = best[0], -best[1], -best[2]
        used_d |= set(range(i, i + k))
        used_t |= set(range(j, j + k))
        total += k


@pytest.mark.parametrize("broadcast", [True, False])
def test_decontamination_is_exact(spark, monkeypatch, broadcast):
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", 1 << 20 if broadcast else 0)
    monkeypatch.setattr(decontaminate, "ITEM_BLOCK", 3)
    r = np.random.default_rng(5)
    opening = ["all", "items", "begin", "like", "this", "one", "here"]
    items = [(i, opening[: r.integers(0, 8)] + [f"w{r.integers(12)}" for _ in range(r.integers(6, 16))]) for i in range(40)] + [(40, ["two", "words"]), (3, ["a", "b", "c", "d", "e", "f"])]
    docs = [(i, opening[: r.integers(0, 8)] + [x for _ in range(r.integers(0, 3)) for k in [r.integers(40)] for lo in [r.integers(0, 6)] for x in items[k][1][lo : lo + r.integers(4, 14)]] + [f"w{r.integers(12)}" for _ in range(r.integers(0, 6))]) for i in range(80)]
    docs += [(100, ["two", "words"]), (101, ["two", "words", "more"]), (102, [])]
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items] + [(7, None), (None, "")], "item_id long, text string")
    out = decontaminate.op7(spark.createDataFrame([(i, " ".join(w)) for i, w in docs] + [(103, None)], "doc_id long, text string").repartition(4), bench).collect()
    got = {x.doc_id: (x.item_id, round(x.coverage, 9), x.n_items) for x in out}
    want = {103: (None, 0.0, 0)}
    for i, w in docs:
        all_ = [(brute_tiling(w, t), k) if len(t) >= 5 else (float(w == t), k) for k, t in sorted(items)]
        hit = [x for x in all_ if x[0] >= 0.5]
        best = max(hit, key=lambda x: x[0]) if hit else (0.0, None)
        want[i] = (best[1], round(best[0], 9), len(hit))
    assert got == want and 10 < sum(v[0] is not None for v in got.values()) < 80


def test_shared_openings_pair_nothing():
    rows = [(i, f"please answer the question below {' '.join(f'i{i}w{k}' for k in range(45))}") for i in range(300)]
    items = decontaminate.Items(rows, 5, 0.5)
    w = next(decontaminate.words([(0, "please answer the question below my own text goes on and on here")]))
    assert items.best(w) == [(None, 0.0, [], 0, 0)]
    assert not np.isin(decontaminate.runs(w.hashes, 5), items.seeds).any()


def test_decontamination_in_any_case(spark):
    items = [(1, "Doesbo dora el ñ es, queasarjarr mente, ciónmiírr asesrr ños ueíos."), (2, "La. Éai «éonleeau» pour an éonqueê aivi ai, straße éoiré"), (3, "Paí.")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    shouted = [" ".join(w + "!!" for w in t.upper().split()) for _, t in items]
    rows = [*enumerate(shouted), (3, unicodedata.normalize("NFD", shouted[0])), (4, "Doesbo — dora | el ñ es queasarjarr"), (5, "pai"), (6, "... !! «»"), (7, None), (8, "(PAÍ) x")]
    out = {r.doc_id: (r.item_id, r.coverage) for r in decontaminate.op7(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert out == {0: (1, 1.0), 1: (2, 1.0), 2: (3, 1.0), 3: (1, 1.0), 4: (1, 6 / 11), 5: (None, 0.0), 6: (None, 0.0), 7: (None, 0.0), 8: (None, 0.0)}


def test_normal_form():
    texts = ["¿Qué? “ÉÉ”... a—b it’s 日本。 😀x 😀 \U0001d400 _z_ $5", "", None, "  ", "Ünï—", "—"]
    for limit in (1, 1 << 20):
        got = [w.data[s:e].tobytes().decode() for w in decontaminate.words(enumerate(texts), limit) for s, e in zip(w.start, w.end, strict=True)]
        assert got == ["qué", "éé", "a—b", "it’s", "日本", "x", "\U0001d400", "z", "5", "ünï"]


def test_network_gradients():
    r, net = np.random.default_rng(0), toxicity.Network()
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    mask = np.ones((7, 6))
    mask[4:, 2] = 0
    b = {"word": np.array([3, 0, 7, 3]), "gram": np.array([1, 2, 3, 2, 5, 9]), "first": np.array([0, 2, 3, 5, 6]), "odds": r.normal(size=(4, toxicity.N_ODDS)), "at": r.integers(0, 4, (7, 6)), "mask": mask, "doc": np.array([0, 0, 1, 2, 2, 2]), "y": np.array([0, 1, 1.0])}
    _, g = net.gradients(b)
    for k in ("words", "chars"):
        full = np.zeros_like(net.p[k])
        full[g[k][0]] = g[k][1]
        g[k] = full
    for k, v in net.p.items():
        for _ in range(4):
            i = (int(r.choice([0, 1, 2, 3, 5, 7, 9])), int(r.integers(v.shape[1]))) if k in ("words", "chars") else tuple(r.integers(0, s) for s in v.shape)
            old, step = v[i], 1e-5
            v[i] = old + step
            up = net.gradients(b)[0]
            v[i] = old - step
            down = net.gradients(b)[0]
            v[i] = old
            assert abs((up - down) / 2 / step - g[k][i]) < 1e-6, k


def test_network_runs_in_single_precision():
    r, net = np.random.default_rng(1), toxicity.Network()
    odds = r.normal(size=(4, toxicity.N_ODDS)).astype(np.float32)
    b = {"word": np.array([3, 0, 7, 3]), "gram": np.array([1, 2, 3, 2, 5, 9]), "first": np.array([0, 2, 3, 5, 6]), "odds": odds, "at": r.integers(0, 4, (7, 6)), "mask": np.ones((7, 6), np.float32), "doc": np.array([0, 0, 1, 2, 2, 2]), "y": np.array([0, 1, 1], np.float32)}
    proj = net.projected(net.inputs(b["word"], b["gram"], b["first"], odds))
    logit, _ = net.forward(proj, b["at"], b["mask"])
    assert proj.dtype == logit.dtype == np.float32
    _, g = net.gradients(b)
    assert all(g[k].dtype == np.float32 for k in ("w", "c", "u", "a", "ac", "v", "o", "oc"))


def test_toxicity_tables_leave_a_document_out():
    r, tables = np.random.default_rng(2), toxicity.Tables()
    tables.seen[:, :, :50] = r.integers(0, 4, (3, 2, 50))
    tables.docs[:] = 30, 10
    tables.finish()
    for label in (0, 1):
        left = tables.without(label)
        for k, b in ((k, b) for k in range(3) for b in range(50) if tables.seen[k, label, b]):
            p, q = int(tables.seen[k, 1, b]) - label, int(tables.seen[k, 0, b]) - (1 - label)
            rate = (p + toxicity.SHRINK * 0.25) / (p + q + toxicity.SHRINK)
            assert abs(left.odds[k, b] - math.log(rate / (1 - rate)) - math.log(3)) < 1e-5 and left.any[k, b] == (p + q > 0)


def plain_score(model, text):
    """The network as the docstring of toxicity.py tells it, one number at a time."""
    import io

    z = {k: v.astype(float) if v.dtype.kind == "f" else v for k, v in np.load(io.BytesIO(model)).items()}
    h, known, sigmoid = toxicity.HIDDEN, set(z["known"].tolist()), lambda x: 1 / (1 + math.exp(-x))
    one = lambda b: int(textvec.span_hashes(textvec.prefix_hashes(np.frombuffer(b, np.uint8)), np.array([0]), np.array([len(b)]))[0])
    mixed = lambda x, k: int(textvec.mix(np.array([(x + k) % (1 << 64)], np.uint64))[0])
    rows = []
    for word in lowered(text):
        b, x = word.encode(), []
        own = one(b)
        x += z["words"][1 + mixed(own, 0) % (toxicity.WORD_ROWS - 1) if own in known else 0].tolist()
        grams = [b[i : i + 3] for i in range(len(b) - 2)] or [b]
        x += np.mean([z["chars"][mixed(one(t), 3) % toxicity.CHAR_ROWS] for t in grams], 0).tolist()
        odds, seen = z["odds"], z["any"]
        x += [odds[0, own % toxicity.TABLE], float(seen[0, own % toxicity.TABLE])]
        for k, parts in ((1, [b[:n] for n in toxicity.PREFIXES if len(b) >= n]), (2, [b[i : i + toxicity.INNER] for i in range(len(b) - toxicity.INNER + 1)])):
            lean = [odds[k, mixed(one(t), k) % toxicity.TABLE] for t in parts]
            x += [max(lean), sum(lean) / len(lean)] if lean else [0.0, 0.0]
        rows.append(np.array([*x, min(len(b), 40) / 10]))
    best = 0.0
    for begin in range(0, max(len(rows) - toxicity.WINDOW, 0) + toxicity.STRIDE, toxicity.STRIDE):
        win = rows[begin : begin + toxicity.WINDOW]
        if not win or (begin and begin + toxicity.WINDOW - toxicity.STRIDE >= len(rows)):
            continue
        states = [[None] * len(win), [None] * len(win)]
        for d in (0, 1):
            state = np.zeros(h)
            for t in range(len(win)) if d == 0 else range(len(win) - 1, -1, -1):
                x, hu = win[t] @ z["w"][d] + z["c"][d][0], state @ z["u"][d]
                zr = [sigmoid(v) for v in x[: 2 * h] + hu[: 2 * h]]
                new = [math.tanh(x[2 * h + i] + zr[h + i] * hu[2 * h + i]) for i in range(h)]
                state = states[d][t] = np.array([zr[i] * state[i] + (1 - zr[i]) * new[i] for i in range(h)])
        hs = [np.concatenate([a, b]) for a, b in zip(*states, strict=True)]
        s = np.array([np.tanh(x @ z["a"] + z["ac"]) @ z["v"] for x in hs])
        w = np.exp(s - s.max())
        best = max(best, sigmoid(float((w / w.sum()) @ np.array(hs) @ z["o"] + z["oc"][0])))
    return best


def test_toxicity_scores_by_brute_force(spark, data, pandas_docs, docs, labels):
    model = toxicity.model(docs, labels)
    assert model and model == toxicity.model(docs, labels)
    got = {r.doc_id: r.score for r in toxicity.op8(docs, labels).collect()}
    some = [(i, t) for i, t in zip(pandas_docs.doc_id, pandas_docs.text, strict=True) if len(lowered(t)) < 400][:40]
    assert max(len(lowered(t)) for _, t in some) > 128
    assert all(abs(plain_score(model, t) - got[i]) < 1e-4 for i, t in some)


def test_windows_cover_all_words():
    first = np.array([0, 0, 1, 64, 129, 400])
    text, at, mask = toxicity.windows(first)
    for i in range(5):
        assert set(at[text == i][mask[text == i] > 0].tolist()) == set(range(first[i], first[i + 1]))


def test_toxicity(spark):
    r = np.random.default_rng(2)
    calm, rude = [f"word{i}" for i in range(200)], ["idiot", "moron", "scum"]
    rows, marks = [], []
    for i in range(400):
        words, bad = list(r.choice(calm, r.integers(5, 150))), i % 5 == 0
        if bad:
            words[r.integers(len(words))] = str(r.choice(rude))
        rows.append((i, " ".join(words)))
        marks.append((i, 1, int(bad)))
    d, m = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality long, toxic long")
    out = toxicity.op8(d, m).toPandas().merge(m.toPandas(), on="doc_id")
    test = out[out.held_out]
    assert len(test) > 50 and (test.predicted == test.toxic).mean() > 0.95
    assert (out.held_out == out.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)).all()


def components_of(pairs):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def test_components(spark):
    r = np.random.default_rng(4)
    pairs = [(int(a), int(b)) for a, b in r.integers(0, 60, (45, 2))] + [(i, i + 1) for i in range(100, 140)]
    got = {x.id: x.root for x in graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = components_of([p for p in pairs if p[0] != p[1]])
    assert got == want


def test_components_of_few_edges_take_few_files_and_rounds(spark, monkeypatch):
    files = []

    def recorded(df, **options):
        files.append(len((out := common.stored(df, **options)).inputFiles()))
        return out

    monkeypatch.setattr(graph, "stored", recorded)
    options = {"spark.sql.shuffle.partitions": "48", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in options}
    pairs = [(i, i + 1) for i in range(200)] + [(1000, i) for i in range(1001, 1200)]
    stars = [(i, i % 7) for i in range(7, 300)]
    try:
        for k, v in options.items():
            spark.conf.set(k, v)
        got = {x.id: x.root for x in graph.components(spark.createDataFrame(pairs, "a long, b long"), rows=len(pairs)).collect()}
        assert got == components_of(pairs) and max(files) == 1
        # Edges of more than one task's rows still come out whole.
        monkeypatch.setattr(common, "FILE_ROWS", 150)
        files.clear()
        got = {x.id: x.root for x in graph.components(spark.createDataFrame(pairs, "a long, b long"), rows=len(pairs)).collect()}
        assert got == components_of(pairs) and 1 < max(files) <= 6
        # Stars are settled as they are: the first round shows it.
        files.clear()
        got = {x.id: x.root for x in graph.components(spark.createDataFrame(stars, "a long, b long")).collect()}
        assert got == components_of(stars) and len(files) == 4
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def check_links(spark, rows, n):
    sets = {}
    for i, t in rows:
        w = lowered(t)
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = components_of(pairs)
    for r in near_dedup.clusters(spark.createDataFrame(rows, "doc_id long, text string"), n).collect():
        assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), want.get(r.doc_id, r.doc_id)) and r.kept == (r.component_id == r.doc_id)
    return pairs


def test_near_duplicates(spark, pandas_docs):
    rows = list(zip(pandas_docs.doc_id.tolist(), pandas_docs.text, strict=True))
    assert check_links(spark, rows, 2) and check_links(spark, rows, 5)


def test_near_duplicates_filter_rarely_overrules_the_distance():
    n, extra, distance, far = near_dedup.SYMBOLS, near_dedup.EXTRA, near_dedup.DISTANCE, near_dedup.FAR
    p = lambda n, k: math.comb(n, k) * 0.2**k * 0.8 ** (n - k)
    by_distance = sum(p(n, k) for k in range(distance + 1, n + 1))
    by_filter = sum(p(n, k) * sum(p(extra, j) for j in range(far - k + 1, extra + 1)) for k in range(distance + 1))
    assert by_filter < 0.2 * by_distance
    a, b = ((np.zeros((1, n), np.uint16), np.zeros((1, extra), np.uint8)) for _ in range(2))
    b[0][0, :distance], b[1][0, : 118 - distance] = 1, 1
    assert near_dedup._near(a, b).all()


def test_near_duplicates_of_one_template(spark, monkeypatch):
    # A chain of variants around the threshold: many buckets with members in different components, compared in small blocks.
    monkeypatch.setattr(near_dedup, "BLOCK", 20)
    monkeypatch.setattr(near_dedup, "REGION_BLOCK", 20)
    r = np.random.default_rng(6)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(150):
        w = list(base)
        for k in r.choice(120, r.integers(0, 16), replace=False):
            w[k] = f"e{r.integers(0, 40)}"
        rows.append((i, " ".join(w)))
    assert check_links(spark, rows, 2)


def test_near_duplicates_of_repeated_ids(spark):
    base = [f"w{i}" for i in range(300)]
    other = [f"v{i}" for i in range(300)]
    one, two = " ".join(base), " ".join(other)
    rows = [(1, one), (1, two), (2, one + " x"), (3, two + " y"), (4, "alone in this"), (5, two), (6, "p q"), (6, "r s"), (7, "r s"), (8, None), (8, one)]
    out = {(r.doc_id, r.n_shingles): (r.component_id, r.kept) for r in near_dedup.clusters(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()}
    assert out == {(1, 299): (1, True), (2, 300): (1, False), (3, 300): (1, False), (4, 2): (4, True), (5, 299): (1, False), (6, 1): (6, True), (7, 1): (6, False), (8, 0): (1, False), (8, 299): (1, False)}


def test_templates_are_not_compared_in_pairs(spark, monkeypatch):
    # Two thirds of each text is one template, the rest its own: no link, and no document left to compare.
    seen = []
    one = near_dedup._mixed

    def noted(members):
        out = one(members)
        seen.append(out[0].count())
        return out

    monkeypatch.setattr(near_dedup, "_mixed", noted)
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(base + [f"own{i}x{k}" for k in range(100)])) for i in range(60)]
    assert check_links(spark, rows, 2) == [] and seen[0] > 60 and seen[-1] == 0


def test_encoder(docs, pandas_docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(token_output.TOKENIZER))
    odd = ["a  b", " \n  z ", "<|endoftext|> a<|endoftext|>b", "it's we 're 's", "", "　 a 　b", "tab\t x  \n\n y", "é è  ñ", "\x1c a \x1fb \x85 c", "x\ny\n\nz\n", " \nq", "日本\n語 x"]
    e = token_output.Encoder(token_output.TOKENIZER)
    for texts in (odd, pandas_docs.text.tolist()):
        for rows, data, bounds in textvec.buffers(enumerate(texts)):
            ids, at = e.encode(data, bounds)
            for k, i in enumerate(rows):
                assert ids[at[k] : at[k + 1]].tolist() == t.encode(texts[i], add_special_tokens=False).ids


def test_token_output(spark, docs, pandas_docs, tmp_path, monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_output, "BLOCK_BYTES", 20_000)
    t = Tokenizer.from_file(public_tokenizers.path(token_output.TOKENIZER))
    want = [[*x.ids, 2] for x in t.encode_batch(pandas_docs.text.tolist(), add_special_tokens=False)]
    token_output.write_tokens(docs, str(tmp_path / "t"))
    out = token_output.read_index(spark, str(tmp_path / "t")).orderBy("doc_id").collect()
    start = 0
    for r, i, ids in zip(out, pandas_docs.doc_id, want, strict=True):
        assert tuple(r) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    dictionary = bytes(spark.read.parquet(str(tmp_path / "t" / "dictionary")).first()[0])
    block = token_output.Block(bytes(spark.read.parquet(str(tmp_path / "t" / "blocks")).filter("part = 0 and block = 1").first().payload), dictionary)
    k = pandas_docs.doc_id.tolist().index(block.doc_ids[2])
    assert block[2].tolist() == want[k]
    with pytest.raises(ValueError):
        token_output.Block(block.payload, dictionary + b"x")


def test_word_rules(spark):
    text = "a b \x1c c\t\n\x0bd\re \x85"
    df = spark.createDataFrame([(text,), (None,)], "t string").select(common.word_array(F.col("t")).alias("w"), common.word_count(F.col("t")).alias("n")).collect()
    assert df[0].w == WORD.findall(text) and df[0].n == len(df[0].w) and df[1].w == [] and df[1].n == 0
    w = next(textvec.words([(0, text), (1, None), (2, "X y")]))
    assert [w.data[s:e].tobytes().decode() for s, e in zip(w.start, w.end, strict=True)] == [x.translate(LOWER) for x in WORD.findall(text)] + ["x", "y"]
    assert w.first.tolist() == [0, len(df[0].w), len(df[0].w), len(df[0].w) + 2]
