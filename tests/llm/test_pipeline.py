"""The pipeline against brute-force versions of its stages, each on what the one before kept."""

import collections
import re
import zlib

import numpy as np

import corpus_pipeline

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return WORD.findall(text or "")


def passes(text):
    w, at, hit = words(text), collections.defaultdict(list), set()
    for k in range(len(w) - 2):
        at[tuple(w[k : k + 3])].append(k)
    for places in at.values():
        if len(places) > 1:
            hit |= {p + j for p in places for j in range(3)}
    return len(w) >= 50 and 100 * len(hit) <= 50 * len(w)


def representatives(rows):
    sets, root = {}, {}
    for i, t in rows:
        w = words((t or "").translate(LOWER))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
        root[i] = i

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i for i in ids if find(i) == i}


def coverage(doc, item):
    """Greedy string tiling, word by word."""
    least, used_d, used_t, total = min(5, len(item)), set(), set(), 0
    while item:
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
    return 0.0


def test_stages(spark, data, pandas_docs):
    stages = [f for _, f in corpus_pipeline.STAGES]
    docs = spark.read.parquet(f"{data}/documents.parquet")
    text = dict(zip(pandas_docs.doc_id, pandas_docs.text, strict=True))

    one = stages[0](spark, docs, data).cache()
    kept = {r.doc_id for r in one.collect()}
    assert one.columns == docs.columns and kept == {i for i, t in text.items() if passes(t)}

    two = stages[1](spark, one, data).cache()
    left = {r.doc_id for r in two.collect()}
    assert two.columns == docs.columns and left == representatives([(i, text[i]) for i in sorted(kept)])

    three = stages[2](spark, two, data).cache()
    clean = {r.doc_id for r in three.collect()}
    items = [words(r.text.translate(LOWER)) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    runs = [{tuple(i[k : k + 5]) for k in range(len(i) - 4)} for i in items]
    bad = set()
    for i in left:
        w = words(text[i].translate(LOWER))
        mine = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
        if any(mine & r and coverage(w, item) >= 0.5 for item, r in zip(items, runs, strict=True)):
            bad.add(i)
    assert three.columns == docs.columns and bad and clean == left - bad

    four = stages[3](spark, three, data).cache()
    copies = collections.Counter(r.doc_id for r in four.collect())
    assert four.columns == docs.columns and set(copies) <= clean and max(copies.values()) <= 2
    size = {i: len(words(text[i])) for i in clean}
    source = dict(zip(pandas_docs.doc_id, pandas_docs.source, strict=True))
    names = sorted({source[i] for i in clean})
    total = np.array([sum(size[i] for i in clean if source[i] == s) for s in names], float)
    weight, free, target = np.array([(5, 2, 1)[k % 3] for k in range(len(names))], float), np.ones(len(names), bool), np.zeros(len(names))
    while True:
        target[free] = (1.5 * total.sum() - target[~free].sum()) * weight[free] / weight[free].sum()
        over = free & (target > 2 * total)
        if not over.any():
            break
        target[over], free = 2 * total[over], free & ~over
    taken = np.array([sum(size[i] * n for i, n in copies.items() if source[i] == s) for s in names], float)
    assert (abs(taken - target) <= np.maximum(0.05 * target, 50)).all()

    five = stages[4](spark, four, data).collect()
    assert collections.Counter(r.doc_id for r in five) == copies
    shards = collections.Counter(r.shard for r in five)
    assert max(shards.values()) - min(shards.values()) <= 1
    assert sorted((r.shard, r.slot) for r in five) == [(s, k) for s in sorted(shards) for k in range(shards[s])]
    assert all(r.text_crc32 == zlib.crc32(r.text.encode()) and r.text == text[r.doc_id] for r in five)


def test_run(spark, data):
    out = corpus_pipeline.run(spark, data)
    again = corpus_pipeline.run(spark, data)
    rows = lambda df: sorted((r.doc_id, r.shard) for r in df.collect())
    assert rows(out) == rows(again) and out.count() > 0
