"""Every operator and stage on odd rows, no rows, and extra columns whose names clash with its own."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from quern.llm import decontaminate, importance, katz, mixing, near_dedup, quality_rules, repeats, sharding, textvec, token_output, toxicity

BENCH = "item_id long, text string, extra string"
CLASH = ["size", "curve", "shard", "slot", "copies", "rate", "n_words", "kept", "base_failed", "host_rate", "coverage", "score", "__item", "__hash", "rep", "key", "id", "doc", "begin", "end", "Text2", "batch"]


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, " ".join(f"word{i}" for i in range(20)), "x"), (2, None, None), (None, "", "y"), (3, "single", "z"), (1, "a b", "x")], BENCH)


def ops(labels, bench):
    return {
        "op1": sharding.op1, "op2": mixing.op2, "op3": quality_rules.op3, "op4": repeats.op4, "op5": lambda d: importance.op5(d, labels), "op6": katz.op6,
        "op7": lambda d: decontaminate.op7(d, bench), "op8": lambda d: toxicity.op8(d, labels), "op9": near_dedup.op9, "op10": token_output.op10,
    }


NAMES = [f"op{n}" for n in range(1, 11)]
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def bag(rows):
    return collections.Counter(tuple("NULL" if v is None or v != v else round(float(v), 9) if isinstance(v, float) else v for v in r) for r in rows)


def repeats_of(rows, length=100):
    """Of rows in (doc_id, text) order, nulls first."""
    seen, out = set(), []
    for r in sorted(rows, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text is not None, r.text or "")):
        raw = (r.text or "").encode()
        cover = bytearray(len(raw))
        for a in range(len(raw) - length + 1):
            s = raw[a : a + length]
            if s in seen:
                cover[a : a + length] = b"\1" * length
            seen.add(s)
        kept = bytes(b for b, c in zip(raw, cover, strict=True) if not c)
        out.append((r.doc_id, len(raw), sum(cover), len(re.findall(b"\1+", bytes(cover))), hashlib.sha256(kept).hexdigest()))
    return out


def clusters_of(rows):
    root = {i: i for i in range(len(rows))}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = []
    for r in rows:
        w = words(r.text)
        sets.append({tuple(w[k : k + 2]) for k in range(len(w) - 1)} if len(w) >= 2 else {tuple(w)} if w else set())
    for i, a in enumerate(rows):
        for j in range(i):
            b = rows[j]
            if a.doc_id is None or b.doc_id is None:
                continue
            if a.doc_id == b.doc_id or (sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r.doc_id is not None:
            least[find(i)] = min(least.get(find(i), r.doc_id), r.doc_id)
    return [(r.doc_id, len(sets[i]), least.get(find(i)), r.doc_id == least.get(find(i)) if r.doc_id is not None else True) for i, r in enumerate(rows)]


def tokens_of(rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    t, start, out = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0, []
    hashed = lambda x: 42 if x is None else int(np.uint64(xxhash.xxh64_intdigest(x.encode(), 42)).astype(np.int64))
    for r in sorted(rows, key=lambda r: (r.doc_id is not None, r.doc_id or 0, hashed(r.text))):
        ids = [*t.encode(r.text or "", add_special_tokens=False).ids, 2]
        out.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def quality_of(rows):
    out = []
    for r in rows:
        text = r.text or ""
        w, at, hit = WORD.findall(text), collections.defaultdict(list), set()
        for k in range(len(w) - 2):
            at[tuple(w[k : k + 3])].append(k)
        for places in at.values():
            if len(places) > 1:
                hit |= {p + j for p in places for j in range(3)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        out.append((r.doc_id, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w)))
    return out


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows(spark, odd, odd_labels, bench, name):
    """Values on nulls, empty and long texts, ties and repeated rows, against brute force."""
    rows, df = odd.collect(), ops(odd_labels, bench)[name](odd)
    out = df.collect()
    got = lambda *columns: bag([tuple(r[c] for c in columns) for r in out])
    assert got("doc_id") == bag([(r.doc_id,) for r in rows])
    if name == "op1":
        assert got("doc_id", "size", "text_crc32") == bag([(r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in rows])
        shards = collections.Counter(r.shard for r in out)
        assert max(shards.values()) - min(shards.values()) <= 1 and {(r.shard, r.slot) for r in out} == {(s, k) for s, n in shards.items() for k in range(n)}
    elif name == "op2":
        size, of = [len(WORD.findall(r.text or "")) for r in rows], collections.Counter()
        for r, n in zip(rows, size, strict=True):
            of[r.source] += n
        assert got("doc_id", "size", "source_size") == bag([(r.doc_id, n, of[r.source]) for r, n in zip(rows, size, strict=True)])
        assert sum({(r.source_size, r.target): r.target for r in out}.values()) <= 1.5 * sum(size) + 1e-6 and all(r.taken == r.copies * r.size and 0 <= r.copies <= 2 for r in out)
    elif name == "op3":
        assert got("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == bag(quality_of(rows)) and not any(r.kept and r.base_failed for r in out)
    elif name == "op4":
        assert got("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == bag(repeats_of(rows))
    elif name == "op5":
        ratio = importance.log_ratio(odd, odd_labels)
        want = []
        for r in rows:
            w = [x.encode() for x in words(r.text)]
            h = [int(textvec.span_hashes(textvec.prefix_hashes(np.frombuffer(x, np.uint8)), np.array([0]), np.array([len(x)]))[0]) for x in w]
            grams = h + [int(textvec.mix(np.array([a], np.uint64) * textvec._BASE + np.array([b], np.uint64))[0]) for a, b in zip(h, h[1:], strict=False)]
            want.append((r.doc_id, len(grams), float(sum(ratio[g % importance.BUCKETS] for g in grams))))
        key = lambda x: tuple("" if v is None else round(v, 6) if isinstance(v, float) else v for v in x)
        assert sorted(map(str, map(key, [(r.doc_id, r.n_grams, r.log_weight) for r in out]))) == sorted(map(str, map(key, want)))
        assert sum(r.kept for r in out) == round(len(rows) * 0.6)
    elif name == "op6":
        w = [[*words(r.text), "</s>"] for r in rows]
        held = [zlib.crc32(b"" if r.doc_id is None else str(r.doc_id).encode()) % 5 == 1 for r in rows]
        c = collections.Counter(x for t, h in zip(w, held, strict=True) if not h for x in t)
        n = sum(c.values())
        base = [round(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (len(c) + 1))) for x in t), 6) for t in w]
        assert bag([(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out]) == bag([(r.doc_id, h, len(t), sum(x in c for x in t), n, b) for r, h, t, b in zip(rows, held, w, base, strict=True)])
        assert all(r.score < 0 for r in out)
    elif name == "op7":
        whole = " ".join(f"word{i}" for i in range(20))
        assert got("doc_id", "item_id", "coverage") == bag([(r.doc_id, 1, 1.0) if whole in (r.text or "") or r.doc_id == 8 else (r.doc_id, 3, 1.0) if r.text == "single" else (r.doc_id, 1, 0.95) if r.doc_id == 1 << 40 else (r.doc_id, None, 0.0) for r in rows])
    elif name == "op8":
        assert all(r.score == 0 and r.predicted == 0 for r in out if not words({x.doc_id: x.text for x in rows}[r.doc_id]) and r.doc_id is not None) and all(0 <= r.score <= 1 for r in out)
        assert got("doc_id", "held_out") == bag([(r.doc_id, zlib.crc32(b"" if r.doc_id is None else str(r.doc_id).encode()) % 4 == 2) for r in rows])
    elif name == "op9":
        assert got("doc_id", "n_shingles", "component_id", "kept") == bag(clusters_of(rows))
    else:
        assert got("doc_id", "start", "n_tokens", "ids_crc32") == bag(tokens_of(rows))


@pytest.mark.parametrize("name", NAMES)
def test_no_rows(empty, odd_labels, bench, name):
    assert ops(odd_labels.limit(0), bench.limit(0))[name](empty).count() == 0


@pytest.mark.parametrize("name", NAMES)
def test_clashing_columns(odd, odd_labels, bench, name):
    wide = odd.select("*", *[F.lit("other").alias(c) for c in CLASH])
    f = ops(odd_labels, bench)[name]
    a, b = f(odd).collect(), f(wide).collect()
    skip = {"taken", "copies", "kept"} if name == "op2" else set()
    assert bag([tuple(v for k, v in r.asDict().items() if k not in skip) for r in a]) == bag([tuple(v for k, v in r.asDict().items() if k not in skip) for r in b])


@pytest.mark.parametrize("stage", [n for n, _ in corpus_pipeline.STAGES])
def test_stages(spark, odd, empty, bench, tmp_path, stage):
    """Every stage returns its input's rows with all their columns, however these are named."""
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    f, last = dict(corpus_pipeline.STAGES)[stage], stage == corpus_pipeline.STAGES[-1][0]
    wide = odd.select("*", *[F.lit(f"its {c}").alias(c) for c in CLASH])
    out = f(spark, wide, str(tmp_path))
    assert last or out.columns == wide.columns
    rows, plain = out.collect(), odd.collect()
    name = {c: f"input_{c}" if last and c in sharding.ADDED else c for c in wide.columns}
    assert all(r[name[c]] == f"its {c}" for r in rows for c in CLASH)
    got, all_ = (collections.Counter((r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in x) for x in (rows, plain))
    if stage == "quality rules":
        good = [r for r, q in zip(plain, quality_of(plain), strict=True) if not q[-1]]
        assert set(got) <= {(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in good}
    elif stage == "near-duplicates":
        # Five-word shingles: the copies of doc -5 go, texts without words and null doc_ids stay.
        assert got == collections.Counter({k: n for k, n in all_.items() if k[0] not in (1, 2, 1 << 40) or (k[0] == 1 << 40 and not got[k] == 0)})
        assert not any(k[0] in (1, 2) for k in got) and any(k[0] == -5 for k in got)
    elif stage == "benchmark decontamination":
        assert got == collections.Counter({k: n for k, n in all_.items() if k[0] not in (1, 2, -5, 7, 8, 1 << 40)})
    elif stage == "mixing":
        assert all(n <= 2 * all_[k] for k, n in got.items())
    else:
        assert got == all_
    assert f(spark, empty, str(tmp_path)).count() == 0
