"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained and run in numpy.

Inputs of a word: a learned vector of the word itself, the mean of learned vectors of its character trigrams, and how the word and its character n-grams
(prefixes of several lengths, and inner ones) lean in the training documents, as shrunk log odds from hashed tables, with its length and whether it was seen. Words that fewer than
MIN_DOCS training documents hold share one vector, so that none is learned by heart. A linear layer feeds the inputs to two GRUs, one in each direction; attention over the steps
pools their states into one logit a window. Windows are of WINDOW words, every STRIDE words; a text's score is the highest of all its windows, so nothing of a long text is left out.

Training uses labelled documents, never held-out ones, in one task: the TRAIN_DOCS of least hash among those of up to TRAIN_DOC_BYTES. All their windows take part:
a document's logit is the soft maximum (log sum of exponentials) of its windows', and the loss is of the document's label. Every input from the tables leaves the document's own
label out. Matrices are trained by Adam, vectors by Adagrad. The model is a few MB whatever the input, and scoring is a map over the documents: no shuffle.

Defined cases: null or wordless texts score 0; a null doc_id or repeated rows are scored each by itself; without labels of both kinds all score 0;
an empty table gives no rows; columns other than doc_id and text are not read, whatever their names.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textvec
from .common import bounded_batches

TRAIN_DOCS = 6000
TRAIN_DOC_BYTES = 1 << 16
WINDOW, STRIDE = 64, 32
HIDDEN = 8
EMBED = 8
WORD_ROWS = CHAR_ROWS = 1 << 15
MIN_DOCS = 3
TABLE = 1 << 18
SHRINK = 3.0
PREFIXES = range(4, 10)
INNER = 5
TRIGRAM = 3
THRESHOLD = 0.3
EPOCHS, RATE, VECTOR_RATE, BATCH = 5, 0.01, 0.05, 768
#: Bytes that training and scoring keep between steps.
HELD_BYTES = 128 << 20
#: Sharpness of the soft maximum over a document's windows.
SHARP = 3.0
N_ODDS = 7
N_INPUTS = 2 * EMBED + N_ODDS


def _odds(p: np.ndarray, n: np.ndarray, prior: float) -> np.ndarray:
    """Shrunk log odds of label 1 given presence, less the prior's; 0 for what was never seen."""
    rate = (p + SHRINK * prior) / (p + n + SHRINK)
    return np.log(rate / (1 - rate)) - np.log(prior / (1 - prior))


def _buckets(data: np.ndarray, prefix: np.ndarray, start: np.ndarray, end: np.ndarray):
    """For each input kind: (owner index into the spans, bucket)."""
    mask = np.uint64(TABLE - 1)
    size = end - start
    yield np.arange(len(start)), textvec.span_hashes(prefix, start, end) & mask
    owner, bucket = [], []
    for n in PREFIXES:
        some = np.flatnonzero(size >= n)
        owner.append(some)
        bucket.append(textvec.mix(textvec.span_hashes(prefix, start[some], start[some] + n) + np.uint64(1)) & mask)
    owner, bucket = np.concatenate(owner), np.concatenate(bucket)
    order = np.argsort(owner, kind="stable")
    yield owner[order], bucket[order]
    count = np.maximum(size - INNER + 1, 0)
    owner = np.repeat(np.arange(len(start)), count)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + start[owner]
    yield owner, textvec.mix(textvec.span_hashes(prefix, at, at + INNER) + np.uint64(2)) & mask


class Tables:
    """Numbers of toxic and clean training documents by bucket, for each kind of input."""

    def __init__(self):
        self.seen = np.zeros((3, 2, TABLE), np.int32)
        self.docs = np.zeros(2, np.int64)

    def add(self, kinds, doc: np.ndarray, label: np.ndarray) -> None:
        self.docs += np.bincount(label, minlength=2)
        for k, (owner, bucket) in enumerate(kinds):
            pair = np.unique(doc[owner].astype(np.uint64) * np.uint64(TABLE) + bucket)
            d, b = (pair // np.uint64(TABLE)).astype(np.int64), (pair % np.uint64(TABLE)).astype(np.int64)
            for y in (0, 1):
                self.seen[k, y] += np.bincount(b[label[d] == y], minlength=TABLE).astype(np.int32)

    def finish(self) -> None:
        self.prior = float(np.clip(self.docs[1] / max(self.docs.sum(), 1), 1e-3, 1 - 1e-3))
        self.odds = np.stack([_odds(self.seen[k, 1], self.seen[k, 0], self.prior) for k in range(3)]).astype(np.float32)
        self.any = (self.seen.sum(1) > 0).astype(np.float32)

    def without(self, label: int) -> Tables:
        """For the words of a training document of this label, which is left out."""
        out = Tables()
        out.seen = np.maximum(self.seen - np.array([label == 0, label == 1], np.int32)[:, None], 0)
        out.docs = self.docs
        out.finish()
        return out

    def inputs(self, kinds, size: np.ndarray) -> np.ndarray:
        """(spans, N_ODDS)"""
        n = len(size)
        out = np.zeros((n, N_ODDS), np.float32)
        for k, (owner, bucket) in enumerate(kinds):
            bucket = bucket.astype(np.int64)
            odds, known = self.odds[k, bucket], self.any[k, bucket]
            if k == 0:
                out[:, 0], out[:, 1] = odds, known
            elif len(owner):
                first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
                out[owner[first], 2 * k] = np.maximum.reduceat(odds, first)
                out[owner[first], 2 * k + 1] = np.add.reduceat(odds, first) / np.diff(np.append(first, len(owner)))
        out[:, 6] = np.minimum(size, 40) / 10
        return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """Parameters in a dict. Rows of `w`, `c` and `u` are the two directions, the second one running backwards."""

    def __init__(self, seed: int = 8):
        r = np.random.default_rng(seed)
        h, f = HIDDEN, N_INPUTS
        self.p = {
            "w": r.normal(0, 0.3, (2, f, 3 * h)), "c": np.zeros((2, 1, 3 * h)), "u": r.normal(0, 0.3, (2, h, 3 * h)),
            "a": r.normal(0, 0.3, (2 * h, h)), "ac": np.zeros(h), "v": r.normal(0, 0.3, h), "o": r.normal(0, 0.3, 2 * h), "oc": np.zeros(1),
            "words": r.normal(0, 0.1, (WORD_ROWS, EMBED)), "chars": r.normal(0, 0.1, (CHAR_ROWS, EMBED)),
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def inputs(self, word: np.ndarray, gram: np.ndarray, first: np.ndarray, odds: np.ndarray) -> np.ndarray:
        """(words, N_INPUTS): rows of the word vectors, character trigrams gram[first[i] : first[i + 1]] (one at least), inputs from the tables."""
        if not len(word):
            return np.zeros((0, N_INPUTS), odds.dtype)
        chars = np.add.reduceat(self.p["chars"][gram], first[:-1])
        chars /= np.diff(first)[:, None]
        return np.concatenate([self.p["words"][word], chars, odds], 1)

    def projected(self, x: np.ndarray) -> np.ndarray:
        """(2, rows, 3 HIDDEN)"""
        return x @ self.p["w"] + self.p["c"]

    def forward(self, proj: np.ndarray, at: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Logits of windows; at, mask: (steps, windows), rows of proj and whether there is a word. Windows are the last axis of all that is made, so that each operation runs along them."""
        h, steps = HIDDEN, len(at)
        # Gates are 1 / (1 + exp(-x)): their part of x comes with the sign changed.
        sign = np.repeat(np.array([-1, 1], proj.dtype), [2 * h, h])
        proj, u = proj * sign, np.ascontiguousarray((self.p["u"] * sign).transpose(0, 2, 1))
        state = np.zeros((2, h, at.shape[1]), proj.dtype)
        hs, saved = np.empty((steps, 2 * h, at.shape[1]), proj.dtype), []
        x = np.empty((2, 3 * h, at.shape[1]), proj.dtype)
        with np.errstate(over="ignore"):
            for k in range(steps):
                x[0], x[1] = proj[0].take(at[k], 0).T, proj[1].take(at[steps - 1 - k], 0).T
                hu = u @ state
                gate = x[:, : 2 * h] + hu[:, : 2 * h]
                np.exp(gate, out=gate)
                gate += 1
                np.reciprocal(gate, out=gate)
                z, r, hun = gate[:, :h], gate[:, h:], hu[:, 2 * h :]
                n = r * hun
                n += x[:, 2 * h :]
                np.tanh(n, out=n)
                move = 1 - z
                move *= mask[[k, steps - 1 - k]][:, None]
                if keep:
                    saved.append((state, z, r, n, hun, move))
                state = state + move * (n - state)
                hs[k, :h], hs[steps - 1 - k, h:] = state
        e = np.tanh(self.p["a"].T @ hs + self.p["ac"][:, None])
        s = np.where(mask > 0, self.p["v"] @ e, np.float32(-1e9))
        w = np.exp(s - s.max(0))
        w /= w.sum(0)
        c = np.einsum("tn,thn->hn", w, hs)
        return self.p["o"] @ c + self.p["oc"][0], (hs, e, w, c, saved)

    def gradients(self, b: dict) -> tuple[float, dict]:
        """Loss and its gradients on a batch of documents: word, gram, first, odds of its rows (inputs()), at and mask of its windows, doc of each window, y of each document."""
        p, h = self.p, HIDDEN
        x = self.inputs(b["word"], b["gram"], b["first"], b["odds"])
        proj = self.projected(x)
        at, mask, doc, y = b["at"], b["mask"], b["doc"], b["y"]
        steps = len(at)
        logit, (hs, e, w, c, saved) = self.forward(proj, at, mask, True)
        # Soft maximum over each document's windows; windows come in order of documents.
        start = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
        top = np.maximum.reduceat(logit, start)
        part = np.exp(SHARP * (logit - top[doc]))
        whole = np.add.reduceat(part, start)
        soft = top + np.log(whole) / SHARP
        prob = _sigmoid(soft)
        loss = -np.mean(np.log(np.where(y > 0, prob, 1 - prob) + 1e-9))
        dl = ((prob - y) / len(y))[doc] * part / whole[doc]
        g = {"o": c @ dl, "oc": dl.sum(keepdims=True)}
        dc = p["o"][:, None] * dl
        dw = np.einsum("thn,hn->tn", hs, dc)
        ds = w * (dw - (w * dw).sum(0))
        dhs = w[:, None] * dc
        g["v"] = (e @ ds[:, :, None]).sum((0, 2))
        de = ds[:, None] * p["v"][:, None] * (1 - e * e)
        g["a"], g["ac"] = (hs @ de.transpose(0, 2, 1)).sum(0), de.sum((0, 2))
        dhs += p["a"] @ de
        carry, gu = np.zeros_like(saved[0][0]), np.zeros_like(p["u"])
        dx = np.empty((2, 3 * h, *at.shape), proj.dtype)
        for k in range(steps - 1, -1, -1):
            state, z, r, n, hun, move = saved[k]
            dh = carry
            dh[0] += dhs[k, :h]
            dh[1] += dhs[steps - 1 - k, h:]
            moved = dh * move
            dn = moved * (1 - n * n)
            d = np.empty((2, 3 * h, at.shape[1]), proj.dtype)
            np.multiply(moved * (state - n), z, out=d[:, :h])
            np.multiply(dn * hun, r * (1 - r), out=d[:, h : 2 * h])
            d[:, 2 * h :] = dn
            dx[0, :, k], dx[1, :, steps - 1 - k] = d
            d[:, 2 * h :] *= r
            gu += state @ d.transpose(0, 2, 1)
            carry = dh - moved + p["u"] @ d
        g["u"] = gu
        # Back from windows to rows, from rows to inputs.
        flat, rows = at.ravel(), len(x)
        dproj = np.array([[np.bincount(flat, y.ravel(), rows) for y in side] for side in dx]).astype(proj.dtype)
        g["c"] = dproj.sum(2)[:, None]
        g["w"] = x.T @ dproj.transpose(0, 2, 1)
        din = (p["w"] @ dproj).sum(0)
        g["words"] = _rows(b["word"], din[:EMBED])
        size = np.diff(b["first"])
        g["chars"] = _rows(b["gram"], (din[EMBED : 2 * EMBED] / size)[:, np.repeat(np.arange(rows), size)])
        return loss, g

    def fit(self, batches, epochs: int, steps: int) -> None:
        """batches: a function of the epoch; steps: how many there are in all."""
        vectors = ("words", "chars")
        m, v = ({k: np.zeros_like(a) for k, a in self.p.items() if k not in vectors} for _ in range(2))
        squares = {k: np.full(len(self.p[k]), 1e-8, np.float32) for k in vectors}
        step = 0
        for epoch in range(epochs):
            for b in batches(epoch):
                rate = 0.5 * (1 + np.cos(np.pi * min(step / steps, 1))) + 0.01
                _, g = self.gradients(b)
                step += 1
                for k, a in g.items():
                    if k in vectors:
                        row, d = a
                        squares[k][row] += (d * d).mean(1)
                        self.p[k][row] -= (VECTOR_RATE * rate * d / np.sqrt(squares[k][row])[:, None]).astype(np.float32)
                        continue
                    a = np.clip(a, -1, 1)
                    m[k] += 0.1 * (a - m[k])
                    v[k] += 0.001 * (a * a - v[k])
                    self.p[k] = (self.p[k] - RATE * rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)


def _rows(row: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct rows, sums of their gradients); d: a column a row."""
    some = np.flatnonzero(np.bincount(row))
    return some, np.stack([np.bincount(row, x)[some] for x in d], 1)


def windows(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, word index by step, mask) of all overlapping windows of texts with words first[i] : first[i + 1]."""
    size = np.diff(first)
    count = np.where(size > 0, np.maximum(1, -(-(size - WINDOW) // STRIDE) + 1), 0)
    text = np.repeat(np.arange(len(size)), count)
    begin = first[text] + STRIDE * (np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count))
    at = begin[:, None] + np.arange(WINDOW)
    last = first[text + 1][:, None] - 1
    return text, np.minimum(at, last), (at <= last).astype(np.float32)


def trigrams(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows of the character vectors, bounds by word): all runs of TRIGRAM bytes of a word, or the word if it has fewer."""
    count = np.maximum(end - start - TRIGRAM + 1, 1)
    first = np.append(0, np.cumsum(count))
    owner = np.repeat(np.arange(len(start)), count)
    at = np.arange(len(owner)) - first[owner] + start[owner]
    h = textvec.span_hashes(prefix, at, np.minimum(at + TRIGRAM, end[owner]))
    return (textvec.mix(h + np.uint64(3)) & np.uint64(CHAR_ROWS - 1)).astype(np.int64), first


def word_rows(hashes: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Rows of the word vectors; words not known (hashes ascending) share row 0."""
    at = np.minimum(np.searchsorted(known, hashes), max(len(known) - 1, 0))
    hit = known[at] == hashes if len(known) else np.zeros(len(hashes), bool)
    return np.where(hit, 1 + (textvec.mix(hashes) % np.uint64(WORD_ROWS - 1)).astype(np.int64), 0)


def _pack(net: Network, tables: Tables, known: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez_compressed(out, odds=tables.odds.astype(np.float16), any=tables.any.astype(bool), known=known, **net.p)
    return out.getvalue()


def train(rows: list[tuple[str | None, int]]) -> bytes:
    """A model from (text, label); b"" unless both labels occur."""
    rows = [(t, int(y)) for t, y in rows if t and y is not None]
    tables, r = Tables(), np.random.default_rng(4)
    chunks = [(w, np.array(w.rows), textvec.prefix_hashes(w.data)) for w in textvec.words((y, t) for t, y in rows) if len(w.start)]
    if len({int(y) for w, ys, _ in chunks for y in ys[np.diff(w.first) > 0]}) < 2:
        return b""
    for w, y, prefix in chunks:
        tables.add(_buckets(w.data, prefix, w.start, w.end), w.text, y)
    tables.finish()
    left = [tables.without(k) for k in (0, 1)]
    # All words of all chunks, each once for either label: the tables leave a document's own label out.
    hashes, odds, grams, at, mask, label, sizes = [], [], [], [], [], [], []
    held: dict[int, np.ndarray] = {}
    for n, (w, y, prefix) in enumerate(chunks):
        _, one, back = np.unique(w.hashes, return_index=True, return_inverse=True)
        shift = sum(len(h) for h in hashes)
        size = (w.end - w.start)[one]
        hashes.append(w.hashes[one])
        kinds = list(_buckets(w.data, prefix, w.start[one], w.end[one]))
        odds.append([left[k].inputs(kinds, size) for k in (0, 1)])
        grams.append(trigrams(prefix, w.start[one], w.end[one]))
        doc, step, m = windows(w.first)
        at.append(shift + back[step])
        mask.append(m)
        count = np.bincount(doc, minlength=len(y))
        label.append(y[count > 0])
        sizes.append(count[count > 0])
        held[n] = np.unique(np.stack([w.text, back + shift]), axis=1)[1]
    hashes, odds = np.concatenate(hashes), [np.concatenate([o[k] for o in odds]) for k in (0, 1)]
    first = np.concatenate([[0], *[np.diff(g[1]) for g in grams]]).cumsum()
    gram, at, mask, label, sizes = np.concatenate([g[0] for g in grams]), np.concatenate(at), np.concatenate(mask), np.concatenate(label), np.concatenate(sizes)
    # Words that enough documents hold have vectors of their own.
    h, which = np.unique(hashes, return_inverse=True)
    known = h[np.bincount(which, np.bincount(np.concatenate(list(held.values())), minlength=len(hashes)), len(h)) >= MIN_DOCS]
    word = word_rows(hashes, known)
    begin = np.cumsum(sizes) - sizes
    place = np.zeros(2 * len(hashes), np.int32)  # of a word with a label among those of a batch

    def batches(_: int):
        order = r.permutation(len(label))
        upto = np.cumsum(sizes[order])
        for docs in np.split(order, np.flatnonzero(np.diff(upto // BATCH)) + 1):
            win = np.concatenate([np.arange(begin[d], begin[d] + sizes[d]) for d in docs])
            doc = np.repeat(np.arange(len(docs)), sizes[docs])
            asked = (at[win] * 2 + label[docs][doc][:, None]).T
            place[asked] = 1
            key = np.flatnonzero(place)
            place[key] = np.arange(len(key), dtype=np.int32)
            back = place[asked]
            place[key] = 0
            row, y = key >> 1, key & 1
            n = first[row + 1] - first[row]
            inside = np.append(0, np.cumsum(n))
            some = np.arange(inside[-1]) - np.repeat(inside[:-1], n) + np.repeat(first[row], n)
            yield {"word": word[row], "gram": gram[some], "first": inside, "odds": np.where(y[:, None] > 0, odds[1][row], odds[0][row]), "at": back, "mask": np.ascontiguousarray(mask[win].T), "doc": doc, "y": label[docs].astype(np.float32)}

    net = Network()
    per = max(1, -(-int(sizes.sum()) // BATCH))
    epochs = min(max(EPOCHS, -(-150 // per)), 100)  # 150 steps at least
    net.fit(batches, epochs, epochs * per)
    return _pack(net, tables, known)


class Scorer:
    def __init__(self, model: bytes):
        z = np.load(io.BytesIO(model))
        self.tables, self.net, self.known = Tables.__new__(Tables), Network(), z["known"]
        self.tables.odds, self.tables.any = z["odds"].astype(np.float32), z["any"].astype(np.float32)
        self.net.p = {k: z[k] for k in self.net.p}

    def scores(self, w: textvec.Words) -> np.ndarray:
        out = np.zeros(len(w.rows))
        if not len(w.start):
            return out
        _, one, back = np.unique(w.hashes, return_index=True, return_inverse=True)
        prefix, start, end = textvec.prefix_hashes(w.data), w.start[one], w.end[one]
        odds = self.tables.inputs(_buckets(w.data, prefix, start, end), end - start)
        proj = self.net.projected(self.net.inputs(word_rows(w.hashes[one], self.known), *trigrams(prefix, start, end), odds))
        text, at, mask = windows(w.first)
        back, mask = back[at].T.astype(np.int32), mask.T
        for i in range(0, len(text), 2048):
            part = slice(i, i + 2048)
            logit, _ = self.net.forward(proj, np.ascontiguousarray(back[:, part]), np.ascontiguousarray(mask[:, part]))
            np.maximum.at(out, text[part], _sigmoid(logit.astype(np.float64)))
        return out


def _trained(batches):
    rows = [r for b in batches for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
    with textvec.held(HELD_BYTES):
        model = train(rows)
    yield pa.RecordBatch.from_arrays([pa.array([model], pa.binary())], ["model"])


def _scored(shared):
    def run(batches):
        scorer = Scorer(shared.value) if shared.value else None
        for batch in batches:
            with textvec.held(HELD_BYTES):
                score = [np.zeros(len(w.rows)) if scorer is None else scorer.scores(w) for w in textvec.words(((None, t) for t in batch.column(1).to_pylist()), limit=2 << 20)]
            if score:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.clip(np.concatenate(score), 0, 1))], ["doc_id", "score"])

    return run


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def model(docs: DataFrame, labels: DataFrame) -> bytes:
    rows = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    some = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_DOCS)
    sample = docs.select("doc_id", "text").filter(F.octet_length("text") <= TRAIN_DOC_BYTES).join(F.broadcast(some), "doc_id")  # TRAIN_DOCS ids at most
    # Of rows that share a doc_id, the first text: no more rows than ids.
    sample = sample.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").cast("int").alias("toxic")).select("text", "toxic")
    got = sample.repartition(1).sortWithinPartitions("text").mapInArrow(_trained, "model binary").first()
    return bytes(got[0]) if got else b""


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id and score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model(bounded_batches(docs), labels))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scored(shared), "doc_id long, score double")


def op8(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return scored(docs, labels).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
