"""Token ids as compressed binary blocks with random access.

Documents are dealt by ranges of doc_id, encoded in order, and each document's ids (2 bytes each if they fit, else 4; the end id last) become
one zstandard frame. All frames share one dictionary, trained on a bounded sample of serialized id arrays, so short documents compress well and yet can be read
alone. A block holds up to BLOCK_BYTES of frames:

    b"QTB1" | sha256 of the dictionary | width u8 | has-null-id u8 | documents u32 | doc_id i64 * n | ids u32 * n | frame offsets u64 * (n + 1) | frames

Blocks are the `payload` rows of a Parquet table (part, block, n_ids, payload), so any store that Spark reaches will do, and its committer covers lost
executors. The dictionary lies beside them in a table of one row.

Encoding: texts are cut before single spaces and around single line ends, which never changes the ids of a byte-level BPE whose words may begin with one space, and each
distinct piece is encoded once per worker (a bounded cache, keyed by 64-bit hashes); new pieces are encoded many at a time, as lines of a text.

Defined cases: null text is empty (the end id only); null doc_ids come first; rows that repeat a doc_id follow each other, by a hash of their texts; an empty table gives an empty
table; a sample too small to train on gives an empty dictionary; columns other than doc_id and text are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import os
import uuid
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textvec
from .common import bounded_batches, hash_sample, shared_dir

TOKENIZER = "byte_bpe_50k.json"
END_ID = 2
#: The dictionary is trained on the whole ids of twice as many documents at most, those of least hash, as far as they fit in SAMPLE_BYTES together.
SAMPLE_DOCS = 1000
SAMPLE_BYTES = 16 << 20
DICTIONARY_BYTES = 1 << 16
BLOCK_BYTES = 1 << 20
CACHE_PIECES = 2_500_000
LEVEL = 3
MAGIC = b"QTB1"

#: A space may start a piece if this byte follows: not a space, nor the lead byte of a character that may be one.
_STARTS = np.ones(256, bool)
_STARTS[[*range(9, 14), *range(28, 33), 0x85, 0xA0, 0xC2, 0xE1, 0xE2, 0xE3]] = False


class Encoder:
    """ids of many texts at once; pieces already seen are looked up by their 64-bit hashes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        if not os.path.exists(path):
            import public_tokenizers

            path = public_tokenizers.path(path)
        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        newline = self._plain(["\n"])[0]
        self.newline = newline[0] if len(newline) == 1 else None
        self._reset()

    def _plain(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _reset(self) -> None:
        self.ids = np.zeros(1 << 16, self.dtype)
        self.bounds = np.zeros(1 << 16, np.int64)
        self.count = 0
        # (hashes ascending, numbers of their pieces): all but the latest, and the latest.
        self.known = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))] * 2

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Number of each piece, -1 if new."""
        out = np.full(len(h), -1, np.int64)
        for keys, at in self.known:
            if len(keys):
                k = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                out = np.where(keys[k] == h, at[k], out)
        return out

    def _add(self, h: np.ndarray, pieces: list[bytes], plain: np.ndarray) -> None:
        """h ascending; plain: which pieces may stand in a list with line ends between."""
        n, size, flat = len(h), np.zeros(len(h), np.int64), []
        text = [p.decode("utf-8", "surrogatepass") for p in pieces]
        lines, rest = (np.flatnonzero(plain), np.flatnonzero(~plain)) if self.newline is not None else (np.zeros(0, np.int64), np.arange(n))
        groups = [lines[i : i + 500] for i in range(0, len(lines), 500)]
        order = []
        for group, ids in zip(groups, self._plain(["\n".join([text[i] for i in g]) for g in groups]), strict=True):
            ids = np.array(ids, self.dtype)
            ends = np.append(np.flatnonzero(ids == self.newline), len(ids))
            if len(ends) != len(group):
                rest = np.concatenate([rest, group])
                continue
            size[group] = np.diff(np.append(-1, ends)) - 1
            flat.append(np.delete(ids, ends[:-1]))
            order.append(group)
        for i, ids in zip(rest, self._plain([text[i] for i in rest]), strict=True):
            size[i] = len(ids)
            flat.append(np.array(ids, self.dtype))
        order = np.concatenate([*order, rest]).astype(np.int64)
        flat = np.concatenate(flat)
        first, end = self.count, self.bounds[self.count]
        while len(self.bounds) <= first + n:
            self.bounds = np.concatenate([self.bounds, np.zeros_like(self.bounds)])
        while len(self.ids) < end + len(flat):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[end : end + len(flat)] = flat
        self.bounds[first + 1 : first + 1 + n] = end + np.cumsum(size[order])
        self.count += n
        number = np.empty(n, np.int64)
        number[order] = first + np.arange(n)
        self.known[1] = _merged(self.known[1], (h, number))
        if len(self.known[1][0]) > 1 << 18:
            self.known = [_merged(*self.known), (np.zeros(0, np.uint64), np.zeros(0, np.int64))]

    def encode(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds) of the texts data[bounds[i] : bounds[i + 1] - 1]."""
        if self.count > CACHE_PIECES:
            self._reset()
        cut = np.zeros(len(data) + 1, bool)
        good = _STARTS[data]
        cut[: len(data) - 1] = (data[:-1] == 32) & good[1:]
        # A line end between two characters that are no spaces is a piece of its own.
        alone = np.flatnonzero((data[1:-1] == 10) & good[:-2] & (data[:-2] < 128) & good[2:]) + 1
        cut[alone] = True
        cut[alone + 1] = True
        # The separator after each text is in no piece: texts begin and end at cuts of their own.
        cut[bounds[1:] - 1] = False
        cut[bounds[:-1]] = bounds[1:] - bounds[:-1] > 1
        start = np.flatnonzero(cut)
        text = np.searchsorted(bounds, start, "right") - 1
        end = np.minimum(np.append(start[1:], len(data)), bounds[text + 1] - 1)
        if not len(start):
            return np.zeros(0, self.dtype), np.zeros(len(bounds), np.int64)
        h, at, back = np.unique(textvec.span_hashes(textvec.prefix_hashes(data), start, end), return_index=True, return_inverse=True)
        known = self._find(h)
        if len(new := np.flatnonzero(known < 0)):
            raw, s, e = data.tobytes(), start[at[new]], end[at[new]]
            bad = np.append(0, np.cumsum(~good))
            plain = bad[e] - bad[np.minimum(s + 1, e)] + ~good[s] * (data[s] != 32) == 0
            self._add(h[new], [raw[i:j] for i, j in zip(s.tolist(), e.tolist(), strict=True)], plain)
            known = self._find(h)
        known = known[back]
        size = self.bounds[known + 1] - self.bounds[known]
        to = np.cumsum(size)
        ids = self.ids[np.arange(to[-1]) + np.repeat(self.bounds[known] - to + size, size)]
        total = np.bincount(text + 1, size, len(bounds)).astype(np.int64)
        return ids, np.cumsum(total)


def _merged(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    h = np.concatenate([a[0], b[0]])
    order = np.argsort(h, kind="stable")
    return h[order], np.concatenate([a[1], b[1]])[order]


_encoders: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _serialized(batches, path: str, end_id: int):
    """(doc_id, bytes of the ids) for each row."""
    enc = _encoder(path)
    for batch in batches:
        pairs = zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True)
        for rows, data, bounds in textvec.buffers(pairs, 2 << 20):
            ids, at = enc.encode(data, bounds)
            full = np.insert(ids, at[1:], end_id)
            at = at + np.arange(len(at))
            for i, row in enumerate(rows):
                yield row, full[at[i] : at[i + 1]].tobytes()


def _trained(path: str, end_id: int):
    def run(batches):
        samples, total = [], 0
        for _, ids in _serialized(batches, path, end_id):
            total += len(ids)
            if samples and total > SAMPLE_BYTES:
                break
            samples.append(ids)
        try:
            dictionary = zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=256, d=8).as_bytes()
        except (zstandard.ZstdError, ValueError):
            dictionary = b""
        yield pa.RecordBatch.from_arrays([pa.array([dictionary], pa.binary())], ["dictionary"])

    return run


def pack(dictionary: bytes, width: int, rows: list[tuple[int | None, int, bytes]]) -> bytes:
    """A block of (doc_id, number of ids, frame)."""
    n = len(rows)
    offsets = np.zeros(n + 1, np.uint64)
    np.cumsum([len(f) for _, _, f in rows], out=offsets[1:])
    nulls = sum(r[0] is None for r in rows)
    head = [MAGIC, hashlib.sha256(dictionary).digest(), bytes([width, nulls > 0]), np.uint32(n).tobytes()]
    # Null ids sort first: their number stands in the first id's place if there are any.
    ids = np.array([0 if r[0] is None else r[0] for r in rows], np.int64)
    if nulls:
        ids[0] = nulls
    return b"".join([*head, ids.astype("<i8").tobytes(), np.array([r[1] for r in rows], "<u4").tobytes(), offsets.astype("<u8").tobytes(), *(f for _, _, f in rows)])


class Block:
    """Random access to the documents of a block."""

    def __init__(self, payload: bytes, dictionary: bytes):
        if payload[:4] != MAGIC or payload[4:36] != hashlib.sha256(dictionary).digest():
            raise ValueError("not a token block, or another dictionary")
        self.payload, self.dtype = payload, {2: "<u2", 4: "<u4"}[payload[36]]
        n = int(np.frombuffer(payload, "<u4", 1, 38)[0])
        ids = np.frombuffer(payload, "<i8", n, 42)
        nulls = int(ids[0]) if payload[37] else 0
        self.doc_ids = [None] * nulls + ids[nulls:].tolist()
        self.sizes = np.frombuffer(payload, "<u4", n, 42 + 8 * n)
        self.offsets = np.frombuffer(payload, "<u8", n + 1, 42 + 12 * n).astype(np.int64) + 42 + 12 * n + 8 * (n + 1)
        self.reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)

    def __getitem__(self, i: int) -> np.ndarray:
        raw = self.reader.decompress(self.payload[self.offsets[i] : self.offsets[i + 1]])
        return np.frombuffer(raw, self.dtype)


def _written(dictionary: bytes, path: str, end_id: int):
    def run(batches):
        part, block = TaskContext.get().partitionId(), 0
        writer = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        width = np.dtype(_encoder(path).dtype).itemsize
        rows, size = [], 0

        def flush():
            total = sum(r[1] for r in rows)
            return pa.RecordBatch.from_arrays([pa.array([part]), pa.array([block]), pa.array([total]), pa.array([pack(dictionary, width, rows)], pa.binary())], ["part", "block", "n_ids", "payload"])

        for doc_id, raw in _serialized(batches, path, end_id):
            frame = writer.compress(raw)
            if rows and size + len(frame) > BLOCK_BYTES:
                yield flush()
                rows, size, block = [], 0, block + 1
            rows.append((doc_id, len(raw) // width, frame))
            size += len(frame)
        if rows:
            yield flush()

    return run


def write_tokens(docs: DataFrame, out: str, tokenizer: str = TOKENIZER, end_id: int = END_ID) -> None:
    """Encode docs (doc_id, text) and write blocks in ascending doc_id order under the folder out."""
    docs = bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sample = hash_sample(docs, docs.count(), SAMPLE_DOCS, "doc_id", "text").coalesce(1)
    dictionary = sample.mapInArrow(_trained(tokenizer, end_id), "dictionary binary")
    dictionary.write.parquet(f"{out}/dictionary")
    first = docs.sparkSession.read.parquet(f"{out}/dictionary").first()
    raw = bytes(first.dictionary) if first else b""
    # Rows of one doc_id are split by text, and equal rows by their place in the input, so no range has to hold them all.
    order = ["doc_id", "__hash", "__row"]
    dealt = docs.withColumns({"__hash": F.xxhash64("text"), "__row": F.monotonically_increasing_id()}).repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    dealt.mapInArrow(_written(raw, tokenizer, end_id), "part long, block long, n_ids long, payload binary").write.parquet(f"{out}/blocks")


def _measured(dictionary: bytes):
    def run(batches):
        for batch in batches:
            for part, number, payload in zip(*(batch.column(c).to_pylist() for c in ("part", "block", "payload")), strict=True):
                b = Block(payload, dictionary)
                crc = [zlib.crc32(b[i].astype("<u4").tobytes()) for i in range(len(b.doc_ids))]
                before = np.cumsum(b.sizes, dtype=np.int64) - b.sizes
                n = len(crc)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * n, pa.int64()), pa.array([number] * n, pa.int64()), pa.array(b.doc_ids, pa.int64()), pa.array(before), pa.array(b.sizes.astype(np.int64)), pa.array(crc, pa.int64())],
                    ["part", "block", "doc_id", "before", "n_tokens", "ids_crc32"],
                )

    return run


def read_index(spark: SparkSession, out: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the blocks."""
    first = spark.read.parquet(f"{out}/dictionary").first()
    blocks = spark.read.schema("part long, block long, n_ids long, payload binary").parquet(f"{out}/blocks")
    heads = blocks.select("part", "block", "n_ids")
    parts = heads.groupBy("part").agg(F.sum("n_ids").alias("__n"))  # as many rows as the writer had tasks
    parts = parts.select("part", (F.sum("__n").over(Window.partitionBy(F.lit(0)).orderBy("part")) - F.col("__n")).alias("__part"))
    inside = F.sum("n_ids").over(Window.partitionBy("part").orderBy("block")) - F.col("n_ids")
    heads = heads.withColumn("__block", inside).join(parts, "part").select("part", "block", (F.col("__part") + F.col("__block")).alias("__start"))
    rows = blocks.select("part", "block", "payload").mapInArrow(_measured(bytes(first.dictionary) if first else b""), "part long, block long, doc_id long, before long, n_tokens long, ids_crc32 long")
    return rows.join(heads, ["part", "block"]).select("doc_id", (F.col("__start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def op10(docs: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    out = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, out)
    return read_index(spark, out)
