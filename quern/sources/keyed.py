"""Keyed tables: upserted rows in memory, Parquet runs on a shared store, last write wins.

Inserts gather on the driver and are flushed as one small run; whole DataFrames are appended as runs of their own. A run's rows carry the sequence number of
their write. Compaction merges a level's runs with those of the next level that they overlap, keeps each key's latest row, and writes files of disjoint key ranges in key order, so that
Parquet statistics answer key predicates. The manifest is replaced by one rename and tells its own format, checksum and version; folders it no longer names stay until vacuum(), as DataFrames made
before may still read them.

Reads take the manifest as it is. Runs whose key ranges cannot match are left out. A run that no newer run or row in memory overlaps is read as it is. From any other, the keys that newer ones hold are taken
off by an anti-join, which reads nothing but those keys: they are broadcast if the manifest's counts say that they are few, else joined by a shuffle. So predicates on any column reach
every run's files, and nothing is deduplicated.

Spark jobs of writers run one at a time, without the lock that inserts and reads take for a moment.
"""

from __future__ import annotations

import threading
from dataclasses import replace

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import CorruptTableError, InvalidQueryError
from ..functions.expressions import quoted
from ..plans.ranges import KeyRange
from ..types import INT64_MAX, INT64_MIN, TableSchema
from .files import Store
from .manifest import Config, Manifest, Run, pick

SEQ = "__seq"
#: Keys of newer runs that are broadcast (8 bytes each).
BROADCAST_KEYS = 2_000_000


class KeyedTable:
    def __init__(self, spark: SparkSession, path: str, schema: TableSchema, config: Config | None = None):
        self.spark, self.path, self.schema, self.config = spark, path.rstrip("/"), schema, config or Config()
        self._store, self._lock, self._jobs = Store(spark), threading.RLock(), threading.RLock()
        self._wake, self._worker, self._failure = threading.Condition(self._lock), None, None
        self._buffer: dict[int, tuple] = {}
        self._frozen: list[dict[int, tuple]] = []
        self._stored = T.StructType([*schema.spark.fields, T.StructField(SEQ, T.LongType(), False)])
        self._closed = False
        file = f"{self.path}/manifest.json"
        self._manifest = Manifest.from_json(self._store.read(file)) if self._store.exists(file) else Manifest()
        if not self._store.exists(f"{self.path}/schema.json"):
            import json

            self._store.write(f"{self.path}/schema.json", json.dumps(schema.to_json()))

    @classmethod
    def open(cls, spark: SparkSession, path: str, config: Config | None = None) -> KeyedTable:
        import json

        return cls(spark, path, TableSchema.from_json(json.loads(Store(spark).read(f"{path.rstrip('/')}/schema.json"))), config)

    # Writing

    def insert(self, row: tuple) -> None:
        """Insert or replace one row."""
        if not self.schema.accepts(row):
            raise InvalidQueryError("the row does not fit the table")
        with self._lock:
            self._raise_failure()
            self._buffer[row[0]] = (*row, self._next_seq())
            full = len(self._buffer) >= self.config.buffer_rows
            if full:
                self._frozen.append(self._buffer)
                self._buffer = {}
                if self.config.background:
                    self._start()
        if full and not self.config.background:
            self._drain()

    def append(self, df: DataFrame, batch: tuple[str, int] | None = None) -> None:
        """Insert or replace all rows of df, which are one write: of equal keys in df the greatest row stays. batch: a stream's name and its batch's number; a batch not above the last one taken is left out."""
        key = self.schema.key.name
        named = df.select(*[quoted(c.name).cast(c.type.spark).alias(c.name) for c in self.schema.columns])
        with self._jobs:
            if batch and batch[1] <= self._manifest.batch_of(batch[0]):
                return
            self.flush()
            with self._lock:
                seq = self._next_seq()
            rows = named.withColumn(SEQ, F.lit(seq).cast("long")).repartitionByRange(quoted(key))
            run = self._write(_latest(rows, self.schema).sortWithinPartitions(quoted(key)), 0)
            with self._lock:
                self._add(run, (), batch)
            self._compact_due()

    def flush(self) -> None:
        """Write what is in memory."""
        with self._lock:
            self._freeze()
        self._drain()

    def compact(self) -> None:
        """Merge all runs into one level."""
        with self._jobs:
            self.flush()
            if len(self._manifest.runs) > 1:
                self._merge(self._manifest.runs, max(1, self._manifest.levels - 1))

    def wait_for_compaction(self) -> None:
        """Return when nothing is left to flush or compact; raise what went wrong in the background."""
        with self._lock:
            if self.config.background:
                self._start()
                self._wake.wait_for(lambda: self._worker is None)
            self._raise_failure()
        self._drain()

    def vacuum(self) -> None:
        """Delete folders of runs that were merged; DataFrames made before then can no longer be read."""
        with self._jobs:
            for path in self._manifest.obsolete:
                self._store.delete(path)
            with self._lock:
                self._commit(replace(self._manifest, obsolete=()))

    def close(self) -> None:
        self.wait_for_compaction()
        self.flush()

    def _raise_failure(self) -> None:
        failure, self._failure = self._failure, None
        if failure:
            raise failure

    def _freeze(self) -> None:
        if self._buffer:
            self._frozen.append(self._buffer)
            self._buffer = {}

    def _next_seq(self) -> int:
        m = self._manifest
        self._manifest = replace(m, next_seq=m.next_seq + 1)
        return m.next_seq

    def _start(self) -> None:
        if self._worker is None:
            self._worker = threading.Thread(target=self._work, daemon=True)
            self._worker.start()

    def _work(self) -> None:
        failure = None
        try:
            self._drain()
        except Exception as e:
            failure = e
        with self._lock:
            self._failure = failure or self._failure
            self._worker = None
            self._wake.notify_all()
            if self._frozen and not failure:
                self._start()

    def _drain(self) -> None:
        """Write frozen rows, oldest first, then compact what is due. Rows stay readable in memory until the run that holds them is in the manifest."""
        with self._jobs:
            while self._frozen:
                rows = self._frozen[0]
                df = self.spark.createDataFrame([rows[k] for k in sorted(rows)], self._stored)
                run = self._write(df.coalesce(1).sortWithinPartitions(self.schema.key.name), 0)
                with self._lock:
                    self._frozen.pop(0)
                    self._add(run, ())
            self._compact_due()

    def _write(self, df: DataFrame, level: int) -> Run:
        number = self._manifest.next_run
        path, key = f"{self.path}/runs/{number}", quoted(self.schema.key.name)
        # The range of keys and the number of rows come from the writing job itself.
        seen = Observation()
        df.observe(seen, F.min(key).alias("low"), F.max(key).alias("high"), F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(path)
        found = seen.get
        low, high, rows = (found.get(k) for k in ("low", "high", "rows"))
        return Run(number, level, path, low or 0, high if rows else -1, rows, self._store.size(path), self.config.layout(level))

    def _add(self, run: Run, old: tuple[Run, ...], batch: tuple[str, int] | None = None) -> None:
        manifest = self._manifest.replaced(old, run if run.rows else None)
        if batch:
            manifest = replace(manifest, batches=tuple(sorted((dict(manifest.batches) | {batch[0]: batch[1]}).items())))
        self._commit(manifest)

    def _commit(self, manifest: Manifest) -> None:
        file = f"{self.path}/manifest.json"
        stored = Manifest.from_json(self._store.read(file)).version if self._store.exists(file) else 0
        if stored != manifest.version:
            raise CorruptTableError("another writer has changed the table meanwhile")
        manifest = replace(manifest, version=manifest.version + 1)
        self._store.write(file, manifest.to_json())
        self._manifest = manifest

    def _compact_due(self) -> None:
        while due := pick(self._manifest, self.config):
            source = self._manifest.at(due[0])
            span = KeyRange(min(r.low for r in source), max(r.high for r in source))
            self._merge(source + tuple(r for r in self._manifest.at(due[1]) if span.overlaps(r.low, r.high)), due[1])

    def _merge(self, runs: tuple[Run, ...], level: int) -> None:
        files = max(1, -(-sum(r.rows for r in runs) // self.config.file_rows))
        key = quoted(self.schema.key.name)
        # Rows that newer runs replace are left out where they are read; the rest, of distinct keys, is dealt once by key ranges.
        rows = self._live(runs, KeyRange(), None).repartitionByRange(files, key)
        run = self._write(rows.sortWithinPartitions(key), level)
        with self._lock:
            self._add(run, runs)

    # Reading

    def _read(self, runs: tuple[Run, ...]) -> DataFrame:
        return self.spark.read.schema(self._stored).parquet(*[r.path for r in runs])

    @property
    def runs(self) -> tuple[Run, ...]:
        return self._manifest.runs

    def dataframe(self, keys: KeyRange | None = None) -> DataFrame:
        """A snapshot of the rows, of those in a key range only if given."""
        with self._lock:
            held: dict[int, tuple] = {}
            for part in (*self._frozen, self._buffer):
                held |= part
            manifest = self._manifest
        columns = [quoted(n) for n in self.schema.names]
        keys = keys or KeyRange()
        if keys.empty:
            return self.spark.createDataFrame([], self.schema.spark)
        rows = [held[k] for k in sorted(held) if keys.low <= k <= keys.high]
        runs = manifest.overlapping(keys)
        fresh = self.spark.createDataFrame(rows, self._stored) if rows or not runs else None
        return self._live(runs, keys, fresh, (rows[0][0], rows[-1][0]) if rows else None).select(*columns)

    def _live(self, runs: tuple[Run, ...], keys: KeyRange, fresh: DataFrame | None, span: tuple[int, int] | None = None) -> DataFrame:
        """The latest row of each key in the range; fresh: rows in memory, newer than all runs, of keys in span."""
        key = quoted(self.schema.key.name)

        def inside(df: DataFrame, low: int, high: int) -> DataFrame:
            return df.filter(key.between(low, high)) if (low, high) != (INT64_MIN, INT64_MAX) else df

        parts = [] if fresh is None else [fresh]
        alone = [r for r in runs if not any(r.newer(o) or o.newer(r) for o in runs if o != r and o.low <= r.high and r.low <= o.high) and not (span and r.low <= span[1] and span[0] <= r.high)]
        if alone:
            parts.append(inside(self._read(tuple(alone)), keys.low, keys.high))
        for run in runs:
            if run in alone:
                continue
            low, high = max(run.low, keys.low), min(run.high, keys.high)
            newer = [o for o in runs if o != run and o.newer(run) and o.low <= high and low <= o.high]
            df = inside(self._read((run,)), keys.low, keys.high)
            taken = []
            if newer:
                taken.append((inside(self._read(tuple(newer)), low, high).select(key), sum(o.rows for o in newer)))
            if span and span[0] <= high and low <= span[1]:
                taken.append((fresh.select(key), self.config.buffer_rows))
            for other, n in taken:
                other = other.withColumnRenamed(self.schema.key.name, "__taken")
                df = df.join(F.broadcast(other) if n <= BROADCAST_KEYS else other, key == F.col("__taken"), "left_anti")
            parts.append(df)
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def scan(self, low: int | None = None, high: int | None = None, columns: list[str] | None = None, ordered: bool = False) -> DataFrame:
        """Rows with low <= key < high; either end may be open. columns: without repeats, in the order wanted."""
        names = self.schema.names if columns is None else columns
        if len(set(names)) < len(names):
            raise InvalidQueryError("a column is asked for twice")
        for n in names:
            self.schema.index(n)
        keys = KeyRange()
        if low is not None:
            keys = keys.meet(low, INT64_MAX)
        if high is not None:
            keys = keys.meet(keys.low, high - 1)
        df = self.dataframe(keys)
        if ordered:
            df = df.orderBy(quoted(self.schema.key.name))
        return df.select(*[quoted(n) for n in names])

    def get(self, key: int, columns: list[str] | None = None) -> DataFrame:
        """The row of a key, or none."""
        return self.scan(key, None if key == INT64_MAX else key + 1, columns)


def _latest(df: DataFrame, schema: TableSchema) -> DataFrame:
    """Each key's row of the highest sequence number."""
    key = schema.key.name
    rest = [quoted(n) for n in schema.names if n != key]
    best = df.groupBy(quoted(key)).agg(F.max(F.struct(quoted(SEQ), *rest)).alias("__best"))
    return best.select(quoted(key), *[F.col("__best")[c.name].alias(c.name) for c in schema.columns if c.name != key], F.col("__best")[SEQ].alias(SEQ))
