"""Keyed tables: flush, levels, snapshots, restart."""

import pytest

from quern.errors import CorruptTableError, InvalidQueryError
from quern.session import Engine
from quern.sources.keyed import KeyedTable
from quern.sources.manifest import Config, Manifest, Run, pick
from quern.streaming.ingest import upsert_stream
from quern.types import INT64_MAX, INT64_MIN, Column, TableSchema, Type

SCHEMA = TableSchema.keyed([Column("id", Type.INT64, True, False), Column("value", Type.INT64, False, False), Column("score", Type.DOUBLE, False, False), Column("name", Type.STRING, False, False)])
SMALL = Config(buffer_rows=4, level0_runs=2, size_ratio=2, base_bytes=1, columnar_from=2)


def row(k):
    return k, k * 10, k * 0.5, f"name_{k}"


def ids(df):
    return [r.id for r in df.collect()]


def test_levels_and_ranges(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path / "t"), SCHEMA, SMALL)
    for k in range(1, 66):
        t.insert(row(k))
    assert max(r.level for r in t.runs) >= 2 and any(r.layout == "COLUMN" for r in t.runs)
    assert ids(t.scan(ordered=True)) == list(range(1, 66))
    assert ids(t.scan(10, 21, ordered=True)) == list(range(10, 21))
    assert ids(t.scan(5, 63, ordered=True)) == list(range(5, 63))
    assert [tuple(r) for r in t.get(42, ["value", "name"]).collect()] == [(420, "name_42")]
    assert t.get(1000).count() == 0
    with pytest.raises(InvalidQueryError):
        t.scan(columns=["id", "id"])


def test_last_write_wins_and_restart(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path / "t"), SCHEMA, SMALL)
    for k in (3, 1, 2, 4, 2, 1, 9, 1):
        t.insert(row(k))
    t.insert((1, -1, 0.0, "new"))
    before = t.dataframe()
    t.insert((2, -2, 0.0, "newer"))
    t.close()
    again = KeyedTable.open(spark, str(tmp_path / "t"), SMALL)
    assert again.schema == SCHEMA
    assert {r.id: r.value for r in again.dataframe().collect()} == {1: -1, 2: -2, 3: 30, 4: 40, 9: 90}
    again.append(spark.createDataFrame([(3, 5, 1.0, "bulk"), (3, 4, 1.0, "bulk"), (7, 7, 1.0, "bulk")], SCHEMA.spark))
    again.compact()
    assert len(again.runs) == 1
    assert {r.id: r.value for r in again.dataframe().collect()} == {1: -1, 2: -2, 3: 5, 4: 40, 7: 7, 9: 90}
    # A snapshot taken before still reads its own files.
    assert {r.id: r.value for r in before.collect()}[2] == 20
    again.vacuum()
    assert ids(again.scan(ordered=True)) == [1, 2, 3, 4, 7, 9]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_predicates_reach_all_runs(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path / "t"), SCHEMA, Config(buffer_rows=1000, level0_runs=100))
    t.append(spark.range(2000).selectExpr("id", "id * 10 AS value", "id * 0.5 AS score", "concat('name_', id) AS name"))
    high = lambda: t.dataframe().filter("value > 19900")
    assert "Join" not in plan(high()) and "GreaterThan(value,19900)" in plan(high())
    # One row in memory, and one small run: the base is still filtered where it is read, and nothing is grouped.
    t.insert((1995, 5, 0.0, "gone"))
    t.append(spark.createDataFrame([(1999, 30000, 0.0, "new"), (3, 40000, 0.0, "up")], SCHEMA.spark))
    t.insert((1996, 50000, 0.0, "held"))
    p = plan(high())
    assert "Aggregate" not in p and "Sort" not in p and p.count("GreaterThan(value,19900)") >= 2 and "BroadcastHashJoin" in p
    assert {r.id: r.value for r in high().collect()} == {1991: 19910, 1992: 19920, 1993: 19930, 1994: 19940, 1996: 50000, 1997: 19970, 1998: 19980, 1999: 30000, 3: 40000}
    # Runs beside those that overlap are read as they are.
    t.append(spark.createDataFrame([(k, 1, 0.0, "far") for k in (5000, 5001)], SCHEMA.spark))
    assert "Join" not in plan(t.scan(4000)) and sorted(ids(t.scan(4000))) == [5000, 5001]
    t.compact()
    assert "Join" not in plan(high()) and t.dataframe().count() == 2002


def test_many_newer_keys_are_not_broadcast(spark, tmp_path, monkeypatch):
    from quern.sources import keyed

    monkeypatch.setattr(keyed, "BROADCAST_KEYS", 3)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        t = KeyedTable(spark, str(tmp_path / "t"), SCHEMA, Config(level0_runs=100))
        t.append(spark.createDataFrame([row(k) for k in range(20)], SCHEMA.spark))
        t.append(spark.createDataFrame([(k, -k, 0.0, "x") for k in range(5, 15)], SCHEMA.spark))
        df = t.dataframe()
        assert "SortMergeJoin" in plan(df) and {r.id: r.value for r in df.collect()} == {k: -k if 5 <= k < 15 else k * 10 for k in range(20)}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_inserts_and_reads_go_on_beside_compaction(spark, tmp_path, monkeypatch):
    import threading

    t = KeyedTable(spark, str(tmp_path / "t"), SCHEMA, Config(buffer_rows=4, level0_runs=2, background=True))
    started, go, one = threading.Event(), threading.Event(), KeyedTable._write

    def slow(self, df, level):
        started.set()
        assert go.wait(60)
        return one(self, df, level)

    monkeypatch.setattr(KeyedTable, "_write", slow)
    for k in range(4):
        t.insert(row(k))
    assert started.wait(60)
    for k in range(4, 9):
        t.insert(row(k))  # not held up by the write
    assert ids(t.scan(ordered=True)) == list(range(9))
    go.set()
    t.wait_for_compaction()
    assert ids(t.scan(ordered=True)) == list(range(9)) and t.runs
    t.close()


def test_a_failed_background_flush_is_told_by_the_next_insert(spark, tmp_path, monkeypatch):
    t = KeyedTable(spark, str(tmp_path / "t"), SCHEMA, Config(buffer_rows=2, background=True))
    with monkeypatch.context() as m:
        m.setattr(KeyedTable, "_write", lambda *_: (_ for _ in ()).throw(OSError("disk")))
        t.insert(row(1))
        t.insert(row(2))
        while t._worker is not None:
            pass
    with pytest.raises(OSError):
        t.insert(row(3))
    t.insert(row(3))
    t.close()
    assert ids(t.scan(ordered=True)) == [1, 2, 3]


def test_manifest_checks(spark, tmp_path):
    path = str(tmp_path / "t")
    a = KeyedTable(spark, path, SCHEMA)
    a.insert(row(1))
    a.flush()
    b = KeyedTable.open(spark, path)
    b.insert(row(2))
    b.flush()
    a.insert(row(3))
    with pytest.raises(CorruptTableError):
        a.flush()  # overtaken
    text = (tmp_path / "t" / "manifest.json").read_text()
    for bad in (text.replace("runs/1", "runs/9"), text.replace('"format": 1', '"format": 7'), text[:50], "{}"):
        with pytest.raises(CorruptTableError):
            Manifest.from_json(bad)
    assert Manifest.from_json(text).runs == b.runs


def test_extreme_keys_and_values(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path / "t"), TableSchema.keyed([Column("id", Type.INT64, True, False), Column("x", Type.DOUBLE), Column("s", Type.STRING)]), Config(buffer_rows=2))
    for r in ((INT64_MIN, None, ""), (INT64_MAX, -1.5, None), (0, 0.0, "it's")):
        t.insert(r)
    assert [tuple(r) for r in t.scan(ordered=True).collect()] == [(INT64_MIN, None, ""), (0, 0.0, "it's"), (INT64_MAX, -1.5, None)]
    assert ids(t.get(INT64_MAX)) == [INT64_MAX]
    with pytest.raises(InvalidQueryError):
        t.insert((1, 5, None))


def test_background(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path / "t"), SCHEMA, Config(buffer_rows=5, level0_runs=2, background=True))
    for k in range(32):
        t.insert(row(k))
    t.wait_for_compaction()
    assert ids(t.scan(ordered=True)) == list(range(32))
    t.close()


def test_policy():
    run = lambda i, level, size: Run(i, level, "", 0, 1, 1, size, "ROW")
    c = Config(level0_runs=2, base_bytes=10, size_ratio=3)
    assert pick(Manifest((run(1, 0, 5),)), c) is None
    assert pick(Manifest((run(1, 0, 5), run(2, 0, 5))), c) == (0, 1)
    assert pick(Manifest((run(1, 1, 30),)), c) is None
    assert pick(Manifest((run(1, 1, 31),)), c) == (1, 2)
    with pytest.raises(ValueError):
        Config(buffer_rows=0)


def test_data_skipping_table(spark, tmp_path):
    e = Engine(spark, str(tmp_path), Config(buffer_rows=50))
    e.sql("CREATE TABLE users (id INT64 KEY, age INT64, score DOUBLE NULL, name STRING NULL);")
    for i in range(120):
        e.sql(f"INSERT INTO users (id, age, score, name) VALUES ({i}, {i}, {i / 10.0}, 'user_{i}');")
    assert sorted(ids(e.sql("SELECT id FROM users WHERE age >= 75;"))) == list(range(75, 120))
    e.close()


def test_stream(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path / "t"), SCHEMA)
    spark.createDataFrame([row(k) for k in range(5)], SCHEMA.spark).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA.spark).parquet(str(tmp_path / "in"))
    upsert_stream(stream, t, str(tmp_path / "c"), available_now=True).awaitTermination()
    assert ids(t.scan(ordered=True)) == list(range(5))
    # A repeated batch is left out, even where other writes came between.
    t.append(spark.createDataFrame([(2, -1, 0.0, "later")], SCHEMA.spark))
    t.append(spark.createDataFrame([row(2)], SCHEMA.spark), (str(tmp_path / "c"), 0))
    assert t.get(2).first().value == -1
