"""The dialect end to end on a small table with nulls."""

import pytest

from quern import errors as e
from quern.catalogue import _CREW
from quern.session import Engine
from quern.types import Column, SchemaBuilder, TableSchema, Type


@pytest.fixture(scope="module")
def people(spark, tmp_path_factory):
    engine = Engine(spark, str(tmp_path_factory.mktemp("people")))
    engine.run(_CREW)
    return engine


def rows(engine, sql):
    return [tuple(r) if len(r) > 1 else r[0] for r in engine.sql(sql).collect()]


PLAIN = [
    ("SELECT nick FROM crew ORDER BY id", ["Ika", "Juro", None, "Lene", "Milo"]),
    ("SELECT id FROM crew WHERE grade < 40 ORDER BY id", [7, 12, 15, 30]),
    ("SELECT nick FROM crew WHERE id = 30", ["Milo"]),
    ("SELECT id FROM crew WHERE id = 30 AND grade < 40", [30]),
    ("SELECT id FROM crew WHERE id = 11 AND grade < 40", []),
    ("SELECT id FROM crew WHERE id >= 11 AND id < 15 ORDER BY id", [11, 12]),
    ("SELECT id FROM crew WHERE id >= 7 AND id <= 15 AND grade < 40 ORDER BY id", [7, 12, 15]),
    ("SELECT id FROM crew WHERE id = 7 AND id = 11", []),
    ("SELECT nick IS NULL FROM crew WHERE id = 12", [True]),
    ("SELECT id FROM crew WHERE NOT grade >= 40 ORDER BY id", [7, 12, 15, 30]),
    ("SELECT id FROM crew ORDER BY grade, id", [12, 7, 15, 30, 11]),
    ("SELECT id FROM crew ORDER BY grade DESC, id", [11, 7, 15, 30, 12]),
    ("SELECT nick FROM crew ORDER BY grade, id", [None, "Ika", "Lene", "Milo", "Juro"]),
    ("SELECT id FROM crew ORDER BY grade, id LIMIT 2", [12, 7]),
    ("SELECT id FROM crew ORDER BY pay, id", [7, 15, 12, 30, 11]),
    ("SELECT id FROM crew ORDER BY pay DESC", [11, 30, 12, 15, 7]),
    ("SELECT id FROM crew ORDER BY grade, nick DESC", [12, 30, 15, 7, 11]),
    ("SELECT id FROM crew WHERE grade < 45 ORDER BY pay DESC", [30, 12, 15, 7]),
    ("SELECT id FROM crew ORDER BY nick IS NULL, id", [7, 11, 15, 30, 12]),
    ("SELECT id FROM crew WHERE grade = 31 ORDER BY nick DESC LIMIT 2", [30, 15]),
    ("SELECT id FROM crew WHERE id >= 7 AND id <= 30 AND grade < 45 ORDER BY grade, id DESC", [12, 30, 15, 7]),
    ("SELECT id FROM crew LIMIT 0", []),
    ("SELECT id FROM crew WHERE id > 7.5 AND id != 12 ORDER BY id", [11, 15, 30]),
    ("SELECT id FROM crew WHERE id = NULL", []),
    ("SELECT COUNT(id), SUM(grade), AVG(pay), MIN(grade), MAX(pay) FROM crew", [(5, 166, 2885.375, 28, 6100.75)]),
    ("SELECT AVG(grade) FROM crew", [33.2]),
    ("SELECT COUNT(id), SUM(grade), AVG(grade), MIN(grade), MAX(grade) FROM crew WHERE id = 7 AND id = 11", [(0, None, None, None, None)]),
    ("SELECT COUNT(id) FROM crew LIMIT 0", []),
    ("SELECT COUNT(pay), SUM(pay) FROM crew WHERE id = 11", [(0, None)]),
    ("SELECT COUNT(nick IS NULL) FROM crew", [5]),
    ("SELECT grade, COUNT(id) FROM crew GROUP BY grade ORDER BY grade DESC LIMIT 2", [(45, 1), (31, 3)]),
    ("SELECT grade, COUNT(pay), SUM(pay) FROM crew GROUP BY grade ORDER BY grade", [(28, 1, 2750.0), (31, 3, 8791.5), (45, 0, None)]),
    ("SELECT nick, COUNT(id) FROM crew GROUP BY nick ORDER BY nick", [("Ika", 1), ("Juro", 1), ("Lene", 1), ("Milo", 1), (None, 1)]),
    ("SELECT grade, nick, COUNT(id) FROM crew GROUP BY grade, nick ORDER BY grade, nick DESC", [(28, None, 1), (31, "Milo", 1), (31, "Lene", 1), (31, "Ika", 1), (45, "Juro", 1)]),
    ("SELECT grade, COUNT(id) FROM crew WHERE id > 1000 GROUP BY grade", []),
    ("SELECT grade >= 30, COUNT(id) FROM crew GROUP BY grade >= 30 ORDER BY grade >= 30", [(False, 1), (True, 4)]),
    ("SELECT grade FROM crew GROUP BY grade ORDER BY nick, grade", [31, 45, 28]),
    ("SELECT COUNT(id) FROM crew GROUP BY 7 ORDER BY 3", [5]),
]


@pytest.mark.parametrize("sql,expected", PLAIN)
def test_select(people, sql, expected):
    assert rows(people, sql + ";") == expected


def test_names(people):
    assert people.sql("SELECT *, grade, grade > 1, COUNT(id) FROM crew GROUP BY id, nick, grade, pay, grade > 1;").columns == ["id", "nick", "grade", "pay", "grade", "expression6", "count(id)"]
    assert people.sql("SELECT SUM(grade), COUNT(grade IS NULL) FROM crew;").columns == ["sum(grade)", "count(expression2)"]


ERRORS = [
    ("SELECT x FROM crew;", e.ColumnNotFoundError), ("SELECT ID FROM crew;", e.ColumnNotFoundError), ("SELECT id FROM nobody;", e.TableNotFoundError), ("SELECT id FROM crew ORDER BY x;", e.ColumnNotFoundError),
    ("SELECT COUNT(id) FROM crew GROUP BY x;", e.ColumnNotFoundError), ("SELECT nick, COUNT(id) FROM crew GROUP BY grade;", e.InvalidQueryError), ("SELECT nick, COUNT(id) FROM crew;", e.InvalidQueryError),
    ("SELECT id FROM crew WHERE grade;", e.InvalidQueryError), ("SELECT SUM(nick) FROM crew;", e.TypeMismatchError), ("SELECT MAX(NULL) FROM crew;", e.TypeMismatchError), ("SELECT id FROM crew WHERE NOT grade;", e.TypeMismatchError),
    ("SELECT id FROM crew WHERE nick > 5;", e.TypeMismatchError), ("SELECT id FROM crew WHERE id = 'x';", e.TypeMismatchError), ("INSERT INTO crew (id) VALUES (1);", e.TypeMismatchError),
    ("INSERT INTO crew (id, grade) VALUES (1, 2, 3);", e.InvalidQueryError), ("INSERT INTO crew (id, id, grade) VALUES (1, 1, 3);", e.InvalidQueryError), ("INSERT INTO crew (id, grade, x) VALUES (1, 1, 3);", e.ColumnNotFoundError),
    ("INSERT INTO crew (id, grade, pay) VALUES (1, 1, 3);", e.TypeMismatchError), ("INSERT INTO crew (id, grade) VALUES (NULL, 1);", e.TypeMismatchError), ("CREATE TABLE crew (id INT64 KEY);", e.InvalidQueryError),
    ("CREATE TABLE p2 (id STRING KEY);", e.InvalidQueryError), ("CREATE TABLE p2 (a INT64, id INT64 KEY);", e.InvalidQueryError), ("CREATE TABLE p2 (id INT64 KEY, id DOUBLE);", e.InvalidQueryError), ("CREATE TABLE p2 (id INT64);", e.InvalidQueryError),
]


@pytest.mark.parametrize("sql,error", ERRORS)
def test_errors(people, sql, error):
    with pytest.raises(error):
        people.sql(sql)


def test_schema_builder():
    s = SchemaBuilder().add_column("id", Type.INT64, is_key=True, nullable=False).add_column("x", Type.DOUBLE).build()
    assert s.names == ["id", "x"] and s.key.name == "id" and s.accepts((1, None)) and not s.accepts((None, 1.0)) and not s.accepts((1, 1))
    with pytest.raises(e.InvalidQueryError):
        SchemaBuilder().add_column("id", Type.INT64, is_key=True).build()
    with pytest.raises(e.ColumnNotFoundError):
        TableSchema((Column("a", Type.INT64),)).index("A")


def test_point_filter_reaches_the_files(spark, tmp_path):
    spark.range(1000).selectExpr("id", "cast(id as double) v").write.parquet(f"{tmp_path}/t")
    engine = Engine(spark)
    engine.catalog.register_parquet("t", f"{tmp_path}/t", "id")
    plan = engine.sql("SELECT v FROM t WHERE id = 7 AND v > 1.0;")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(id,7)" in plan and "GreaterThan(v,1.0)" in plan
    assert "GreaterThanOrEqual(id,6)" in engine.sql("SELECT v FROM t WHERE id > 5.5;")._jdf.queryExecution().executedPlan().toString()


def test_groups_in_order(people):
    people.sorted_groups = True
    try:
        assert rows(people, "SELECT nick, grade FROM crew GROUP BY nick, grade;") == [("Ika", 31), ("Juro", 45), ("Lene", 31), ("Milo", 31), (None, 28)]
        assert rows(people, "SELECT grade FROM crew GROUP BY grade ORDER BY grade DESC;") == [45, 31, 28]
    finally:
        people.sorted_groups = False


def test_large_limits_are_exact(spark, monkeypatch):
    from quern.operators import relational

    df = spark.range(100).repartition(7).orderBy("id")
    assert relational.limited(df, 3_000_000_000).count() == 100
    monkeypatch.setattr(relational, "_PLAN_LIMIT", 5)
    assert [r.id for r in relational.limited(df, 42).collect()] == list(range(42))
