"""The registered operator queries against their DuckDB counterparts."""

import pytest

from quern.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracle(spark, data, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    a, b = queries.queries()[name](spark, data).toPandas(), con.execute(queries.oracle_sql()[name]).fetchdf()
    assert sorted(a.columns) == sorted(b.columns)
    rows = lambda df: sorted(tuple(map(str, r)) for r in df[[c for c in sorted(df.columns) if c != "grown_shard"]].astype(object).itertuples(index=False))
    assert rows(a) == rows(b)


def test_all_operators_are_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert {f"op{n}" for n in range(1, 11)} == {k.split("_")[0] for k in names if k.startswith("op")} and "pipeline" in names
