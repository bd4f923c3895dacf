"""Every registered query against its SQL twin in DuckDB, over the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from larkspur.plans import catalog

DATA = Path("/root/testdata/sf0.001")
QUERIES, SQL = catalog.queries(), catalog.oracle_sql()
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(repr(tuple(round(r[i], 3) if isinstance(r[i], float) else r[i] for i in order)) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, str(DATA))
    c = duck.execute(SQL[name])
    assert _rows(df.columns, [tuple(r) for r in df.collect()]) == _rows([d[0] for d in c.description], c.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - {"propensity_scores", "feature_importance"}))
def test_runs_without_sql(spark, name):
    assert QUERIES[name](spark, str(DATA)).count() > 0


def test_entry_points(spark):
    import __spark_entry__

    assert set(QUERIES) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0
