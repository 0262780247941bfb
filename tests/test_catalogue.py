import duckdb
import pytest

from askframe import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings labels conversations"


@pytest.fixture(scope="module")
def oracle(folder):
    connection = duckdb.connect()
    for name in TABLES.split():
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return connection


def plain(value):
    if value is None or value != value:
        return "null"
    return f"{value:.5f}" if isinstance(value, int | float) and not isinstance(value, bool) else str(value)


def test_every_query_has_sql():
    assert set(catalogue.queries()) == set(catalogue.ORACLE)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_query_equals_sql(spark, folder, oracle, name):
    df = catalogue.queries()[name](spark, folder)
    columns = sorted(df.columns)
    found = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    result = oracle.execute(catalogue.ORACLE[name])
    names = [d[0] for d in result.description]
    wanted = sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall())
    assert sorted(names) == columns and found == wanted
