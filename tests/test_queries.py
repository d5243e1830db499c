import duckdb
import pytest

from pathloom import queries

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents".split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", list(queries.queries()))
def test_query_agrees_with_sql(spark, duck, name):
    df = queries.queries()[name](spark, DIR)
    result = duck.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    order = lambda rows: sorted(rows, key=lambda r: [(v is None, str(v)) for v in r])
    assert order([tuple(r[c] for c in columns) for r in df.collect()]) == order(result.fetchall())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
