"""Every registered query of the graph engine against its SQL, on the smallest tables."""

import duckdb
import pytest

from geoweft import queries

SF = "/root/testdata/sf0.001"
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "labels"]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    yield c
    c.close()


def plain(value):
    if isinstance(value, float):
        return f"{value:.4f}"
    return bytes(value) if isinstance(value, bytearray) else value


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(queries.Q))
def test_query_equals_its_sql(spark, duck, name):
    got = queries.Q[name](spark, SF)
    want = duck.execute(queries.SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert rows(got.columns, got.collect()) == rows(columns, want.fetchall())


@pytest.mark.parametrize(("name", "others"), [("sqlite_positions", ["lineitem", "labels"]), ("sqlite_properties", ["lineitem", "nation", "region", "supplier"])])
def test_sqlite_query_needs_no_other_table(spark, duck, tmp_path, name, others):
    """Tables that no row of the result comes from are neither read nor written, nor can they make the query fail."""
    for t in set(TABLES) - set(others):
        (tmp_path / f"{t}.parquet").symlink_to(f"{SF}/{t}.parquet")
    got, want = queries.Q[name](spark, str(tmp_path)), duck.execute(queries.SQL[name])
    assert rows(got.columns, got.collect()) == rows([d[0] for d in want.description], want.fetchall())
