import pytest

from larkspur.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = ["documents", "labels", "events", "pages", "region", "nation", "orders"]


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def cell(value):
    if isinstance(value, float):
        return f"{value:.5f}"
    return str(value)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_agrees_with_its_sql(spark, duck, name):
    out = registry.queries()[name](spark, SF)
    if name not in registry.oracle_sql():
        assert out.count() > 0
        return
    cursor = duck.execute(registry.oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(out.columns)
    want = sorted(tuple(map(cell, r)) for r in cursor.fetchall())
    got = sorted(tuple(map(cell, r)) for r in out.select(*names).collect())
    assert got == want
