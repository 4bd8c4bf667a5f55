import duckdb
import pytest

from corbel.plans.queries import ORACLE, QUERIES

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SMALL)
    if name not in ORACLE:
        assert got.count() > 0
        return
    want = duck.execute(ORACLE[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    plain = lambda rows: sorted(map(repr, (tuple(x.replace(tzinfo=None) if hasattr(x, "tzinfo") else x for x in r) for r in rows)))
    assert plain(got.select(columns).collect()) == plain(want.fetchall())
