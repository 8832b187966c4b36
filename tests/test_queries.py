"""Each query gives the rows of its SQL, run by DuckDB on the same tables."""

import duckdb
import pytest

from terrane import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for n in "region nation customer supplier part orders lineitem events documents labels conversations".split():
        con.execute(f"CREATE VIEW {n} AS SELECT * FROM '{SF}/{n}.parquet'")
    return con


def plain(v):
    if v is None or v != v:
        return None
    if hasattr(v, "item"):
        v = v.item()
    return round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_rows(spark, duck, name):
    got = queries.QUERIES[name](spark, SF)
    cur = duck.execute(queries.SQL[name])
    want = cur.fetchall()
    names = [d[0] for d in cur.description]
    assert sorted(got.columns) == sorted(names)
    rows = [tuple(r[c] for c in names) for r in got.collect()]
    assert sorted(repr(tuple(map(plain, r))) for r in rows) == sorted(repr(tuple(map(plain, r))) for r in want)


def test_uuid_query(spark):
    ids = [r["id"] for r in queries.QUERIES["fn_uuid"](spark, SF).collect()]
    assert len(set(ids)) == len(ids) == 5


def test_order_of_sorted_query(spark):
    rows = queries.QUERIES["sort_multi"](spark, SF).collect()
    assert rows == sorted(rows, key=lambda r: (-r["o_totalprice"], r["o_orderkey"]))
