"""Every registered query of the sheet engine against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from gridloom import catalog

DIR = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="the driver's tables aren't here")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for file in os.listdir(DIR):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM read_parquet('{DIR}/{file}')")
    return con


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)
    assert catalog.FLAGSHIP in catalog.QUERIES


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_gives_the_rows_of_its_sql(spark, db, name):
    df = catalog.QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    got = [tuple(r) for r in df.select(*(f"`{c}`" for c in columns)).collect()]
    found = db.execute(catalog.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = [tuple(r[names.index(c)] for c in columns) for r in found.fetchall()]
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(got, key=key) == sorted(want, key=key)
    assert got


@pytest.mark.parametrize("name, table", [("serial_roundtrip", "events"), ("xlsx_roundtrip", "orders"), ("xlsx_compact", "orders")])
def test_round_trips_cover_the_whole_table(spark, name, table):
    assert catalog.QUERIES[name](spark, DIR).count() == spark.read.parquet(f"{DIR}/{table}.parquet").count()


def test_serials_go_to_the_second_that_sql_gives(spark, db, tmp_path):
    """Half seconds, a microsecond before them, both ends of the dates of serials and nulls; the two events of 60 copies of the tables that differed are among them."""
    db.execute(f"""COPY (
        SELECT row_number() OVER () - 1 AS event_id, CASE WHEN us >= 0 THEN day + to_microseconds(us) END AS ts
        FROM (SELECT unnest([0, 1, 499999, 500000, 500001, 999999, 46887500000, 9569500000, 86399499999, 86399500000, -1]) AS us),
        (SELECT unnest(['1600-02-29', '1899-12-29', '1899-12-30', '1969-12-31', '2026-08-17', '2027-12-01', '2079-06-07', '9999-12-30']::TIMESTAMP[]) AS day)
    ) TO '{tmp_path}/events.parquet' (FORMAT parquet)""")
    got = catalog.QUERIES["serial_roundtrip"](spark, str(tmp_path)).select("event_id", "serial", "back").orderBy("event_id").collect()
    want = db.execute(catalog.ORACLES["serial_roundtrip"].replace("FROM events", f"FROM read_parquet('{tmp_path}/events.parquet')") + " ORDER BY event_id").fetchall()
    assert len(got) == 88
    assert [tuple(r) for r in got] == want
