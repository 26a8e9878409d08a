"""Queries against their SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry


def cells(rows):
    norm = lambda v: "" if v is None or v != v else repr(round(v, 9)) if isinstance(v, float) else str(v)
    return sorted(tuple(map(norm, r)) for r in rows)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM read_parquet('{sf}/{f}')")
    return con


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_equals_sql(spark, sf, duck, name):
    df = entry.queries()[name](spark, sf)
    cols = sorted(df.columns)
    got = cells(tuple(r[c] for c in cols) for r in df.collect())
    cur = duck.execute(f"SELECT {', '.join(cols)} FROM ({entry.oracle_sql()[name]}) q")
    assert got == cells(cur.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(k for m in entry._MODULES if not m.__name__.startswith("chanlake.llm") for k in m.QUERIES))
def test_empty_and_null_tables(spark, empty_sf, null_sf, name):
    for sf in (empty_sf, null_sf):
        df = entry.queries()[name](spark, sf)
        assert df.columns
        df.collect()


def test_message_hash_keeps_all_rows(spark, sf, tmp_path):
    import hashlib
    from datetime import datetime, timezone

    import pyarrow as pa
    import pyarrow.parquet as pq

    t = pq.read_table(f"{sf}/messages.parquet").slice(0, 3)
    dates = [datetime(2024, 5, 1, 10, 2, 3, tzinfo=timezone.utc), datetime(2024, 5, 1, 10, 2, 3, 250000, tzinfo=timezone.utc), None]
    for name, col in (("date", pa.array(dates, pa.timestamp("us", "UTC"))), ("text", pa.array(["a"] * 3)), ("message_id", pa.array([7] * 3, pa.int64()))):
        t = t.set_column(t.column_names.index(name), name, col)
    pq.write_table(t, tmp_path / "messages.parquet")
    got = {r["delivery_id"]: r["hash"] for r in entry.queries()["message_hash"](spark, str(tmp_path)).collect()}
    assert list(map(got.get, t["delivery_id"].to_pylist())) == [hashlib.md5(f"a|{d}|7".encode()).hexdigest() for d in dates]
