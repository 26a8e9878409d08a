import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from chanlake.session import get_spark

    s = get_spark("local[4]", 4, "tests")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def _copies(sf, to, change):
    import pyarrow.parquet as pq

    for f in os.listdir(sf):
        pq.write_table(change(f[:-8], pq.read_table(f"{sf}/{f}")), f"{to}/{f}")
    return str(to)


@pytest.fixture(scope="session")
def empty_sf(sf, tmp_path_factory):
    """The tables without rows."""
    return _copies(sf, tmp_path_factory.mktemp("empty"), lambda name, t: t.slice(0, 0))


@pytest.fixture(scope="session")
def null_sf(sf, tmp_path_factory):
    """A few rows of each table, nulls everywhere but in the row ids, every row twice."""
    import pyarrow as pa

    ids = ("delivery_id", "doc_id", "item_id", "run_id")

    def change(name, t):
        t = t.slice(0, 20)
        t = pa.table({c: t[c] if c in ids else pa.nulls(t.num_rows, t.schema.field(c).type) for c in t.column_names})
        return pa.concat_tables([t, t])

    return _copies(sf, tmp_path_factory.mktemp("nulls"), change)
