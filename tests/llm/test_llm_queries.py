"""Every query of the subpackage over the smallest tables."""

import pytest

from chanlake.llm import queries as q

COLUMNS = {"p2_found": "delivery_id kind", "p3_found": "field key_a key_b", "p5_found": "delivery_id lang", "p6_found": "delivery_id", "p7_found": "delivery_id group_id", "p8_found": "doc_id item_id", "p10_found": "doc_id"}


@pytest.mark.parametrize("name", sorted(set(q.QUERIES) - {"p6_scores", "p6_rates"}))
def test_runs(spark, sf, name):
    df = q.QUERIES[name](spark, sf)
    rows = df.collect()
    if name in COLUMNS:
        assert df.columns == COLUMNS[name].split() and len(rows) == len(set(rows))
    assert rows


@pytest.mark.parametrize("name", sorted(set(q.QUERIES) - {"p6_scores", "p6_rates"}))
def test_empty_and_null_tables(spark, empty_sf, null_sf, name):
    assert q.QUERIES[name](spark, empty_sf).count() in (0, 16) or name == "p9_shares"
    rows = q.QUERIES[name](spark, null_sf).collect()
    if name in COLUMNS:
        assert rows == []
