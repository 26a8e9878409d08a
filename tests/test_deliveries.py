import random

from chanlake.operators import deliveries as D

SCHEMA = "delivery_id long, channel_id long, message_id long, scraped_at timestamp_ntz, _id string, c0 int, _lost boolean"


def rows(n, seed):
    from datetime import datetime, timedelta

    r = random.Random(seed)
    t = datetime(2031, 1, 1)
    pick = lambda x, p=0.1: None if r.random() < p else x
    return [(k, pick(r.choice([7] * 5 + [1, 2])), pick(r.randrange(n // 4)), pick(t + timedelta(hours=r.randrange(5))), "x", k, True) for k in range(n)]


def expected(data):
    best = {}
    for d, c, m, t, *_ in data:
        if c is not None and m is not None:
            best.setdefault((c, m), []).append((t is not None, t, -d))
    keep = {-max(v, key=lambda x: (x[0], x[1] or 0, x[2]) if x[0] else (False, 0, x[2]))[2] for v in best.values()}
    return {d for d, c, m, *_ in data if c is not None and m is not None and d not in keep}


def test_against_brute_force_with_nulls_ties_and_clashing_names(spark):
    data = rows(400, 1)
    df = spark.createDataFrame(data, SCHEMA).repartition(5)
    lost = [r[0] for r in D.redundant(df).collect()]
    assert sorted(lost) == sorted(expected(data))
    kept = {r[0] for r in D.keep_one(df, ["delivery_id", "_id"]).collect()}
    assert kept == {r[0] for r in data} - set(lost)


def test_one_identifier_for_all_rows(spark):
    data = [(k, 1, 1, None, "x", 0, False) for k in range(300)]
    assert D.redundant(spark.createDataFrame(data, SCHEMA)).count() == 299


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert D.redundant(df).count() == 0 and D.keep_one(df, ["delivery_id"]).count() == 0


def test_text_keys_and_repeated_rows(spark):
    df = spark.createDataFrame([(1, "a", 5), (1, "a", 5), (2, "b", 1), (3, None, 1), (3, None, 1)], "id long, k string, o int")
    assert [r[0] for r in D.redundant(df, ["k"], "o", "id").collect()] == [1]
    assert D.keep_one(df, ["id"], ["k"], "o", "id").count() == 4


def test_ledger_over_batches(spark, tmp_path):
    data = rows(300, 2)
    led = D.Ledger(spark, str(tmp_path / "ledger"), shards=4)
    seen, taken = set(), []
    for k in range(3):
        part = data[k * 100 : k * 100 + 100]
        got = {r[0] for r in led.ingest(spark.createDataFrame(part, SCHEMA)).collect()}
        taken += got
        for d, c, m, *_ in part:
            if c is None or m is None:
                assert d in got
        fresh = {(c, m) for d, c, m, *_ in part if None not in (c, m)} - seen
        assert {(c, m) for d, c, m, *_ in part if d in got and None not in (c, m)} == fresh
        assert sum(1 for d, c, m, *_ in part if d in got and None not in (c, m)) == len(fresh)
        seen |= fresh
    assert led.version() == 3
    again = led.ingest(spark.createDataFrame(data[:100], SCHEMA)).collect()
    assert all(data[r[0]][1] is None or data[r[0]][2] is None for r in again)


def test_shards_double_and_results_stay(spark, tmp_path):
    data = rows(300, 3)
    one, two = (D.Ledger(spark, str(tmp_path / n), shards=1, per_shard=k) for n, k in (("a", 10**6), ("b", 20)))
    for k in range(3):
        part = spark.createDataFrame(data[k * 100 : k * 100 + 100], SCHEMA)
        assert sorted(r[0] for r in one.ingest(part).collect()) == sorted(r[0] for r in two.ingest(part).collect())
    assert one.pointer()["shards"] == 1 and two.pointer()["shards"] >= 4
    assert one.pointer()["identifiers"] == two.pointer()["identifiers"]
    assert two.vacuum(0) > 0 and two.version() == 3
    again = two.ingest(spark.createDataFrame(data, SCHEMA)).collect()
    assert all(data[r[0]][1] is None or data[r[0]][2] is None for r in again)


def test_the_second_of_two_writers_changes_nothing(spark, tmp_path):
    a, b = (D.Ledger(spark, str(tmp_path / "ledger"), shards=2) for _ in "ab")
    one, two = (spark.createDataFrame([(k, 1, k, None, "x", 0, False)], SCHEMA) for k in (1, 2))
    start = b.pointer()
    b.pointer = lambda: start  # b has read the ledger before a commits
    assert [r[0] for r in a.ingest(one).collect()] == [1]
    import pytest

    with pytest.raises(Exception):
        b.ingest(two)
    del b.pointer
    assert a.ingest(one).count() == 0
    assert [r[0] for r in b.ingest(two).collect()] == [2]


def test_bitmap():
    import numpy as np

    b = D.Bitmap()
    codes = np.r_[np.arange(70_000), 200_000]
    b.unite(codes)
    c = D.Bitmap()
    for k, body in b.dump():
        c.load(k, body)
    probe = np.array([0, 65_535, 69_999, 70_000, 200_000, 200_001])
    assert c.test(probe).tolist() == [True, True, True, False, True, False] and c.chunks[0] is None
