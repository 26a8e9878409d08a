"""Stored state, settings, proxies and live streams."""

from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from chanlake import cli
from chanlake.config import Config
from chanlake.functions import volume
from chanlake.operators import continuity, graph, media, pages, proxies
from chanlake.plans import scratch
from chanlake.sources import messages as store
from chanlake.streaming import landing

DAY = datetime(2031, 1, 1, tzinfo=timezone.utc)


def test_settings(tmp_path):
    c = Config.from_env({"CHANLAKE_API_ID": "7", "CHANLAKE_BATCH_SIZE": "0", "CHANLAKE_LOG_LEVEL": "DEBUG"})
    assert (c.api_id, c.batch_size, c.log_level) == (7, 0, "DEBUG")
    assert c.errors() == ["api_hash is required", "batch_size must be >= 1"]
    c.to_file(str(tmp_path / "c.json"))
    assert Config.from_file(str(tmp_path / "c.json")) == c
    (tmp_path / "bad.json").write_text('{"colour": 1}')
    with pytest.raises(ValueError):
        Config.from_file(str(tmp_path / "bad.json"))
    assert Config.from_env({"CHANLAKE_API_ID": ""}).api_id is None
    cli.main(["init", str(tmp_path / "d.json")])
    assert Config.from_file(str(tmp_path / "d.json")).batch_size == 100


def test_checkpoints_keep_what_a_row_leaves_out(spark, tmp_path):
    c = store.Checkpoints(spark, str(tmp_path / "c"))
    rows = lambda *r: spark.createDataFrame(r, "channel_id long, channel_name string, min_id long, max_id long, completed boolean, updated_at timestamp, extra int")
    c.update(rows((1, "a", 5, 9, None, DAY, 0), (2, "b", None, None, None, DAY, 0), (None, "x", 1, 1, None, DAY, 0)))
    c.update(rows((1, None, 3, 7, True, DAY + timedelta(days=1), 0)))
    c.update(rows((1, None, 3, 7, True, DAY + timedelta(days=1), 0)))
    r = c.read(1)
    assert (r["channel_name"], r["min_id"], r["max_id"], r["completed"]) == ("a", 3, 9, True)
    assert c.read(2)["min_id"] is None and c.read(3) is None and c.state().count() == 2


def test_gaps_across_blocks_and_long_ranges(spark, monkeypatch):
    rows = [(1, k) for k in (1, 2, 5, 40, 41, 300)] + [(1, 2), (2, 7), (None, 1), (None, 4), (3, None)]
    df = spark.createDataFrame(rows, "channel_id long, message_id long")
    want = [(1, 3, 4), (1, 6, 39), (1, 42, 299), (None, 2, 3)]
    for bits in (1, 3, 20):
        monkeypatch.setattr(continuity, "BLOCK_BITS", bits)
        monkeypatch.setattr(continuity, "CHUNK", 7)
        got = sorted(((r["channel_id"], r["from_id"], r["to_id"]) for r in continuity.gap_ranges(df).collect()), key=str)
        assert got == sorted(want, key=str)
        ids = [tuple(r) for r in continuity.gaps(df).collect()]
        assert len(ids) == len(set(ids)) == sum(b - a + 1 for _, a, b in want)


def test_fallback_ids_across_blocks(spark, monkeypatch):
    df = spark.createDataFrame([(k, "a" if k % 3 else None, None if k % 2 else 0, "x") for k in range(40)] + [(50, "a", 99, "x")], "k long, channel string, message_id long, _block string")
    got = []
    for n in (7, 10**6):
        monkeypatch.setattr(pages, "NUMBERED", n)
        got.append({r["k"]: r["message_id"] for r in pages.fallback_ids(df.drop("_block"), "channel", "k").collect()})
    assert got[0] == got[1] and got[0][50] == 99
    assert [got[0][k] for k in (1, 2, 4)] == [1, 2, 3] and [got[0][k] for k in (0, 3)] == [1, 2]


def test_proxies(spark):
    rows = [("http", f"h{k}", 80 + k, None, None, float(k), None, k, 5 if k == 0 else 0) for k in range(30)]
    p = spark.createDataFrame(rows, "type string, host string, port int, country string, country_code string, latency_ms double, score double, successes int, failures int")
    assert proxies.available(p).count() == 29 and proxies.ranked(p).count() == 10
    up = sorted((r["host"], r["port"]) for r in proxies.available(p).collect())
    assert [(proxies.chosen(p, "round_robin", t)["host"]) for t in (-1, 0, 28)] == [up[0][0], up[1][0], up[0][0]]
    assert proxies.chosen(p, "weighted", seed=1)["host"] in {r["host"] for r in proxies.ranked(p).collect()}
    assert {proxies.chosen(p, "random", seed=s)["host"] for s in range(12)} > {"h1"} - {"h1"}
    assert proxies.chosen(p.limit(0)) is None and proxies.chosen(p.limit(0), "round_robin") is None
    more = proxies.added(p, "h1", 81)
    assert more.count() == 30 and proxies.added(p, "new", 1).count() == 31
    assert proxies.tested(p.limit(0).select(F.lit(True).alias("ok"))).first()["success_rate"] == 0.0
    assert [tuple(r) for r in proxies.by(p, "type").collect()] == [("http", 29)]


def test_media_counts(spark):
    t = spark.createDataFrame([(s,) for s in ("downloaded", "exists", "unsupported", "failed", None, "pending")], "status string")
    assert tuple(media.stats(t).first()) == (3, 1, 2)
    assert tuple(media.stats(t.limit(0)).first()) == (0, 0, 0)


def test_forward_source(spark):
    df = spark.createDataFrame([("channel", 1, None), ("chat", 2, None), ("user", 3, None), (None, None, 4), ("user", 3, 5)], "kind string, peer long, old long")
    got = [r[0] for r in df.select(graph.forward_source(F.col("kind"), F.col("peer"), F.col("old"))).collect()]
    assert got == [1, 2, None, 4, 5]


def test_files_of_unlike_schemas(spark, tmp_path):
    a = spark.createDataFrame([(1, 10, "x")], "message_id long, channel_id long, text string")
    b = spark.createDataFrame([(2.0, "y", 5)], "message_id double, text string, more int")
    paths = []
    for k, df in enumerate((a, b, a)):
        paths.append(str(tmp_path / f"f{k}"))
        df.write.parquet(paths[-1])
    got = store.load_foreign(spark, paths)
    assert sorted(r["message_id"] for r in got.collect()) == [1, 1, 2] and got.schema == store.SCHEMA
    assert store.load_foreign(spark, []).count() == 0


def test_live_status_equals_the_whole_log(spark, tmp_path):
    src, told = tmp_path / "in", []
    for k in range(3):
        rows = [(1, m, f"text {m} {k if m == 2 else 0}", DAY + timedelta(hours=k)) for m in range(k, 4)] + [(1, None, "no id", DAY)]
        df = spark.createDataFrame(rows, "channel_id long, message_id long, text string, scraped_at timestamp")
        store.conform(df).coalesce(1).write.mode("append").parquet(str(src))
    listener = landing.Progress(told.append)
    spark.streams.addListener(listener)
    try:
        q = landing.ingest(landing.messages(spark, str(src), files=1), str(tmp_path / "s"), str(tmp_path / "l"), str(tmp_path / "c"), str(tmp_path / "state")).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
        landing.stop(q)
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    finally:
        spark.streams.removeListener(listener)
    assert not q.isActive
    rows = lambda df: sorted(map(tuple, df.select("channel_id", "message_id", "status", "observed", "first_seen_us", "last_checked_us").collect()))
    live, whole = rows(landing.live_status(spark, str(tmp_path / "state"))), rows(landing.status(spark, str(tmp_path / "l")))
    assert live == whole and {r[2] for r in live} == {"observed", "edited"}


def test_partitions_follow_the_volume(spark, tmp_path):
    spark.range(200_000).selectExpr("id", "cast(id as string) AS s").write.parquet(str(tmp_path / "t"))
    t = spark.read.parquet(str(tmp_path / "t"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert volume.partitions(t, 1 << 40) == n
    assert volume.partitions(t, 10_000) > 2 * n
    assert volume.partitions(t, 1) == volume.MOST
    assert volume.partitions(spark.createDataFrame([(1,)], "a int")) >= n


def test_small_files_in_the_shared_folder(spark):
    path = scratch.scratch_path(spark, "small")
    assert scratch.read_bytes(spark, path) is None
    scratch.write_bytes(spark, path, b"\x00\xff body")
    assert scratch.read_bytes(spark, path) == b"\x00\xff body"
