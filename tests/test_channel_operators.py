import json
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from chanlake.functions import disclosure
from chanlake.operators import continuity, filters, graph, media, pages, proxies
from chanlake.operators.filters import FilterSpec
from chanlake.sources import messages as store
from chanlake.sources import sinks

UTC = timezone.utc


def frame(spark, rows):
    cols = "id int, text string, views long, reactions_json string, media_type string, has_media boolean, date timestamp"
    return spark.createDataFrame(rows, cols)


def ids(df):
    return sorted(r[0] for r in df.select("id").collect())


def test_filter_quirks(spark):
    df = frame(spark, [(1, "Malware ÉTION c&c", 5, None, None, False, None), (2, None, None, "bad json", "MessageMediaPhoto", True, datetime(2031, 1, 1, tzinfo=UTC)), (3, "", 50, '[{"emoji":"x"},{"emoji":"y","count":4}]', "", None, None)])
    assert ids(FilterSpec().apply(df)) == [1, 2, 3]
    assert ids(FilterSpec(media_types=["PHOTO"]).apply(df)) == [1, 2, 3]  # null and empty types skip the criterion
    assert ids(FilterSpec(media_types=["video"], min_views=50, mode="any").apply(df)) == [3]
    assert ids(FilterSpec(keywords=["étion", "C&C"]).apply(df)) == [1]
    assert ids(FilterSpec(regexes=[r"^z*$"]).apply(df)) == [2, 3]
    assert ids(FilterSpec(min_views=0).apply(df)) == [1, 2, 3]
    assert ids(FilterSpec(min_reactions=4).apply(df)) == [3]
    assert ids(FilterSpec(min_date=datetime(2031, 1, 1, tzinfo=UTC)).apply(df)) == [2]
    x = FilterSpec(keywords=["malware"], excludes=["étion"], mode="any").annotate(df).where("id = 1").first()
    assert not x["matched"] and x["matched_filters"] == ["excluded"] and x["matched_keywords"] == ["Malware"]
    assert FilterSpec().stats(df.limit(0)).first()["match_rate"] == 0.0
    with pytest.raises(ValueError):
        FilterSpec(regexes=["("]).apply(df)


def test_keyword_file():
    s = filters.from_lines(["# c", "", " malware ", r"/CVE-\d+/"])
    assert (s.keywords, s.regexes, s.mode) == (["malware"], [r"CVE-\d+"], "any")


def fold(log):
    """The log one row after the other."""
    cur, hist, first = None, [], None
    for kind, text, check, gap in log:
        if kind == "O":
            c = continuity_checksum(text) if check else None
            first = first or c
            cur = "edited" if c and c != first else "observed"
            hist += [cur] if c else []
        elif kind == "G":
            cur = "deleted" if cur == "observed" else gap
        elif cur is not None:
            cur = "deleted"
            hist.append("deleted")
    return cur, hist


def continuity_checksum(text):
    import hashlib

    return hashlib.sha256(text.encode()).hexdigest()[:16] if text else None


def test_continuity_against_sequential_fold(spark):
    import random

    r = random.Random(5)
    t0 = datetime(2031, 1, 1, tzinfo=UTC)
    rows, exp = [], {}
    for m in range(120):
        log = [(r.choice("OOGD"), r.choice(["a", "b", "", None]), r.random() < 0.8, r.choice(["unknown", "inaccessible"])) for _ in range(r.randrange(1, 6))]
        log = [(k, t if k == "O" else None, c if k == "O" else None, g if k == "G" else None) for k, t, c, g in log]
        exp[m] = fold(log)
        rows += [(1, m, t0 + timedelta(hours=k), k, *x) for k, x in enumerate(log)]
    df = spark.createDataFrame(rows + rows[:30], "channel_id long, message_id long, observed_ts timestamp, seq int, kind string, text string, check_edit boolean, gap_status string")
    got = {r["message_id"]: r["status"] for r in continuity.continuity(df).collect()}
    assert got == {m: s for m, (s, _) in exp.items() if s is not None}
    hist = {}
    for r in continuity.edit_history(df).orderBy("ts_us").collect():
        hist.setdefault(r["message_id"], []).append(r["status"])
    assert hist == {m: h for m, (s, h) in exp.items() if h}
    m = continuity.metrics(continuity.continuity(df)).first().asDict()
    assert m["gaps"] == m["expected"] - m["observed"]
    assert continuity.continuity(df.limit(0)).count() == 0


def test_statement():
    s = continuity.statement("c", {"gap_ratio": 0.0025, "deletion_rate": 0, "edit_rate": 0.5, "start": datetime(2031, 1, 2), "end": datetime(2031, 2, 3)})
    assert "0.2%" in s and "2031-01-02 and 2031-02-03" in s and "editing" in s and "deletion rate was" not in s


def test_gap_ranges(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (1, 6), (1, 6), (2, 4), (1, None)], "channel_id long, message_id long")
    assert [tuple(r) for r in continuity.gap_ranges(df).collect()] == [(1, 3, 5, 3)]
    assert sorted(r[1] for r in continuity.gaps(df).collect()) == [3, 4, 5]


def edges(spark, rows):
    return spark.createDataFrame(rows, "source long, target long, weight long, first_pos long")


def test_snowball(spark):
    e = edges(spark, [(9, 1, 2, 1), (9, 2, 2, 1), (8, 1, 3, 2), (7, 8, 5, 1)])
    r = graph.snowball(e, [1, 2], depth=2)
    assert r.visited == [1, 2, 8] and r.known == [1, 9, 8, 2, 7]  # 9 has weight 2 with its discoverer and isn't scanned
    n = {x["channel_id"]: (x["forward_count"], x["scanned"]) for x in graph.snowball_nodes(e, r).collect()}
    assert n == {1: (0, True), 2: (0, True), 8: (3, True), 9: (4, False), 7: (5, False)}
    e = edges(spark, [(10 + k, 1, 3, k) for k in range(5)] + [(50, 2, 3, 1)])
    r = graph.snowball(e, [1, 2], max_channels=3)
    assert len(r.known) == 6 and r.visited == [1]
    r = graph.snowball(e, [1, 2], accessible=lambda c: c != 1)
    assert r.errors == 1 and r.visited == [2]


def test_graph_exports():
    n, e = [(1, "T", None, 5, 2), (2, None, None, None, 0)], [(1, 2, 3)]
    x = graph.graphml(n, e).decode()
    assert 'key="title">T<' in x and 'key="username"' not in x and x.count('key="forward_count"') == 2 and 'key="weight">3<' in x
    x = graph.gexf(n, e).decode()
    assert 'label="T"' in x and 'label="2"' in x and 'weight="3"' in x


PAGE = """head<div class="tgme_widget_message_wrap js" data-post="chan/101"><a class="tgme_widget_message_forwarded_from_name" href="https://t.me/src1/5">s</a>
<div class="tgme_widget_message_text js" dir="auto">Hi<br/>A &amp;lt; B <b>x</b></div><time class="t" datetime="2031-01-02T03:04:05+00:00"></time><span class="tgme_widget_message_views">1.2K</span></div>
<div class="tgme_widget_message_wrap" data-post="chan/abc"><a style="background-image:url('p.jpg')"></a><video src="v.mp4"></video></div><div class="tgme_widget_message_wrap" data-post="chan/103"></div>"""


def test_pages(spark):
    r = pages.messages(spark.createDataFrame([(1, PAGE), (2, ""), (3, None), (4, "<div>")], "page_id int, html string")).orderBy("message_id").collect()
    assert len(r) == 2
    assert (r[1]["message_id"], r[1]["text"], r[1]["forward_from"], r[1]["views_text"]) == (101, "Hi\nA < B x", "src1", "1.2K")
    assert r[0]["message_id"] is None and r[0]["media_urls"] == ["p.jpg", "v.mp4"] and r[0]["text"] == ""
    c = spark.createDataFrame([(k,) for k in ("1.2K", "3M", "12 345", "1,234", "n/a", "", None)], "raw string")
    assert [x[0] for x in c.select(pages.counter(F.col("raw"))).collect()] == [1200, 3_000_000, 12345, 1234, None, None, None]
    h = '<div class="tgme_channel_info_header_title x"><span>T </span></div><div class="tgme_channel_info_counter"><span class="counter_value">1.5K</span> <span class="counter_type">subscribers</span>'
    g = pages.header(spark.createDataFrame([(h,), ("no",)], "html string"), F.lit("@@chan")).collect()
    assert [tuple(x) for x in g] == [("chan", "T", None, 1500)]


def test_media_and_disclosure(spark, tmp_path):
    d = spark.createDataFrame([("MessageMediaDocument", "image/jpeg", None)], "m string, mime string, f string")
    k = media.kind(F.col("m"), F.col("mime"), F.lit(False), F.lit(False))
    assert tuple(d.select(k, media.extension(k, F.col("mime"), F.col("f"))).first()) == ("image", "jpg")
    for n in ("b.bin", "a.bin", "c.bin"):
        (tmp_path / n).write_bytes(b"x" if n != "c.bin" else b"y")
    files = spark.read.format("binaryFile").load(str(tmp_path))
    assert sorted(r["path"].rsplit("/", 1)[1] for r in media.distinct_files(files).collect()) == ["a.bin", "c.bin"]
    lim = {r["backend"]: r["limitations"] for r in disclosure.limitations(disclosure.capabilities(spark)).collect()}
    assert lim["mtproto"] == [] and len(lim["web"]) == 9 and disclosure.disclaimer("?") == disclosure.UNKNOWN


def test_proxies(spark):
    t = proxies.parse_lines(spark.createDataFrame([("# c",), ("1.2.3.4:80",), ("socks5://u:p@h.example:1080",), ("bad",), ("",)], "value string")).collect()
    assert {(r["type"], r["host"], r["port"], r["username"]) for r in t} == {("http", "1.2.3.4", 80, None), ("socks5", "h.example", 1080, "u")}
    j = json.dumps({"proxies": [{"ip": "9.9.9.9", "port": 1, "country": "X"}, {"port": 2}]})
    assert [(r["host"], r["type"], r["country"]) for r in proxies.parse_json(spark.createDataFrame([(j,), ("nope",)], "value string")).collect()] == [("9.9.9.9", "socks5", "X")]
    m = spark.createDataFrame([(1, "a", 1, None, None, 3.0, None, None), (2, "a", 1, "X", "x", 9.0, 1.0, "o")], "n int, host string, port int, country string, country_code string, latency_ms double, score double, org string")
    assert [(r["n"], r["country"], r["latency_ms"]) for r in proxies.merged(m, "n").collect()] == [(1, "X", 9.0)]
    p = spark.createDataFrame([("h", 1, 0, 0, None, None), ("g", 1, 0, 5, 10.0, 5.0)], "host string, port int, successes int, failures int, latency_ms double, score double")
    s = proxies.pool_stats(p).first()
    assert (s["total"], s["available"], s["dead"], s["mean_success_rate"]) == (2, 1, 1, 0.5)
    assert [r["host"] for r in proxies.ranked(p).collect()] == ["h", "g"]


def test_store_and_sinks(spark, tmp_path):
    p1, p2 = str(tmp_path / "a"), str(tmp_path / "b")
    spark.createDataFrame([(1.0, 5, "x")], "message_id double, channel_id int, text string").write.parquet(p1)
    spark.createDataFrame([(2, 5, "a,\"b\"\nc")], "message_id long, channel_id long, text string").write.parquet(p2)
    m = store.load_foreign(spark, [p1, p2])
    assert sorted((r["message_id"], r["channel_id"]) for r in m.collect()) == [(1, 5), (2, 5)] and m.schema == store.SCHEMA
    assert sinks.to_json_array(m.select("message_id", "text"), str(tmp_path / "x.json")) == 2
    assert len(json.loads((tmp_path / "x.json").read_text())) == 2
    sinks.to_csv(m.select("text"), str(tmp_path / "csv"))
    assert {r[0] for r in spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(str(tmp_path / "csv")).collect()} == {"x", 'a,"b"\nc'}
    sinks.append_messages(m.withColumn("channel_name", F.lit("c")), str(tmp_path / "store"))
    assert store.load(spark, str(tmp_path / "store")).where("channel_name = 'c'").count() == 2
    with sinks.Run(spark, str(tmp_path / "runs"), ["c"]) as r:
        r.count(messages_collected=2)
        r.end()
    assert spark.read.parquet(str(tmp_path / "runs")).count() == 1
    rep = sinks.bias_report({"channel_id": 1, "expected": 4, "observed": 3, "gaps": 1, "gap_ratio": 0.00015, "coverage_rate": 0.75, "deleted": 0, "possibly_deleted": 1, "deletion_rate": 0.0, "edited": 0, "edit_rate": 0.0, "start_us": 0, "end_us": None}, "c", [], str(tmp_path / "r.json"))
    assert rep["metrics"]["coverage"]["gap_ratio"] == 0.0001


def test_stream_equals_batch(spark, tmp_path):
    from chanlake.streaming import landing

    t = datetime(2031, 1, 1, tzinfo=UTC)
    rows = [(k % 7, 1, "ab"[k % 2] if k % 7 == 3 else "a", t + timedelta(minutes=k)) for k in range(20)]
    df = spark.createDataFrame(rows, "message_id long, channel_id long, text string, scraped_at timestamp")
    src = str(tmp_path / "land")
    store.conform(df).repartition(4).write.parquet(src)
    q = landing.ingest(landing.messages(spark, src, files=1), str(tmp_path / "s"), str(tmp_path / "l"), str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "s")).count() == 20
    assert landing.status(spark, str(tmp_path / "l")).exceptAll(continuity.continuity(landing.observations(store.conform(df)))).count() == 0
    first = landing.first_arrivals(landing.messages(spark, src)).writeStream.format("memory").queryName("firsts").trigger(availableNow=True).start()
    first.awaitTermination()
    assert spark.sql("select * from firsts").count() == 7


def test_empty_messages_in_every_operator(spark):
    e = spark.createDataFrame([], store.SCHEMA)
    assert store.latest(e).count() == 0 and store.normalized(e).count() == 0 and graph.edges(e, 5).count() == 0
    assert graph.stats(graph.edges(e)).first()["total_edges"] == 0
    assert continuity.gaps(e).count() == 0 and filters.keyword_counts(e, filters.preset("cti")).count() == 0
