"""Queries over landed pages, proxy pools, media tasks, exports and stored state, and their SQL.

Pages, proxy lists and tasks aren't among the tables. They are made from whole tables here, in the form in which they land, and
what the operators read out of them is compared with the tables.
"""

from __future__ import annotations


import xml.etree.ElementTree as ET
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.disclosure import _FLAGS, _WEB, DISCLAIMERS, LIMITATIONS, capabilities, disclosures
from ..operators import activity, continuity, filters, graph, media, pages, proxies
from ..sources import messages as store
from ..sources import sinks
from ..sources.tables import table
from ..streaming import landing
from . import scratch
from .channel_queries import _FOLD, _KEPT, _NEWEST, _TOTAL, _kept, _m, _q
from .channel_queries import ORACLES as ORACLES_OF

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


# -- pages --------------------------------------------------------------------------------------------


def landed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page, channel, html): pages of about twenty messages of a channel with the markup of public previews."""
    m = _m(spark, sf_dir)
    name = F.concat(F.lit("chan"), F.coalesce(F.col("channel_id").cast("string"), F.lit("")))
    safe = F.replace(F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit("\n"), F.lit("<br/>"))
    part = lambda *c: F.coalesce(F.concat(*[F.lit(x) if isinstance(x, str) else x for x in c]), F.lit(""))
    post = F.concat(name, F.lit("/"), F.coalesce(F.col("message_id").cast("string"), F.lit("x")))
    block = F.concat(
        F.lit('<div class="tgme_widget_message_wrap js-wrap" data-post="'), post, F.lit('">'),
        part('<a class="tgme_widget_message_forwarded_from_name" href="https://t.me/chan', F.col("fwd_from_channel_id").cast("string"), '/7"><span>source</span></a>'),
        part('<div class="tgme_widget_message_text js-text" dir="auto">', safe, "</div>"),
        F.when(F.col("has_media"), part("<a style=\"background-image:url('https://media.example/", F.col("delivery_id").cast("string"), ".jpg')\"></a>")).otherwise(""),
        part('<span class="tgme_widget_message_views">', F.col("views").cast("string"), "</span>"),
        part('<time datetime="', F.date_format("date", "yyyy-MM-dd'T'HH:mm:ssxxx"), '"></time>'), F.lit("</div>"),
    )
    x = m.select(name.alias("channel"), F.floor(F.col("delivery_id") / 20).alias("page"), "delivery_id", block.alias("block"))
    x = x.groupBy("channel", "page").agg(F.array_sort(F.collect_list(F.struct("delivery_id", "block"))).alias("blocks"))
    return x.select("page", "channel", F.concat(F.lit("<html><body>"), F.array_join(F.transform("blocks", lambda b: b["block"]), "\n"), F.lit("</body></html>")).alias("html"))


_SPACE = "\\s\\x1c-\\x1f\\x{85}\\x{a0}"
_WEBTEXT = "replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
for _a, _b in pages.ENTITIES:
    _WEBTEXT = f"replace({_WEBTEXT}, '{_q(_a)}', '{_q(_b)}')"
_WEBTEXT = f"regexp_replace(coalesce({_WEBTEXT}, ''), '^[{_SPACE}]+|[{_SPACE}]+$', '', 'g')"
_WEB_ROWS = f"""SELECT delivery_id, concat('chan', channel_id) AS channel, message_id, {_WEBTEXT} AS text, epoch_us(date_trunc('second', date)) AS date_us, 'chan' || CAST(fwd_from_channel_id AS VARCHAR) AS forward_from,
 CASE WHEN has_media THEN concat('https://media.example/', delivery_id, '.jpg') END AS media_url, CAST(views AS VARCHAR) AS views_text FROM messages"""
_WEB_SQL = f"SELECT * FROM ({_WEB_ROWS}) w WHERE text <> '' OR media_url IS NOT NULL"


@query(f"SELECT channel, message_id, text, date_us FROM ({_WEB_SQL}) q")
def web_messages(spark, sf_dir):
    return pages.messages(landed(spark, sf_dir)).select("channel", "message_id", "text", F.unix_micros("date").alias("date_us"))


@query(f"SELECT channel, message_id, forward_from, media_url, views_text FROM ({_WEB_SQL}) q")
def html_links(spark, sf_dir):
    """Forward, media and views of each message of a page; views stay as written."""
    return pages.messages(landed(spark, sf_dir)).select("channel", "message_id", "forward_from", F.try_element_at("media_urls", F.lit(1)).alias("media_url"), "views_text")


@query(f"SELECT DISTINCT forward_from FROM ({_WEB_SQL}) q WHERE forward_from IS NOT NULL")
def web_forwards(spark, sf_dir):
    return pages.messages(landed(spark, sf_dir)).where("forward_from is not null and forward_from <> ''").select("forward_from").distinct()


@query(f"SELECT channel, count(*) AS messages FROM (SELECT DISTINCT channel, message_id, text, date_us FROM ({_WEB_SQL}) q) d GROUP BY channel")
def web_distinct(spark, sf_dir):
    """Messages of each channel by their hash: what is on more than one page counts once."""
    p = pages.messages(landed(spark, sf_dir)).withColumn("hash", pages.message_hash(F.col("text"), F.col("date"), F.col("message_id")))
    return p.select("channel", "hash").distinct().groupBy("channel").agg(F.count("*").alias("messages"))


@query("SELECT delivery_id, coalesce(nullif(message_id, 0), row_number() OVER (PARTITION BY channel_id ORDER BY delivery_id)) AS message_id FROM messages")
def web_message_ids(spark, sf_dir):
    """Ids of all rows, the running number in the channel where a row has none."""
    return pages.fallback_ids(_m(spark, sf_dir).select("delivery_id", "channel_id", "message_id"), "channel_id", "delivery_id").select("delivery_id", "message_id")


@query(
    """SELECT DISTINCT concat('c', id) AS username, regexp_replace(title, '^ +| +$', '', 'g') AS title, participants_count FROM channels WHERE title IS NOT NULL AND NOT regexp_matches(title, '[<>"]') AND regexp_replace(title, '^ +| +$', '', 'g') <> ''"""
)
def page_headers(spark, sf_dir):
    """Title and members of channel pages; titles with markup aren't written into pages here."""
    c = table(spark, sf_dir, "channels").where("title is not null and not title rlike '[<>\"]' and trim(title) <> ''")
    n = F.coalesce(F.concat(F.lit('<div class="tgme_channel_info_counter"><span class="counter_value">'), F.col("participants_count").cast("string"), F.lit('</span> <span class="counter_type">subscribers</span></div>')), F.lit(""))
    html = F.concat(F.lit('<div class="tgme_channel_info_header_title"><span dir="auto">'), "title", F.lit("</span></div>"), n)
    p = c.select(F.concat(F.lit("@c"), F.col("id").cast("string")).alias("name"), html.alias("html"))
    return pages.header(p, F.col("name")).select("username", "title", "participants_count").distinct()


# -- proxies ------------------------------------------------------------------------------------------

_KINDS = ("socks5", "socks4", "http", "https")


def pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pool with repeated addresses, made from all messages."""
    k = F.col("delivery_id")
    m = _m(spark, sf_dir)
    n = F.coalesce("views", F.lit(0))
    return m.select(
        k.alias("k"), F.element_at(F.array(*map(F.lit, _KINDS)), (k % 4 + 1).cast("int")).alias("type"), F.concat(F.lit("10.0."), (k % 97).cast("string"), F.lit("."), (k % 11).cast("string")).alias("host"), (1000 + k % 3).cast("int").alias("port"),
        F.when(k % 3 == 0, F.concat(F.lit("country"), (k % 7).cast("string"))).alias("country"), F.when(k % 3 == 0, F.concat(F.lit("C"), (k % 7).cast("string"))).alias("country_code"),
        F.when(k % 5 != 0, (k % 900).cast("double")).alias("latency_ms"), F.when(k % 2 == 0, (k % 50).cast("double")).alias("score"), F.when(k % 4 == 0, F.lit("org")).alias("org"), (n % 5).alias("successes"), (k % 13).alias("failures"),
    )


_POOL = """(SELECT delivery_id AS k, (['socks5','socks4','http','https'])[delivery_id % 4 + 1] AS type, concat('10.0.', delivery_id % 97, '.', delivery_id % 11) AS host, CAST(1000 + delivery_id % 3 AS INTEGER) AS port,
 CASE WHEN delivery_id % 3 = 0 THEN concat('country', delivery_id % 7) END AS country, CASE WHEN delivery_id % 3 = 0 THEN concat('C', delivery_id % 7) END AS country_code, CASE WHEN delivery_id % 5 <> 0 THEN CAST(delivery_id % 900 AS DOUBLE) END AS latency_ms,
 CASE WHEN delivery_id % 2 = 0 THEN CAST(delivery_id % 50 AS DOUBLE) END AS score, CASE WHEN delivery_id % 4 = 0 THEN 'org' END AS org, coalesce(views, 0) % 5 AS successes, delivery_id % 13 AS failures FROM messages)"""
_RATE = "CASE WHEN successes + failures = 0 THEN 1.0 ELSE CAST(successes AS DOUBLE) / (successes + failures) END"
_DEAD = f"(failures >= 3 AND ({_RATE}) < 0.2)"
_SCORE = f"100 * ({_RATE}) - coalesce(latency_ms, 0.0) / 100 + coalesce(score, 0.0) / 10"


@query(f"SELECT type, host, port, CASE WHEN k % 6 = 0 THEN 'u' END AS username FROM {_POOL} p WHERE k % 10 <> 0")
def proxy_lines(spark, sf_dir):
    """Text lists with URLs, comments, blanks and broken lines."""
    p = pool(spark, sf_dir)
    auth = F.when(F.col("k") % 6 == 0, "u:pw@").otherwise("")
    line = F.concat("type", F.lit("://"), auth, "host", F.lit(":"), F.col("port").cast("string"))
    bad = F.element_at(F.array(F.lit("# comment"), F.lit("   "), F.lit("no port"), F.lit("host:99999999")), (F.col("k") % 4 + 1).cast("int"))
    lines = p.select(F.when(F.col("k") % 10 == 0, bad).otherwise(line).alias("value"))
    return proxies.parse_lines(lines).select("type", "host", "port", "username")


@query(f"SELECT type, host, port, country, latency_ms FROM {_POOL} p WHERE k % 10 <> 0")
def proxy_json(spark, sf_dir):
    """JSON lists with aliases of fields, bare or inside an object; broken documents and items without an address give nothing."""
    p = pool(spark, sf_dir)
    k = F.col("k")
    item = F.when(k % 2 == 0, F.to_json(F.struct(F.col("host").alias("ip"), F.col("port").cast("string").alias("port"), F.col("type"), F.col("country"), F.col("latency_ms").alias("latency")))).otherwise(
        F.to_json(F.struct(F.col("host").alias("address"), "port", F.col("type").alias("protocol"), F.col("country").alias("country_name"), F.col("latency_ms").alias("response_time")))
    )
    doc = F.when(k % 10 == 0, F.element_at(F.array(F.lit("{broken"), F.lit('[{"ip": "10.1.1.1"}]'), F.lit("[]")), (k % 3 + 1).cast("int"))).when(k % 3 == 0, F.concat(F.lit("["), item, F.lit("]"))).when(k % 3 == 1, F.concat(F.lit('{"proxies": ['), item, F.lit("]}"))).otherwise(F.concat(F.lit('{"working": ['), item, F.lit("]}")))
    return proxies.parse_json(p.select(doc.alias("value"))).select("type", "host", "port", "country", "latency_ms")


@query(
    f"""SELECT host, port, type, CASE WHEN country IS NOT NULL THEN country ELSE rich.country END AS country, CASE WHEN country IS NOT NULL OR rich IS NULL THEN latency_ms ELSE rich.latency_ms END AS latency_ms
 FROM (SELECT *, row_number() OVER w AS rn, first_value(CASE WHEN country IS NOT NULL THEN {{'country': country, 'latency_ms': latency_ms}} END IGNORE NULLS) OVER (PARTITION BY host, port ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS rich FROM {_POOL} p WINDOW w AS (PARTITION BY host, port ORDER BY k)) q WHERE rn = 1"""
)
def proxy_merged(spark, sf_dir):
    return proxies.merged(pool(spark, sf_dir), "k").select("host", "port", "type", "country", "latency_ms")


@query(f"SELECT k, concat(type, '://', CASE WHEN k % 6 = 0 THEN 'u:pw@' ELSE '' END, host, ':', port) AS url, {_RATE} AS success_rate, {_DEAD} AS dead FROM {_POOL} p")
def proxy_state(spark, sf_dir):
    """URL, success rate and whether it is dead, of each proxy."""
    p = pool(spark, sf_dir)
    user, pw = F.when(F.col("k") % 6 == 0, "u"), F.when(F.col("k") % 6 == 0, "pw")
    return p.select("k", proxies.url(F.col("type"), F.col("host"), F.col("port"), user, pw).alias("url"), proxies.success_rate(F.col("successes"), F.col("failures")).alias("success_rate"), proxies.is_dead(F.col("successes"), F.col("failures")).alias("dead"))


_ONE = f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY host, port ORDER BY k) AS rn FROM {_POOL} p) q WHERE rn = 1)"


def _one(spark: SparkSession, sf_dir: str) -> DataFrame:
    return proxies.merged(pool(spark, sf_dir).withColumn("country", F.coalesce("country", F.lit("-"))), "k")


@query(f"SELECT host, port FROM (SELECT host, port, row_number() OVER (ORDER BY {_SCORE} DESC, host, port) AS place, count(*) OVER () AS n FROM {_ONE} o WHERE NOT {_DEAD}) q WHERE place <= greatest(10, n // 4)")
def proxy_ranked(spark, sf_dir):
    return proxies.ranked(proxies.available(_one(spark, sf_dir))).select("host", "port")


@query(f"SELECT host, port FROM (SELECT host, port, row_number() OVER (ORDER BY host, port) - 1 AS place, count(*) OVER () AS n FROM {_ONE} o WHERE NOT {_DEAD}) q WHERE place = 8 % n")
def proxy_round_robin(spark, sf_dir):
    """The proxy of turn 7."""
    row = proxies.chosen(_one(spark, sf_dir), "round_robin", 7)
    return spark.createDataFrame([(row["host"], row["port"])] if row else [], "host string, port int")


@query(f"SELECT k FROM {_POOL} p WHERE type IN ('socks5', 'http') AND (country_code IS NULL OR country_code = 'C3')")
def proxy_preferred(spark, sf_dir):
    return proxies.preferred(pool(spark, sf_dir), ["socks5", "http"], "c3").select("k")


@query(f"SELECT k FROM {_POOL} p")
def proxy_preferred_none(spark, sf_dir):
    """No proxy is of the wanted type: all stay."""
    return proxies.preferred(pool(spark, sf_dir), ["carrier"]).select("k")


@query(f"SELECT count(*) AS total, count(*) FILTER (NOT {_DEAD}) AS available, count(*) FILTER ({_DEAD}) AS dead FROM {_POOL} p")
def proxy_pool_stats(spark, sf_dir):
    return proxies.pool_stats(pool(spark, sf_dir)).select("total", "available", "dead")


@query(f"SELECT type, count(*) AS proxies FROM {_POOL} p WHERE NOT {_DEAD} GROUP BY type")
def proxy_by_type(spark, sf_dir):
    return proxies.by(pool(spark, sf_dir), "type")


@query(f"SELECT country_code, count(*) AS proxies FROM {_POOL} p WHERE NOT {_DEAD} AND country_code IS NOT NULL GROUP BY country_code")
def proxy_by_country(spark, sf_dir):
    return proxies.by(pool(spark, sf_dir), "country_code")


@query(f"SELECT country, count(*) AS proxies FROM {_POOL} p WHERE country IS NOT NULL GROUP BY country ORDER BY proxies DESC, country LIMIT 5")
def proxy_top_countries(spark, sf_dir):
    return proxies.top_countries(pool(spark, sf_dir))


@query(f"SELECT count(*) AS total, count(*) FILTER (successes > 0) AS working, count(*) FILTER (successes <= 0) AS dead, CASE WHEN count(*) = 0 THEN 0.0 ELSE CAST(count(*) FILTER (successes > 0) AS DOUBLE) / count(*) END AS success_rate FROM {_POOL} p")
def proxy_test_summary(spark, sf_dir):
    return proxies.tested(pool(spark, sf_dir).select((F.col("successes") > 0).alias("ok")))


@query(f"SELECT concat(host, ':', port) AS value FROM {_POOL} p WHERE NOT {_DEAD}")
def working_proxies(spark, sf_dir):
    """The list of working proxies, written and read again."""
    path = scratch.scratch_path(spark, "working")
    proxies.addresses(pool(spark, sf_dir)).write.text(path)
    return spark.read.text(path)


@query(f"SELECT type, host, port FROM {_POOL} p UNION ALL SELECT 'socks5', '10.9.9.9', 9050")
def proxy_added(spark, sf_dir):
    """One proxy more; an address that the pool has already changes nothing."""
    p = pool(spark, sf_dir).select("type", "host", "port")
    more = proxies.added(p, "10.9.9.9", 9050)
    return proxies.added(more, "10.9.9.9", 9050, "http").select("type", "host", "port")


# -- media --------------------------------------------------------------------------------------------

_STATUSES = ("downloaded", "exists", "duplicate", "unsupported", "failed", "pending")


@query("SELECT count(*) FILTER (delivery_id % 7 < 4) AS downloaded, count(*) FILTER (delivery_id % 7 = 4) AS failed, count(*) FILTER (delivery_id % 7 > 4) AS pending FROM messages WHERE media_type IS NOT NULL AND media_type NOT IN ('MessageMediaWebPage', 'MessageMediaEmpty')")
def media_stats(spark, sf_dir):
    s = F.try_element_at(F.array(*map(F.lit, _STATUSES)), (F.col("delivery_id") % 7 + 1).cast("int"))
    return media.stats(media.candidates(_m(spark, sf_dir)).select(s.alias("status")))


@query("SELECT md5(coalesce(text, '')) AS md5, min(delivery_id) AS delivery_id FROM messages GROUP BY 1")
def media_distinct(spark, sf_dir):
    """Of files with equal content the first; the texts stand for files."""
    f = _m(spark, sf_dir).select(F.lpad(F.col("delivery_id").cast("string"), 20, "0").alias("path"), F.coalesce("text", F.lit("")).cast("binary").alias("content"))
    return media.distinct_files(f).select("md5", F.col("path").cast("long").alias("delivery_id"))


# -- exports and the store ----------------------------------------------------------------------------

_PLAIN_ROWS = "SELECT delivery_id, channel_name, text, views, epoch_us(date) AS date_us, has_media FROM messages"


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _m(spark, sf_dir).select("delivery_id", "channel_name", "text", "views", F.unix_micros("date").alias("date_us"), "has_media")


@query(f"{_PLAIN_ROWS} WHERE text IS NOT NULL AND text <> ''")
def export_csv(spark, sf_dir):
    """Written as CSV and read again; CSV can't tell an empty text from none, so these are left out."""
    df, path = _rows(spark, sf_dir).where("text <> ''"), scratch.scratch_path(spark, "csv")
    sinks.to_csv(df, path)
    return spark.read.schema(df.schema).option("header", True).option("escape", '"').option("multiLine", True).csv(path)


@query(_PLAIN_ROWS)
def export_json(spark, sf_dir):
    df, path = _rows(spark, sf_dir), scratch.scratch_path(spark, "json")
    sinks.to_json_lines(df, path)
    return spark.read.schema(df.schema).json(path)


@query(_PLAIN_ROWS)
def export_parquet(spark, sf_dir):
    path = scratch.scratch_path(spark, "parquet")
    sinks.to_parquet(_rows(spark, sf_dir), path)
    return spark.read.parquet(path)


@query(f"{_PLAIN_ROWS} WHERE coalesce(views, 0) >= 100")
def export_filtered(spark, sf_dir):
    path = scratch.scratch_path(spark, "filtered")
    sinks.to_json_lines(filters.FilterSpec(min_views=100).apply(_rows(spark, sf_dir)), path)
    return spark.read.schema(_rows(spark, sf_dir).schema).json(path)


@query("SELECT delivery_id AS row, coalesce(channel_name, '') AS channel_name, message_id, text, backend FROM messages")
def store_append(spark, sf_dir):
    """API and web rows appended to the store as two batches, then read with its schema; the batch number of a row is kept in grouped_id here."""
    m = _m(spark, sf_dir).withColumn("grouped_id", F.col("delivery_id")).withColumn("channel_name", F.coalesce("channel_name", F.lit("")))
    path = scratch.scratch_path(spark, "store")
    for b in (F.col("backend") == "web", F.coalesce(F.col("backend") != "web", F.lit(True))):
        sinks.append_messages(store.conform(m.where(b)), path)
    x = spark.read.schema(store.SCHEMA).parquet(path)
    return x.select(F.col("grouped_id").alias("row"), F.coalesce("channel_name", F.lit("")).alias("channel_name"), "message_id", "text", "backend")


@query("SELECT channel_id, arg_max(channel_name, {'a': scraped_at, 'b': channel_name}) AS channel_name, min(message_id) AS min_id, max(message_id) AS max_id FROM messages WHERE channel_id IS NOT NULL AND message_id IS NOT NULL AND scraped_at IS NOT NULL AND channel_name IS NOT NULL GROUP BY channel_id")
def checkpoint_store(spark, sf_dir):
    """Checkpoints of two runs, each sent twice, and what is stored afterwards."""
    c = store.Checkpoints(spark, scratch.scratch_path(spark, "checkpoints"))
    m = _m(spark, sf_dir).where("channel_id is not null and message_id is not null and scraped_at is not null and channel_name is not null")
    for k in (0, 1, 0, 1):
        part = m.where(F.pmod(F.xxhash64("run_id"), F.lit(2)) == k)
        o = F.struct("scraped_at", "channel_name")
        c.update(part.groupBy("channel_id").agg(F.max_by("channel_name", o).alias("channel_name"), F.min("message_id").alias("min_id"), F.max("message_id").alias("max_id"), F.max("scraped_at").alias("updated_at")))
    return c.state().select("channel_id", "channel_name", "min_id", "max_id")


@query("SELECT id, regexp_replace(username, '^@+', '') AS username, title, coalesce(is_megagroup, false) AS is_megagroup, participants_count FROM channels WHERE id IS NOT NULL UNION ALL SELECT id, regexp_replace(username, '^@+', ''), NULL, false, NULL FROM channels WHERE id IS NOT NULL")
def channel_info(spark, sf_dir):
    """Rows of the dimension from full records and from reduced ones."""
    c = table(spark, sf_dir, "channels")
    at = F.concat(F.lit("@"), "username")
    full = store.channel_rows(c.withColumn("username", at))
    return full.unionByName(store.channel_rows(c.select("id", at.alias("username")))).select("id", "username", "title", "is_megagroup", "participants_count")


@query("SELECT channel_name AS channel, message_id, epoch_us(date) AS timestamp_us, coalesce(text, '') AS text, views, coalesce(has_media, false) AS has_media, CAST(NULL AS VARCHAR) AS forward_from FROM messages WHERE backend = 'mtproto'")
def backend_items(spark, sf_dir):
    return store.items(_m(spark, sf_dir).where("backend = 'mtproto'")).select("channel", "message_id", F.unix_micros("timestamp").alias("timestamp_us"), "text", "views", "has_media", "forward_from")


# -- forwards and disclosure --------------------------------------------------------------------------

_PEER = "CASE delivery_id % 4 WHEN 0 THEN 'channel' WHEN 1 THEN 'chat' WHEN 2 THEN 'user' END"
_SOURCE = f"CASE WHEN {_PEER} IN ('channel', 'chat') THEN fwd_from_channel_id WHEN delivery_id % 4 = 3 THEN fwd_from_channel_id END"


@query(_NEWEST.replace("fwd_from_channel_id <> channel_id", f"({_SOURCE}) <> channel_id").replace("fwd_from_channel_id AS source", f"{_SOURCE} AS source"))
def forward_edges_by_peer(spark, sf_dir):
    """Edges where the forward names a channel, a chat or, the old way, only an id; forwards from users are no edges."""
    k = F.col("delivery_id") % 4
    kind = F.when(k == 0, "channel").when(k == 1, "chat").when(k == 2, "user")
    source = graph.forward_source(kind, F.when(k != 3, F.col("fwd_from_channel_id")), F.when(k == 3, F.col("fwd_from_channel_id")))
    return graph.edges(_kept(spark, sf_dir), 500, source)


def _told(k: str) -> str:
    flags = "{" + ",".join(f'"{f}":{"true" if k == "mtproto" or f in _WEB else "false"}' for f in _FLAGS) + "}"
    return f"('{k}', '{'high' if k == 'mtproto' else 'low'}', '{flags}', '{'; '.join(m for f, m in LIMITATIONS if k == 'web' and f not in _WEB)}', '{_q(DISCLAIMERS[k])}')"


@query(f"SELECT * FROM (VALUES {_told('mtproto')}, {_told('web')}) v(backend, bias_confidence, capabilities, limitations, disclaimer)")
def bias_disclosure(spark, sf_dir):
    return disclosures(capabilities(spark)).select("backend", "bias_confidence", "capabilities", F.array_join("limitations", "; ").alias("limitations"), "disclaimer")


_LAST_LINKS = f"SELECT channel_id, CAST(sum({_TOTAL}) AS BIGINT) AS reactions FROM ({_KEPT}) k WHERE channel_id IS NOT NULL GROUP BY channel_id"


@query(_LAST_LINKS)
def channel_reactions(spark, sf_dir):
    """Reactions of each channel over the kept messages."""
    k = activity.reaction_totals(_kept(spark, sf_dir).where("channel_id is not null"), "channel_id")
    return k.groupBy("channel_id").agg(F.sum("reactions").alias("reactions"))


@query("SELECT line, keyword, pattern FROM (VALUES (1, 'freight', NULL), (2, NULL, 'licen[sc]e'), (3, 'ÉTÉ', NULL)) v(line, keyword, pattern)")
def keyword_file(spark, sf_dir):
    """Keywords and patterns of a keyword file with comments, blanks and spaces."""
    s = filters.from_lines(["# words", "", "  freight  ", "/licen[sc]e/", "#x", "ÉTÉ"])
    rows = [(1, s.keywords[0], None), (2, None, s.regexes[0]), (3, s.keywords[1], None)]
    return spark.createDataFrame(rows, "line int, keyword string, pattern string")


# -- statements, graph files, manifests ---------------------------------------------------------------


def _told_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return continuity.metrics(continuity.continuity(table(spark, sf_dir, "observations"))).select("channel_id", "gap_ratio", "deletion_rate", "edit_rate", "coverage_rate", "start_us", "end_us")


def _statements(batches):
    import pyarrow as pa

    for b in batches:
        rows = b.to_pylist()
        text = [continuity.statement(str(r["channel_id"]), r | {"start": sinks._moment(r["start_us"]), "end": sinks._moment(r["end_us"])}) for r in rows]
        yield pa.RecordBatch.from_arrays([b.column("channel_id"), pa.array(text, pa.string()), pa.array([round(r["coverage_rate"], 4) for r in rows], pa.float64())], ["channel_id", "statement", "coverage_rate"])


_METRICS = ORACLES_OF["bias_metrics"]
_DAYS = "strftime(make_timestamp({}), '%Y-%m-%d')"
_PART = "printf('%.1f%%', {} * 100)"


@query(
    f"""SELECT channel_id, concat('Data collection for channel ''', channel_id, ''' ', CASE WHEN start_us IS NOT NULL AND end_us IS NOT NULL THEN concat('occurred between ', {_DAYS.format("start_us")}, ' and ', {_DAYS.format("end_us")}, '. ') ELSE '' END,
 'Approximately ', {_PART.format("gap_ratio")}, ' of message IDs within the observed range were unavailable at collection time, consistent with deletion or access restrictions. ',
 CASE WHEN deletion_rate > 0 THEN concat('The confirmed deletion rate was ', {_PART.format("deletion_rate")}, '. ') ELSE '' END,
 CASE WHEN edit_rate > 0 THEN concat('Approximately ', {_PART.format("edit_rate")}, ' of collected messages showed evidence of post-publication editing. ') ELSE '' END) AS statement, round(coverage_rate, 4) AS coverage_rate FROM ({_METRICS}) q"""
)
def bias_statements(spark, sf_dir):
    """The methodology statement of every channel, and its coverage to four places."""
    return _told_metrics(spark, sf_dir).mapInArrow(_statements, "channel_id long, statement string, coverage_rate double")


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = graph.stored(graph.edges(_kept(spark, sf_dir), 500))
    dim = store.upserted_channels(table(spark, sf_dir, "channels"), ["scraped_at", "version", "title"])
    return graph.resolved(graph.nodes(e), dim), e


_EDGE_ROWS = f"SELECT CAST(source AS BIGINT) AS source, CAST(target AS BIGINT) AS target, CAST(weight AS BIGINT) AS weight FROM ({_NEWEST}) e"


def _xml_edges(spark: SparkSession, body: bytes, weight) -> DataFrame:
    found = [x for x in ET.fromstring(body).iter() if x.tag.rsplit("}", 1)[-1] == "edge"]
    return spark.createDataFrame([(int(x.get("source")), int(x.get("target")), int(weight(x))) for x in found], "source long, target long, weight long")


@query(_EDGE_ROWS)
def graphml_edges(spark, sf_dir):
    """The edges of the exported GraphML document; a graph of channels passes through the driver, as its formats are one document."""
    n, e = sinks._graph_rows(*_graph(spark, sf_dir))
    return _xml_edges(spark, graph.graphml(n, e), lambda x: x[0].text)


@query(_EDGE_ROWS)
def gexf_edges(spark, sf_dir):
    n, e = sinks._graph_rows(*_graph(spark, sf_dir))
    return _xml_edges(spark, graph.gexf(n, e), lambda x: x.get("weight"))


@query("SELECT * FROM (VALUES (2, 'full', 5, 1, 0, true)) v(channels, scrape_mode, collected, errors, flood_waits, ended)")
def run_manifest(spark, sf_dir):
    """A run's manifest as its row says afterwards; ending it twice writes one row."""
    path = scratch.scratch_path(spark, "runs")
    with sinks.Run(spark, path, ["a", "b"], "full", limit=5) as run:
        run.count(messages_collected=5, errors_encountered=1)
    run.end()
    r = store.run_records(spark.read.parquet(path))
    return r.select(F.col("n_channels").cast("int").alias("channels"), "scrape_mode", F.col("collected").cast("int").alias("collected"), F.col("errors").cast("int").alias("errors"), F.col("flood_waits").cast("int").alias("flood_waits"), F.col("created_us").isNotNull().alias("ended"))


# -- streams ------------------------------------------------------------------------------------------


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The messages as a stream of files, written to a landing folder first."""
    m = _m(spark, sf_dir)
    path = scratch.scratch_path(spark, "landing")
    m.repartition(3, F.pmod(F.xxhash64("delivery_id"), F.lit(3))).write.parquet(path)
    return landing.messages(spark, path, m.schema, files=1)


def _done(stream_writer) -> None:
    q = stream_writer.trigger(availableNow=True).start()
    q.awaitTermination()


@query("SELECT DISTINCT channel_id, message_id FROM messages WHERE channel_id IS NOT NULL AND message_id IS NOT NULL AND scraped_at IS NOT NULL")
def stream_first_arrivals(spark, sf_dir):
    """Messages of a stream without later copies; the state is bounded by the watermark, which is wider than the tables' span here."""
    s = _stream(spark, sf_dir).where("scraped_at is not null").withColumn("scraped_at", F.col("scraped_at").cast("timestamp"))
    path = scratch.scratch_path(spark, "arrivals")
    _done(landing.first_arrivals(s, "3650 days").select("channel_id", "message_id").writeStream.format("parquet").option("path", path).option("checkpointLocation", scratch.scratch_path(spark, "state")))
    return spark.read.schema("channel_id long, message_id long").parquet(path)


_SEEN = "SELECT channel_id, message_id, scraped_at AS observed_ts, 1 AS seq, 'O' AS kind, text, true AS check_edit, CAST(NULL AS VARCHAR) AS gap_status FROM messages WHERE channel_id IS NOT NULL AND message_id IS NOT NULL"


@query(_FOLD.replace("FROM observations", f"FROM ({_SEEN}) o") + " SELECT channel_id, message_id, status, observed, first_seen_us, last_checked_us FROM cont")
def stream_continuity(spark, sf_dir):
    """Continuity as three micro-batches leave it, each computing again what it touched."""
    store_, log, state = (scratch.scratch_path(spark, n) for n in ("store", "log", "live"))
    _done(landing.ingest(_stream(spark, sf_dir), store_, log, scratch.scratch_path(spark, "progress"), state))
    if not scratch.exists(spark, state):  # no file, no batch
        return continuity.continuity(landing.observations(_m(spark, sf_dir))).select("channel_id", "message_id", "status", "observed", "first_seen_us", "last_checked_us")
    return landing.live_status(spark, state).select("channel_id", "message_id", "status", "observed", "first_seen_us", "last_checked_us")
