"""Queries of the channel analytics operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.disclosure import _WEB, LIMITATIONS, capabilities, limitations
from ..operators import activity, continuity, filters, graph, media, pages
from ..operators.filters import CRYPTO, CTI, NEWS, FilterSpec
from ..sources import messages as store
from ..sources.tables import spread, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql is not None:
            ORACLES[name or f.__name__] = sql
        return f

    return add


def _m(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "messages")


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns that filters look at, spread for work on texts that isn't a filter (those are pushed to the scan)."""
    return spread(_m(spark, sf_dir).select("delivery_id", "text", "date", "views", "forwards", "reactions_json", "has_media", "media_type"))


def _kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.latest(_m(spark, sf_dir), [F.col("delivery_id")])


_KEPT = """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY channel_id, message_id ORDER BY scraped_at DESC NULLS LAST, delivery_id) AS rn FROM messages) q
 WHERE rn = 1 OR message_id IS NULL OR channel_id IS NULL"""


# -- sources ------------------------------------------------------------------------------------------


@query(f"SELECT delivery_id, channel_id, message_id, epoch_us(date) AS date_us, text FROM ({_KEPT}) k")
def load_messages(spark, sf_dir):
    k = _kept(spark, sf_dir).orderBy(F.desc("date"), "delivery_id")
    return k.select("delivery_id", "channel_id", "message_id", F.unix_micros("date").alias("date_us"), "text")


@query(f"SELECT channel_id, message_id, delivery_id FROM ({_KEPT}) k WHERE message_id IS NOT NULL AND channel_id IS NOT NULL")
def dedup_latest(spark, sf_dir):
    return _kept(spark, sf_dir).where("message_id is not null and channel_id is not null").select("channel_id", "message_id", "delivery_id")


@query("SELECT delivery_id, message_id, epoch_us(date) AS date_us FROM messages WHERE message_id > 50 AND message_id < 5000 ORDER BY date DESC, delivery_id LIMIT 1000")
def history_scan(spark, sf_dir):
    h = store.history(_m(spark, sf_dir), 1000, 50, 5000, tie=[F.col("delivery_id")])
    return h.select("delivery_id", "message_id", F.unix_micros("date").alias("date_us"))


_RX = "CASE WHEN json_valid(reactions_json) THEN from_json(reactions_json, '[{\"emoji\":\"VARCHAR\",\"count\":\"BIGINT\"}]') ELSE [] END"


@query(
    f"""SELECT delivery_id, coalesce(text, '') AS text, coalesce(views, 0) AS views, coalesce(forwards, 0) AS forwards, coalesce(replies_count, 0) AS replies_count,
 media_type IS NOT NULL AS has_media, coalesce(is_pinned, false) AS is_pinned, CAST(coalesce(len(list_filter({_RX}, lambda x: x.emoji IS NOT NULL)), 0) AS INTEGER) AS n_reactions FROM messages"""
)
def normalize_messages(spark, sf_dir):
    n = store.normalized(_m(spark, sf_dir))
    return n.select("delivery_id", "text", "views", "forwards", "replies_count", "has_media", "is_pinned", F.size("reactions").alias("n_reactions"))


@query("SELECT id, version, title, username FROM channels WHERE is_megagroup OR is_broadcast ORDER BY id, version, title, username NULLS FIRST, scraped_at LIMIT 100")
def list_channels(spark, sf_dir):
    c = table(spark, sf_dir, "channels").where("is_megagroup or is_broadcast")
    return c.orderBy("id", "version", "title", "username", "scraped_at").limit(100).select("id", "version", "title", "username")


@query("SELECT channel_name, arg_min(channel_id, delivery_id) AS channel_id FROM messages WHERE channel_name IS NOT NULL GROUP BY channel_name")
def channel_lookup(spark, sf_dir):
    return _m(spark, sf_dir).where("channel_name is not null").groupBy("channel_name").agg(F.min_by("channel_id", "delivery_id").alias("channel_id"))


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.run_records(table(spark, sf_dir, "runs"))


_RUNS = """SELECT run_id, epoch_us(created_at) AS created_us, j->>'$.scrape_mode' AS scrape_mode, CAST(json_array_length(j, '$.channels') AS BIGINT) AS n_channels,
 CAST(j->>'$.runtime_stats.messages_collected' AS BIGINT) AS collected, CAST(j->>'$.runtime_stats.errors_encountered' AS BIGINT) AS errors, CAST(j->>'$.runtime_stats.flood_waits' AS BIGINT) AS flood_waits
 FROM (SELECT *, CASE WHEN json_valid(manifest_json) THEN CAST(manifest_json AS JSON) END AS j FROM runs) r"""


@query(f"{_RUNS} ORDER BY created_us DESC, run_id LIMIT 10")
def run_history(spark, sf_dir):
    return store.run_history(table(spark, sf_dir, "runs"))


@query(f"SELECT scrape_mode, count(*) AS runs, CAST(sum(collected) AS BIGINT) AS collected, CAST(sum(errors) AS BIGINT) AS errors, CAST(sum(flood_waits) AS BIGINT) AS flood_waits FROM ({_RUNS}) q GROUP BY scrape_mode")
def run_counters(spark, sf_dir):
    return _runs(spark, sf_dir).groupBy("scrape_mode").agg(F.count("*").alias("runs"), F.sum("collected").alias("collected"), F.sum("errors").alias("errors"), F.sum("flood_waits").alias("flood_waits"))


@query("SELECT channel_id, min(message_id) AS min_id, max(message_id) AS max_id, count(*) AS messages FROM messages WHERE message_id IS NOT NULL GROUP BY channel_id")
def checkpoint(spark, sf_dir):
    return store.checkpoints(_m(spark, sf_dir))


_HALF = "SELECT channel_id, max(message_id) AS max_id FROM messages WHERE date < TIMESTAMPTZ '2031-04-01 00:00:00+00' AND message_id IS NOT NULL GROUP BY channel_id"


@query(f"SELECT m.delivery_id FROM messages m LEFT JOIN ({_HALF}) h ON h.channel_id = m.channel_id WHERE m.message_id > h.max_id OR h.max_id IS NULL")
def incremental_slice(spark, sf_dir):
    """What a run would add that resumes above the ids known at a date."""
    m = _m(spark, sf_dir)
    known = store.checkpoints(m.where(F.col("date") < F.lit(datetime(2031, 4, 1, tzinfo=timezone.utc)))).select("channel_id", "max_id")
    return m.join(known, "channel_id", "left").where("message_id > max_id or max_id is null").select("delivery_id")


@query("SELECT delivery_id, backend, channel_id, message_id, CASE WHEN backend = 'web' THEN NULL ELSE sender_id END AS sender_id FROM messages WHERE backend IN ('web', 'mtproto')")
def union_backends(spark, sf_dir):
    m = _m(spark, sf_dir).select("delivery_id", "backend", "channel_id", "message_id", "sender_id")
    return store.union_backends(m.where("backend = 'mtproto'"), m.where("backend = 'web'").drop("sender_id"))


@query(
    """SELECT id, arg_max_null(username, o) AS username, arg_max(title, o) AS title, arg_max_null(participants_count, o) AS participants_count, arg_min(is_megagroup, o) AS is_megagroup, arg_min(is_broadcast, o) AS is_broadcast
 FROM (SELECT *, {'a': scraped_at, 'b': version, 'c': title} AS o FROM channels) c GROUP BY id"""
)
def channel_upsert(spark, sf_dir):
    c = table(spark, sf_dir, "channels")
    return store.upserted_channels(c, ["scraped_at", "version", "title"]).select("id", "username", "title", "participants_count", "is_megagroup", "is_broadcast")


@query("SELECT DISTINCT coalesce(username, CAST(id AS VARCHAR)) AS label FROM channels")
def channel_labels(spark, sf_dir):
    return table(spark, sf_dir, "channels").select(F.coalesce("username", F.col("id").cast("string")).alias("label")).distinct()


# -- filters ------------------------------------------------------------------------------------------


def _q(s: str) -> str:
    return s.replace("'", "''")


def _rx(pattern: str) -> str:
    return f"regexp_matches(coalesce(text, ''), '{_q(pattern)}', 'i')"


def _kw(words) -> str:
    import re

    return _rx("|".join(re.sub(r"([^\w\s]|_)", r"\\\1", w) for w in words))


_TOTAL = f"CAST(coalesce(list_sum(list_transform({_RX}, lambda x: coalesce(x.count, 0))), 0) AS BIGINT)"
_WORDS = ("archive", "certificate", "карт", "ÉTÉ", "100%")
_PATTERNS = (r"[A-Z]{2}-\d{4}", r"licen[sc]e", r"\d{3} rows")
_EXCLUDE = ("invitation", "freight")
_FROM, _TO = datetime(2031, 2, 1, tzinfo=timezone.utc), datetime(2031, 5, 1, tzinfo=timezone.utc)
_DATES = "date >= TIMESTAMPTZ '2031-02-01 00:00:00+00' AND date <= TIMESTAMPTZ '2031-05-01 00:00:00+00'"
_KIND = "CASE WHEN coalesce(media_type, '') <> '' THEN contains(lower(media_type), 'photo') END"
_PARTS = {
    "keywords": _kw(_WORDS),
    "regex": " OR ".join(f"{_rx(p)}" for p in _PATTERNS),
    "min_views": "coalesce(views, 0) >= 100",
    "min_reactions": f"{_TOTAL} >= 10",
    "has_media": "coalesce(has_media, false)",
    "media_type": _KIND,
    "min_text_length": "length(coalesce(text, '')) >= 80",
}
_SPEC = FilterSpec(keywords=_WORDS, regexes=_PATTERNS, excludes=_EXCLUDE, min_views=100, min_reactions=10, has_media=True, media_types=["photo"], min_text_length=80)
_NOT = f"NOT {_kw(_EXCLUDE)}"
_ALL = " AND ".join(f"coalesce({c}, true)" for c in (f"({x})" for x in _PARTS.values()))
_ANY = " OR ".join(f"coalesce({c}, false)" for c in (f"({x})" for x in _PARTS.values()))


def _apply(spec: FilterSpec, where: str, name: str) -> None:
    def run(spark, sf_dir):
        return spec.apply(_m(spark, sf_dir)).select("delivery_id")

    run.__name__ = name
    query(f"SELECT delivery_id FROM messages WHERE {where}")(run)


_apply(FilterSpec(keywords=_WORDS), _PARTS["keywords"], "filter_keywords")
_apply(FilterSpec(regexes=_PATTERNS), _PARTS["regex"], "filter_regex")
_apply(FilterSpec(excludes=_EXCLUDE), _NOT, "filter_exclude")
_apply(FilterSpec(min_date=_FROM, max_date=_TO), _DATES, "filter_date_range")
_apply(FilterSpec(min_views=100), _PARTS["min_views"], "filter_min_views")
_apply(FilterSpec(min_reactions=10), _PARTS["min_reactions"], "filter_min_reactions")
_apply(FilterSpec(min_forwards=3), "coalesce(forwards, 0) >= 3", "filter_min_forwards")
_apply(FilterSpec(has_media=True), _PARTS["has_media"], "filter_has_media")
_apply(FilterSpec(media_types=["photo"]), f"coalesce({_KIND}, true)", "filter_media_types")
_apply(FilterSpec(min_text_length=80, max_text_length=200), "length(coalesce(text, '')) BETWEEN 80 AND 200", "filter_text_length")
_apply(filters.with_mode(_SPEC, "all"), f"{_ALL} AND {_NOT}", "filter_mode_all")
_apply(filters.with_mode(_SPEC, "any"), f"({_ANY}) AND {_NOT}", "filter_mode_any")
_apply(filters.preset("cti"), _kw(CTI), "preset_cti")
_apply(filters.preset("crypto"), _kw(CRYPTO), "preset_crypto")
_apply(filters.preset("viral"), "coalesce(views, 0) >= 10000", "preset_viral")
_apply(filters.preset("news"), _kw(NEWS), "preset_news")

_HELD = "list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{k}' END" for k, c in _PARTS.items()) + "], lambda x: x IS NOT NULL)"


@query(f"SELECT delivery_id, ({_ANY}) AND {_NOT} AS matched, CASE WHEN NOT ({_NOT}) THEN 'excluded' WHEN {_ANY} THEN array_to_string({_HELD}, ',') ELSE '' END AS labels FROM messages")
def filter_match_details(spark, sf_dir):
    s = filters.with_mode(_SPEC, "any")
    return s.annotate(_texts(spark, sf_dir)).select("delivery_id", "matched", F.array_join("matched_filters", ",").alias("labels"))


@query(f"SELECT count(*) AS checked, CAST(sum(CASE WHEN {_kw(NEWS)} THEN 1 ELSE 0 END) AS BIGINT) AS matched, sum(CASE WHEN {_kw(NEWS)} THEN 1 ELSE 0 END) / CAST(count(*) AS DOUBLE) AS match_rate FROM messages")
def filter_stats(spark, sf_dir):
    return filters.preset("news").stats(_texts(spark, sf_dir))


def _found_sql(words) -> str:
    import re

    pats = ["(" + re.sub(r"([^\w\s]|_)", r"\\\1", w) + ")" for w in words]
    return "list_filter([" + ", ".join(f"CASE WHEN {_rx(p)} THEN regexp_extract(coalesce(text, ''), '{_q(p)}', 1, 'i') END" for p in pats) + "], lambda x: x IS NOT NULL)"


@query(f"SELECT delivery_id, array_to_string({_found_sql(NEWS)}, '|') AS found FROM messages WHERE {_kw(NEWS)}")
def matched_keywords(spark, sf_dir):
    s = filters.preset("news")
    return s.apply(_m(spark, sf_dir)).select("delivery_id", F.array_join(s.found(), "|").alias("found"))


@query(f"SELECT keyword, count(*) AS hits FROM (SELECT unnest({_found_sql(CTI)}) AS keyword FROM messages WHERE {_kw(CTI)}) q GROUP BY keyword ORDER BY hits DESC, keyword LIMIT 10")
def top_keywords(spark, sf_dir):
    return filters.keyword_counts(_m(spark, sf_dir), filters.preset("cti"))


@query(f"SELECT delivery_id, CASE WHEN length(text) > 100 THEN concat(left(text, 100), '...') ELSE text END AS preview FROM messages WHERE {_kw(NEWS)} ORDER BY date DESC, delivery_id LIMIT 5")
def preview(spark, sf_dir):
    m = filters.preset("news").apply(_m(spark, sf_dir)).orderBy(F.desc("date"), "delivery_id").limit(5)
    return m.select("delivery_id", F.when(F.char_length("text") > 100, F.concat(F.left("text", F.lit(100)), F.lit("..."))).otherwise(F.col("text")).alias("preview"))


# -- scalar functions ---------------------------------------------------------------------------------


@query("SELECT delivery_id, CASE WHEN coalesce(text, '') <> '' THEN left(sha256(text), 16) END AS checksum, length(text) AS length FROM messages")
def text_checksum(spark, sf_dir):
    return _m(spark, sf_dir).select("delivery_id", continuity.checksum(F.col("text")).alias("checksum"), F.char_length("text").cast("long").alias("length"))


_MOMENT = "CASE WHEN date IS NULL THEN 'None' WHEN epoch_us(date) % 1000000 = 0 THEN concat(strftime(date AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S'), '+00:00') ELSE concat(strftime(date AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S.%f'), '+00:00') END"


@query(f"SELECT delivery_id, md5(concat(coalesce(text, ''), '|', {_MOMENT}, '|', coalesce(CAST(message_id AS VARCHAR), 'None'))) AS hash FROM messages")
def message_hash(spark, sf_dir):
    return _m(spark, sf_dir).select("delivery_id", pages.message_hash(F.col("text"), F.col("date"), F.col("message_id")).alias("hash"))


_PLAIN = "regexp_replace(regexp_replace(text, '<br\\s*/?>', chr(10), 'g'), '<[^>]+>', '', 'g')"
for _a, _b in pages.ENTITIES:
    _PLAIN = f"replace({_PLAIN}, '{_q(_a)}', '{_q(_b)}')"


@query(f"SELECT doc_id, regexp_replace({_PLAIN}, '^\\s+|\\s+$', '', 'g') AS plain FROM documents")
def html_to_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", pages.plain(F.col("text")).alias("plain"))


_RAW = "CASE version % 3 WHEN 0 THEN CAST(participants_count AS VARCHAR) WHEN 1 THEN concat(participants_count // 1000, '.5K') ELSE concat(' ', participants_count // 10, ',', participants_count % 10, ' ') END"


@query(f"SELECT id, version, scraped_us, raw, CAST(CASE WHEN raw LIKE '%K' THEN participants_count // 1000 * 1000 + 500 ELSE participants_count END AS BIGINT) AS participants FROM (SELECT id, version, epoch_us(scraped_at) AS scraped_us, participants_count, {_RAW} AS raw FROM channels WHERE participants_count IS NOT NULL) c")
def parse_counter(spark, sf_dir):
    p = F.col("participants_count")
    raw = F.when(F.col("version") % 3 == 0, p.cast("string")).when(F.col("version") % 3 == 1, F.concat(F.floor(p / 1000).cast("string"), F.lit(".5K"))).otherwise(F.concat(F.lit(" "), F.floor(p / 10).cast("string"), F.lit(","), (p % 10).cast("string"), F.lit(" ")))
    c = table(spark, sf_dir, "channels").where("participants_count is not null").withColumn("raw", raw)
    return c.select("id", "version", F.unix_micros("scraped_at").alias("scraped_us"), "raw", pages.counter(F.col("raw")).alias("participants"))


@query("SELECT delivery_id, ltrim(concat('@@', channel_name), '@') AS channel FROM messages WHERE channel_name IS NOT NULL")
def normalize_channel(spark, sf_dir):
    return _m(spark, sf_dir).where("channel_name is not null").select("delivery_id", store.normalize_channel(F.concat(F.lit("@@"), F.col("channel_name"))).alias("channel"))


@query("SELECT delivery_id, media_type FROM messages WHERE media_type IS NOT NULL AND media_type NOT IN ('MessageMediaWebPage', 'MessageMediaEmpty')")
def media_candidates(spark, sf_dir):
    return media.candidates(_m(spark, sf_dir)).select("delivery_id", "media_type")


def _media(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("delivery_id") % 4
    mime = F.when(k == 0, "video/mp4").when(k == 1, "audio/ogg").when(k == 2, "image/jpeg").otherwise("application/octet-stream")
    m = media.candidates(_m(spark, sf_dir)).withColumns({"mime": mime, "file": F.when(k == 3, F.lit("Report.final.PDF"))})
    m = m.withColumn("kind", media.kind(F.col("media_type"), F.col("mime"), F.startswith("mime", F.lit("video/")), F.startswith("mime", F.lit("audio/"))))
    return m.withColumn("ext", media.extension(F.col("kind"), F.col("mime"), F.col("file")))


_MEDIA = """SELECT *, CASE kind WHEN 'photo' THEN 'jpg' WHEN 'video' THEN 'mp4' WHEN 'audio' THEN 'ogg' WHEN 'image' THEN 'jpg' WHEN 'document' THEN 'pdf' END AS ext FROM
 (SELECT *, CASE media_type WHEN 'MessageMediaPhoto' THEN 'photo' WHEN 'MessageMediaDocument' THEN CASE delivery_id % 4 WHEN 0 THEN 'video' WHEN 1 THEN 'audio' WHEN 2 THEN 'image' ELSE 'document' END END AS kind
 FROM messages WHERE media_type IS NOT NULL AND media_type NOT IN ('MessageMediaWebPage', 'MessageMediaEmpty')) q"""


@query(f"SELECT delivery_id, kind, ext FROM ({_MEDIA}) m")
def media_classify(spark, sf_dir):
    return _media(spark, sf_dir).select("delivery_id", "kind", "ext")


@query(f"SELECT delivery_id, CASE WHEN message_id IS NOT NULL AND kind IS NOT NULL THEN concat(strftime(date AT TIME ZONE 'UTC', '%Y%m%d_%H%M%S'), '_', message_id, '_', kind, '.', ext) END AS filename FROM ({_MEDIA}) m")
def media_filename(spark, sf_dir):
    return _media(spark, sf_dir).select("delivery_id", media.filename(F.col("date"), F.col("message_id"), F.col("kind"), F.col("ext")).alias("filename"))


_LIMITS = {k: "; ".join(m for f, m in LIMITATIONS if k == "web" and f not in _WEB) for k in ("mtproto", "web")}


@query("SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{c}', '{_LIMITS[k]}')" for k, c in (("mtproto", "high"), ("web", "low"))) + ") v(backend, bias_confidence, limitations)")
def backend_limitations(spark, sf_dir):
    return limitations(capabilities(spark)).select("backend", "bias_confidence", F.array_join("limitations", "; ").alias("limitations"))


@query(f"SELECT delivery_id, array_to_string(list_transform({_RX}, lambda x: concat(coalesce(x.emoji, ''), '=', coalesce(x.count, 0))), ';') AS reactions FROM messages WHERE reactions_json IS NOT NULL")
def reactions_to_json(spark, sf_dir):
    r = F.transform(filters.reactions(F.col("reactions_json")), lambda x: F.concat(F.coalesce(x["emoji"], F.lit("")), F.lit("="), F.coalesce(x["count"], F.lit(0)).cast("string")))
    return _m(spark, sf_dir).where("reactions_json is not null").select("delivery_id", F.array_join(r, ";").alias("reactions"))


# -- aggregates ---------------------------------------------------------------------------------------


@query(
    f"""SELECT channel_id, count(*) AS messages, count(DISTINCT sender_id) AS senders, CAST(coalesce(sum(views), 0) AS BIGINT) AS views, CAST(coalesce(sum(forwards), 0) AS BIGINT) AS forwards, epoch_us(min(date)) AS first_us, epoch_us(max(date)) AS last_us,
 CAST(sum(CASE WHEN has_media THEN 1 ELSE 0 END) AS BIGINT) AS media, CAST(sum(CASE WHEN is_pinned THEN 1 ELSE 0 END) AS BIGINT) AS pinned FROM ({_KEPT}) k GROUP BY channel_id"""
)
def channel_stats(spark, sf_dir):
    return activity.channel_stats(_kept(spark, sf_dir))


@query(f"SELECT delivery_id, {_TOTAL} AS reactions FROM messages")
def reaction_totals(spark, sf_dir):
    return activity.reaction_totals(_m(spark, sf_dir), "delivery_id")


@query("SELECT channel_id, CAST(sum(epoch_us(scraped_at) - epoch_us(date)) AS BIGINT) AS latency_us, count(*) AS messages FROM messages WHERE scraped_at IS NOT NULL AND date IS NOT NULL GROUP BY channel_id")
def sampling_latency(spark, sf_dir):
    return activity.sampling_latency(_m(spark, sf_dir))


# -- completeness -------------------------------------------------------------------------------------

_FOLD = """WITH log AS (SELECT DISTINCT channel_id, message_id, observed_ts, seq, kind, text, check_edit, gap_status FROM observations),
 s AS (SELECT *, CASE WHEN kind = 'O' AND coalesce(check_edit, false) AND coalesce(text, '') <> '' THEN left(sha256(text), 16) END AS sum FROM log),
 b AS (SELECT *, first_value(sum IGNORE NULLS) OVER (PARTITION BY channel_id, message_id ORDER BY observed_ts, seq, kind, coalesce(text, '') ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS base,
   max(CASE WHEN kind <> 'D' THEN 1 ELSE 0 END) OVER (PARTITION BY channel_id, message_id ORDER BY observed_ts, seq, kind, coalesce(text, '') ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS live FROM s),
 f AS (SELECT *, CASE WHEN kind = 'O' THEN CASE WHEN sum <> base THEN 'edited' ELSE 'observed' END END AS seen FROM b WHERE live = 1),
 g AS (SELECT *, lag(seen) OVER w AS prev, lead(kind) OVER w AS nxt FROM f WINDOW w AS (PARTITION BY channel_id, message_id ORDER BY observed_ts, seq, kind, coalesce(text, ''))),
 cont AS (SELECT channel_id, message_id, max(CASE WHEN nxt IS NULL THEN CASE WHEN kind = 'O' THEN seen WHEN kind = 'D' THEN 'deleted' WHEN prev = 'observed' THEN 'deleted' ELSE gap_status END END) AS status,
   bool_or(kind = 'O') AS observed, epoch_us(min(observed_ts)) AS first_seen_us, epoch_us(max(observed_ts)) AS last_checked_us FROM g GROUP BY channel_id, message_id)"""


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "observations")


@query(f"{_FOLD} SELECT * FROM cont", "continuity")
def continuity_status(spark, sf_dir):
    return continuity.continuity(_log(spark, sf_dir))


@query(f"{_FOLD} SELECT channel_id, message_id, epoch_us(observed_ts) AS ts_us, seq, CASE WHEN kind = 'D' THEN 'deleted' ELSE seen END AS status, sum AS checksum, CASE WHEN kind = 'O' THEN length(text) END AS length FROM f WHERE kind = 'D' OR sum IS NOT NULL")
def edit_history(spark, sf_dir):
    return continuity.edit_history(_log(spark, sf_dir))


def _count(s: str) -> str:
    return f"CAST(sum(CASE WHEN status = '{s}' THEN 1 ELSE 0 END) AS BIGINT) AS {s}"


@query(f"{_FOLD} SELECT channel_id, {', '.join(map(_count, ('observed', 'edited', 'deleted', 'inaccessible', 'unknown')))} FROM cont GROUP BY channel_id")
def bias_status_counts(spark, sf_dir):
    return continuity.status_counts(continuity.continuity(_log(spark, sf_dir)))


@query(
    f"""{_FOLD}, m AS (SELECT channel_id, max(message_id) - min(message_id) + 1 AS expected, CAST(sum(CASE WHEN status IN ('observed', 'edited') THEN 1 ELSE 0 END) AS BIGINT) AS observed, CAST(sum(CASE WHEN status = 'deleted' THEN 1 ELSE 0 END) AS BIGINT) AS deleted,
 CAST(sum(CASE WHEN status IN ('unknown', 'inaccessible') THEN 1 ELSE 0 END) AS BIGINT) AS possibly_deleted, CAST(sum(CASE WHEN status = 'edited' THEN 1 ELSE 0 END) AS BIGINT) AS edited,
 min(CASE WHEN status = 'observed' THEN first_seen_us END) AS start_us, max(CASE WHEN status = 'observed' THEN last_checked_us END) AS end_us FROM cont GROUP BY channel_id)
 SELECT *, expected - observed AS gaps, CASE WHEN expected = 0 THEN 0.0 ELSE CAST(expected - observed AS DOUBLE) / expected END AS gap_ratio, CASE WHEN expected = 0 THEN 0.0 ELSE CAST(observed AS DOUBLE) / expected END AS coverage_rate,
 CASE WHEN expected = 0 THEN 0.0 ELSE CAST(deleted AS DOUBLE) / expected END AS deletion_rate, CASE WHEN observed = 0 THEN 0.0 ELSE CAST(edited AS DOUBLE) / observed END AS edit_rate FROM m"""
)
def bias_metrics(spark, sf_dir):
    return continuity.metrics(continuity.continuity(_log(spark, sf_dir)))


_IDS = "SELECT channel_id, message_id, lead(message_id) OVER (PARTITION BY channel_id ORDER BY message_id) AS nxt FROM (SELECT DISTINCT channel_id, message_id FROM messages WHERE message_id IS NOT NULL) d"


@query(f"SELECT channel_id, message_id + 1 AS from_id, nxt - 1 AS to_id, nxt - message_id - 1 AS missing FROM ({_IDS}) q WHERE nxt - message_id > 1")
def gap_ranges(spark, sf_dir):
    return continuity.gap_ranges(_m(spark, sf_dir))


@query(f"SELECT channel_id, unnest(range(message_id + 1, nxt)) AS message_id FROM ({_IDS}) q WHERE nxt - message_id > 1")
def detect_gaps(spark, sf_dir):
    return continuity.gaps(_m(spark, sf_dir)).orderBy("channel_id", "message_id")


# -- forwards -----------------------------------------------------------------------------------------

_EDGE = "count(*) AS weight, epoch_us(min(date)) AS first_us, epoch_us(max(date)) AS last_us"
_EDGES = f"SELECT fwd_from_channel_id AS source, channel_id AS target, {_EDGE} FROM ({_KEPT}) k WHERE message_id IS NOT NULL AND channel_id IS NOT NULL AND fwd_from_channel_id <> channel_id GROUP BY 1, 2"
_NEWEST = f"""SELECT fwd_from_channel_id AS source, channel_id AS target, {_EDGE}, min(pos) AS first_pos
 FROM (SELECT *, row_number() OVER (PARTITION BY channel_id ORDER BY message_id DESC) AS pos FROM ({_KEPT}) k WHERE message_id IS NOT NULL AND channel_id IS NOT NULL) q WHERE pos <= 500 AND fwd_from_channel_id <> channel_id GROUP BY 1, 2"""


def _edges(spark: SparkSession, sf_dir: str, limit: int | None = None) -> DataFrame:
    return graph.edges(_kept(spark, sf_dir), limit)


@query(_EDGES)
def forward_edges(spark, sf_dir):
    return _edges(spark, sf_dir).drop("first_pos")


@query(_NEWEST)
def forward_edges_limited(spark, sf_dir):
    return _edges(spark, sf_dir, 500)


@query(f"SELECT source AS channel_id, CAST(sum(weight) AS BIGINT) AS forward_count, count(*) AS targets FROM ({_EDGES}) e GROUP BY source")
def forward_nodes(spark, sf_dir):
    return graph.nodes(_edges(spark, sf_dir))


@query(f"WITH e AS ({_EDGES}) SELECT (SELECT count(DISTINCT c) FROM (SELECT source AS c FROM e UNION ALL SELECT target FROM e) b) AS total_channels, count(*) AS total_edges, CAST(coalesce(sum(weight), 0) AS BIGINT) AS forwards_analyzed, count(DISTINCT target) AS visited FROM e")
def graph_stats(spark, sf_dir):
    return graph.stats(_edges(spark, sf_dir))


@query(f"SELECT source AS channel_id, CAST(sum(weight) AS BIGINT) AS forward_count FROM ({_EDGES}) e GROUP BY source ORDER BY forward_count DESC, channel_id LIMIT 20")
def top_forwarded(spark, sf_dir):
    return graph.nodes(_edges(spark, sf_dir)).select("channel_id", "forward_count").orderBy(F.desc("forward_count"), "channel_id").limit(20)


@query("SELECT DISTINCT fwd_from_channel_id AS channel_id FROM messages WHERE fwd_from_channel_id IS NOT NULL")
def distinct_forwards(spark, sf_dir):
    return _m(spark, sf_dir).where("fwd_from_channel_id is not null").select(F.col("fwd_from_channel_id").alias("channel_id")).distinct()


@query(
    f"""SELECT n.channel_id, n.forward_count, c.title, c.participants_count FROM (SELECT source AS channel_id, CAST(sum(weight) AS BIGINT) AS forward_count FROM ({_EDGES}) e GROUP BY source) n
 LEFT JOIN (SELECT id, arg_max(title, o) AS title, arg_max_null(participants_count, o) AS participants_count FROM (SELECT *, {{'a': scraped_at, 'b': version, 'c': title}} AS o FROM channels) q GROUP BY id) c ON c.id = n.channel_id"""
)
def resolve_channels(spark, sf_dir):
    dim = store.upserted_channels(table(spark, sf_dir, "channels"), ["scraped_at", "version", "title"])
    return graph.resolved(graph.nodes(_edges(spark, sf_dir)), dim).select("channel_id", "forward_count", "title", "participants_count")


def _snowball(spark: SparkSession, sf_dir: str, depth: int) -> DataFrame:
    """From the two channels that most forwards lead into; the cap isn't reached."""
    e = graph.stored(_edges(spark, sf_dir, 500))
    seeds = [r[0] for r in e.groupBy("target").agg(F.sum("weight").alias("w")).orderBy(F.desc("w"), "target").limit(2).collect()]
    return graph.snowball_nodes(e, graph.snowball(e, seeds, depth, 1_000_000, 3))


_SEEDS = f"WITH e AS ({_NEWEST}), seeds AS (SELECT target AS c, row_number() OVER (ORDER BY sum(weight) DESC, target) AS pos FROM e GROUP BY target QUALIFY pos <= 2)"
_FIRST = ", d1 AS (SELECT e.source AS c, e.weight FROM e JOIN seeds s ON s.c = e.target WHERE e.source NOT IN (SELECT c FROM seeds) QUALIFY row_number() OVER (PARTITION BY e.source ORDER BY s.pos) = 1)"


@query(
    f"""{_SEEDS}, known AS (SELECT c, true AS scanned FROM seeds UNION SELECT DISTINCT source, false FROM e WHERE target IN (SELECT c FROM seeds) AND source NOT IN (SELECT c FROM seeds))
 SELECT k.c AS channel_id, CAST(coalesce((SELECT sum(weight) FROM e WHERE e.source = k.c AND e.target IN (SELECT c FROM seeds)), 0) AS BIGINT) AS forward_count, scanned FROM known k"""
)
def snowball_depth1(spark, sf_dir):
    return _snowball(spark, sf_dir, 1)


@query(
    f"""{_SEEDS}{_FIRST}, v AS (SELECT c FROM seeds UNION SELECT c FROM d1 WHERE weight >= 3), known AS (SELECT c FROM v UNION SELECT c FROM d1 UNION SELECT source FROM e WHERE target IN (SELECT c FROM v))
 SELECT k.c AS channel_id, CAST(coalesce((SELECT sum(weight) FROM e WHERE e.source = k.c AND e.target IN (SELECT c FROM v)), 0) AS BIGINT) AS forward_count, k.c IN (SELECT c FROM v) AS scanned FROM known k"""
)
def snowball_depth2(spark, sf_dir):
    return _snowball(spark, sf_dir, 2)


# -- joins and duplicates -----------------------------------------------------------------------------


@query(f"WITH k AS ({_KEPT}) SELECT c.delivery_id, p.delivery_id AS parent_delivery_id FROM k c JOIN k p ON p.channel_id = c.channel_id AND p.message_id = c.reply_to_id")
def reply_parents(spark, sf_dir):
    k = _kept(spark, sf_dir).select("delivery_id", "channel_id", "message_id", "reply_to_id")
    p = k.select(F.col("delivery_id").alias("parent_delivery_id"), F.col("channel_id").alias("pc"), F.col("message_id").alias("pm"))
    return k.join(p, (F.col("channel_id") == F.col("pc")) & (F.col("reply_to_id") == F.col("pm"))).select("delivery_id", "parent_delivery_id")


@query("SELECT min(delivery_id) AS delivery_id, count(*) AS copies FROM messages WHERE coalesce(text, '') <> '' GROUP BY md5(text)")
def dedup_by_hash(spark, sf_dir):
    return _m(spark, sf_dir).where("coalesce(text, '') <> ''").groupBy(F.md5("text").alias("h")).agg(F.min("delivery_id").alias("delivery_id"), F.count("*").alias("copies")).drop("h")
