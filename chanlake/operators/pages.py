"""Messages and channel headers out of landed web pages, with regular expressions of the JVM.

The class names below are fixed values of the pages' markup. Broken markup gives nulls, never an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Markup of the pages.
BLOCK = r'<div class="tgme_widget_message_wrap[^"]*"[^>]*data-post="'
TEXT = r'(?s)<div class="tgme_widget_message_text[^"]*"[^>]*>(.*?)</div>'
TIME = r'<time[^>]*datetime="([^"]+)"'
FORWARD = r'<a class="tgme_widget_message_forwarded_from_name"[^>]*href="https://t\.me/([^"]+)"'
PHOTO = r"style=\"background-image:url\('([^']+)'\)\""
VIDEO = r'<video[^>]*src="([^"]+)"'
VIEWS = r'<span class="tgme_widget_message_views">([^<]+)</span>'
TITLE = r'(?s)<div class="tgme_channel_info_header_title[^"]*"[^>]*>.*?<span[^>]*>([^<]+)</span>'
ABOUT = r'<div class="tgme_channel_info_description[^"]*">([^<]+)</div>'
COUNTER = r'(?s)<div class="tgme_channel_info_counter[^"]*">.*?<span class="counter_value">([^<]+)</span>.*?<span class="counter_type">([^<]+)</span>'
# Entities, decoded one after the other.
ENTITIES = (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "))


def one(text: Column, pattern: str, group: int = 1) -> Column:
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


def plain(html: Column) -> Column:
    """Line breaks kept, tags dropped, entities decoded, white space trimmed."""
    out = F.regexp_replace(F.regexp_replace(html, r"<br\s*/?>", "\n"), r"<[^>]+>", "")
    for a, b in ENTITIES:
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.regexp_replace(out, r"^[\s\x1c-\x1f\x{85}\x{a0}]+|[\s\x1c-\x1f\x{85}\x{a0}]+$", "")


def counter(raw: Column) -> Column:
    """1.2K, 3M, 12 345 and 1,234 as numbers; anything else is null."""
    c = F.regexp_replace(F.regexp_replace(raw, r"^\s+|\s+$", ""), "[ ,]", "")
    head = F.substring(c, F.lit(1), F.char_length(c) - 1).try_cast("double")
    return F.when(F.endswith(c, F.lit("K")), (head * 1e3).cast("long")).when(F.endswith(c, F.lit("M")), (head * 1e6).cast("long")).otherwise(c.try_cast("long"))


def message_hash(text: Column, ts: Column, message_id: Column) -> Column:
    micro = F.when(F.unix_micros(ts) % 1_000_000 == 0, F.date_format(ts, "yyyy-MM-dd HH:mm:ssxxx")).otherwise(F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSSxxx"))
    return F.md5(F.concat_ws("|", F.coalesce(text, F.lit("")), F.coalesce(micro, F.lit("None")), F.coalesce(message_id.cast("string"), F.lit("None"))))


def messages(pages: DataFrame, html: str = "html") -> DataFrame:
    """One row for each message block with text or media."""
    src = pages.select(*[c for c in pages.columns if c != html], F.explode(F.split(F.col(html), f"(?={BLOCK})")).alias("block")).where(F.col("block").rlike("^" + BLOCK))
    b = F.col("block")
    post = F.regexp_extract(b, r'data-post="([^"]+)"', 1)
    out = src.select(
        "*",
        F.when(F.contains(post, F.lit("/")), F.element_at(F.split(post, "/"), -1).try_cast("long")).alias("message_id"),
        F.coalesce(plain(one(b, TEXT)), F.lit("")).alias("text"),
        F.try_to_timestamp(one(b, TIME)).alias("date"),
        F.element_at(F.split(one(b, FORWARD), "/"), 1).alias("forward_from"),
        F.concat(F.regexp_extract_all(b, F.lit(PHOTO), F.lit(1)), F.regexp_extract_all(b, F.lit(VIDEO), F.lit(1))).alias("media_urls"),
        F.trim(one(b, VIEWS)).alias("views_text"),
    )
    return out.where((F.col("text") != "") | (F.size("media_urls") > 0)).drop("block")


def header(pages: DataFrame, username: Column, html: str = "html") -> DataFrame:
    """Title, description and participants of a channel page; pages with none of them give no row."""
    h = F.col(html)
    kind = F.lower(one(h, COUNTER, 2))
    x = pages.select(F.regexp_replace(username, "^@+", "").alias("username"), F.trim(one(h, TITLE)).alias("title"), F.trim(one(h, ABOUT)).alias("about"), F.when(F.contains(kind, F.lit("subscriber")) | F.contains(kind, F.lit("member")), counter(one(h, COUNTER, 1))).alias("participants_count"))
    return x.where("title is not null or about is not null or participants_count is not null")


#: Rows in order that one task numbers.
NUMBERED = 1_000_000


def fallback_ids(df: DataFrame, channel: str, order: str, message_id: str = "message_id") -> DataFrame:
    """Rows without a message id (or with 0) get their running number in the channel; ``order`` is a distinct number.

    Numbers are counted in blocks of the order, so a channel with a large part of all rows isn't one task.
    """
    x = df.withColumn("_block", F.floor(F.col(order) / NUMBERED))
    size = x.groupBy(channel, "_block").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(channel).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    size = size.withColumn("_before", before).withColumnsRenamed({channel: "_channel", "_block": "_at"})
    x = x.withColumn("_rn", F.row_number().over(Window.partitionBy(channel, "_block").orderBy(order)))
    x = x.join(size, x[channel].eqNullSafe(size["_channel"]) & (x["_block"] == size["_at"]))
    return x.withColumn(message_id, F.coalesce(F.nullif(F.col(message_id), F.lit(0)), F.col("_before") + F.col("_rn"))).select(*df.columns)
