"""Completeness of a collection: observations, edits, gaps and deletions.

The log of observations is append-only. A message's status is a closed form over its log, ordered by time: no row is
ever updated. ``O`` rows are sightings, ``G`` gaps, ``D`` deletions. The first non-empty text that is checked for edits is the
message's baseline; a later sighting with another checksum is an edit. A deletion before any sighting or gap is
ignored; a gap right after an unedited sighting is a deletion, otherwise it has the status it was recorded with.

Rows that are repeated exactly count once. Rows of one time and sequence number are ordered by kind and text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def checksum(text):
    return F.when(F.coalesce(text, F.lit("")) != "", F.left(F.sha2(text, 256), F.lit(16)))


def _folded(log: DataFrame) -> DataFrame:
    keys = ["channel_id", "message_id"]
    order = Window.partitionBy(*keys).orderBy("observed_ts", "seq", "kind", F.coalesce("text", F.lit("")))
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    x = log.select(*keys, "observed_ts", "seq", "kind", "text", "check_edit", "gap_status").distinct()
    x = x.withColumn("sum", F.when((F.col("kind") == "O") & F.coalesce("check_edit", F.lit(False)), checksum(F.col("text"))))
    x = x.withColumn("base", F.first("sum", ignorenulls=True).over(whole)).withColumn("live", F.max(F.when(F.col("kind") != "D", 1).otherwise(0)).over(upto) == 1)
    return x.where("live").withColumn("seen", F.when(F.col("kind") == "O", F.when(F.col("sum") != F.col("base"), "edited").otherwise("observed")))


def edit_history(log: DataFrame) -> DataFrame:
    """(channel, message, time, status, checksum, length) of every checked sighting and every deletion."""
    x = _folded(log).where("kind = 'D' or sum is not null")
    return x.select("channel_id", "message_id", F.unix_micros("observed_ts").alias("ts_us"), "seq", F.when(F.col("kind") == "D", "deleted").otherwise(F.col("seen")).alias("status"), F.col("sum").alias("checksum"), F.when(F.col("kind") == "O", F.char_length("text")).cast("long").alias("length"))


def continuity(log: DataFrame) -> DataFrame:
    """One row for each message that was seen or missed."""
    order = Window.partitionBy("channel_id", "message_id").orderBy("observed_ts", "seq", "kind", F.coalesce("text", F.lit("")))
    x = _folded(log)
    x = x.withColumn("prev", F.lag("seen").over(order)).withColumn("next", F.lead("kind").over(order))
    status = F.when(F.col("kind") == "O", F.col("seen")).when(F.col("kind") == "D", "deleted").when(F.col("prev") == "observed", "deleted").otherwise(F.col("gap_status"))
    x = x.withColumn("status", F.when(F.col("next").isNull(), status))
    return x.groupBy("channel_id", "message_id").agg(F.max("status").alias("status"), F.max(F.col("kind") == "O").alias("observed"), F.unix_micros(F.min("observed_ts")).alias("first_seen_us"), F.unix_micros(F.max("observed_ts")).alias("last_checked_us"))


def status_counts(cont: DataFrame) -> DataFrame:
    return cont.groupBy("channel_id").agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("observed", "edited", "deleted", "inaccessible", "unknown")])


def metrics(cont: DataFrame) -> DataFrame:
    """Coverage, gap, deletion and edit rates of each channel."""
    s = F.col("status")
    x = cont.groupBy("channel_id").agg(
        (F.max("message_id") - F.min("message_id") + 1).alias("expected"),
        F.count_if(s.isin("observed", "edited")).alias("observed"),
        F.count_if(s == "deleted").alias("deleted"),
        F.count_if(s.isin("unknown", "inaccessible")).alias("possibly_deleted"),
        F.count_if(s == "edited").alias("edited"),
        F.min(F.when(s == "observed", F.col("first_seen_us"))).alias("start_us"),
        F.max(F.when(s == "observed", F.col("last_checked_us"))).alias("end_us"),
    )
    x = x.withColumn("gaps", F.col("expected") - F.col("observed"))
    rate = lambda a, b: F.when(F.col(b) == 0, F.lit(0.0)).otherwise(F.col(a) / F.col(b))
    return x.withColumns({"gap_ratio": rate("gaps", "expected"), "coverage_rate": rate("observed", "expected"), "deletion_rate": rate("deleted", "expected"), "edit_rate": rate("edited", "observed")})


#: Ids of a channel that one task sorts, as a power of two, and ids of one chunk when ranges are written out.
BLOCK_BITS, CHUNK = 20, 100_000


def gap_ranges(ids: DataFrame) -> DataFrame:
    """Missing stretches between the lowest and the highest id of each channel, as ranges; nothing is exploded.

    Ids are sorted in blocks of 2^20, so a channel with a large part of all rows is the work of many tasks; stretches across
    blocks come from the ends of the blocks.
    """
    x = ids.select("channel_id", "message_id").where("message_id is not null").distinct().withColumn("block", F.shiftright("message_id", BLOCK_BITS))
    inside = x.withColumn("next", F.lead("message_id").over(Window.partitionBy("channel_id", "block").orderBy("message_id")))
    ends = x.groupBy("channel_id", "block").agg(F.min("message_id").alias("low"), F.max("message_id").alias("message_id"))
    across = ends.withColumn("next", F.lead("low").over(Window.partitionBy("channel_id").orderBy("block")))
    both = inside.select("channel_id", "message_id", "next").unionByName(across.select("channel_id", "message_id", "next"))
    return both.where("next - message_id > 1").select("channel_id", (F.col("message_id") + 1).alias("from_id"), (F.col("next") - 1).alias("to_id"), (F.col("next") - F.col("message_id") - 1).alias("missing"))


def gaps(ids: DataFrame) -> DataFrame:
    """Every missing id, made from the ranges chunk by chunk; a long range is no long array."""
    r = gap_ranges(ids)
    chunks = r.withColumn("a", F.explode(F.sequence("from_id", "to_id", F.lit(CHUNK).cast("long"))))
    return chunks.select("channel_id", F.explode(F.sequence("a", F.least("to_id", F.col("a") + CHUNK - 1))).alias("message_id"))


def statement(name: str, m: dict) -> str:
    """Methodology statement for one row of :func:`metrics`; ``start`` and ``end`` are dates, ``latency_s`` optional."""
    # The sentences of the statement.
    out = f"Data collection for channel '{name}' "
    if m.get("start") and m.get("end"):
        out += f"occurred between {m['start']:%Y-%m-%d} and {m['end']:%Y-%m-%d}. "
    out += f"Approximately {m['gap_ratio']:.1%} of message IDs within the observed range were unavailable at collection time, consistent with deletion or access restrictions. "
    if m["deletion_rate"] > 0:
        out += f"The confirmed deletion rate was {m['deletion_rate']:.1%}. "
    if m["edit_rate"] > 0:
        out += f"Approximately {m['edit_rate']:.1%} of collected messages showed evidence of post-publication editing. "
    if m.get("latency_s"):
        out += f"Average sampling latency was {m['latency_s'] / 3600:.1f} hours, which may underrepresent short-lived content."
    return out
