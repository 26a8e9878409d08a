"""Statistics of channels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .filters import reaction_total


def channel_stats(df: DataFrame) -> DataFrame:
    """Counts, senders, views, forwards and time range of each channel."""
    return df.groupBy("channel_id").agg(
        F.count("*").alias("messages"),
        F.count_distinct("sender_id").alias("senders"),
        F.coalesce(F.sum("views"), F.lit(0)).alias("views"),
        F.coalesce(F.sum("forwards"), F.lit(0)).alias("forwards"),
        F.unix_micros(F.min("date")).alias("first_us"),
        F.unix_micros(F.max("date")).alias("last_us"),
        F.count_if("has_media").alias("media"),
        F.count_if("is_pinned").alias("pinned"),
    )


def reaction_totals(df: DataFrame, row_id: str) -> DataFrame:
    return df.select(row_id, reaction_total(F.col("reactions_json")).alias("reactions"))


def sampling_latency(df: DataFrame) -> DataFrame:
    """Mean whole microseconds between publication and collection, by channel."""
    d = F.unix_micros("scraped_at") - F.unix_micros("date")
    return df.where("scraped_at is not null and date is not null").groupBy("channel_id").agg(F.sum(d).alias("latency_us"), F.count("*").alias("messages"))
