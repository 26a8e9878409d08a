"""What each collector can and can't see, for reports.

The texts are fixed values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_FLAGS = (
    "public_channels private_channels message_text message_timestamps views forwards reactions replies sender_info media_urls media_download resume_by_id edit_detection deletion_detection message_id_reliable "
    "forward_source_detection snowball_discovery bias_tracking_supported"
).split()
_WEB = set("public_channels message_text message_timestamps media_urls forward_source_detection snowball_discovery".split())
LIMITATIONS = (
    ("private_channels", "Public channels only"),
    ("message_id_reliable", "Message IDs inferred, not authoritative"),
    ("edit_detection", "Edits not observable"),
    ("deletion_detection", "Deletions not detectable"),
    ("reactions", "Reactions not captured"),
    ("views", "View counts unavailable or inaccurate"),
    ("media_download", "Media download not supported"),
    ("resume_by_id", "Resume by message ID not reliable"),
    ("sender_info", "Sender information not available"),
)
DISCLAIMERS = {
    "mtproto": "Data collected via official Telegram MTProto API. Subject to standard API limitations and rate controls.",
    "web": "Data collected via HTML scraping of public web interface. Message IDs are inferred and may not be authoritative. Edit history, reactions, and accurate view counts are not available. This data should be treated as observational, not archival.",
    "rss": "Data ingested from third-party RSS feeds or mirrors. Completeness, accuracy, and timeliness cannot be guaranteed. This is secondary source data.",
}
UNKNOWN = "Unknown backend. Data quality unverified."


def capabilities(spark: SparkSession) -> DataFrame:
    rows = [("mtproto", *[True] * len(_FLAGS), "high"), ("web", *[f in _WEB for f in _FLAGS], "low")]
    return spark.createDataFrame(rows, ", ".join(["backend string", *(f"{f} boolean" for f in _FLAGS), "bias_confidence string"]))


def limitations(caps: DataFrame) -> DataFrame:
    return caps.select("backend", "bias_confidence", F.array_compact(F.array(*[F.when(~F.col(f), F.lit(m)) for f, m in LIMITATIONS])).alias("limitations"))


def disclaimer(backend: str) -> str:
    return DISCLAIMERS.get(backend, UNKNOWN)


def disclosures(caps: DataFrame) -> DataFrame:
    """What goes with every export: backend, confidence, capabilities as JSON, known limitations and disclaimer."""
    told = F.lit(UNKNOWN)
    for k, v in DISCLAIMERS.items():
        told = F.when(F.col("backend") == k, v).otherwise(told)
    flags = F.to_json(F.struct(*_FLAGS))
    return limitations(caps).join(caps.select("backend", flags.alias("capabilities"), told.alias("disclaimer")), "backend")
