"""Reading, normalising and reconciling collected messages.

Of several copies of a message the latest counts, among equals the one delivered first; rows without an
identifier are all kept. Foreign files are read by groups of equal schema and cast, because files written without a
schema may disagree about types.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.filters import REACTIONS, reactions

_L, _S, _B, _T = T.LongType(), T.StringType(), T.BooleanType(), T.TimestampType()
SCHEMA = T.StructType(
    [
        T.StructField(n, t)
        for n, t in (
            ("message_id", _L), ("channel_id", _L), ("channel_name", _S), ("date", _T), ("text", _S), ("raw_text", _S), ("sender_id", _L), ("sender_username", _S), ("views", _L), ("forwards", _L),
            ("replies_count", _L), ("reactions_json", _S), ("reply_to_id", _L), ("media_type", _S), ("has_media", _B), ("is_pinned", _B), ("edit_date", _T), ("grouped_id", _L), ("scraped_at", _T),
            ("fwd_from_channel_id", _L), ("forward_from", _S), ("backend", _S),
        )
    ]
)


def conform(df: DataFrame) -> DataFrame:
    """The columns of the schema, cast; missing ones are null."""
    return df.select(*[(F.col(f.name).try_cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in SCHEMA])


def load_foreign(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Files of any writer as one frame of the schema: one scan for the files of each inferred schema."""
    by: dict[str, list[str]] = {}
    for p in paths:
        by.setdefault(spark.read.parquet(p).schema.json(), []).append(p)
    out = spark.createDataFrame([], SCHEMA)
    for same in by.values():
        out = out.unionByName(conform(spark.read.parquet(*same)))
    return out


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def latest(df: DataFrame, tie: Sequence[Column] = ()) -> DataFrame:
    """One row for each message: the last scraped."""
    w = Window.partitionBy("channel_id", "message_id").orderBy(F.desc_nulls_last("scraped_at"), *tie)
    named = df.where("channel_id is not null and message_id is not null")
    one = named.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
    return one.unionByName(df.where("channel_id is null or message_id is null"))


def history(df: DataFrame, limit: int, min_id: int | None = None, max_id: int | None = None, before=None, tie: Sequence[Column] = ()) -> DataFrame:
    """The newest messages between exclusive bounds."""
    if min_id is not None:
        df = df.where(F.col("message_id") > min_id)
    if max_id is not None:
        df = df.where(F.col("message_id") < max_id)
    if before is not None:
        df = df.where(F.col("date") < F.lit(before))
    return df.orderBy(F.desc("date"), *tie).limit(limit)


def normalized(df: DataFrame) -> DataFrame:
    """Absent texts, counters and flags replaced by their defaults; reactions without an emoji dropped."""
    zero = {c: F.coalesce(c, F.lit(0)).cast("long") for c in ("views", "forwards", "replies_count")}
    kept = F.filter(reactions(F.col("reactions_json")), lambda x: x["emoji"].isNotNull())
    return df.withColumns({**zero, "text": F.coalesce("text", F.lit("")), "reactions": kept.cast(REACTIONS), "has_media": F.col("media_type").isNotNull(), "is_pinned": F.coalesce("is_pinned", F.lit(False))})


def union_backends(*frames: DataFrame) -> DataFrame:
    """Rows of several collectors, whatever columns each of them lacks."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def upserted_channels(snapshots: DataFrame, order: Sequence[str] = ("scraped_at", "version")) -> DataFrame:
    """Channel dimension: what may change from the last snapshot, flags and creation from the first."""
    o = F.struct(*order)
    last = [F.max_by(c, o).alias(c) for c in ("username", "title", "about", "participants_count", "scraped_at")]
    first = [F.min_by(c, o).alias(c) for c in ("is_megagroup", "is_broadcast", "created_at")]
    return snapshots.groupBy("id").agg(*last, *first)


def checkpoints(df: DataFrame) -> DataFrame:
    """Lowest and highest id seen of each channel; a resumed run continues above the highest."""
    return df.where("message_id is not null").groupBy("channel_id").agg(F.min("message_id").alias("min_id"), F.max("message_id").alias("max_id"), F.count("*").alias("messages"))


def normalize_channel(name: Column) -> Column:
    return F.regexp_replace(name, "^@+", "")


class Checkpoints:
    """Where each channel's collection stands: an append-only table, the state is the fold over it.

    A row may leave out what it doesn't know; nulls change nothing. Ends are widened, never narrowed, so a batch that is
    sent again changes nothing either.
    """

    SCHEMA = "channel_id long, channel_name string, min_id long, max_id long, completed boolean, updated_at timestamp"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def update(self, rows: DataFrame) -> None:
        have = [f.split()[0] for f in self.SCHEMA.split(", ")]
        kinds = dict(f.split() for f in self.SCHEMA.split(", "))
        rows.select(*[(F.col(c) if c in rows.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in have]).write.mode("append").parquet(self.path)

    def state(self) -> DataFrame:
        x = self.spark.read.schema(self.SCHEMA).parquet(self.path)
        last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.struct("updated_at", c))).alias(c)
        return x.where("channel_id is not null").groupBy("channel_id").agg(last("channel_name"), F.min("min_id").alias("min_id"), F.max("max_id").alias("max_id"), last("completed"), F.max("updated_at").alias("updated_at"))

    def read(self, channel_id: int):
        """The state of one channel, or None."""
        return self.state().where(F.col("channel_id") == channel_id).first()


def channel_rows(info: DataFrame) -> DataFrame:
    """Rows of the channel dimension from what a collector returns: full metadata, or the reduced record with an id and a name only."""
    kinds = {"id": "long", "username": "string", "title": "string", "about": "string", "participants_count": "long", "is_megagroup": "boolean", "is_broadcast": "boolean", "created_at": "timestamp", "scraped_at": "timestamp"}
    known = lambda c, t: (F.col(c).try_cast(t) if c in info.columns else F.lit(None).cast(t))
    out = info.select(*[known(c, t).alias(c) for c, t in kinds.items()]).where("id is not null")
    return out.withColumns({"username": normalize_channel(F.col("username")), "is_megagroup": F.coalesce("is_megagroup", F.lit(False)), "is_broadcast": F.coalesce("is_broadcast", F.lit(False))})


def items(df: DataFrame) -> DataFrame:
    """Messages in the form that all collectors share: no reactions, no replies, and the forward by name only where it has one."""
    cols = df.columns
    name = F.col("forward_from") if "forward_from" in cols else F.lit(None).cast("string")
    return df.select(F.col("channel_name").alias("channel"), "message_id", F.col("date").alias("timestamp"), F.coalesce("text", F.lit("")).alias("text"), "views", "sender_id", F.coalesce("has_media", F.lit(False)).alias("has_media"), name.alias("forward_from"), "backend", "scraped_at")


MANIFEST = "struct<run_id:string,channels:array<string>,scrape_mode:string,runtime_stats:struct<messages_collected:bigint,errors_encountered:bigint,flood_waits:bigint>,_corrupt_record:string>"


def run_records(runs: DataFrame) -> DataFrame:
    """Runs with what their manifests say; of a manifest that is missing or cut off all is null."""
    x = runs.withColumn("j", F.from_json("manifest_json", MANIFEST))
    j = F.when(F.col("j._corrupt_record").isNull(), F.col("j"))
    s = j["runtime_stats"]
    n = F.when(j["channels"].isNotNull(), F.size(j["channels"])).cast("long")
    return x.select("run_id", F.unix_micros("created_at").alias("created_us"), j["scrape_mode"].alias("scrape_mode"), n.alias("n_channels"), s["messages_collected"].alias("collected"), s["errors_encountered"].alias("errors"), s["flood_waits"].alias("flood_waits"))


def run_history(runs: DataFrame, n: int = 10) -> DataFrame:
    return run_records(runs).orderBy(F.desc("created_us"), "run_id").limit(n)
