"""Streams of messages from a landing folder into the store."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQueryListener

from ..operators import continuity
from ..sources.messages import SCHEMA


def messages(spark: SparkSession, path: str, schema: T.StructType = SCHEMA, files: int = 100) -> DataFrame:
    """New files of the folder, at most ``files`` in one micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def first_arrivals(stream: DataFrame, delay: str = "7 days") -> DataFrame:
    """The first arrival of each message; the state is dropped once the watermark has passed."""
    named = stream.where("channel_id is not null and message_id is not null")
    return named.withWatermark("scraped_at", delay).dropDuplicatesWithinWatermark(["channel_id", "message_id"])


def observations(batch: DataFrame) -> DataFrame:
    """Sightings for the continuity log."""
    m = batch.where("channel_id is not null and message_id is not null")
    return m.select("channel_id", "message_id", F.col("scraped_at").alias("observed_ts"), F.lit(1).alias("seq"), F.lit("O").alias("kind"), "text", F.lit(True).alias("check_edit"), F.lit(None).cast("string").alias("gap_status"))


def ingest(stream: DataFrame, store: str, log: str, checkpoint: str, state: str | None = None):
    """A query that appends each micro-batch to the store and its sightings to the log.

    A micro-batch has a folder of its own in both, so that one that is run again replaces what it wrote before. With ``state`` the
    continuity of the messages that the batch touched, and of no others, is computed again and kept there by batch.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{store}/batch={number}")
        batch = spark.read.schema(batch.schema).parquet(f"{store}/batch={number}")
        observations(batch).write.mode("overwrite").parquet(f"{log}/batch={number}")
        if state:
            touched = batch.where("channel_id is not null and message_id is not null").select("channel_id", "message_id").distinct()
            seen = spark.read.parquet(log).drop("batch").join(touched, ["channel_id", "message_id"], "left_semi")
            continuity.continuity(seen).write.mode("overwrite").parquet(f"{state}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def status(spark: SparkSession, log: str) -> DataFrame:
    """Continuity over all that the stream has logged."""
    return continuity.continuity(spark.read.parquet(log).drop("batch"))


def live_status(spark: SparkSession, state: str) -> DataFrame:
    """Continuity as the micro-batches left it: of each message what the last batch that touched it found. It is a fold, so the whole log isn't read."""
    x = spark.read.parquet(state)
    cols = [c for c in x.columns if c not in ("channel_id", "message_id", "batch")]
    last = F.max_by(F.struct(*cols), "batch").alias("s")
    return x.groupBy("channel_id", "message_id").agg(last).select("channel_id", "message_id", *[F.col(f"s.{c}").alias(c) for c in cols])


class Progress(StreamingQueryListener):
    """Calls ``tell(rows so far)`` after each micro-batch; :func:`stop` ends a query after the batch it is at."""

    def __init__(self, tell):
        self.tell, self.rows = tell, 0

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.rows += event.progress.numInputRows
        self.tell(self.rows)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def stop(query, wait_s: float = 60.0) -> None:
    """Let the running micro-batch commit, then stop; what arrives later is for the next start from the checkpoint."""
    until = time.time() + wait_s
    while query.isActive and query.status["isTriggerActive"] and time.time() < until:
        time.sleep(0.05)
    query.stop()


def windowed_counts(stream: DataFrame, width: str = "1 hour", delay: str = "1 day") -> DataFrame:
    """Messages of each channel and time window."""
    w = stream.withWatermark("date", delay).groupBy(F.window("date", width), "channel_id")
    return w.agg(F.count("*").alias("messages"), F.sum("views").alias("views"))
