"""Names, kinds and duplicates of media files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def candidates(df: DataFrame) -> DataFrame:
    """Rows with media that is more than a link preview."""
    return df.where("media_type is not null and media_type not in ('MessageMediaWebPage', 'MessageMediaEmpty')")


def kind(media_type: Column, mime: Column, is_video: Column, is_audio: Column) -> Column:
    doc = F.when(is_video, "video").when(is_audio, "audio").when(F.startswith(mime, F.lit("image/")), "image").otherwise("document")
    return F.when(media_type == "MessageMediaPhoto", "photo").when(media_type == "MessageMediaDocument", doc)


def extension(media_kind: Column, mime: Column, filename: Column) -> Column:
    tail = F.element_at(F.split(mime, "/"), -1)
    has = F.contains(mime, F.lit("/"))
    dotted = F.when(F.contains(F.coalesce(filename, F.lit("")), F.lit(".")), F.element_at(F.split(filename, r"\."), -1)).otherwise("bin")
    out = F.when(media_kind == "photo", "jpg").when(media_kind == "video", F.when(has, tail).otherwise("mp4")).when(media_kind == "audio", F.when(has, tail).otherwise("mp3")).when(media_kind == "image", tail).when(media_kind == "document", dotted)
    return F.replace(F.lower(out), F.lit("jpeg"), F.lit("jpg"))


def filename(date: Column, message_id: Column, media_kind: Column, ext: Column) -> Column:
    return F.concat(F.date_format(date, "yyyyMMdd_HHmmss"), F.lit("_"), message_id.cast("string"), F.lit("_"), media_kind, F.lit("."), ext)


def distinct_files(files: DataFrame) -> DataFrame:
    """Of files with equal content the one with the first path; reads the ``binaryFile`` source."""
    x = files.withColumn("md5", F.md5("content")).drop("content")
    return x.withColumn("_rn", F.row_number().over(Window.partitionBy("md5").orderBy("path"))).where("_rn = 1").drop("_rn")


def stats(tasks: DataFrame) -> DataFrame:
    """(downloaded, failed, pending) of download tasks with a ``status``. A file that is there already, has a twin or isn't supported is done and counts as downloaded."""
    done = F.col("status").isin("downloaded", "exists", "duplicate", "unsupported")
    return tasks.agg(F.count_if(done).alias("downloaded"), F.count_if(F.col("status") == "failed").alias("failed"), F.count_if(F.col("status").isNull() | (F.col("status") == "pending")).alias("pending"))
