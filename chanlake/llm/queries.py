"""Queries of the operators for training text and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import deliveries
from ..sources.tables import spread, table
from .oracles import ORACLES  # noqa: F401  (with QUERIES, what the entry reads)
from . import abuse, languages, leaks, lookalikes, mixing, neardup, personal, residue, samples


def _messages(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spread(table(spark, sf_dir, "messages").select("delivery_id", "text", *columns))


def _documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text", *columns))


def _posts(spark: SparkSession, sf_dir: str) -> neardup.NearDuplicates:
    """Kept messages of at least 40 tokens, by pairs of adjacent tokens."""
    keys = ("channel_id", "message_id", "scraped_at")
    m = _messages(spark, sf_dir, *keys)
    s = neardup.digests(m, "delivery_id", "text", 2, 40, keys)
    kept = deliveries.keep_one(s, ["id", "s1", "s2"], row_id="id")
    return neardup.NearDuplicates(kept, m, "delivery_id", "text", width=2, threshold=0.7, min_tokens=40)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _posts(spark, sf_dir).classes().select(F.col("id").alias("delivery_id"), "group_id")


def _vocabulary(spark: SparkSession, sf_dir: str):
    texts = _messages(spark, sf_dir).select("text").unionByName(table(spark, sf_dir, "channels").select(F.col("title").alias("text")))
    return lookalikes.vocabulary(texts, "text")


def _prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vocabulary(spark, sf_dir)
    texts = lookalikes.forms(_messages(spark, sf_dir), ["delivery_id"], "text", v)
    titles = lookalikes.forms(table(spark, sf_dir, "channels").select("id", "title").distinct(), ["id"], "title", v)
    return lookalikes._prints(texts, "delivery_id", "text").unionByName(lookalikes._prints(titles, "id", "title"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalikes.pairs(_prints(spark, sf_dir))


def p3_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that share their form with other texts, by class; a title counts once for each way in which its channel wrote it."""
    return lookalikes.classes(_prints(spark, sf_dir))


def p3_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text with a token of mixed alphabets that the corpus knows in one."""
    m = _messages(spark, sf_dir)
    v = lookalikes.vocabulary(m, "text", lookalikes._WORD)
    return lookalikes.forms(m, ["delivery_id"], "text", v, lookalikes.repair).where("text <> form").select("delivery_id", F.col("form").alias("repaired"))


def p3_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text whose form differs from how it is written."""
    f = lookalikes.forms(_messages(spark, sf_dir), ["delivery_id"], "text", _vocabulary(spark, sf_dir))
    return f.where("text <> form").select("delivery_id", "form")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaked(_documents(spark, sf_dir), table(spark, sf_dir, "eval_items"))


def p8_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of characters to remove from each document concerned."""
    return leaks.leak_spans(_documents(spark, sf_dir), table(spark, sf_dir, "eval_items"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.detect(_messages(spark, sf_dir), "delivery_id", "text").select("delivery_id", "kind").distinct()


def p2_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.redacted(_messages(spark, sf_dir), "delivery_id", "text")


def _assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    filters = languages.fit(_messages(spark, sf_dir), "text")
    return languages.assign(_messages(spark, sf_dir, "lang"), filters, "delivery_id", "text", "lang")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages.disagreements(_assigned(spark, sf_dir), "delivery_id")


def p5_stretches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stretch in one language, counted in words, with its confidence."""
    return _assigned(spark, sf_dir).select("delivery_id", F.explode("stretches").alias("s")).select("delivery_id", "s.begin", "s.end", "s.lang", "s.confidence")


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = samples.sample(table(spark, sf_dir, "messages"), "delivery_id", "text", abuse.SAMPLE)
    return abuse.scores(_messages(spark, sf_dir, "channel_id", "backend"), abuse.stored(spark, texts), "delivery_id", "text", ["channel_id", "backend"])


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).where(F.col("score") >= abuse.THRESHOLD).select("delivery_id")


def p6_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("delivery_id", "score")


def p6_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of abusive messages of each channel and backend."""
    bad = F.count_if(F.col("score") >= abuse.THRESHOLD)
    return _scored(spark, sf_dir).groupBy("channel_id", "backend").agg(F.count("*").alias("messages"), bad.alias("abusive"), (bad / F.count("*")).alias("rate"))


def _mixture(spark: SparkSession, sf_dir: str) -> mixing.Mixture:
    return mixing.Mixture(_documents(spark, sf_dir, "source"), table(spark, sf_dir, "mix_targets"))


def p9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixture(spark, sf_dir).collection()


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixture(spark, sf_dir).shares()


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.judged(_documents(spark, sf_dir), residue.fit(), "doc_id", "text")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir).where("excluded").select("doc_id")


def p10_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The other documents, with the share of residue in each."""
    return _judged(spark, sf_dir).where("not excluded").select("doc_id", "share")


QUERIES = {
    f.__name__: f
    for f in (p2_found, p2_redacted, p3_found, p3_classes, p3_forms, p3_repaired, p5_found, p5_stretches, p6_found, p6_scores, p6_rates, p7_found, p8_found, p8_spans, p9_mixture, p9_shares, p10_found, p10_kept)
}
