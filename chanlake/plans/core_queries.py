"""Queries of the core operators for training data and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import deliveries, hierarchy
from ..sources.tables import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deliveries.redundant(table(spark, sf_dir, "messages"))


def p1_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deliveries and kept messages of each channel."""
    m = table(spark, sf_dir, "messages")
    lost = deliveries.redundant(m, carry=["channel_id"]).select("channel_id", F.lit(0).alias("n"), F.lit(1).alias("lost"))
    j = m.select("channel_id", F.lit(1).alias("n"), F.lit(0).alias("lost")).unionByName(lost)
    return j.groupBy("channel_id").agg(F.sum("n").alias("deliveries"), (F.sum("n") - F.sum("lost")).alias("kept"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = hierarchy.hierarchy(table(spark, sf_dir, "messages"))
    return h.where("linked").select("channel_id", "message_id", "root_id", "depth")


def p4_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids from the root down to each message, as text; null where the links lead in circles."""
    p = hierarchy.paths(table(spark, sf_dir, "messages"))
    return p.select("channel_id", "message_id", F.concat_ws("/", F.col("path").cast("array<string>")).alias("path")).withColumn("path", F.when(F.col("path") != "", F.col("path")))


def p4_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.descendants(table(spark, sf_dir, "messages"))


def p4_all_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As p4_paths, and from the smallest id of the circle down where the links lead in circles."""
    p = hierarchy.all_paths(table(spark, sf_dir, "messages"))
    return p.withColumn("path", F.concat_ws("/", F.col("path").cast("array<string>")))


def p4_all_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As p4_descendants, and the pairs on circles and below them."""
    return hierarchy.all_descendants(table(spark, sf_dir, "messages"))


QUERIES = {f.__name__: f for f in (p1_found, p1_channels, p4_found, p4_paths, p4_descendants, p4_all_paths, p4_all_descendants)}

_RANKED = "row_number() OVER (PARTITION BY channel_id, message_id ORDER BY scraped_at DESC NULLS LAST, delivery_id) AS rn"
_NODES = """
WITH RECURSIVE node AS (
  SELECT channel_id, message_id, max(reply_to_id) AS parent FROM messages WHERE message_id IS NOT NULL GROUP BY channel_id, message_id
), link AS (
  SELECT c.channel_id, c.message_id, c.parent FROM node c JOIN node p ON p.channel_id = c.channel_id AND p.message_id = c.parent
)"""
#: Walks up from every linked message, keeping the ids passed; a walk stops at the first id it has passed before.
_WALK = (
    _NODES
    + """, walk AS (
  SELECT channel_id, message_id, parent AS nxt, [message_id] AS passed FROM link
  UNION ALL
  SELECT w.channel_id, w.message_id, l.parent, list_append(w.passed, w.nxt)
  FROM walk w JOIN link l ON l.channel_id = w.channel_id AND l.message_id = w.nxt WHERE NOT list_contains(w.passed, w.nxt)
), last AS (
  SELECT w.* FROM walk w LEFT JOIN link l ON l.channel_id = w.channel_id AND l.message_id = w.nxt
  WHERE l.message_id IS NULL OR list_contains(w.passed, w.nxt)
)"""
)
ORACLES = {
    "p1_found": f"SELECT delivery_id FROM (SELECT delivery_id, message_id, channel_id, {_RANKED} FROM messages) WHERE rn > 1 AND message_id IS NOT NULL AND channel_id IS NOT NULL",
    "p1_channels": f"SELECT channel_id, count(*) AS deliveries, CAST(sum(CASE WHEN rn = 1 OR message_id IS NULL OR channel_id IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS kept FROM (SELECT channel_id, message_id, {_RANKED} FROM messages) GROUP BY channel_id",
    "p4_found": _WALK
    + """ SELECT channel_id, message_id,
  CASE WHEN list_contains(passed, nxt) THEN list_min(list_slice(passed, list_position(passed, nxt), len(passed))) ELSE nxt END AS root_id,
  CAST(CASE WHEN list_contains(passed, nxt) THEN -1 ELSE len(passed) END AS BIGINT) AS depth FROM last""",
    "p4_paths": _WALK
    + """ SELECT n.channel_id, n.message_id,
  CASE WHEN l.message_id IS NULL THEN CAST(n.message_id AS VARCHAR) WHEN list_contains(l.passed, l.nxt) THEN NULL
  ELSE concat(l.nxt, '/', list_aggregate(list_reverse(l.passed), 'string_agg', '/')) END AS path
  FROM node n LEFT JOIN last l ON l.channel_id = n.channel_id AND l.message_id = n.message_id""",
    "p4_descendants": _WALK
    + """, ok AS (SELECT channel_id, message_id, list_append(passed, nxt) AS up FROM last WHERE NOT list_contains(passed, nxt)), steps AS (SELECT channel_id, message_id AS descendant_id, up, unnest(range(2, len(up) + 1)) AS k FROM ok)
  SELECT channel_id, up[k] AS message_id, descendant_id, k - 1 AS distance FROM steps""",
    "p4_all_paths": _WALK
    + """, up AS (
  SELECT channel_id, message_id, list_contains(passed, nxt) AS circle, CASE WHEN list_contains(passed, nxt)
  THEN list_slice(passed, 1, list_position(passed, list_min(list_slice(passed, list_position(passed, nxt), len(passed))))) ELSE list_append(passed, nxt) END AS ids FROM last
)
  SELECT n.channel_id, n.message_id, coalesce(u.circle, false) AS circle,
  CASE WHEN u.message_id IS NULL THEN CAST(n.message_id AS VARCHAR) ELSE list_aggregate(list_reverse(u.ids), 'string_agg', '/') END AS path
  FROM node n LEFT JOIN up u ON u.channel_id = n.channel_id AND u.message_id = n.message_id""",
    "p4_all_descendants": _WALK
    + """, up AS (
  SELECT channel_id, message_id, list_contains(passed, nxt) AS circle, CASE WHEN list_contains(passed, nxt) THEN passed ELSE list_append(passed, nxt) END AS ids FROM last
), steps AS (SELECT channel_id, message_id AS descendant_id, circle, ids, unnest(range(2, len(ids) + 1)) AS k FROM up)
  SELECT channel_id, ids[k] AS message_id, descendant_id, k - 1 AS distance, circle FROM steps""",
}
