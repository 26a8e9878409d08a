"""The graph of forwards between channels, its expansion from seeds, and its exports."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.scratch import materialize


def forward_source(kind, peer_id, legacy):
    """The channel or chat that a message was forwarded from; users are no source."""
    return F.coalesce(F.when(kind.isin("channel", "chat"), peer_id), legacy)


def edges(df: DataFrame, limit: int | None = None, source: Column | str = "fwd_from_channel_id") -> DataFrame:
    """(source, target, weight, first_us, last_us, first_pos): forwards into each channel, self-forwards left out.

    With ``limit`` only the newest messages of each channel count; ``first_pos`` is the place of the newest forward among them.
    ``source`` is a column, or :func:`forward_source` of rows that name the kind of the peer.
    """
    src = F.col(source) if isinstance(source, str) else source
    x = df.where("message_id is not null and channel_id is not null").select("channel_id", "message_id", "date", src.alias("fwd_from_channel_id"))
    w = Window.partitionBy("channel_id").orderBy(F.desc("message_id"))
    if limit is not None:
        x = x.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= limit)
    else:
        x = x.withColumn("pos", -F.col("message_id"))
    x = x.where("fwd_from_channel_id <> channel_id")
    return x.groupBy(F.col("fwd_from_channel_id").alias("source"), F.col("channel_id").alias("target")).agg(
        F.count("*").alias("weight"), F.unix_micros(F.min("date")).alias("first_us"), F.unix_micros(F.max("date")).alias("last_us"), F.min("pos").cast("long").alias("first_pos")
    )


def nodes(e: DataFrame) -> DataFrame:
    """Sources by the number of forwards from them."""
    return e.groupBy(F.col("source").alias("channel_id")).agg(F.sum("weight").alias("forward_count"), F.count("*").alias("targets"))


def stats(e: DataFrame) -> DataFrame:
    """Channels, edges, forwards and scanned channels of the whole graph."""
    ends = F.array(F.struct(F.col("source").alias("c"), F.col("target").alias("t"), F.col("weight").alias("w"), F.lit(1).alias("one")), F.struct(F.col("target").alias("c"), F.col("target").alias("t"), F.lit(0).cast("long").alias("w"), F.lit(0).alias("one")))
    x = e.select(F.inline(ends))
    return x.agg(F.count_distinct("c").alias("total_channels"), F.coalesce(F.sum("one"), F.lit(0)).cast("long").alias("total_edges"), F.coalesce(F.sum("w"), F.lit(0)).alias("forwards_analyzed"), F.count_distinct("t").alias("visited"))


@dataclass
class Snowball:
    """Result of an expansion: all known channels in order of discovery, those scanned, and errors."""

    known: list[int] = field(default_factory=list)
    visited: list[int] = field(default_factory=list)
    errors: int = 0


def stored(e: DataFrame) -> DataFrame:
    """The edges written once, so that no level computes them again."""
    return materialize(e, "edges")


def snowball(e: DataFrame, seeds: Sequence[int], depth: int = 1, max_channels: int = 100, min_forwards: int = 3, accessible=lambda c: True) -> Snowball:
    """Level by level from the seeds over edges that are stored (:func:`stored`). A level is joined as a table of its own; what reaches
    the driver are the edges into its channels: at most ``max_channels`` times the message limit."""
    out, known, visited = Snowball(), {}, set()
    level = list(dict.fromkeys(seeds))
    for _ in range(depth):
        level = [c for c in dict.fromkeys(level) if c not in visited]
        if not level:
            break
        into: dict[int, list[tuple[int, int]]] = {}
        if len(known) < max_channels:
            own = e.sparkSession.createDataFrame([(c,) for c in level], "target long")
            rows = e.join(own, "target", "left_semi").select("source", "target", "weight", "first_pos").orderBy("target", "first_pos", "source")
            for r in rows.toLocalIterator():
                into.setdefault(r["target"], []).append((r["source"], r["weight"]))
        queue = []
        for c in level:
            if len(known) >= max_channels:
                break
            if not accessible(c):
                out.errors += 1
                continue
            known.setdefault(c, None)
            visited.add(c)
            out.visited.append(c)
            for s, weight in into.get(c, ()):
                if s not in known:
                    known[s] = c
                    if weight >= min_forwards:
                        queue.append(s)
        level = queue
    out.known = list(known)
    return out


def snowball_nodes(e: DataFrame, result: Snowball) -> DataFrame:
    """(channel_id, forward_count, scanned) over the edges into scanned channels."""
    spark = e.sparkSession
    k = spark.createDataFrame([(c, c in set(result.visited)) for c in result.known], "channel_id long, scanned boolean")
    v = spark.createDataFrame([(c,) for c in result.visited], "target long")
    w = e.join(v, "target", "left_semi").groupBy(F.col("source").alias("channel_id")).agg(F.sum("weight").alias("forward_count"))
    return k.join(w, "channel_id", "left").select("channel_id", F.coalesce("forward_count", F.lit(0)).alias("forward_count"), "scanned")


def resolved(n: DataFrame, channels: DataFrame) -> DataFrame:
    """Nodes with what the channel dimension knows of them."""
    return n.join(channels.select(F.col("id").alias("channel_id"), "username", "title", "participants_count"), "channel_id", "left")


_KEYS = (("title", "string"), ("username", "string"), ("participants", "int"), ("forward_count", "int"))


def graphml(node_rows, edge_rows) -> bytes:
    """Rows of (channel_id, title, username, participants, forward_count) and (source, target, weight)."""
    root = ET.Element("graphml", xmlns="http://graphml.graphdrawing.org/xmlns")
    for name, kind in _KEYS:
        ET.SubElement(root, "key", {"id": name, "for": "node", "attr.name": name, "attr.type": kind})
    ET.SubElement(root, "key", {"id": "weight", "for": "edge", "attr.name": "weight", "attr.type": "int"})
    g = ET.SubElement(root, "graph", id="G", edgedefault="directed")
    for r in node_rows:
        n = ET.SubElement(g, "node", id=str(r[0]))
        for (name, _), v in zip(_KEYS, r[1:]):
            if v or name == "forward_count":
                ET.SubElement(n, "data", key=name).text = str(v or 0)
    for k, (s, t, w) in enumerate(edge_rows):
        x = ET.SubElement(g, "edge", id=f"e{k}", source=str(s), target=str(t))
        ET.SubElement(x, "data", key="weight").text = str(w)
    return ET.tostring(root, encoding="utf-8", xml_declaration=True)


def gexf(node_rows, edge_rows) -> bytes:
    root = ET.Element("gexf", xmlns="http://www.gexf.net/1.2draft", version="1.2")
    g = ET.SubElement(root, "graph", mode="static", defaultedgetype="directed")
    a = ET.SubElement(g, "attributes", {"class": "node"})
    for k, (name, kind) in enumerate(_KEYS[1:]):
        ET.SubElement(a, "attribute", id=str(k), title=name, type="integer" if kind == "int" else kind)
    ns = ET.SubElement(g, "nodes")
    for r in node_rows:
        n = ET.SubElement(ns, "node", id=str(r[0]), label=str(r[1] or r[2] or r[0]))
        values = ET.SubElement(n, "attvalues")
        for k, v in enumerate(r[2:]):
            if v or k == 2:
                ET.SubElement(values, "attvalue", {"for": str(k), "value": str(v or 0)})
    es = ET.SubElement(g, "edges")
    for k, (s, t, w) in enumerate(edge_rows):
        ET.SubElement(es, "edge", id=str(k), source=str(s), target=str(t), weight=str(w))
    return ET.tostring(root, encoding="utf-8", xml_declaration=True)
