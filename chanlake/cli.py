"""Command line over stored messages: ``python -m chanlake.cli COMMAND ...``."""

from __future__ import annotations

import argparse
import json
import sys
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Config
from .operators import activity, continuity, filters, graph, proxies
from .session import get_spark
from .sources import messages as store
from .sources import sinks


def _day(text: str) -> datetime:
    t = datetime.fromisoformat(text)
    return t if t.tzinfo else t.replace(tzinfo=timezone.utc)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="chanlake", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, text: str, *paths: str) -> argparse.ArgumentParser:
        c = sub.add_parser(name, help=text)
        for path in paths:
            c.add_argument(path)
        return c

    add("stats", "statistics of each channel", "messages")
    c = add("export", "the latest copy of each message", "messages", "output")
    c.add_argument("--format", choices=("json", "csv", "parquet"), default="json")
    c = add("filter", "messages that match", "messages")
    c.add_argument("--preset", choices=("cti", "crypto", "viral", "news"))
    c.add_argument("--keywords-file")
    for name in ("--keyword", "--regex", "--exclude", "--media-type"):
        c.add_argument(name, action="append", default=[])
    for name in ("--min-views", "--min-reactions", "--min-forwards", "--min-length", "--max-length"):
        c.add_argument(name, type=int)
    c.add_argument("--min-date", type=_day)
    c.add_argument("--max-date", type=_day)
    c.add_argument("--has-media", action=argparse.BooleanOptionalAction, default=None)
    c.add_argument("--mode", choices=("any", "all"), default="any")
    c.add_argument("--output")
    c.add_argument("--format", choices=("json", "csv", "parquet"), default="json")
    add("gaps", "missing ranges of ids", "messages")
    add("bias", "completeness of each channel from an observation log", "log")
    c = add("statement", "methodology statement of a channel", "log")
    c.add_argument("channel_id", type=int)
    c.add_argument("--name", default="")
    c = add("report", "bias report of a channel", "log", "output")
    c.add_argument("channel_id", type=int)
    c.add_argument("--name", default="")
    c = add("discover", "expand the graph of forwards from seeds", "messages")
    c.add_argument("seeds", nargs="+", type=int)
    c.add_argument("--depth", type=int, default=1)
    c.add_argument("--max-channels", type=int, default=100)
    c.add_argument("--min-forwards", type=int, default=3)
    c.add_argument("--message-limit", type=int, default=500)
    c.add_argument("--channels", help="snapshots of channels, for titles and names")
    c.add_argument("--output", help="a file that ends in .graphml, .gexf, .json or .txt")
    c = add("history", "the latest collection runs", "runs")
    c.add_argument("--limit", type=int, default=10)
    c = add("channels", "channels and groups of a snapshot", "snapshots")
    c.add_argument("--limit", type=int, default=100)
    c = add("init", "write a settings file, from the environment where it says something", "output")
    add("proxies", "parse a proxy list, text or .json", "path")
    return p


def spec(a: argparse.Namespace) -> filters.FilterSpec:
    """A keyword file comes before a preset, a preset before single options."""
    if a.keywords_file:
        with open(a.keywords_file, encoding="utf-8") as f:
            return filters.from_lines(f.readlines())
    if a.preset:
        return filters.preset(a.preset, a.min_views or 10_000)
    return filters.FilterSpec(
        keywords=a.keyword, regexes=a.regex, excludes=a.exclude, media_types=a.media_type, min_views=a.min_views, min_reactions=a.min_reactions, min_forwards=a.min_forwards,
        min_text_length=a.min_length, max_text_length=a.max_length, min_date=a.min_date, max_date=a.max_date, has_media=a.has_media, mode=a.mode,
    )


def _save(df: DataFrame, path: str, kind: str) -> None:
    {"json": sinks.to_json_array, "csv": sinks.to_csv, "parquet": sinks.to_parquet}[kind](df, path)


def _show(df: DataFrame) -> None:
    for row in df.toLocalIterator():
        print(json.dumps(row.asDict(True), ensure_ascii=False, default=str))


def _metrics(spark: SparkSession, a: argparse.Namespace) -> dict:
    m = continuity.metrics(continuity.continuity(spark.read.parquet(a.log))).where(F.col("channel_id") == a.channel_id).first()
    if m is None:
        sys.exit(f"channel {a.channel_id} isn't in the log")
    d = m.asDict()
    return d | {"start": sinks._moment(d["start_us"]), "end": sinks._moment(d["end_us"])}


def _discover(spark: SparkSession, a: argparse.Namespace) -> None:
    e = graph.stored(graph.edges(store.latest(store.conform(spark.read.parquet(a.messages))), a.message_limit))
    r = graph.snowball(e, a.seeds, a.depth, a.max_channels, a.min_forwards)
    nodes = graph.snowball_nodes(e, r)
    if a.channels:
        nodes = graph.resolved(nodes, store.upserted_channels(spark.read.parquet(a.channels)))
    else:
        nodes = nodes.withColumns({"username": F.lit(None).cast("string"), "title": F.lit(None).cast("string"), "participants_count": F.lit(None).cast("long")})
    into = e.join(spark.createDataFrame([(c,) for c in r.visited], "target long"), "target", "left_semi")
    if not a.output:
        _show(nodes.orderBy(F.desc("forward_count"), "channel_id").limit(20))
    elif a.output.endswith(".graphml"):
        sinks.to_graphml(nodes, into, a.output)
    elif a.output.endswith(".gexf"):
        sinks.to_gexf(nodes, into, a.output)
    elif a.output.endswith(".json"):
        sinks.to_graph_json(nodes, into, a.output)
    else:
        sinks.channel_list(nodes.withColumnRenamed("channel_id", "id"), a.output)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(argv)
    if a.command == "init":
        c = Config.from_env()
        c.to_file(a.output)
        print("\n".join(c.errors()) or "complete")
        return
    spark = spark or get_spark()
    if a.command in ("stats", "export", "filter", "gaps"):
        m = store.latest(store.conform(spark.read.parquet(a.messages)))
    if a.command == "stats":
        _show(activity.channel_stats(m))
    elif a.command == "export":
        _save(m.orderBy(F.desc("date"), F.desc("message_id")), a.output, a.format)
    elif a.command == "filter":
        s = spec(a)
        _show(s.stats(m))
        _show(filters.keyword_counts(m, s)) if s.keywords or s.regexes else None
        hit = s.apply(m)
        if a.output:
            _save(hit, a.output, a.format)
        else:
            text = F.when(F.char_length("text") > 100, F.concat(F.left("text", F.lit(100)), F.lit("..."))).otherwise(F.col("text"))
            _show(hit.orderBy(F.desc("date"), F.desc("message_id")).limit(5).select("channel_id", "message_id", text.alias("preview")))
    elif a.command == "gaps":
        _show(continuity.gap_ranges(m))
    elif a.command == "bias":
        _show(continuity.metrics(continuity.continuity(spark.read.parquet(a.log))))
    elif a.command == "statement":
        print(continuity.statement(a.name or str(a.channel_id), _metrics(spark, a)))
    elif a.command == "report":
        sinks.bias_report(_metrics(spark, a), a.name or str(a.channel_id), [], a.output)
    elif a.command == "history":
        _show(store.run_history(spark.read.parquet(a.runs), a.limit))
    elif a.command == "channels":
        known = store.upserted_channels(spark.read.parquet(a.snapshots)).where("is_megagroup or is_broadcast").orderBy("id").limit(a.limit)
        _show(known.select("id", "username", "title", "participants_count", F.when(F.col("is_broadcast"), "channel").otherwise("group").alias("type")))
    elif a.command == "discover":
        _discover(spark, a)
    elif a.command == "proxies":
        _show(proxies.parse_json(spark.read.text(a.path, wholetext=True)) if a.path.endswith(".json") else proxies.parse_lines(spark.read.text(a.path)))


if __name__ == "__main__":
    main()
