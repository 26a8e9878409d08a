"""Writing: the message store and exports.

Tables are written by Spark and committed as a whole. Single-document formats (a JSON array, graph XML, reports) pass through the
driver row by row; they are meant for results, not for tables.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import continuity, graph


def append_messages(df: DataFrame, path: str, rows_per_file: int = 1_000_000) -> None:
    """To the store, one folder for each channel name. Rows of a channel go to as many tasks as it needs."""
    spread = df.repartition("channel_name", F.pmod(F.xxhash64("message_id"), F.lit(8)))
    spread.write.mode("append").option("compression", "snappy").option("maxRecordsPerFile", rows_per_file).partitionBy("channel_name").parquet(path)


def to_parquet(df: DataFrame, path: str) -> None:
    """One file: the export format asks for it."""
    df.coalesce(1).write.mode("overwrite").option("compression", "snappy").parquet(path)


def to_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').option("multiLine", True).csv(path)


def to_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def _plain(v):
    return v.isoformat() if isinstance(v, datetime) else v


def to_json_array(df: DataFrame, path: str) -> int:
    """An array of records in one local file; the number of records."""
    n = 0
    with open(path, "w", encoding="utf-8") as f:
        f.write("[")
        for row in df.toLocalIterator():
            f.write(("," if n else "") + "\n" + json.dumps({k: _plain(v) for k, v in row.asDict(True).items()}, ensure_ascii=False, indent=2, default=str))
            n += 1
        f.write("\n]\n")
    return n


def channel_list(channels: DataFrame, path: str) -> None:
    channels.select(F.coalesce("username", F.col("id").cast("string")).alias("value")).distinct().write.mode("overwrite").text(path)


def _graph_rows(nodes: DataFrame, edges: DataFrame):
    n = nodes.select("channel_id", "title", "username", "participants_count", "forward_count").orderBy("channel_id").toLocalIterator()
    e = edges.select("source", "target", "weight").orderBy("source", "target").toLocalIterator()
    return map(tuple, n), map(tuple, e)


def to_graphml(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    _write(path, graph.graphml(*_graph_rows(nodes, edges)))


def to_gexf(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    _write(path, graph.gexf(*_graph_rows(nodes, edges)))


def to_graph_json(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    n, e = _graph_rows(nodes, edges)
    n, e = list(n), list(e)
    names = ("id", "title", "username", "participants_count", "forward_count")
    body = {"channels": [dict(zip(names, r)) for r in n], "edges": [dict(zip(("source", "target", "weight"), r)) for r in e], "stats": {"total_channels": len(n), "total_edges": len(e)}}
    _write(path, json.dumps(body, ensure_ascii=False, indent=2).encode())


def _write(path: str, body: bytes) -> None:
    with open(path, "wb") as f:
        f.write(body)


def _moment(us: int | None) -> datetime | None:
    return None if us is None else datetime.fromtimestamp(us / 1e6, timezone.utc)


def bias_report(metrics_row: dict, name: str, runs: list[dict], path: str, now: Callable[[], datetime] = lambda: datetime.now(timezone.utc)) -> dict:
    """Report of one channel: one row of the metrics, rounded on the driver, the statement and the last five runs."""
    m = dict(metrics_row)
    start, end = _moment(m.get("start_us")), _moment(m.get("end_us"))
    r = lambda k: round(m[k], 4)
    body = {
        "generated_at": now().isoformat(),
        "channel": {"id": m["channel_id"], "name": name},
        "metrics": {
            "coverage": {"expected_messages": m["expected"], "observed_messages": m["observed"], "gap_count": m["gaps"], "gap_ratio": r("gap_ratio"), "coverage_rate": r("coverage_rate")},
            "deletions": {"confirmed_deleted": m["deleted"], "possibly_deleted": m["possibly_deleted"], "deletion_rate": r("deletion_rate")},
            "edits": {"edited_messages": m["edited"], "edit_rate": r("edit_rate")},
            "temporal": {"collection_start": start and start.isoformat(), "collection_end": end and end.isoformat()},
        },
        "methodology_statement": continuity.statement(name, m | {"start": start, "end": end}),
        "recent_runs": runs[:5],
    }
    _write(path, json.dumps(body, ensure_ascii=False, indent=2, default=str).encode())
    return body


class Run:
    """A collection run: a manifest row on leaving the block, and on repeated ends nothing more."""

    def __init__(self, spark: SparkSession, path: str, channels: list[str], mode: str = "incremental", **parameters):
        self.spark, self.path, self.ended = spark, path, False
        self.manifest = {"run_id": str(uuid.uuid4()), "channels": channels, "scrape_mode": mode, "parameters": parameters, "start_time_utc": datetime.now(timezone.utc).isoformat(), "runtime_stats": {"messages_collected": 0, "messages_skipped": 0, "errors_encountered": 0, "flood_waits": 0, "proxy_rotations": 0}}

    def count(self, **more: int) -> None:
        for k, v in more.items():
            self.manifest["runtime_stats"][k] += v

    def end(self) -> None:
        if self.ended:
            return
        self.ended = True
        now = datetime.now(timezone.utc)
        self.manifest["end_time_utc"] = now.isoformat()
        row = [(self.manifest["run_id"], now, json.dumps(self.manifest))]
        self.spark.createDataFrame(row, "run_id string, created_at timestamp, manifest_json string").write.mode("append").parquet(self.path)

    def __enter__(self) -> Run:
        return self

    def __exit__(self, *_) -> None:
        self.end()
