"""Mixing sources to target shares of tokens by weighted fair queueing.

Documents of a source stand in a shuffled queue, all first copies before any second copy. A document's
virtual finish time is the number of tokens of its source up to and with it, divided by the source's target share. The
collection is all copies in the order of their finish times, cut off at the total budget: at every point the
sources have received tokens in proportion to their shares, but for one document each.

The running sums are made without any task seeing a whole source: queues are cut into buckets by the shuffle key, small
sums per bucket are accumulated first, in two levels, and the sum inside a bucket is added to its bucket's offset.

Defined results: rows with a null id, text or source and texts without tokens are no documents; of several rows with
one id one counts. A target without documents gets nothing and is reported with share 0, as is a target share of 0 or null; a null or
negative ``max_repeats`` counts as 0. The largest budget that all other sources can fill within their repeats is the default.
Empty tables give an empty collection.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.scratch import materialize

#: A vocabulary in the format of one base64 token and its rank a line.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The splitting pattern that belongs to it.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Documents of one bucket of a queue, about.
BUCKET = 20_000
#: Buckets whose sums are accumulated together: 2 to this power.
PART_BITS = 10

_encoders: dict[int, object] = {}


def _encoder(body: bytes):
    k = hash(body)
    if k not in _encoders:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in body.splitlines() if line.strip())}
        _encoders[k] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[k]


def token_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", path: str = VOCABULARY) -> DataFrame:
    """(id, source, n): documents with at least one token. The vocabulary is read by the driver and sent to the tasks."""
    src = docs.select(docs[doc_id].cast("long").alias("id"), docs[source].cast("string").alias("source"), docs[text].cast("string").alias("text")).dropna()
    with open(path, "rb") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(sent.value)
        for b in batches:
            n = [len(enc.encode_ordinary(t)) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("source"), pa.array(n, pa.int64())], ["id", "source", "n"])

    counted = src.mapInArrow(run, "id long, source string, n long").where("n > 0")
    return counted.groupBy("id").agg(F.min(F.struct("source", "n")).alias("x")).select("id", "x.source", "x.n")


def _goals(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    t = targets.select(targets["source"].cast("string").alias("source"), F.coalesce(targets["target_share"], F.lit(0.0)).alias("share"), F.greatest(F.coalesce(targets["max_repeats"], F.lit(0)), F.lit(0)).cast("long").alias("most"))
    t = t.where("source is not null").groupBy("source").agg(F.max("share").alias("share"), F.max("most").alias("most"))
    have = sizes.groupBy("source").agg(F.sum("n").alias("have"), F.count("*").alias("docs"))
    return t.join(have, "source", "left").fillna(0, ["have", "docs"])


class Mixture:
    """``collection`` and ``shares`` of documents mixed to targets (source, target_share, max_repeats)."""

    def __init__(self, docs: DataFrame, targets: DataFrame, budget: float | None = None, seed: int = 42, path: str = VOCABULARY, doc_id: str = "doc_id", text: str = "text", source: str = "source"):
        self.sizes = materialize(token_counts(docs, doc_id, text, source, path), "sizes")
        self.goals = materialize(_goals(self.sizes, targets), "goals")
        self.seed, self.doc_id = seed, doc_id
        able = self.goals.where("share > 0 and have > 0 and most > 0").agg(F.min(F.col("have") * F.col("most") / F.col("share"))).first()[0]
        self.budget = min(able or 0.0, budget if budget is not None else able or 0.0)
        self._picked: DataFrame | None = None

    def picked(self) -> DataFrame:
        """(id, source, copy, n, finish) of all copies within the budget, in no order."""
        if self._picked is None:
            g = self.goals.where("share > 0 and have > 0 and most > 0")
            need = F.least(F.col("most"), F.ceil(F.lit(float(self.budget)) * F.col("share") / F.col("have")) + 1)
            g = g.select("source", "share", need.cast("int").alias("copies"), F.greatest(F.lit(1), F.ceil(F.col("docs") / F.lit(BUCKET))).cast("long").alias("buckets"))
            copies = self.sizes.join(g, "source").select("id", "source", "n", "share", "buckets", F.explode(F.sequence(F.lit(1), "copies")).alias("copy"))
            key = F.xxhash64(F.lit(self.seed), "id", "copy")
            copies = copies.withColumn("key", key).withColumn("bucket", F.pmod("key", "buckets").cast("int"))
            sums = materialize(copies.groupBy("source", "copy", "bucket").agg(F.sum("n").alias("s")).withColumn("part", F.shiftright("bucket", PART_BITS)), "sums")
            tops = sums.groupBy("source", "copy", "part").agg(F.sum("s").alias("t"))
            above = Window.partitionBy("source").orderBy("copy", "part").rowsBetween(Window.unboundedPreceding, -1)
            tops = tops.select("source", "copy", "part", F.coalesce(F.sum("t").over(above), F.lit(0)).alias("base"))
            before = Window.partitionBy("source", "copy", "part").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
            sums = sums.withColumn("within", F.coalesce(F.sum("s").over(before), F.lit(0))).join(tops, ["source", "copy", "part"])
            sums = sums.select("source", "copy", "bucket", (F.col("base") + F.col("within")).alias("offset"))
            inside = Window.partitionBy("source", "copy", "bucket").orderBy("key", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
            queued = copies.join(sums, ["source", "copy", "bucket"]).withColumn("finish", (F.col("offset") + F.sum("n").over(inside)) / F.col("share"))
            cut = float(self.budget) * (1 + 1e-12)
            self._picked = materialize(queued.where(F.col("finish") <= cut).select("id", "source", "copy", "n", "finish"), "mixture")
        return self._picked

    def collection(self) -> DataFrame:
        """(doc_id, source, copy, n_tokens, finish), sorted by finish time."""
        p = self.picked().orderBy("finish", "source", "id", "copy")
        return p.select(F.col("id").alias(self.doc_id), "source", "copy", F.col("n").alias("n_tokens"), "finish")

    def shares(self) -> DataFrame:
        """(source, target_share, actual_share, tokens, documents, most_copies, unused_tokens) for each target.

        ``unused_tokens`` is what the source could still give within its repeats."""
        p = self.picked()
        got = p.groupBy("source").agg(F.sum("n").alias("tokens"), F.countDistinct("id").alias("documents"), F.max("copy").alias("most_copies"))
        total = F.lit(p.agg(F.sum("n")).first()[0] or 1)
        out = self.goals.join(got, "source", "left").fillna(0, ["tokens", "documents", "most_copies"])
        return out.select("source", F.col("share").alias("target_share"), (F.col("tokens") / total).alias("actual_share"), "tokens", "documents", "most_copies", (F.col("have") * F.col("most") - F.col("tokens")).alias("unused_tokens"))
