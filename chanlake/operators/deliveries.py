"""Messages delivered more than once: keep exactly one copy of each.

An identifier is a tuple of key columns. Identifiers are hashed to shards; a shard encodes them exactly by a
dictionary and keeps a compressed bitmap with a bit for each code (:class:`Shard`). Arrivals are presented to
their shard latest first, among equals by the smallest row id; an arrival is selected if the bit of its code is unseen, and
the bits of the selected arrivals are united with the bitmap. The same code serves one table
(:func:`keep_one`, :func:`redundant`) and batches over time (:class:`Ledger`).

Every input batch elects its local winners before anything is shuffled, so a single identifier that
makes up a large part of all rows reaches its shard as one row per batch. Shards are hashes of the whole
identifier and thus even, whatever the skew of the single key columns; their number follows from the size of the input
(``SHARD_BYTES``), and each is one partition. Rows are sorted by Spark, which can spill, and streamed past the bitmap: what a
task holds is the dictionary of its shard.

Defined results: a row with a null in any key column has no identifier and is always kept. A null order
value counts as the oldest. Rows equal in order value and id are copies of one row; one of them is kept
by :func:`keep_one`, and :func:`redundant` reports the id once for each further copy. Empty input gives
empty output. Further columns, whatever their names, are ignored or carried along.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.arrowkit import dense_codes, emit
from ..functions.volume import partitions
from ..plans.scratch import materialize

KEYS = ("channel_id", "message_id")
#: Estimated bytes of keys and order that one shard of a table gets; its dictionary takes a few times as much.
SHARD_BYTES = 32 << 20


class Bitmap:
    """Bits in chunks of 65 536: a chunk without a set bit isn't kept, a full one is kept as such, others are packed."""

    BITS = 1 << 16

    def __init__(self) -> None:
        self.chunks: dict[int, np.ndarray | None] = {}  # None: full

    def test(self, codes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(codes), bool)
        for k in np.unique(codes >> 16).tolist():
            at = np.flatnonzero(codes >> 16 == k)
            if k in self.chunks:
                c, low = self.chunks[k], codes[at] & 0xFFFF
                out[at] = True if c is None else (c[low >> 3] >> (low & 7)) & 1 == 1
        return out

    def unite(self, codes: np.ndarray) -> None:
        for k in np.unique(codes >> 16).tolist():
            c = self.chunks.get(k, np.zeros(self.BITS // 8, np.uint8))
            if c is not None:
                low = codes[codes >> 16 == k] & 0xFFFF
                np.bitwise_or.at(c, low >> 3, (1 << (low & 7)).astype(np.uint8))
                self.chunks[k] = None if (c == 255).all() else c

    def end(self, chunk: int) -> int:
        """One more than the last bit that is set in a chunk."""
        c = self.chunks[chunk]
        return self.BITS if c is None else int(np.flatnonzero(np.unpackbits(c, bitorder="little"))[-1]) + 1

    def dump(self) -> list[tuple[int, bytes]]:
        """A full chunk is an empty body."""
        return [(k, b"" if c is None else zlib.compress(c.tobytes())) for k, c in sorted(self.chunks.items())]

    def load(self, chunk: int, body: bytes) -> None:
        self.chunks[chunk] = np.frombuffer(zlib.decompress(body), np.uint8).copy() if body else None


class Shard:
    """Exact dictionary of the identifiers of one shard, and the bits of those that were seen."""

    def __init__(self) -> None:
        self.codes: dict[tuple, int] = {}
        self.seen = Bitmap()
        self.next = 0

    def encode(self, keys: Sequence[Sequence]) -> np.ndarray:
        out = np.empty(len(keys[0]), np.int64)
        for i, k in enumerate(zip(*keys)):
            c = self.codes.get(k)
            if c is None:
                c = self.codes[k] = self.next
                self.next += 1
            out[i] = c
        return out

    def select(self, keys: Sequence[Sequence]) -> np.ndarray:
        """True for the first arrival of each unseen bit; its bit is seen afterwards."""
        code = self.encode(keys)
        won = np.zeros(len(code), bool)
        won[np.unique(code, return_index=True)[1]] = True
        won &= ~self.seen.test(code)
        self.seen.unite(code[won])
        return won


def _elect(table: pa.Table, keys: Sequence[str]) -> np.ndarray:
    """Map side: true for the latest arrival of each identifier in one batch. ``_ord`` and ``_id`` decide."""
    won = np.zeros(table.num_rows, bool)
    if not table.num_rows:
        return won
    unnamed = np.zeros(table.num_rows, bool)  # without an identifier: never redundant
    for k in keys:
        unnamed |= np.asarray(table[k].is_null())
    code, _ = dense_codes([table[k] for k in keys])
    by = pa.table({"c": code, "o": table["_ord"], "i": table["_id"]})
    order = pc.sort_indices(by, sort_keys=[("c", "ascending"), ("o", "descending"), ("i", "ascending")]).to_numpy()
    won[order[np.r_[True, code[order][1:] != code[order][:-1]]]] = True
    return won | unnamed


def _local(keys: Sequence[str], lost: bool):
    """Map side: losers of a batch are dropped, or marked and emptied of all that isn't reported."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = pa.Table.from_batches([b])
            if not t.num_rows:
                continue
            won = pa.array(_elect(t, keys))
            if not lost:
                t = t.filter(won)
                yield from emit(t.append_column("_lost", pa.array(np.zeros(t.num_rows, bool))))
                continue
            for k in (*keys, "_ord"):
                j = t.column_names.index(k)
                t = t.set_column(j, t.schema.field(j), pc.if_else(won, t[k], pa.scalar(None, t[k].type)))
            yield from emit(t.append_column("_lost", pc.invert(won)))

    return run


def _sharded(keys: Sequence[str], lost: bool, names: Sequence[str]):
    """One shard, latest arrivals first: emits all losers or all winners."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = Shard()
        for b in batches:
            t = pa.Table.from_batches([b])
            gone = t["_lost"].to_numpy(zero_copy_only=False).astype(bool)
            named = ~gone
            for k in keys:
                named &= np.asarray(t[k].is_valid())
            open_ = np.flatnonzero(named)
            won = ~gone
            if len(open_):
                part = t.take(pa.array(open_))
                won[open_] = shard.select([part[k].to_pylist() for k in keys])
            yield from emit(t.filter(pa.array(~won if lost else won)).select(list(names)))

    return run


def _prepared(df: DataFrame, keys: Sequence[str], order: str, row_id: str, carry: Sequence[str]) -> tuple[DataFrame, T.StructType, list[str]]:
    """Positional names inside, so that clashing or odd column names can't interfere."""
    names = [f"k{i}" for i in range(len(keys))]
    cols = [df[k].alias(n) for k, n in zip(keys, names)]
    cols += [df[order].alias("_ord"), df[row_id].alias("_id")]
    cols += [df[c].alias(f"c{i}") for i, c in enumerate(carry)]
    out = df.select(*cols)
    return out, T.StructType([*(T.StructField(f.name, f.dataType) for f in out.schema.fields), T.StructField("_lost", T.BooleanType())]), names


def _elected(df: DataFrame, keys: Sequence[str], order: str, row_id: str, carry: Sequence[str], lost: bool) -> DataFrame:
    src, schema, names = _prepared(df, keys, order, row_id, carry)
    unnamed = F.lit(False)
    for k in names:
        unnamed = unnamed | F.col(k).isNull()
    if lost:
        src = src.where(~unnamed)
    n = partitions(src, SHARD_BYTES)
    shard = F.when(unnamed, F.pmod(F.hash("_id"), F.lit(n))).otherwise(F.pmod(F.xxhash64(*names), F.lit(n))).cast("int")
    placed = src.mapInArrow(_local(names, lost), schema).repartitionById(n, shard)
    kept = [f for f in schema.fields if f.name.startswith("c")]
    return placed.sortWithinPartitions(F.desc_nulls_last("_ord"), "_id").mapInArrow(_sharded(names, lost, [f.name for f in kept]), T.StructType(kept))


def redundant(df: DataFrame, keys: Sequence[str] = KEYS, order: str = "scraped_at", row_id: str = "delivery_id", carry: Sequence[str] = ()) -> DataFrame:
    """The ids of all rows that are not kept, with the carried columns."""
    lost = _elected(df, keys, order, row_id, [row_id, *carry], True)
    return lost.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate((row_id, *carry))])


def keep_one(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = KEYS, order: str = "scraped_at", row_id: str = "delivery_id") -> DataFrame:
    """One row for each identifier and every row without one, reduced to ``columns``."""
    won = _elected(df, keys, order, row_id, columns, False)
    return won.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(columns)])


# -- batches that arrive over time ------------------------------------------------------------------


class Ledger:
    """Seen identifiers of all batches so far, kept in a folder.

    The dictionary is a table with a row for each identifier and its code, the bitmap one with a row for each chunk of a
    shard. A batch writes its new identifiers and the united bitmap to folders of their own and then creates the next
    pointer file, which names them. Creating it fails if another writer has done so first; the loser's folders
    are named by no pointer and can't touch the winner's. So a job that dies, or loses, leaves the ledger
    as it was and its batch may simply be sent again. Shards are doubled when they hold more than ``per_shard`` identifiers on average.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str] = KEYS, order: str = "scraped_at", row_id: str = "delivery_id", shards: int = 8, per_shard: int = 1_000_000):
        self.spark, self.path, self.keys, self.order, self.row_id, self.shards, self.per_shard = spark, path.rstrip("/"), tuple(keys), order, row_id, shards, per_shard

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def version(self) -> int:
        p, fs = self._fs(self.path)
        if not fs.exists(p):
            return 0
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return max([0, *(int(n[8:]) for n in names if n.startswith("CURRENT-"))])

    def pointer(self, version: int | None = None) -> dict:
        """What the pointer of a version names; an unfinished pointer is another writer at its last step."""
        v = self.version() if version is None else version
        if not v:
            return {"version": 0, "shards": self.shards, "identifiers": 0, "dictionary": [], "bits": None}
        p, fs = self._fs(f"{self.path}/CURRENT-{v}")
        with_bytes = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils
        stream = fs.open(p)
        body = with_bytes.toString(stream, "UTF-8")
        stream.close()
        if not body:
            raise RuntimeError(f"CURRENT-{v} is being written, or its writer died there; delete it if so")
        return json.loads(body)

    def _commit(self, pointer: dict) -> None:
        p, fs = self._fs(f"{self.path}/CURRENT-{pointer['version']}")
        out = fs.create(p, False)  # fails if another writer was first
        try:
            out.write(bytearray(json.dumps(pointer).encode()))
            out.close()
        except BaseException:
            fs.delete(p, False)
            raise

    def ingest(self, batch: DataFrame) -> DataFrame:
        """The ids of the rows of ``batch`` that are accepted; its identifiers count as seen afterwards.

        Rows without an identifier are accepted and leave no trace in the ledger.
        """
        was = self.pointer()
        src, schema, names = _prepared(batch, self.keys, self.order, self.row_id, [])
        known = src
        for n in names:
            known = known.where(F.col(n).isNotNull())
        n, split = was["shards"], 1
        while was["identifiers"] > self.per_shard * n * split:
            split *= 2
        total = n * split
        kinds = {f.name: f.dataType.simpleString() for f in src.schema.fields}
        columns = {"kind": "int", "shard": "int", "code": "bigint", "body": "binary", "_ord": kinds["_ord"], "_id": kinds["_id"], **{k: kinds[k] for k in names}}
        shaped = lambda df: df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in columns.items()])
        place = F.pmod(F.xxhash64(*names), F.lit(total)).cast("int")
        rows = shaped(known.mapInArrow(_local(names, False), schema).withColumns({"kind": F.lit(2), "shard": place}))
        if was["dictionary"]:
            words = self.spark.read.parquet(*[f"{self.path}/{d}" for d in was["dictionary"]])
            rows = rows.unionByName(shaped(words.withColumns({"kind": F.lit(0), "shard": place})))
            bits = self.spark.read.parquet(f"{self.path}/{was['bits']}").withColumn("shard", F.explode(F.array(*[F.col("shard") + n * k for k in range(split)])))
            rows = rows.unionByName(shaped(bits.withColumn("kind", F.lit(1))))
        rows = rows.repartitionById(total, F.col("shard")).sortWithinPartitions("kind", F.desc_nulls_last("_ord"), "_id")
        done = materialize(rows.mapInArrow(_united(names, list(columns)), ", ".join(f"{c} {t}" for c, t in columns.items())), "ledger")
        tag = uuid.uuid4().hex
        new = {"version": was["version"] + 1, "shards": total, "identifiers": was["identifiers"] + done.where("kind = 0").count(), "dictionary": [*was["dictionary"], f"words-{tag}"], "bits": f"bits-{tag}"}
        done.where("kind = 0").select("code", *names).write.parquet(f"{self.path}/words-{tag}")
        done.where("kind = 1").select("shard", "code", "body").write.parquet(f"{self.path}/bits-{tag}")
        self._commit(new)
        accepted = done.where("kind = 2").select(F.col("_id").alias(self.row_id))
        none = src.where(~F.expr(" AND ".join(f"{k} IS NOT NULL" for k in names))).select(F.col("_id").alias(self.row_id))
        return accepted.unionByName(none)

    def vacuum(self, older_than_s: float = 86_400) -> int:
        """Delete pointers but the last, and folders that it doesn't name and no running writer can still need."""
        now = self.pointer()
        keep = {*now["dictionary"], now["bits"], f"CURRENT-{now['version']}"}
        p, fs = self._fs(self.path)
        if not fs.exists(p):
            return 0
        limit = self.spark.sparkContext._jvm.System.currentTimeMillis() - older_than_s * 1000
        old = [s.getPath() for s in fs.listStatus(p) if s.getPath().getName() not in keep and s.getModificationTime() <= limit]
        for x in old:
            fs.delete(x, True)
        return len(old)


def _united(names: Sequence[str], columns: Sequence[str]):
    """A shard: its dictionary (kind 0) and bitmap (1) come first, then the batch's arrivals (2), latest first. Emits new
    words, the whole bitmap, and accepted arrivals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, number, schema = Shard(), None, None
        for b in batches:
            schema = pa.schema([(f.name, f.type) for f in b.schema])
            t = pa.Table.from_arrays(b.columns, schema=schema)
            kind = t["kind"].to_numpy()
            if t.num_rows and number is None:
                number = t["shard"][0].as_py()
            old = t.filter(pa.array(kind == 0))
            for c, *k in zip(old["code"].to_pylist(), *[old[n].to_pylist() for n in names]):
                shard.codes[tuple(k)] = c
                shard.next = max(shard.next, c + 1)
            chunks = t.filter(pa.array(kind == 1))
            for c, body in zip(chunks["code"].to_pylist(), chunks["body"].to_pylist()):
                shard.seen.load(c, body)
                shard.next = max(shard.next, c * Bitmap.BITS + shard.seen.end(c))  # codes may belong to the other half of a shard that was split
            new = t.filter(pa.array(kind == 2))
            if not new.num_rows:
                continue
            keys = [new[n].to_pylist() for n in names]
            before = shard.next
            won = shard.select(keys)
            yield from emit(new.filter(pa.array(won)))
            code = shard.encode(keys)
            fresh = np.zeros(len(code), bool)
            fresh[np.unique(code, return_index=True)[1]] = True
            fresh &= code >= before
            words = new.filter(pa.array(fresh)).set_column(0, "kind", pa.array(np.zeros(int(fresh.sum()), np.int32)))
            yield from emit(words.set_column(list(columns).index("code"), "code", pa.array(code[fresh])))
        body = shard.seen.dump()
        if body:
            out = {c: pa.nulls(len(body), schema.field(c).type) for c in columns}
            out |= {"kind": pa.array([1] * len(body), pa.int32()), "shard": pa.array([number] * len(body), pa.int32()), "code": pa.array([k for k, _ in body], pa.int64()), "body": pa.array([x for _, x in body], pa.binary())}
            yield from emit(pa.table(out, schema=schema))

    return run
