"""Groups of linked records: connected components over an edge list.

Links are contracted inside partitions first: a union-find over the partition's links leaves at most one
link for each record that occurs there. What remains is finished in one task if it has at most
``SINGLE`` links, which is checked, and by rounds of large-star and small-star joins beyond that.
The label of a component is the smallest id in it. Null ids are ignored, loops and repeated links have no
effect, and an id without links to others gets no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrowkit import emit, ints, whole
from ..plans.scratch import materialize

#: Links that one task may hold: 16 bytes each, twice.
SINGLE = 4_000_000
_EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def least_labels(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids and the smallest id of each one's component, by hooking and pointer jumping."""
    ids, code = np.unique(np.r_[a, b], return_inverse=True)
    x, y = code[: len(a)], code[len(a) :]
    label = np.arange(len(ids))
    while True:
        lx, ly = label[x], label[y]
        lo, hi = np.minimum(lx, ly), np.maximum(lx, ly)
        open_ = lo < hi
        if not open_.any():
            return ids, ids[label]
        np.minimum.at(label, hi[open_], lo[open_])
        while (label[label] != label).any():
            label = label[label]


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    t = whole(batches, _EDGES)
    if not t.num_rows:
        return
    ids, label = least_labels(ints(t["a"], 0), ints(t["b"], 0))
    keep = ids != label
    yield from emit(pa.table({"a": ids[keep], "b": label[keep]}))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) for each id that is linked to another one."""
    e = edges.select(edges[a].cast("long").alias("a"), edges[b].cast("long").alias("b")).where("a is not null and b is not null and a <> b")
    e = materialize(e.mapInArrow(_local, "a long, b long"), "links")
    n = e.count()
    while n > SINGLE:
        # large star: every larger neighbour of a node is linked to the node's least neighbour
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # small star: every smaller neighbour and the node itself are linked to the least of them
        low = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
        m = low.groupBy("a").agg(F.min("b").alias("m"))
        small = low.join(m, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(m.select("a", F.col("m").alias("b")))
        new = materialize(small.distinct().mapInArrow(_local, "a long, b long"), "links")
        k = new.count()
        if k == n and new.exceptAll(e).limit(1).count() == 0:
            break
        e, n = new, k
    if n <= SINGLE:
        e = e.coalesce(1).mapInArrow(_local, "a long, b long")
    out = e.select(F.col("a").alias("id"), F.col("b").alias("component"))
    roots = out.select(F.col("component").alias("id"), "component").distinct()
    return out.unionByName(roots)
