"""Parent-child rows to full hierarchies.

Rows (scope, id, parent) form trees inside each scope. The work is done by contraction:

1. Rows are partitioned by blocks of neighbouring ids. Inside a partition every chain of parents is
   followed by pointer jumping to the last ancestor in the partition, the top of its *fragment*. A top
   whose parent lies elsewhere is a fragment's *exit*. Circles inside a partition are found here.
2. The exits that are referred to form a smaller weighted forest, the *quotient*. It is solved by the
   same procedure, with larger blocks, until it fits one task; a quotient that hardly shrinks is solved
   by pointer doubling over joins instead. Circles that cross partitions are found here.
3. Each row's result is its fragment's result continued by that of its exit.

Only the quotient is ever joined with, and no task holds more than its partition or ``SINGLE`` rows.

Defined results: a row with a null id is ignored, a null scope is a scope like any other; of several
rows for one id the largest parent that is not null counts. ``root_id`` is the last ancestor found and
``depth`` the number of links to it (0 for a row without a parent in the table). If the links never end, ``depth`` is -1
and ``root_id`` the smallest id of the circle that is reached. A row that names itself is a circle of one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrowkit import emit, ints, whole
from ..functions.volume import partitions
from ..plans.scratch import materialize

#: Rows of a quotient that one task may solve; a larger one is contracted further. About 150 MB.
SINGLE = 2_000_000
#: Ids of one block and of the widest one on later levels: 2 to this power. Estimated bytes of the rows one task contracts.
BLOCK, WIDEST, TASK_BYTES = 14, 20, 64 << 20
#: A quotient larger than this share of its forest is solved by doubling.
SHRINK = 0.6

_FOREST = "s long, id long, parent long, w long, low long, root long, depth long"
_FRAGMENT = "s long, id long, exit long, w long, low long, root long, depth long, up long"


def _positions(s: np.ndarray, i: np.ndarray, p: np.ndarray, has: np.ndarray) -> np.ndarray:
    """Row of each row's parent, or -1. Rows have distinct (s, i)."""
    n = len(s)
    _, sc = np.unique(s, return_inverse=True)
    _, c = np.unique(np.r_[i, np.where(has, p, i)], return_inverse=True)
    m = np.int64(c.max()) + 1 if n else 1
    own, want = sc * m + c[:n], sc * m + c[n:]
    order = np.argsort(own, kind="stable")
    at = np.searchsorted(own[order], want)
    at = np.minimum(at, max(n - 1, 0))
    hit = has & (own[order][at] == want) if n else has
    return np.where(hit, order[at], -1) if n else np.zeros(0, np.int64)


def _contract(s, i, p, has, w, low, root, depth):
    """Fragments of one partition: for each row its top, links to the top, least id below the top, circle root."""
    n = len(s)
    up = _positions(s, i, p, has)
    jump = np.where(up >= 0, up, np.arange(n))
    dist = np.where(up >= 0, w, 0)
    least = low.copy()
    for _ in range(max(1, n).bit_length() + 1):
        if not (up[jump] >= 0).any():
            break
        dist = dist + dist[jump]
        least = np.minimum(least, least[jump])
        jump = jump[jump]
    circle = up[jump] >= 0 if n else np.zeros(0, bool)
    if circle.any():  # jump now rests on the circle itself
        ring, step = low.copy(), np.where(up >= 0, up, np.arange(n))
        for _ in range(n.bit_length() + 1):
            ring = np.minimum(ring, ring[step])
            step = step[step]
        root = np.where(circle, ring[jump], root[jump])
        depth = np.where(circle, -1, depth[jump])
    else:
        root, depth = root[jump], depth[jump]
    least = np.minimum(least, low[jump])
    return up, jump, np.where(circle, 0, dist), least, root, depth, circle


def _arrays(t: pa.Table):
    s, i = ints(t["s"], -(2**63)), ints(t["id"], 0)
    has = ~np.asarray(t["parent"].is_null())
    return s, i, ints(t["parent"], 0), has, ints(t["w"], 1), ints(t["low"], 0), ints(t["root"], 0), ints(t["depth"], 0)


_IN = pa.schema([(c, pa.int64()) for c in ("s", "id", "parent", "w", "low", "root", "depth")])


def _fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """exit: parent of the fragment's top if that is elsewhere; w: links to the exit; up: the parent if it is in the partition."""
    t = whole(batches, _IN)
    if not t.num_rows:
        return
    s, i, p, has, w, low, root, depth = _arrays(t)
    up, jump, dist, least, r, d, circle = _contract(s, i, p, has, w, low, root, depth)
    leaves = has[jump] & (up[jump] < 0) & ~circle
    total = np.where(circle, -1, np.where(d < 0, -1, dist + d))
    out = {
        "s": t["s"],
        "id": t["id"],
        "exit": pa.array(p[jump], mask=~leaves),
        "w": pa.array(dist + np.where(leaves, w[jump], 0)),
        "low": pa.array(least),
        "root": pa.array(r),
        "depth": pa.array(total),
        "up": pa.array(np.where(up >= 0, p, 0), mask=up < 0),
    }
    yield from emit(pa.table(out))


def _same_scope(a: str, b: str):
    return F.col(a).eqNullSafe(F.col(b))


def _solved_in_one(df: DataFrame) -> DataFrame:
    return df.coalesce(1).mapInArrow(_fragments, _FRAGMENT).select("s", "id", "root", "depth", "low")


def _solve(df: DataFrame, rows: int, level: int) -> DataFrame:
    """(s, id, root, depth, low) for a weighted forest whose terminal rows carry their own root and depth."""
    if rows <= SINGLE:
        return _solved_in_one(df)
    frag = materialize(_blocked(df, level).mapInArrow(_fragments, _FRAGMENT), "fragments")
    quotient, n = _quotient(frag)
    solved = _double(quotient, n) if n > SHRINK * rows else _solve(quotient, n, level + 1)
    return _expand(frag, solved)


def _blocked(df: DataFrame, level: int) -> DataFrame:
    """Blocks of neighbouring ids in as many partitions as the rows need; blocks widen by level up to a bound."""
    return df.repartition(partitions(df, TASK_BYTES), "s", F.shiftright("id", min(BLOCK + 3 * level, WIDEST)))


def _quotient(frag: DataFrame) -> tuple[DataFrame, int]:
    """The exits that exist, as rows of a forest. An exit is named once, however many rows lead to it."""
    named = frag.where("exit is not null").select(F.col("s").alias("qs"), F.col("exit").alias("qid")).distinct()
    q = named.join(frag, _same_scope("qs", "s") & (F.col("qid") == F.col("id"))).select("s", "id", F.col("exit").alias("parent"), "w", "low", "root", "depth")
    q = materialize(q, "quotient")
    return q, q.count()


def _expand(frag: DataFrame, solved: DataFrame) -> DataFrame:
    e = solved.select(F.col("s").alias("es"), F.col("id").alias("eid"), F.col("root").alias("eroot"), F.col("depth").alias("edepth"), F.col("low").alias("elow"))
    j = frag.join(e, _same_scope("s", "es") & (F.col("exit") == F.col("eid")), "left")
    found = F.col("eid").isNotNull()
    depth = F.when(~found, F.col("depth")).when(F.col("edepth") < 0, F.lit(-1)).otherwise(F.col("w") + F.col("edepth"))
    return j.select("s", "id", F.when(found, F.col("eroot")).otherwise(F.col("root")).alias("root"), depth.cast("long").alias("depth"), F.least("low", F.coalesce("elow", "low")).alias("low"), (found | F.col("up").isNotNull()).alias("linked"))


def _double(q: DataFrame, n: int) -> DataFrame:
    """Pointer doubling: after k rounds every row knows its ancestor 2**k links up."""
    cur = q.join(q.select(F.col("s").alias("ps"), F.col("id").alias("pid")), _same_scope("s", "ps") & (F.col("parent") == F.col("pid")), "left")
    cur = cur.select("s", "id", F.when(F.col("pid").isNotNull(), F.col("parent")).alias("parent"), F.when(F.col("pid").isNotNull(), F.col("w")).otherwise(F.lit(0)).alias("w"), "low", "root", "depth")
    cur = materialize(cur, "doubling")
    base = q.select(F.col("s").alias("bs"), F.col("id").alias("bid"), F.col("root").alias("broot"), F.col("depth").alias("bdepth"))
    for _ in range(n.bit_length() + 1):
        if cur.where("parent is not null").limit(1).count() == 0:
            break
        up = cur.select(F.col("s").alias("us"), F.col("id").alias("uid"), F.col("parent").alias("up"), F.col("w").alias("uw"), F.col("low").alias("ulow"), F.col("root").alias("uroot"), F.col("depth").alias("udepth"))
        j = cur.join(up, _same_scope("s", "us") & (F.col("parent") == F.col("uid")), "left")
        on = F.col("uid").isNotNull()
        done = on & F.col("up").isNull()
        cur = materialize(
            j.select(
                "s",
                "id",
                F.when(done, None).otherwise(F.coalesce("up", "parent")).cast("long").alias("parent"),
                (F.col("w") + F.when(on, F.col("uw")).otherwise(F.lit(0))).alias("w"),
                F.when(on, F.least("low", "ulow")).otherwise(F.col("low")).alias("low"),
                F.when(done, F.col("uroot")).otherwise(F.col("root")).alias("root"),
                F.when(done, F.when(F.col("udepth") < 0, F.lit(-1)).otherwise(F.col("udepth") + F.col("w"))).otherwise(F.col("depth")).cast("long").alias("depth"),
            ),
            "doubling",
        )
    del base
    # Rows that still point somewhere never end; the row they point at lies on the circle, and low covers all of it there.
    ring = cur.select(F.col("s").alias("rs"), F.col("id").alias("rid"), F.col("low").alias("rlow"))
    j = cur.join(ring, _same_scope("s", "rs") & (F.col("parent") == F.col("rid")), "left")
    open_ = F.col("parent").isNotNull()
    return j.select("s", "id", F.when(open_, F.col("rlow")).otherwise(F.col("root")).alias("root"), F.when(open_, F.lit(-1)).otherwise(F.col("depth")).cast("long").alias("depth"), "low")


def _forest(df: DataFrame, scope: str, row_id: str, parent: str) -> DataFrame:
    src = df.select(df[scope].cast("long").alias("s"), df[row_id].cast("long").alias("id"), df[parent].cast("long").alias("p")).where("id is not null")
    one = src.groupBy("s", "id").agg(F.max("p").alias("parent"))
    return one.select("s", "id", "parent", F.lit(1).cast("long").alias("w"), F.col("id").alias("low"), F.col("id").alias("root"), F.lit(0).cast("long").alias("depth"))


def _fragmented(df: DataFrame, scope: str, row_id: str, parent: str) -> DataFrame:
    return materialize(_blocked(_forest(df, scope, row_id, parent), 0).mapInArrow(_fragments, _FRAGMENT), "fragments")


def hierarchy(df: DataFrame, scope: str = "channel_id", row_id: str = "message_id", parent: str = "reply_to_id") -> DataFrame:
    """(scope, id, root_id, depth, linked) for each id; ``linked`` tells whether its parent is in the table."""
    frag = _fragmented(df, scope, row_id, parent)
    quotient, n = _quotient(frag)
    total = n if n <= SINGLE else frag.count()
    solved = _double(quotient, n) if n > SINGLE and n > SHRINK * total else _solve(quotient, n, 1)
    return _expand(frag, solved).select(F.col("s").alias(scope), F.col("id").alias(row_id), F.col("root").alias("root_id"), "depth", "linked")


# -- full paths and descendants ---------------------------------------------------------------------


def _walks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each row of an opened forest the ids from the fragment's top down to the row; ring: the root of rows whose links never ended."""
    t = whole(batches, _IN)
    if not t.num_rows:
        return
    s, i, p, has, w, low, root, depth = _arrays(t)
    up, jump, dist, *_ = _contract(s, i, p, has, w, low, root, depth)
    leaves = has[jump] & (up[jump] < 0)
    walk: dict[int, list[int]] = {}
    for k in np.argsort(dist, kind="stable").tolist():
        walk[k] = [*walk[int(up[k])], int(i[k])] if up[k] >= 0 else [int(i[k])]
    yield from emit(pa.table({"s": t["s"], "id": t["id"], "exit": pa.array(p[jump], mask=~leaves), "walk": pa.array([walk[k] for k in range(len(i))], pa.list_(pa.int64())), "ring": pa.array(root, mask=depth >= 0)}), 5000)


def _opened(df: DataFrame, scope: str, row_id: str, parent: str) -> tuple[DataFrame, DataFrame]:
    """(s, id, walk, ring) of the forest without the link of each circle's smallest id, and the links taken out as (cs, root, last).

    Fragments' walks are put together by doubling: as many joins as the number of fragments on the longest path has binary digits.
    """
    ends = hierarchy(df, scope, row_id, parent).select(F.col(scope).alias("hs"), F.col(row_id).alias("hid"), "root_id", (F.col("depth") < 0).alias("never"))
    j = _forest(df, scope, row_id, parent).join(ends, _same_scope("s", "hs") & (F.col("id") == F.col("hid")))
    ring = F.col("never") & (F.col("id") == F.col("root_id"))
    j = materialize(j.select("s", "id", "parent", "w", "low", F.col("root_id").alias("root"), F.when(F.col("never"), -1).otherwise(0).cast("long").alias("depth"), ring.alias("first")), "ends")
    links = j.where("first").select(F.col("s").alias("cs"), F.col("id").alias("root"), F.col("parent").alias("last"))
    forest = j.select("s", "id", F.when(~F.col("first"), F.col("parent")).alias("parent"), "w", "low", "root", "depth")
    cur = materialize(_blocked(forest, 0).mapInArrow(_walks, "s long, id long, exit long, walk array<long>, ring long"), "walks")
    while cur.where("exit is not null").limit(1).count():
        up = cur.select(F.col("s").alias("us"), F.col("id").alias("uid"), F.col("exit").alias("uexit"), F.col("walk").alias("uwalk"))
        j = cur.join(up, _same_scope("s", "us") & (F.col("exit") == F.col("uid")), "left")
        cur = materialize(j.select("s", "id", F.col("uexit").alias("exit"), F.when(F.col("uid").isNull(), F.col("walk")).otherwise(F.concat("uwalk", "walk")).alias("walk"), "ring"), "paths")
    return cur.select("s", "id", "walk", "ring"), links


def all_paths(df: DataFrame, scope: str = "channel_id", row_id: str = "message_id", parent: str = "reply_to_id") -> DataFrame:
    """(scope, id, path, circle): the ids from the root down to the row itself; where the links never end (``circle``), from the smallest id of the circle."""
    cur, _ = _opened(df, scope, row_id, parent)
    return cur.select(F.col("s").alias(scope), F.col("id").alias(row_id), F.col("walk").alias("path"), F.col("ring").isNotNull().alias("circle"))


def paths(df: DataFrame, scope: str = "channel_id", row_id: str = "message_id", parent: str = "reply_to_id") -> DataFrame:
    """(scope, id, path): as ``all_paths``, but null if the links never end."""
    return all_paths(df, scope, row_id, parent).select(scope, row_id, F.when(~F.col("circle"), F.col("path")).alias("path"))


def _pairs(p: DataFrame, scope: str, row_id: str, *more: str) -> DataFrame:
    p = p.where(F.size("path") > 1)
    e = p.select(scope, F.col(row_id).alias("descendant_id"), *more, F.size("path").alias("n"), F.posexplode("path").alias("at", "anc"))
    return e.where(F.col("at") < F.col("n") - 1).select(scope, F.col("anc").alias(row_id), "descendant_id", (F.col("n") - 1 - F.col("at")).cast("long").alias("distance"), *more)


def all_descendants(df: DataFrame, scope: str = "channel_id", row_id: str = "message_id", parent: str = "reply_to_id") -> DataFrame:
    """(scope, id, descendant_id, distance, circle): one row for each node and each other node below it, by the fewest links.

    On a circle every node is below every other; ``circle`` marks pairs whose links upward never end.
    """
    cur, links = _opened(df, scope, row_id, parent)
    # The circle from its smallest id down is the path of the parent of that id.
    last = cur.where("ring is not null").select(F.col("s").alias("ls"), F.col("id").alias("lid"), F.col("walk").alias("around"))
    rings = links.join(last, _same_scope("cs", "ls") & (F.col("last") == F.col("lid"))).select("cs", "root", "around")
    below = cur.where("ring is not null").join(rings, _same_scope("s", "cs") & (F.col("ring") == F.col("root")))
    on = F.size(F.array_intersect("walk", "around"))  # ids of the circle that the path has; the others lie above its first
    below = below.select("s", "id", F.concat(F.slice("around", on + 1, F.size("around")), F.col("walk")).alias("path"), F.lit(True).alias("circle"))
    ended = cur.where("ring is null").select("s", "id", F.col("walk").alias("path"), F.lit(False).alias("circle"))
    return _pairs(ended.unionByName(below).withColumnsRenamed({"s": scope, "id": row_id}), scope, row_id, "circle")


def descendants(df: DataFrame, scope: str = "channel_id", row_id: str = "message_id", parent: str = "reply_to_id") -> DataFrame:
    """(scope, id, descendant_id, distance): as ``all_descendants`` without the pairs whose links never end."""
    return _pairs(paths(df, scope, row_id, parent), scope, row_id)
