"""Near-duplicate texts with small edits, as classes closed under similarity.

Similarity is the Jaccard coefficient of the sets of distinct n-grams of adjacent tokens. All links between classes above
the threshold are found, without comparing every text with every other, by a prefix-tree join:

* Equal sets are collapsed to one representative first, with map-side combining.
* N-grams get one global order: those in no more than ``rare`` sets first, by hash, then the others by their exact
  frequency. ``rare`` follows from the number of all n-grams so that the frequent ones are ``ORDERED`` at most. Sets
  written in that order form a trie.
* Two sets of at least the threshold must meet in one of their first ``n - ceil(t n) + 1`` n-grams. So the
  subtrees below those n-grams are the units that are distributed. A subtree holds of each set its size and
  a parity sketch of 128 bits. Two sets differ in at least as many n-grams as their sketches do in
  bits, which bounds the overlap from above without the sets themselves; no true pair is lost. Only sets with a partner
  that passes go on, each pair in one subtree.
* A subtree of more than ``CELL`` sets, counted exactly, is cut into a triangle of cells, each the work of one task.
* Then the sets themselves come to their subtree, which is written as one compressed trie (:class:`PrefixTree`). All
  members descend it together: the partial overlap of a member with a common beginning is counted once for all sets
  below, and a member leaves where the remaining lengths can't reach the needed overlap, or where all sets below are in its class
  already. Found links join classes at once, so a subtree of n sets yields n - 1 links at most.

A subtree with more than ``DENSE`` passing pairs a member isn't written out as pairs: it goes on as a whole.

Defined results: a null text and a text below ``min_tokens`` belong to no class; ids are taken to be distinct.
A class is named by its smallest id. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrowkit import emit, ints
from ..functions.volume import partitions
from ..operators.components import components
from ..plans.scratch import materialize
from .grams import Sets, mix

#: N-grams with a place of their own in the global order, at most: 16 bytes each on the driver and in every worker.
ORDERED = 1 << 19
#: Sets of one cell of a subtree, at most.
CELL = 20_000
#: Above this size, a subtree with more than DENSE passing pairs a member goes on as a whole.
LARGE, DENSE = 2_048, 48
#: Estimated bytes of postings, and of sets, that one task gets.
TASK_BYTES = 48 << 20
#: Bytes of the matrix of members and n-grams in one step of a descent.
MATRIX = 32 << 20


def digests(df: DataFrame, row_id: str, text: str, width: int, min_tokens: int, carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, s1, s2, carried columns) for every row; digests are null below ``min_tokens``. Texts aren't passed on."""
    names = [f"c{i}" for i in range(len(carry))]
    src = df.select(df[row_id].cast("long").alias("id"), df[text].cast("string").alias("text"), *[df[c].alias(n) for c, n in zip(carry, names)])
    schema = ", ".join(["id long", "s1 long", "s2 long", *(f"{n} {src.schema[n].dataType.simpleString()}" for n in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = Sets(b.column("text").to_pylist(), width, min_tokens)
            a, c = s.digests()
            none = np.ones(b.num_rows, bool)
            none[s.at] = False
            s1, s2 = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
            s1[s.at], s2[s.at] = a, c
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(s1, mask=none), pa.array(s2, mask=none), *[b.column(n) for n in names]], ["id", "s1", "s2", *names])

    out = src.mapInArrow(run, schema)
    return out.select("id", "s1", "s2", *[F.col(n).alias(c) for n, c in zip(names, carry)])


def _frequent(reps: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams that are in more than ``rare`` sets, sorted, and in how many they are. Counts are exact."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def rows() -> Iterator[pa.RecordBatch]:
            g, n = np.unique(np.concatenate(held), return_counts=True)
            yield from emit(pa.table({"g": g.view(np.int64), "n": n.astype(np.int64)}))

        for b in batches:
            held.append(Sets(b.column("text").to_pylist(), width, 0).gram)
            size += len(held[-1])
            if size > 2_000_000:
                yield from rows()
                held, size = [], 0
        if size:
            yield from rows()

    counted = materialize(reps.select("text").mapInArrow(run, "g long, n long").groupBy("g").agg(F.sum("n").alias("n")).where("n > 1"), "frequencies")
    total = counted.agg(F.sum("n")).first()[0] or 0
    got = counted.where(F.col("n") > total // ORDERED).toArrow()
    g, n = got["g"].to_numpy().view(np.uint64), got["n"].to_numpy()
    at = np.argsort(g)
    return g[at], n[at]


def _order(s: Sets, freq: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Places of the n-grams in global order inside each set."""
    gram, n = freq
    f = np.zeros(len(s.gram), np.int64)
    if len(gram):
        at = np.minimum(np.searchsorted(gram, s.gram), len(gram) - 1)
        f = np.where(gram[at] == s.gram, n[at], 0)
    return np.lexsort((s.gram, f, s.doc))


def _sketches(s: Sets) -> tuple[np.ndarray, np.ndarray]:
    k = len(s.n)
    odd = np.zeros((k, 128), np.uint8)
    for at in range(0, k, 4000):
        a, z = s.start[at], s.start[min(k, at + 4000)]
        m = min(k, at + 4000) - at
        count = np.bincount((s.doc[a:z] - at) * 128 + (s.gram[a:z] & np.uint64(127)).astype(np.int64), minlength=m * 128)
        odd[at : at + m] = (count & 1).reshape(m, 128)
    bits = np.packbits(odd, axis=1).view(np.int64)
    return bits[:, 0].copy(), bits[:, 1].copy()


def _postings(reps: DataFrame, freq, width: int, t: Fraction) -> DataFrame:
    """(key, id, n, b1, b2) for each n-gram of each set's prefix."""
    num, den = t.numerator, t.denominator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = Sets(b.column("text").to_pylist(), width, 0)
            if not len(s.n):
                continue
            ids = ints(b.column("id"), 0)[s.at]
            b1, b2 = _sketches(s)
            order = _order(s, freq.value)
            place = np.arange(len(order)) - s.start[s.doc[order]]
            prefix = s.n - -(-num * s.n // den) + 1
            take = order[place < prefix[s.doc[order]]]
            d = s.doc[take]
            yield from emit(pa.table({"key": s.gram[take].view(np.int64), "id": ids[d], "n": s.n[d].astype(np.int32), "b1": b1[d], "b2": b2[d]}))

    return reps.select("id", "text").mapInArrow(run, "key long, id long, n int, b1 long, b2 long")


def _cells(post: DataFrame) -> DataFrame:
    """Postings of subtrees with more than ``CELL`` sets are cut: a set meets its own block and all others, each pair of blocks in one cell."""
    hot = post.groupBy("key").count().where(F.col("count") > CELL).select(F.col("key").alias("hot"), F.ceil(F.col("count") / CELL).cast("int").alias("m"))
    hot = materialize(hot, "hot")
    n = hot.count()
    if not n:
        return post
    hot = F.broadcast(hot) if n < 1_000_000 else hot
    own = F.pmod(F.xxhash64(F.lit(5), "id"), F.col("m")).cast("int")
    many = post.join(hot, post["key"] == hot["hot"]).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    many = many.withColumn("key", F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))).select(*post.columns)
    return post.join(hot, post["key"] == hot["hot"], "left_anti").unionByName(many)


def _groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Runs of whole groups out of batches that are sorted by a key; what is held is about a batch or a group, whichever is larger."""
    held: list[pa.Table] = []
    for b in batches:
        t = pa.Table.from_batches([b])
        if not t.num_rows:
            continue
        k = ints(t[key], 0)
        cut = int(np.flatnonzero(k != k[-1])[-1]) + 1 if k[0] != k[-1] else 0
        if cut or (held and ints(held[-1][key], 0)[-1] != k[0]):
            if not cut:
                yield pa.concat_tables(held)
                held = [t]
                continue
            yield pa.concat_tables([*held, t.slice(0, cut)])
            held = [t.slice(cut)]
        else:
            held.append(t)
    if held:
        yield pa.concat_tables(held)


def _passing(t: Fraction, n: np.ndarray, b: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether sizes and sketches allow the threshold; x and y broadcast against each other."""
    num, den = t.numerator, t.denominator
    nx, ny = n[x], n[y]
    differ = np.bitwise_count(b[0][x] ^ b[0][y]).astype(np.int64) + np.bitwise_count(b[1][x] ^ b[1][y])
    return (np.minimum(nx, ny) * den >= np.maximum(nx, ny) * num) & (differ * (den + num) <= (nx + ny) * (den - num))


def _candidates(t: Fraction):
    """(a, b, key): pairs of a subtree that pass. Of a dense subtree (a, a, key) for each member, which keeps it whole."""

    def pairs(tab: pa.Table) -> Iterator[pa.RecordBatch]:
        key = ints(tab["key"], 0)
        ids, n = ints(tab["id"], 0), ints(tab["n"], 0)
        b = [ints(tab[c], 0).view(np.uint64) for c in ("b1", "b2")]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.diff(np.r_[first, len(key)])
        found: list[tuple[np.ndarray, np.ndarray]] = []
        rows = np.flatnonzero(np.repeat((size <= 48) & (size > 1), size))
        for d in range(1, 48):  # neighbours at distance d in the sorted array share a subtree if they share the key
            x = rows[rows + d < len(key)]
            x = rows = x[key[x] == key[x + d]]
            if not len(x):
                break
            ok = _passing(t, n, b, x, x + d)
            found.append((x[ok], x[ok] + d))
        for a, g in zip(first[size > 48].tolist(), size[size > 48].tolist()):
            own, many = [], 0
            for i in range(a, a + g - 1, 512):
                x = np.arange(i, min(i + 512, a + g))[:, None]
                y = np.arange(i + 1, a + g)[None, :]
                i_, j_ = np.nonzero(_passing(t, n, b, x, y) & (y > x))
                own.append((x[i_, 0], y[0, j_]))
                many += len(i_)
                if g > LARGE and many > DENSE * g:
                    own = [(np.arange(a, a + g),) * 2]
                    break
            found += own
        x, y = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64),) * 2
        yield from emit(pa.table({"a": np.minimum(ids[x], ids[y]), "b": np.maximum(ids[x], ids[y]), "key": key[x]}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tab in _groups(batches, "key"):
            yield from pairs(tab)

    return run


class PrefixTree:
    """A compressed trie of sets that are written in one global order as increasing numbers.

    A node is (part, children, members that end here, depth below its part, least and largest size of a set at or below it).
    """

    def __init__(self, sets: list[np.ndarray]):
        self.sets = sets
        order = sorted(range(len(sets)), key=lambda k: sets[k].tolist())
        self.root = self._build(order, 0)

    def _build(self, order: list[int], depth: int) -> tuple:
        stack: list[tuple[list[int], int, list]] = []
        top: list = []
        stack.append((order, depth, top))
        while stack:
            rows, d, into = stack.pop()
            a, z = self.sets[rows[0]], self.sets[rows[-1]]
            m = min(len(a), len(z))
            differ = np.flatnonzero(a[d:m] != z[d:m])
            end = d + int(differ[0]) if len(differ) else m  # sorted rows: what first and last share, all share
            here = [k for k in rows if len(self.sets[k]) == end]
            kids: list = []
            sizes = [len(self.sets[k]) for k in rows]
            into.append((a[d:end], kids, here, end, min(sizes), max(sizes), rows))
            i = len(here)
            while i < len(rows):
                c, j = self.sets[rows[i]][end], i
                while j < len(rows) and self.sets[rows[j]][end] == c:
                    j += 1
                stack.append((rows[i:j], end, kids))
                i = j
        return top[0]

    def links(self, num: int, den: int) -> list[tuple[int, int, int]]:
        """(row, row, common n-grams) with common * den >= num * union, as many as join all classes."""
        parent = list(range(len(self.sets)))

        def find(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        size = np.array([len(x) for x in self.sets])
        flat = np.concatenate(self.sets)
        codes, count = np.unique(flat, return_counts=True)
        shared = codes[count > 1]  # what only one set has adds to no overlap
        out: list[tuple[int, int, int]] = []
        step = max(1, MATRIX // max(1, len(shared)))
        for a in range(0, len(self.sets), step):
            rows = range(a, min(a + step, len(self.sets)))
            has = np.zeros((len(rows), len(shared) + 1), bool)
            for k, r in enumerate(rows):
                at = np.minimum(np.searchsorted(shared, self.sets[r]), max(0, len(shared) - 1))
                if len(shared):
                    has[k, at[shared[at] == self.sets[r]]] = True
            stack = [(self.root, np.arange(len(rows)), np.zeros(len(rows), np.int64))]
            while stack:
                (part, kids, here, depth, least, most, below), probe, common = stack.pop()
                if len(part) and len(shared):
                    at = np.minimum(np.searchsorted(shared, part), len(shared) - 1)
                    common = common + has[np.ix_(probe, at[shared[at] == part])].sum(axis=1)
                n = size[probe + a]
                for r in here:
                    good = np.flatnonzero((common * (den + num) >= num * (n + depth)) & (probe + a != r))
                    for k in good.tolist():
                        x, y = find(int(probe[k]) + a), find(r)
                        if x != y:
                            parent[max(x, y)] = min(x, y)
                            out.append((int(probe[k]) + a, r, int(common[k])))
                if not kids:
                    continue
                past = np.array([np.searchsorted(self.sets[int(p) + a], part[-1], side="right") for p in probe]) if len(part) else np.zeros(len(probe), np.int64)
                best = common + np.minimum(most - depth, n - past)  # if all that remains on either side were common
                open_ = best * (den + num) >= num * (n + np.maximum(least, best))
                roots = {find(r) for r in below} if len(below) <= 64 else set()
                if len(roots) == 1:  # all below are in one class: its members have nothing to find here
                    only = roots.pop()
                    open_ &= np.array([find(int(p) + a) != only for p in probe])
                probe, common = probe[open_], common[open_]
                if len(probe):
                    stack += [(kid, probe, common) for kid in kids]
        return out


def _join(freq, width: int, t: Fraction):
    """One trie for each subtree, joined with itself: (a, b, common, na, nb)."""
    num, den = t.numerator, t.denominator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tab in _groups(batches, "key"):
            key, ids = ints(tab["key"], 0), ints(tab["id"], 0)
            s = Sets(tab["text"].to_pylist(), width, 0)
            order = _order(s, freq.value)
            gram, f = freq.value
            out: list[tuple[int, int, int, int, int]] = []
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            for a, z in zip(first.tolist(), [*first[1:].tolist(), len(key)]):
                if z - a < 2:
                    continue
                at = order[s.start[a] : s.start[z]]
                g = s.gram[at]
                n = np.zeros(len(g), np.int64)
                if len(gram):
                    k = np.minimum(np.searchsorted(gram, g), len(gram) - 1)
                    n = np.where(gram[k] == g, f[k], 0)
                # numbers of the subtree's n-grams in global order
                names, inverse = np.unique(g, return_inverse=True)
                freq_of = np.zeros(len(names), np.int64)
                freq_of[inverse] = n
                rank = np.empty(len(names), np.int64)
                rank[np.lexsort((names, freq_of))] = np.arange(len(names))
                codes = rank[inverse]
                cut = s.start[a + 1 : z] - s.start[a]
                sets = np.split(codes, cut)
                for x, y, c in PrefixTree(sets).links(num, den):
                    out.append((int(ids[a + x]), int(ids[a + y]), c, len(sets[x]), len(sets[y])))
            cols = list(zip(*out)) or [()] * 5
            yield from emit(pa.table({c: pa.array(v, pa.int64()) for c, v in zip(("a", "b", "common", "na", "nb"), cols)}))

    return run


class NearDuplicates:
    """The prefix-tree join over one table; ``links`` and ``classes`` are its results."""

    def __init__(self, sets: DataFrame, texts: DataFrame, row_id: str, text: str, width: int = 5, threshold: float = 0.8, min_tokens: int = 0):
        """``sets``: the rows of :func:`digests` that count, made with ``min_tokens``. ``texts`` has the text of each of their ids."""
        self.width, self.t = width, Fraction(threshold).limit_denominator(1000)
        self.sets = materialize(sets.where("s1 is not null").select("id", "s1", "s2"), "sets")
        self.classes_of_equals = materialize(self.sets.groupBy("s1", "s2").agg(F.min("id").alias("rid"), F.count("*").alias("copies")), "equal")
        t = texts.select(texts[row_id].cast("long").alias("id"), texts[text].cast("string").alias("text")).where(F.char_length("text") >= 2 * max(width, min_tokens) - 1)
        self.reps = materialize(t.join(self.classes_of_equals.select(F.col("rid").alias("id")), "id", "left_semi"), "representatives")
        self._links: DataFrame | None = None

    def links(self) -> DataFrame:
        """(a, b, common, na, nb): verified pairs of representatives that connect every class of more than one set."""
        if self._links is None:
            freq = self.reps.sparkSession.sparkContext.broadcast(_frequent(self.reps, self.width))
            post = materialize(_postings(self.reps, freq, self.width, self.t), "postings")
            cells = _cells(post)
            cells = cells.repartition(partitions(cells, TASK_BYTES), "key").sortWithinPartitions("key", "id")
            pairs = cells.mapInArrow(_candidates(self.t), "a long, b long, key long")
            # a pair that passes in several subtrees is the work of one of them
            once = pairs.groupBy("a", "b", F.when(F.col("a") == F.col("b"), F.col("key")).alias("whole")).agg(F.min("key").alias("key"))
            members = once.select("key", F.explode(F.array("a", "b")).alias("id")).distinct()
            sets = members.join(self.reps, "id").select("key", "id", "text")
            sets = sets.repartition(partitions(self.reps, TASK_BYTES), "key").sortWithinPartitions("key", "id")
            self._links = materialize(sets.mapInArrow(_join(freq, self.width, self.t), "a long, b long, common long, na long, nb long"), "links")
        return self._links

    def classes(self) -> DataFrame:
        """(id, group_id) for each member of a class of two or more."""
        named = components(self.links()).select(F.col("id").alias("rid"), "component")
        r = self.classes_of_equals.join(named, "rid", "left").where("component is not null or copies > 1")
        r = r.select("s1", "s2", F.coalesce("component", "rid").alias("group_id"))
        return self.sets.join(r, ["s1", "s2"]).select("id", "group_id")
