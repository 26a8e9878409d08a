"""Evaluation texts that leak into training text.

Every task turns its documents into shards of at most ``SHARD`` tokens and builds an FM-index over each: the
suffix order by prefix doubling, the Burrows-Wheeler transform in a wavelet matrix, and every
``STRIDE``-th text position as a sample. All windows of ``words`` consecutive tokens of the test passages
are searched backwards at once; occurrences are located by walking to the next sampled suffix. Copies of one text in a shard are indexed once.

The test items are a stated query set. They are sent to all tasks in blocks of at most ``BLOCK`` windows; every shard's
index is built once and searched for each block in turn.

Defined results: a null or empty text contains nothing, and passages of fewer than ``words`` tokens can't be found.
Repeated rows of a document or an item change nothing.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrowkit import emit
from .grams import TOKEN, tokens

#: Tokens of one index; about 50 bytes each while it is built.
SHARD = 400_000
#: Distance of sampled text positions.
STRIDE = 16
#: Windows of test items in one broadcast, about 100 MB at most.
BLOCK = 1_000_000


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Order of the rotations of a sequence of small non-negative integers, by prefix doubling over what is still tied."""
    n = len(s)
    if n < 2:
        return np.arange(n)
    width = max(1, int(s.max())).bit_length() + 1
    step = min(4, max(1, 62 // width))
    key = np.zeros(n, np.int64)
    for k in range(step):
        key = (key << width) | np.roll(s, -k)
    sa = np.argsort(key, kind="stable")
    new = np.r_[True, key[sa][1:] != key[sa][:-1]]
    rank = np.empty(n, np.int64)
    while True:
        starts = np.flatnonzero(new)
        rank[sa] = np.repeat(starts, np.diff(np.r_[starts, n]))
        tied = ~new
        tied[:-1] |= ~new[1:]
        at = np.flatnonzero(tied)
        if not len(at) or step > 2 * n:
            return sa
        u = sa[at]
        second = rank[(u + step) % n]
        first = rank[u]
        order = np.lexsort((second, first))
        u, first, second = u[order], first[order], second[order]
        sa[at] = u
        change = np.r_[True, (first[1:] != first[:-1]) | (second[1:] != second[:-1])]
        new[at] = change
        step *= 2


class Wavelet:
    """Ranks of symbols in a sequence, by one bit plane for each bit of a symbol."""

    def __init__(self, s: np.ndarray, bits: int):
        self.bits, self.planes, self.zeros = bits, [], []
        for b in range(bits - 1, -1, -1):
            bit = (s >> b) & 1
            ones = np.zeros(len(s) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.planes.append(ones)
            self.zeros.append(len(s) - int(ones[-1]))
            s = np.concatenate([s[bit == 0], s[bit == 1]])

    def _down(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for k, ones in enumerate(self.planes):
            r = ones[i]
            i = np.where((c >> (self.bits - 1 - k)) & 1, self.zeros[k] + r, i - r)
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        return self._down(c, i) - self._down(c, np.zeros_like(i))

    def at(self, i: np.ndarray) -> np.ndarray:
        c = np.zeros(len(i), np.int64)
        for k, ones in enumerate(self.planes):
            r = ones[i]
            bit = ones[i + 1] - r
            c = (c << 1) | bit
            i = np.where(bit == 1, self.zeros[k] + r, i - r)
        return c


class FMIndex:
    """Index of token sequences; symbol 0 ends each of them."""

    def __init__(self, sequences: Sequence[Sequence[str]]):
        self.words: dict[str, int] = {}
        ids, flat = self.words, []
        self.starts = np.zeros(len(sequences) + 1, np.int64)
        for k, seq in enumerate(sequences):
            for w in seq:
                flat.append(ids.setdefault(w, len(ids) + 1))
            flat.append(0)
            self.starts[k + 1] = len(flat)
        s = np.array(flat, np.int64)
        self.n = len(s)
        sa = suffix_array(s)
        bwt = s[sa - 1]
        sigma = len(ids) + 1
        self.first = np.r_[0, np.cumsum(np.bincount(s, minlength=sigma))]
        self.wavelet = Wavelet(bwt, max(1, sigma.bit_length()))
        self.sampled = sa % STRIDE == 0
        self.place = np.cumsum(self.sampled) - 1
        self.samples = sa[self.sampled]

    def encode(self, phrases: Sequence[Sequence[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of the phrases whose tokens all occur, and which phrases these are."""
        get, rows, which = self.words.get, [], []
        for k, p in enumerate(phrases):
            r = [get(w, 0) for w in p]
            if 0 not in r:
                rows.append(r)
                which.append(k)
        return np.array(rows, np.int64), np.array(which, np.int64)

    def search(self, phrases: Sequence[Sequence[str]]) -> tuple[np.ndarray, np.ndarray]:
        """(phrase, text position) of every occurrence. Phrases are equally long."""
        sym, which = self.encode(phrases)
        lo, hi = np.zeros(len(which), np.int64), np.full(len(which), self.n, np.int64)
        for k in range(sym.shape[1] - 1 if len(which) else -1, -1, -1):
            c = sym[:, k]
            lo = self.first[c] + self.wavelet.rank(c, lo)
            hi = self.first[c] + self.wavelet.rank(c, hi)
            alive = lo < hi
            sym, which, lo, hi = sym[alive], which[alive], lo[alive], hi[alive]
            if not len(which):
                break
        count = hi - lo
        phrase = np.repeat(which, count)
        row = np.repeat(lo, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        return phrase, self.locate(row)

    def locate(self, row: np.ndarray) -> np.ndarray:
        out, steps, open_ = np.zeros(len(row), np.int64), 0, np.arange(len(row))
        row = row.copy()
        while len(open_):
            hit = self.sampled[row]
            out[open_[hit]] = self.samples[self.place[row[hit]]] + steps
            open_, row = open_[~hit], row[~hit]
            c = self.wavelet.at(row)
            row = self.first[c] + self.wavelet.rank(c, row)
            steps += 1
        return out % self.n


def _windows(items: DataFrame, item_id: str, fields: Sequence[str], words: int) -> Iterator[tuple[list[tuple[str, ...]], list[list[int]]]]:
    """Blocks of distinct windows with the items each stands for. The items pass through the driver row by row."""
    at: dict[tuple[str, ...], list[int]] = {}
    src = items.select(items[item_id].cast("long").alias("i"), *[items[f].cast("string").alias(f"f{k}") for k, f in enumerate(fields)])
    for row in src.toLocalIterator():
        for text in row[1:]:
            w = tokens(text)
            for k in range(len(w) - words + 1):
                who = at.setdefault(tuple(w[k : k + words]), [])
                if row[0] is not None and row[0] not in who:
                    who.append(row[0])
        if len(at) >= BLOCK:
            yield list(at), list(at.values())
            at = {}
    if at:
        yield list(at), list(at.values())


def _found(sent: list, words: int, spans: bool):
    """``sent``: blocks of windows. A shard's index is built once and searched for one block after the other, of which one is in memory."""

    def blocks() -> Iterator[tuple[list, list]]:
        for b in sent:
            yield b.value
            if len(sent) > 1:
                b.__dict__.pop("_value", None)  # read again from the worker's disk for the next shard

    def shard(ids: list, seqs: list[list[str]], texts: list[str]) -> Iterator[pa.RecordBatch]:
        unique: dict[tuple[str, ...], list[int]] = {}
        for k, s in enumerate(seqs):
            unique.setdefault(tuple(s), []).append(k)
        keys = list(unique)
        index = FMIndex(keys)
        hits, owned = [], []
        for phrases, owners in blocks():
            which, at = index.search(phrases)
            hits.append(at)
            owned += [owners[w] for w in which.tolist()]
        pos = np.concatenate(hits)
        doc = np.searchsorted(index.starts, pos, side="right") - 1
        if spans:
            order = np.lexsort((pos, doc))
            runs: dict[int, list[list[int]]] = {}
            for d, p in zip(doc[order].tolist(), (pos - index.starts[doc])[order].tolist()):
                r = runs.setdefault(d, [])
                if r and p <= r[-1][1]:
                    r[-1][1] = p + words
                else:
                    r.append([p, p + words])
            out = []
            for d, r in runs.items():
                for k in unique[keys[d]]:
                    low = texts[k].lower() if len(texts[k].lower()) == len(texts[k]) else texts[k]
                    place = [m.span() for m in TOKEN.finditer(low)]
                    h = xxhash.xxh3_64_intdigest(texts[k]) >> 1  # rows of one id may have different texts
                    out += [(ids[k], h, a, b, place[a][0], place[b - 1][1]) for a, b in r if b <= len(place)]
            cols = list(zip(*out)) or [()] * 6
            yield from emit(pa.table({c: pa.array(v, pa.int64()) for c, v in zip(("doc", "h", "first", "last", "begin", "end"), cols)}))
            return
        pairs = {(ids[k], i) for own, d in zip(owned, doc.tolist()) for i in own for k in unique[keys[d]]}
        cols = list(zip(*sorted(pairs))) or [()] * 2
        yield from emit(pa.table({c: pa.array(v, pa.int64()) for c, v in zip(("doc", "item"), cols)}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        seqs: list[list[str]] = []
        texts: list[str] = []
        size = 0
        for b in batches:
            for i, t in zip(b.column("doc").to_pylist(), b.column("text").to_pylist()):
                w = tokens(t)
                if len(w) < words or i is None:
                    continue
                ids.append(i)
                seqs.append(w)
                if spans:
                    texts.append(t)
                size += len(w) + 1
                if size >= SHARD:
                    yield from shard(ids, seqs, texts)
                    ids, seqs, texts, size = [], [], [], 0
        if ids:
            yield from shard(ids, seqs, texts)

    return run


def _search(docs: DataFrame, items: DataFrame, doc_id: str, text: str, item_id: str, fields: Sequence[str], words: int, spans: bool) -> DataFrame:
    src = docs.select(docs[doc_id].cast("long").alias("doc"), docs[text].cast("string").alias("text"))
    schema = "doc long, h long, first long, last long, begin long, end long" if spans else "doc long, item long"
    sent = [docs.sparkSession.sparkContext.broadcast(block) for block in _windows(items, item_id, fields, words)]
    return src.mapInArrow(_found(sent, words, spans), schema) if sent else docs.sparkSession.createDataFrame([], schema)


def leaked(docs: DataFrame, items: DataFrame, words: int = 12, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", fields: Sequence[str] = ("passage", "question")) -> DataFrame:
    """(doc_id, item_id): the document has at least ``words`` consecutive tokens of one of the item's fields."""
    return _search(docs, items, doc_id, text, item_id, fields, words, False).distinct().select(F.col("doc").alias(doc_id), F.col("item").alias(item_id))


def leak_spans(docs: DataFrame, items: DataFrame, words: int = 12, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", fields: Sequence[str] = ("passage", "question")) -> DataFrame:
    """(doc_id, begin, end): merged spans of characters to remove, at least ``words`` tokens each. Spans that different blocks of
    items found are merged too. Rows with one id and one text give their spans once."""
    found = _search(docs, items, doc_id, text, item_id, fields, words, True).distinct()
    up = Window.partitionBy("doc", "h").orderBy("first", "last", "begin", "end")
    before = F.max("last").over(up.rowsBetween(Window.unboundedPreceding, -1))
    runs = found.withColumn("new", F.when(before >= F.col("first"), 0).otherwise(1)).withColumn("run", F.sum("new").over(up))
    return runs.groupBy("doc", "h", "run").agg(F.min("begin").alias("begin"), F.max("end").alias("end")).select(F.col("doc").alias(doc_id), "begin", "end")
