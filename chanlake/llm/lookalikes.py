"""Texts that look the same but differ in characters: one consistent form.

Full-width characters become plain, accents are composed, invisible characters go, every kind of space
becomes the plain one. What then remains are letters that alphabets share by shape. A text's *shape* writes
them all in Latin. The form is made from the shape and nothing else, so two texts have one form exactly
if they look the same:

* a token with letters of one alphabet only, besides shared shapes, is written in that alphabet;
* a token with letters of two alphabets is written in the one that has more letters of its own;
* a token of shared shapes only takes the alphabet of the nearest other token, unless the corpus vocabulary has the
  word in the other alphabet and not in this one.

The vocabulary is needed only for words of shared shapes, as no other word can be written in two alphabets; it is a Bloom filter over
all texts, sized by the number of such words. A false positive may choose the other alphabet, alike for all texts of that shape.

:func:`repair` is the narrower correction: only tokens that mix alphabets are rewritten in their dominant one, and
only if the corpus has the result. It leaves texts that look the same unequal where a whole word is written in look-alikes, so it
serves reading and the form serves comparing.

Case, accents, punctuation, line breaks and emoji (with their joiners and selectors) stay as they are. Null stays null and
equals nothing; an empty text is a text.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrowkit import emit
from ..plans.scratch import materialize

# Letters of one shape in two alphabets, position by position.
_CYRILLIC = ("АВЕЅІЈКМНОРСТХԚԜаеѕіјорсухһԁԛԝ", "ABESIJKMHOPCTXQWaesijopcyxhdqw")
_GREEK = ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοϲϳ", "ABEZHIKMNOPTYXocj")
#: Least bits of the vocabulary filter, its bits for each word, and the most that are sent to the tasks.
BITS, ROOM, MOST_BITS = 1 << 20, 16, 1 << 33
#: Bytes of one bitmap of Spark's bitmap aggregates, which unite the filters of all tasks with map-side combining.
_CHUNK = 4096

_INVISIBLE = (
    "­͏؜ᅟᅠ឴឵᠎​‌‎‏‪‫‬‭‮"
    "⁠⁡⁢⁣⁤⁦⁧⁨⁩⁪⁫⁬⁭⁮⁯﻿ﾠ"
)
_EMOJI = "‼⁉™ℹ↔-↪⌚-⏿▪-➿⤴⤵⬅-⭕〰〽㊗㊙\U0001f000-\U0001faff"
_JOINER = re.compile(f"(?<![{_EMOJI}️])‍|‍(?![{_EMOJI}])")
_SELECTOR = re.compile(f"(?<![{_EMOJI}0-9#*©®])[︀-️]")


def _plain_table() -> dict[int, str | None]:
    out: dict[int, str | None] = {ord(c): None for c in _INVISIBLE}
    for cp in range(0xFF00, 0xFFF0):
        d = unicodedata.decomposition(chr(cp)).split()
        if d and d[0] in ("<wide>", "<narrow>"):
            out.setdefault(cp, "".join(chr(int(x, 16)) for x in d[1:]))
    for cp in range(0x80, 0x3001):
        if unicodedata.category(chr(cp)) == "Zs":
            out[cp] = " "
    return out


def _shape_table() -> dict[int, str]:
    base = {**dict(zip(*_CYRILLIC)), **dict(zip(*_GREEK))}
    out = {ord(k): v for k, v in base.items()}
    for cp in [*range(0x370, 0x530), *range(0x1F00, 0x2000)]:
        d = unicodedata.normalize("NFD", chr(cp))
        if d[0] in base and len(d) > 1:
            out[cp] = unicodedata.normalize("NFC", base[d[0]] + d[1:])
    return out


_PLAIN, _SHAPE = _plain_table(), _shape_table()
_BACK = {"CYRILLIC": {ord(v): k for k, v in zip(*_CYRILLIC)}, "GREEK": {ord(v): k for k, v in zip(*_GREEK)}}
_SHARED = {"CYRILLIC": set(_CYRILLIC[1]), "GREEK": set(_GREEK[1])}
_OTHER = re.compile("[Ͱ-Ͽἀ-῿Ѐ-ԯ]")
_WORD = re.compile(r"[^\W\d_]+")
_LATIN = re.compile("[A-Za-z]")
_SAME = re.compile(f"(?<![^\\W\\d_])(?:[{_CYRILLIC[0]}]+|[{_CYRILLIC[1]}]+)(?![^\\W\\d_])")


def plain(text: str) -> str:
    """Width, encoding of accents, invisible characters and kinds of space brought to one form."""
    if text.isascii():
        return text
    t = text.translate(_PLAIN)
    if "‍" in t:
        t = _JOINER.sub("", t)
    if "️" in t or "︎" in t:
        t = _SELECTOR.sub("", t)
    return unicodedata.normalize("NFC", t)


def shape(text: str) -> str:
    """What the text looks like: equal exactly for texts that look the same."""
    t = plain(text)
    if not _OTHER.search(t):
        return t
    return unicodedata.normalize("NFC", t.translate(_SHAPE))


def _own(word: str) -> tuple[int, int, int]:
    """Letters that only Latin, Cyrillic and Greek have, in a word written in its shape."""
    latin = cyr = greek = 0
    for c in word:
        b = unicodedata.normalize("NFD", c)[0]
        o = ord(b)
        if 0x400 <= o < 0x530:
            cyr += 1
        elif 0x370 <= o < 0x400:
            greek += 1
        elif b not in _SHARED["CYRILLIC"]:
            latin += 1
    return latin, cyr, greek


def _write(word: str, script: str) -> str:
    if script == "LATIN":
        return word
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", word).translate(_BACK[script]))


def form(text: str, known=lambda w: True) -> str:
    """The form of a text. ``known`` tells whether the corpus has a word."""
    t = plain(text)
    if not _OTHER.search(t):
        return t
    s = unicodedata.normalize("NFC", t.translate(_SHAPE))
    names = ("LATIN", "CYRILLIC", "GREEK")
    words = [(m.start(), m.end(), _own(m[0])) for m in _WORD.finditer(s)]
    sure = [(a, b, names[max(range(3), key=lambda k: (o[k], -k))]) for a, b, o in words if any(o)]

    def one(m: re.Match) -> str:
        w = m[0]
        mine = _own(w)
        if any(mine):
            return _write(w, names[max(range(3), key=lambda k: (mine[k], -k))])
        near = min(sure, key=lambda x: (max(m.start() - x[1], x[0] - m.end()), x[0]), default=(0, 0, names[0]))[2]
        first = _write(w, near)
        if known(first):
            return first
        for other in names[:2]:
            if other != near and known(_write(w, other)):
                return _write(w, other)
        return first

    return _WORD.sub(one, s)


def repair(text: str, known=lambda w: True) -> str:
    """The text with look-alikes substituted in tokens that mix alphabets, where the corpus has the result."""
    if text.isascii() or not _OTHER.search(text):
        return text

    def one(m: re.Match) -> str:
        w = m[0]
        if not _OTHER.search(w) or not _LATIN.search(w):
            return w
        own = _own(unicodedata.normalize("NFC", w.translate(_SHAPE)))
        script = ("LATIN", "CYRILLIC", "GREEK")[max(range(3), key=lambda k: (own[k], -k))]
        new = _write(unicodedata.normalize("NFC", w.translate(_SHAPE)), script)
        return new if known(new) else w

    return _WORD.sub(one, text)


def _hashes(words: Sequence[str]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64)


def _bits(h: np.ndarray, bits: int) -> np.ndarray:
    return np.concatenate([h % np.uint64(bits), (h >> np.uint64(32)) * np.uint64(2654435761) % np.uint64(bits)]).astype(np.int64)


def vocabulary(texts: DataFrame, text: str, pattern: re.Pattern = _SAME, room: int = ROOM) -> np.ndarray:
    """Bloom filter over all words that match ``pattern``: by default those of shared shapes that are written in one alphabet."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: set[str] = set()
        for b in batches:
            for t in b.column("text").to_pylist():
                if t:
                    held.update(pattern.findall(plain(t)))
            if len(held) > 200_000:
                yield from emit(pa.table({"h": _hashes(sorted(held)).view(np.int64)}))
                held = set()
        if held:
            yield from emit(pa.table({"h": _hashes(sorted(held)).view(np.int64)}))

    words = materialize(texts.select(texts[text].cast("string").alias("text")).mapInArrow(found, "h long").distinct(), "vocabulary")
    bits = max(BITS, 1 << (max(1, room * words.count()) - 1).bit_length())
    if bits > MOST_BITS:
        raise ValueError(f"the vocabulary needs {bits} bits, more than {MOST_BITS}")

    def filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = np.zeros(bits, bool)
        for b in batches:
            if b.num_rows:
                field[_bits(b.column("h").to_numpy().view(np.uint64), bits)] = True
        packed = np.packbits(field).reshape(-1, _CHUNK)
        at = np.flatnonzero(packed.any(axis=1))
        yield from emit(pa.table({"part": pa.array(at, pa.int32()), "body": pa.array([packed[k].tobytes() for k in at], pa.binary())}))

    out = np.zeros((bits // 8 // _CHUNK, _CHUNK), np.uint8)
    for k, body in words.mapInArrow(filled, "part int, body binary").groupBy("part").agg(F.bitmap_or_agg("body").alias("body")).toLocalIterator():
        out[k] = np.frombuffer(body, np.uint8)
    return np.unpackbits(out.reshape(-1)).astype(bool)


def _known(field: np.ndarray):
    memo: dict[str, bool] = {}

    def known(word: str) -> bool:
        got = memo.get(word)
        if got is None:
            if len(memo) > 100_000:
                memo.clear()
            got = memo[word] = bool(field[_bits(_hashes([word]), len(field))].all())
        return got

    return known


def forms(df: DataFrame, columns: Sequence[str], text: str, filter_: np.ndarray, make=form) -> DataFrame:
    """``columns``, the text and its form (or what else ``make`` gives)."""
    sent = df.sparkSession.sparkContext.broadcast(np.packbits(filter_))
    names = [f"c{k}" for k in range(len(columns))]
    src = df.select(*[df[c].alias(n) for c, n in zip(columns, names)], df[text].cast("string").alias("text"))
    schema = ", ".join(f"{n} {src.schema[n].dataType.simpleString()}" for n in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _known(np.unpackbits(sent.value).astype(bool))
        for b in batches:
            out = [None if t is None else make(t, known) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], [*names, "text", "form"])

    return src.mapInArrow(run, f"{schema}, text string, form string").select(*[F.col(n).alias(c) for n, c in zip(names, columns)], "text", "form")


def _prints(df: DataFrame, key: str, field: str) -> DataFrame:
    """(field, key, h1, h2, v): fingerprints of form and text."""
    return df.where("form is not null").select(F.lit(field).alias("field"), F.col(key).alias("key"), F.xxhash64("form").alias("h1"), F.xxhash64(F.lit("2"), "form").alias("h2"), F.xxhash64("text").alias("v"))


def pairs(prints: DataFrame) -> DataFrame:
    """(field, key_a, key_b) for rows of one form and different text, key_a < key_b.

    Only forms that are written in more than one way take part, so copies of one string never meet. A form that many rows write in two
    ways still has a square number of pairs; :func:`classes` gives the same without them.
    """
    p = materialize(prints, "prints")
    mixed = p.groupBy("field", "h1", "h2").agg(F.min("v").alias("a"), F.max("v").alias("b")).where("a <> b").select("field", "h1", "h2")
    p = p.join(mixed, ["field", "h1", "h2"], "left_semi")
    a = p.select("field", "h1", "h2", F.col("key").alias("key_a"), F.col("v").alias("va"))
    b = p.select("field", "h1", "h2", F.col("key").alias("key_b"), F.col("v").alias("vb"))
    return a.join(b, ["field", "h1", "h2"]).where("key_a < key_b and va <> vb").select("field", "key_a", "key_b").distinct()


def classes(prints: DataFrame) -> DataFrame:
    """(field, key, class_id, ways, rows): rows of forms that are written in more than one way, one row each and no pairs.

    ``class_id`` is the smallest key of the class, ``ways`` the number of different texts, ``rows`` that of rows.
    """
    p = materialize(prints, "prints")
    ways = p.groupBy("field", "h1", "h2", "v").agg(F.min("key").alias("key"), F.count("*").alias("n"))
    c = ways.groupBy("field", "h1", "h2").agg(F.min("key").alias("class_id"), F.count("*").alias("ways"), F.sum("n").alias("rows")).where("ways > 1")
    return p.join(c, ["field", "h1", "h2"]).select("field", "key", "class_id", "ways", "rows")
