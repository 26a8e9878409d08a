"""Language of each text and of each stretch in one language, with a confidence.

Eight Bloom filters, one for the character n-grams of each language, are kept bit-sliced: a byte of the table
holds one bit of each filter, so the lookups of an n-gram return the mask of all languages that
contain it. A word's evidence for a language is the share of its n-grams found there, corrected for the filter's
rate of false positives. The most likely sequence of languages over the words of a text, with a
price for each change, gives the stretches.

The filters are fitted on all texts by distributed counts, bootstrapped from function words, not from the labels:
a sentence counts for a language if the function words in it clearly name one. An n-gram enters the filter of a language
if it is not much rarer there than where it is most frequent and makes up at least ``LEAST_RATE`` of the words, which
bounds the number of n-grams whatever the corpus; the table has ``ROOM`` slots for each. All texts are then assigned.

Defined results: a null text and one without words has no stretches. A word is a whitespace-separated piece of
two or more letters, save one trailing mark of punctuation.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import materialize
from .lookalikes import form

LANGS = ("de", "en", "es", "fr", "it", "pt", "ru", "uk")
#: Least bytes of the table, its bytes for each n-gram, and lookups for each n-gram. A byte has a bit for each language.
SLOTS, ROOM, LOOKUPS = 1 << 20, 8, 2
#: Share of a language's words that an n-gram must occur in to enter its filter, and the least count.
LEAST_RATE, LEAST_COUNT = 1e-6, 2
#: Share of its highest rate over the languages at which an n-gram still counts for another one.
MUCH_RARER = 0.12
#: Price of a change of language, in evidence of full words; the least words and evidence of a stretch that counts.
CHANGE, LEAST_WORDS, LEAST_MARGIN = 1.6, 3, 0.9
#: Weight of a word that is in no filter as a whole, most often a name.
UNKNOWN = 0.12

# Function words of each language.
_FUNCTION = {
    "de": "der die das den dem des ein eine einen einer einem eines und oder aber nicht ist sind war hat haben wird werden wurde mit von für auf aus bei nach seit über unter zwischen wir ihr sie er es ich du mich mein meine dein kein keine niemand deshalb weil dass wenn falls noch nur schon sich zum zur im am an in um bis vor gegen ohne durch dabei dazu auch wie was wer bitte kommt heute leider",
    "en": "the a an and or but not is are was were has have had will would of to in on at by for from with about after before since while because if that this these those there they he she it we you i my your our their who what when why which no nobody only still be been do does did as into near than then all every just can could should please under over between during",
    "es": "el la los las un una unos unas y o pero no es son era está están ha han hay será que de del al en con por para sin sobre entre hasta desde tras según cuando porque si así mientras nadie sabe también ya muy más se le lo su sus nos mi tu este esta estos estas ese esa todo todos todas solo todavía aún hacia durante después antes como donde quien",
    "fr": "le la les un une des et ou mais ne pas est sont était a ont sera que qui de du au aux en dans avec par pour sans sur sous entre vers chez depuis selon quand parce si donc alors personne sait aussi très plus se lui leur leurs son sa ses nos notre votre mon ma ce cette ces tout tous toutes encore peu après avant pendant comme où elle il nous vous je tu",
    "it": "il lo la i gli le un uno una e o ma non è sono era ha hanno sarà che di del della dei delle degli al alla ai in nel nella con per senza su sul sulla tra fra fino dal dalla da secondo quando perché se così mentre nessuno sa anche già molto più si suo sua nostri mio questo questa tutti tutto ancora solo verso durante dopo prima come dove chi",
    "pt": "o a os as um uma uns umas e ou mas não é são era está há tem têm será que de do da dos das ao à no na nos nas em com por para sem sobre entre até desde segundo quando porque se assim enquanto ninguém sabe também já muito mais lhe seu sua nossos meu este esta isso todo todos ainda só pelo pela durante depois antes como onde quem eles",
    "ru": "и в во не на я что он она они мы вы ты с со как а то все но его её их к у же за по из от о об про для при если когда чтобы потому поэтому только ещё уже после до между без через под над был была было были есть быть нет никто который это этот эта эти тот так там тут мне меня мой моя ваш наши свой очень сегодня пожалуйста несколько возле",
    "uk": "і й в у не на я що він вона вони ми ви ти з зі із як а то всі але його її їх до та ж за по від о про для при якщо коли щоб бо тому тільки лише ще вже після між без через під над був була було були є бути немає ніхто який це цей ця ці той так там тут мені мене мій моя ваш наші свій дуже сьогодні будь ласка кілька біля знає",
}
# Names of the languages as labels give them.
_LABELS = {
    "de": "de deu ger german deutsch", "en": "en eng english", "es": "es spa spanish español espanol castellano", "fr": "fr fra fre french français francais",
    "it": "it ita italian italiano", "pt": "pt por portuguese português portugues", "ru": "ru rus russian русский", "uk": "uk ukr ukrainian українська ua",
}
_NAMED = {w: k for k, v in _LABELS.items() for w in v.split()}
_SENTENCE = re.compile(r"[.!?\n]+")
_MARKS = frozenset(".,;:!?")
#: Letters of two alphabets side by side, other widths and invisible characters: evidence is taken from the repaired form.
_DISGUISED = re.compile("[A-Za-z][\u0400-\u052f]|[\u0400-\u052f][A-Za-z]|[\u0370-\u03ff\uff00-\uffef\u200b-\u200f\u2060\ufeff\u00ad]")


def label_languages(label: str | None) -> frozenset[str]:
    """The languages that a label names; empty if it names none."""
    out = set()
    for part in re.split(r"[,;/+&|\s]+", (label or "").strip().lower()):
        got = _NAMED.get(part) or _NAMED.get(re.split(r"[-_]", part)[0])
        if got:
            out.add(got)
    return frozenset(out)


def words(text: str | None) -> list[str]:
    out = []
    for p in (text or "").split():
        w = p[:-1] if p[-1] in _MARKS else p
        if len(w) > 1 and w.isalpha():
            out.append(w)
    return out


def _grams(word: str) -> list[str]:
    """Character n-grams of one to five letters with the word's borders, and the word itself last."""
    w = f"^{word}$"
    n = len(w)
    out = [w[i : i + k] for k in (2, 3, 4, 5) for i in range(n - k + 1) if k < n]
    out += word
    out.append(w + "#")
    return out


def _hashes(grams: Sequence[str]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(g) for g in grams], np.uint64)


def _slots(h: np.ndarray, size: int) -> np.ndarray:
    a, b = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    return np.stack([((a + np.uint64(k) * b) % np.uint64(size)).astype(np.int64) for k in range(LOOKUPS)])


class Filters:
    """The fitted filters: ``table`` is what is sent to the tasks."""

    def __init__(self, table: np.ndarray):
        self.table = table
        bits = np.unpackbits(table[:, None], axis=1, bitorder="little")
        self.false = bits.mean(axis=0) ** LOOKUPS
        self.memo: dict[str, int] = {}
        self.rows: list[np.ndarray] = []

    def _evidence(self, word: str) -> np.ndarray:
        g = _grams(word)
        mask = np.bitwise_and.reduce(self.table[_slots(_hashes(g), len(self.table))], axis=0)
        hit = np.unpackbits(mask[:, None], axis=1, bitorder="little").astype(np.float64)
        share = np.clip((hit.mean(axis=0) - self.false) / (1 - self.false), 0, 1)
        full = hit[-1]
        known = full.any()
        out = share + (full if known else 0)
        return ((out - out.mean()) * (1.0 if known else UNKNOWN)).astype(np.float32)

    def index(self, word: str) -> int:
        k = self.memo.get(word)
        if k is None:
            if len(self.rows) > 200_000:
                self.memo, self.rows = {}, []
            k = self.memo[word] = len(self.rows)
            self.rows.append(self._evidence(word))
        return k

    def stretches(self, texts: Sequence[str | None]) -> list[list[tuple[int, int, str, float]]]:
        """For each text the stretches in one language: first and last word (exclusive), language, confidence."""
        lists = [words(form(t) if t and _DISGUISED.search(t) else t) for t in texts]
        out: list[list[tuple[int, int, str, float]]] = [[] for _ in texts]
        if len(self.rows) > 150_000:
            self.memo, self.rows = {}, []
        own: list[list[int]] = [[self.index(w.lower()) for w in ws] for ws in lists]
        if not self.rows:
            return out
        matrix = np.array(self.rows)
        size = np.array([len(w) for w in own])
        order = np.argsort(-size, kind="stable")
        order = order[size[order] > 0]
        for a in range(0, len(order), 2048):
            rows = order[a : a + 2048]
            n = size[rows]
            longest, b, m = int(n[0]), len(rows), len(LANGS)
            at = np.zeros((b, longest), np.int64)
            for i, r in enumerate(rows.tolist()):
                at[i, : n[i]] = own[r]
            score = matrix[at[:, 0]].copy()
            back = np.zeros((longest, b, m), np.int8)
            live = b
            for t in range(1, longest):
                while live and n[live - 1] <= t:
                    live -= 1
                cur = score[:live]
                best = cur.argmax(axis=1)
                top = cur[np.arange(live), best] - CHANGE
                change = top[:, None] > cur
                back[t, :live] = np.where(change, best[:, None], np.arange(m))
                score[:live] = np.maximum(cur, top[:, None]) + matrix[at[:live, t]]
            state = score.argmax(axis=1)
            path = np.zeros((b, longest), np.int8)
            for t in range(longest - 1, -1, -1):
                on = n > t
                path[on, t] = state[on]
                state = np.where(on, back[t, np.arange(b), state], state)
            for i, r in enumerate(rows.tolist()):
                p = path[i, : n[i]]
                cut = [0, *(np.flatnonzero(p[1:] != p[:-1]) + 1).tolist(), int(n[i])]
                out[r] = self._kept([(x, y, int(p[x])) for x, y in zip(cut, cut[1:])], matrix[at[i, : n[i]]])
        return out

    def _kept(self, runs: list[tuple[int, int, int]], e: np.ndarray) -> list[tuple[int, int, str, float]]:
        """Runs with enough words and evidence; the others join the run before them, or the next."""
        if len(runs) > 1:
            total = e.sum(axis=0)
            main = int(total.argmax())
            good = []
            for x, y, k in runs:
                s = e[x:y].sum(axis=0)
                telling = int((e[x:y, k] - e[x:y, main] > 0.3).sum())
                if telling >= LEAST_WORDS and s[k] - s[main] >= LEAST_MARGIN or k == main:
                    good.append((x, y, k))
            runs = []
            for x, y, k in good:
                if runs and runs[-1][2] == k:
                    runs[-1] = (runs[-1][0], y, k)
                else:
                    runs.append((x, y, k))
            runs = [(0 if j == 0 else runs[j][0], len(e) if j == len(runs) - 1 else runs[j + 1][0], k) for j, (x, y, k) in enumerate(runs)]
        out = []
        for x, y, k in runs:
            s = e[x:y].sum(axis=0).astype(np.float64) * 2
            w = np.exp(s - s.max())
            out.append((x, y, LANGS[k], float(w[k] / w.sum())))
        return out


def _votes() -> dict[str, list[int]]:
    out: dict[str, list[int]] = {}
    for j, k in enumerate(LANGS):
        for w in set(_FUNCTION[k].split()):
            out.setdefault(w, []).append(j)
    return out


_WORD_ROW = "word string, small int, " + ", ".join(f"{k} long" for k in LANGS)
_GRAM_ROW = "h long, " + ", ".join(f"{k} long" for k in LANGS)
#: Distinct words or n-grams that a task counts before it passes them on.
_HELD = 200_000


def _counted_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of the sentences whose function words name a language, by language; ``small`` tells whether a word is ever written small."""
    owners, seen, small = _votes(), Counter(), set()

    def rows() -> pa.RecordBatch:
        names = sorted({w for w, _ in seen} | small)
        at = {w: k for k, w in enumerate(names)}
        n = np.zeros((len(LANGS), len(names)), np.int64)
        for (w, j), c in seen.items():
            n[j, at[w]] = c
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([int(w in small) for w in names], pa.int32()), *map(pa.array, n)], ["word", "small", *LANGS])

    for b in batches:
        for t in b.column("text").to_pylist():
            for part in _SENTENCE.split(t or ""):
                own = words(part)
                small.update(x for x in own if x[0].islower())
                if len(own) < 3:
                    continue
                low = [x.lower() for x in own]
                votes = [0] * len(LANGS)
                for x in low:
                    for j in owners.get(x, ()):
                        votes[j] += 1
                j = max(range(len(LANGS)), key=lambda k: (votes[k], LANGS[k]))
                second = max(v for k, v in enumerate(votes) if k != j)
                if votes[j] >= 2 and votes[j] >= 2 * second or votes[j] >= 4 and votes[j] >= second + 3:
                    seen.update((x, j) for x in low)
        if len(seen) + len(small) > _HELD:
            yield rows()
            seen, small = Counter(), set()
    if seen or small:
        yield rows()


def _counted_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the n-grams of counted words, by hash and language."""
    for b in batches:
        lists = [_grams(w) for w in b.column("word").to_pylist()]
        h = _hashes([g for x in lists for g in x]) if lists else np.zeros(0, np.uint64)
        at = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        keys, inverse = np.unique(h, return_inverse=True)
        n = np.zeros((len(LANGS), len(keys)), np.int64)
        for j, k in enumerate(LANGS):
            np.add.at(n[j], inverse, b.column(k).to_numpy(zero_copy_only=False)[at])
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), *map(pa.array, n)], ["h", *LANGS])


def fit(df: DataFrame, text: str) -> Filters:
    """Filters from all texts. What reaches the driver are the masks of the n-grams in the filters, united by slot."""
    spark = df.sparkSession
    sums = [F.sum(k).alias(k) for k in LANGS]
    seen = df.select(df[text].cast("string").alias("text")).where("text is not null").mapInArrow(_counted_words, _WORD_ROW)
    given = [(w, 1, *[3 if w in _FUNCTION[k].split() else 0 for k in LANGS]) for w in sorted({w for v in _FUNCTION.values() for w in v.split() if len(w) > 1})]
    # words only ever written large are names, save German nouns
    counted = seen.unionByName(spark.createDataFrame(given, _WORD_ROW)).groupBy("word").agg(F.max("small").alias("small"), *sums).where("small = 1")
    counted = materialize(counted.where(" + ".join(LANGS) + " > 0"), "words")
    total = counted.agg(*sums).first()
    grams = counted.mapInArrow(_counted_grams, _GRAM_ROW).groupBy("h").agg(*sums)
    rate = [F.col(k) / F.lit(float(max(1, total[k] or 0))) for k in LANGS]
    top = F.greatest(*rate)
    mask = F.lit(0)
    for j, (k, r) in enumerate(zip(LANGS, rate)):
        inside = (F.col(k) >= LEAST_COUNT) & (r >= LEAST_RATE) & (r >= MUCH_RARER * top)
        mask = mask + F.when(inside, 1 << j).otherwise(0)
    masks = materialize(grams.select("h", mask.cast("int").alias("mask")).where("mask > 0"), "grams")
    size = max(SLOTS, 1 << math.ceil(math.log2(max(1, ROOM * masks.count()))))

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = _slots(b.column("h").to_numpy().view(np.uint64), size)
            yield pa.RecordBatch.from_arrays([pa.array(at.ravel()), pa.array(np.tile(b.column("mask").to_numpy(), LOOKUPS))], ["slot", "mask"])

    got = masks.mapInArrow(slots, "slot long, mask int").groupBy("slot").agg(F.bit_or("mask").cast("short").alias("mask")).toArrow()
    table = np.zeros(size, np.uint8)
    table[got["slot"].to_numpy()] = got["mask"].to_numpy().astype(np.uint8)
    return Filters(table)


def assign(df: DataFrame, filters: Filters, row_id: str, text: str, label: str | None = None) -> DataFrame:
    """(id, n_words, labelled, stretches): ``labelled`` are the languages that the label names, ``stretches`` an
    array of (begin, end, lang, confidence) with begin and end counted in words."""
    sent = df.sparkSession.sparkContext.broadcast(filters.table)
    src = df.select(df[row_id].alias("id"), df[text].cast("string").alias("text"), (df[label].cast("string") if label else F.lit(None).cast("string")).alias("label"))
    kind = src.schema["id"].dataType.simpleString()
    piece = pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("lang", pa.string()), ("confidence", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Filters(sent.value)
        named: dict[str | None, list[str]] = {}
        for b in batches:
            texts = b.column("text").to_pylist()
            got = f.stretches(texts)
            labels = []
            for x in b.column("label").to_pylist():
                if x not in named:
                    if len(named) > 10_000:
                        named.clear()
                    named[x] = sorted(label_languages(x))
                labels.append(named[x])
            flat = [s for g in got for s in g]
            cols = list(zip(*flat)) or [()] * 4
            structs = pa.StructArray.from_arrays([pa.array(c, t.type) for c, t in zip(cols, piece)], fields=list(piece))
            offsets = np.r_[0, np.cumsum([len(g) for g in got])].astype(np.int32)
            n = pa.array([len(words(t)) for t in texts], pa.int32())
            yield pa.RecordBatch.from_arrays([b.column("id"), n, pa.array(labels, pa.list_(pa.string())), pa.ListArray.from_arrays(pa.array(offsets), structs)], ["id", "n_words", "labelled", "stretches"])

    return src.mapInArrow(run, f"id {kind}, n_words int, labelled array<string>, stretches array<struct<begin:int,end:int,lang:string,confidence:double>>").withColumnRenamed("id", row_id)


def disagreements(assigned: DataFrame, row_id: str, least: int = 6) -> DataFrame:
    """(id, lang): texts of at least ``least`` words whose label does not name exactly their languages."""
    langs = F.array_sort(F.array_distinct(F.transform("stretches", lambda s: s["lang"])))
    x = assigned.where(F.col("n_words") >= least).select(row_id, "labelled", langs.alias("langs"))
    return x.where(F.col("langs") != F.col("labelled")).select(row_id, F.explode("langs").alias("lang"))
