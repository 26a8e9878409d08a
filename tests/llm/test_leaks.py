import random

import numpy as np

from chanlake.llm import leaks as L


def test_suffix_array_and_search():
    r = random.Random(1)
    for n in (1, 2, 30, 400):
        s = np.array([r.randrange(3) for _ in range(n)], np.int64)
        turn = lambda k: [*s[k:], *s[:k]]
        assert [turn(k) for k in L.suffix_array(s)] == sorted(map(turn, range(n)))
    seqs = [[r.choice("abc") for _ in range(r.randrange(5, 60))] for _ in range(20)]
    index = L.FMIndex(seqs)
    phrases = [tuple(r.choice("abcd") for _ in range(4)) for _ in range(40)]
    which, pos = index.search(phrases)
    doc = np.searchsorted(index.starts, pos, side="right") - 1
    got = sorted(zip(which.tolist(), doc.tolist(), (pos - index.starts[doc]).tolist()))
    assert got == sorted((k, d, i) for k, p in enumerate(phrases) for d, s in enumerate(seqs) for i in range(len(s) - 3) if tuple(s[i : i + 4]) == p)


def test_leaked(spark, monkeypatch):
    monkeypatch.setattr(L, "SHARD", 60)
    monkeypatch.setattr(L, "BLOCK", 5)
    p = " ".join(f"w{k}" for k in range(20))
    docs = [(1, "X " + p.upper().replace(" ", ",\n> "), "c"), (2, " ".join(p.split()[:11]), "c"), (3, None, "c"), (4, "", "c"), (5, " ".join(p.split()[3:15]) + " y" * 5000, "c"), (5, " ".join(p.split()[3:15]), "c"), (None, p, "c")]
    d = spark.createDataFrame(docs, "doc_id long, text string, item string")
    i = spark.createDataFrame([(7, p, None), (8, "short", p), (9, None, "")], "item_id long, passage string, question string")
    assert sorted(map(tuple, L.leaked(d, i).collect())) == [(1, 7), (1, 8), (5, 7), (5, 8)]
    monkeypatch.setattr(L, "BLOCK", 10**6)
    spans = sorted(map(tuple, L.leak_spans(d, i).collect()))
    assert spans[0][:2] == (1, 2) and docs[0][1][spans[0][1] : spans[0][2]].startswith("W0")
    assert [docs[4][1][b:e] for k, b, e in spans if k == 5] == [docs[5][1]] * 2
    monkeypatch.setattr(L, "BLOCK", 2)
    assert sorted(map(tuple, L.leak_spans(d, i).collect())) == spans  # blocks change nothing
    assert L.leaked(d.limit(0), i).count() == 0 and L.leaked(d, i.limit(0)).count() == 0
