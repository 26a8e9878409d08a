import random

import pytest

from chanlake.llm import neardup as N
from chanlake.llm.grams import tokens


def brute(texts, width, t, least):
    sets, par = {}, {}

    def f(x):
        while par[x] != x:
            x = par[x]
        return x

    for i, x in texts:
        w = tokens(x)
        if len(w) >= max(least, width):
            sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)}
            par[i] = i
    s = sorted(sets)
    for a in s:
        for b in s:
            if a < b and len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b]) - 1e-12:
                x, y = sorted((f(a), f(b)))
                par[y] = x
    g = {i: f(i) for i in s}
    return {(i, c) for i, c in g.items() if sum(v == c for v in g.values()) > 1}


def corpus(n, seed):
    r = random.Random(seed)
    words = [f"w{k}" for k in range(40)]
    base = [[r.choice(words) for _ in range(r.randrange(5, 60))] for _ in range(n // 6)]
    out = []
    for k in range(n):
        w = list(r.choice(base))
        for _ in range(r.randrange(4)):
            w[r.randrange(len(w))] = r.choice(words)
        out.append((k, " ".join(w)))
    return out + [(n, None), (n + 1, ""), (n + 2, "ä " * 3000), (n + 3, "Ä, " * 3000)]


def run(spark, rows, width, t, least):
    df = spark.createDataFrame([(*x, "clash", 1) for x in rows], "delivery_id long, text string, id string, n int").repartition(4)
    s = N.digests(df, "delivery_id", "text", width, least)
    return {tuple(r) for r in N.NearDuplicates(s, df, "delivery_id", "text", width, t).classes().collect()}


@pytest.mark.parametrize(("width", "t", "least"), [(2, 0.7, 10), (5, 0.8, 0)])
def test_against_brute_force(spark, width, t, least):
    rows = corpus(150, 1)
    assert run(spark, rows, width, t, least) == brute(rows, width, t, least)


def test_hot_cells_and_dense_subtrees(spark, monkeypatch):
    monkeypatch.setattr(N, "CELL", 8)
    monkeypatch.setattr(N, "LARGE", 10)
    monkeypatch.setattr(N, "DENSE", 1)
    rows = corpus(120, 2) + [(1000 + k, " ".join(f"w{j}" for j in range(30)) + f" z{k}") for k in range(120)]
    assert run(spark, rows, 2, 0.7, 10) == brute(rows, 2, 0.7, 10)


def test_empty(spark):
    assert run(spark, [], 2, 0.7, 0) == set()


def test_few_ordered_ngrams_and_small_steps(spark, monkeypatch):
    monkeypatch.setattr(N, "ORDERED", 4)
    monkeypatch.setattr(N, "MATRIX", 64)
    rows = corpus(120, 3)
    assert run(spark, rows, 2, 0.7, 10) == brute(rows, 2, 0.7, 10)


def test_trie_against_brute_force():
    import numpy as np

    r = random.Random(4)
    for n in (2, 3, 7, 30):
        base = [sorted(r.sample(range(60), r.randrange(3, 25))) for _ in range(3)]
        sets = []
        for _ in range(n):
            s = set(r.choice(base))
            for _ in range(r.randrange(3)):
                s ^= {r.randrange(60)}
            sets.append(np.array(sorted(s or {1})))
        for num, den in ((7, 10), (9, 10), (1, 1)):
            par = list(range(n))
            for x, y, c in N.PrefixTree(sets).links(num, den):
                assert c == len({*sets[x].tolist()} & {*sets[y].tolist()})
                par = [par[x] if p == par[y] else p for p in par]
            good = [[len({*a.tolist()} & {*b.tolist()}) * den >= num * len({*a.tolist()} | {*b.tolist()}) for b in sets] for a in sets]
            full = list(range(n))
            for x in range(n):
                for y in range(n):
                    if good[x][y]:
                        full = [full[x] if p == full[y] else p for p in full]
            assert [par.index(p) for p in par] == [full.index(p) for p in full]
