import random

from chanlake.operators import components as C


def brute(edges):
    par = {}

    def f(x):
        while par.setdefault(x, x) != x:
            x = par[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = sorted((f(a), f(b)))
            par[y] = x
    return {x: f(x) for x in par}


def run(spark, edges):
    return {r[0]: r[1] for r in C.components(spark.createDataFrame(edges, "a long, b long").repartition(3)).collect()}


def test_random_chain_star_and_nulls(spark, monkeypatch):
    r = random.Random(1)
    e = [(r.randrange(60), r.randrange(60)) for _ in range(40)] + [(100 + k, 101 + k) for k in range(30)] + [(200, 200 + k) for k in range(20)] + [(None, 1), (5, 5)]
    assert run(spark, e) == brute(e)
    monkeypatch.setattr(C, "SINGLE", 3)
    assert run(spark, e) == brute(e)


def test_empty(spark):
    assert run(spark, []) == {}
