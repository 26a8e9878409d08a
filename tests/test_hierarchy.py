import random

import pytest

from chanlake.operators import hierarchy as H

SCHEMA = "channel_id long, message_id long, reply_to_id long, s string, parent int"


def brute(data):
    par = {}
    for c, i, p, *_ in data:
        if i is not None:
            old = par.get((c, i))
            par[c, i] = p if old is None else old if p is None else max(old, p)
    out = {}
    for c, i in par:
        seen, cur = [i], i
        while True:
            n = par[c, cur]
            if n is None or (c, n) not in par:
                out[c, i] = (cur, len(seen) - 1, list(reversed(seen)))
                break
            if n in seen:
                out[c, i] = (min(seen[seen.index(n) :]), -1, None)
                break
            seen.append(n)
            cur = n
    return out, par


def data(n, seed):
    r = random.Random(seed)
    rows = [(r.choice([1, 1, 1, 2, None]), r.choice([k, k, k, None]), r.choice([None, r.randrange(n * 11 // 10), max(0, k - 1)]), "x", 1) for k in range(n)]
    rows += [(1, n + 5, n + 5, "x", 1), (1, n + 6, n + 7, "x", 1), (1, n + 7, n + 6, "x", 1), (2, 3, None, "x", 1)]
    return rows + rows[:20]


@pytest.mark.parametrize(("single", "block", "shrink"), [(10**6, 14, 0.6), (5, 3, 1.1), (5, 3, 0.0)])
def test_against_brute_force(spark, monkeypatch, single, block, shrink):
    monkeypatch.setattr(H, "SINGLE", single)
    monkeypatch.setattr(H, "BLOCK", block)
    monkeypatch.setattr(H, "SHRINK", shrink)
    rows = data(150, 3)
    exp, par = brute(rows)
    got = H.hierarchy(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {(r["channel_id"], r["message_id"]): (r["root_id"], r["depth"]) for r in got} == {k: v[:2] for k, v in exp.items()}
    assert {(r["channel_id"], r["message_id"]) for r in got if r["linked"]} == {(c, i) for (c, i), p in par.items() if p is not None and (c, p) in par}


def test_paths_and_descendants(spark, monkeypatch):
    monkeypatch.setattr(H, "BLOCK", 3)
    rows = data(80, 4)
    exp, _ = brute(rows)
    df = spark.createDataFrame(rows, SCHEMA)
    assert {(r[0], r[1]): r[2] for r in H.paths(df).collect()} == {k: v[2] for k, v in exp.items()}
    pairs = sorted((c or -1, a, i, len(p) - 1 - k) for (c, i), (_, _, p) in exp.items() if p for k, a in enumerate(p[:-1]))
    assert sorted((r[0] or -1, r[1], r[2], r[3]) for r in H.descendants(df).collect()) == pairs


def test_long_chain_and_empty(spark):
    n = 3000
    chain = spark.createDataFrame([(1, k, k - 1 if k else None) for k in range(n)], "channel_id long, message_id long, reply_to_id long")
    got = {r["message_id"]: r["depth"] for r in H.hierarchy(chain).collect()}
    assert got == {k: k for k in range(n)}
    assert H.hierarchy(spark.createDataFrame([], "channel_id long, message_id long, reply_to_id long")).count() == 0


@pytest.mark.parametrize("block", [14, 3])
def test_circles_keep_their_trees(spark, monkeypatch, block):
    monkeypatch.setattr(H, "BLOCK", block)
    # 10 -> 41 -> 23 -> 10 is a circle (child -> parent); 50 -> 23, 90 -> 50, 91 -> 50 hang below it; 70 names itself, 71 -> 70.
    links = {10: 41, 41: 23, 23: 10, 50: 23, 90: 50, 91: 50, 70: 70, 71: 70, 1: None, 2: 1}
    df = spark.createDataFrame([(1, k, p) for k, p in links.items()], "channel_id long, message_id long, reply_to_id long")
    got = {r["message_id"]: (r["path"], r["circle"]) for r in H.all_paths(df).collect()}
    assert got == {
        10: ([10], True), 23: ([10, 23], True), 41: ([10, 23, 41], True), 50: ([10, 23, 50], True), 90: ([10, 23, 50, 90], True), 91: ([10, 23, 50, 91], True),
        70: ([70], True), 71: ([70, 71], True), 1: ([1], False), 2: ([1, 2], False),
    }
    pairs = {(r["message_id"], r["descendant_id"]): (r["distance"], r["circle"]) for r in H.all_descendants(df).collect()}
    want = {}
    for k in links:
        at, n = links[k], 1
        while at is not None and at != k and (at, k) not in want:
            want[at, k] = (n, k > 2)
            at, n = links[at], n + 1
    assert pairs == want and (50, 90) in pairs and (41, 91) in pairs


def test_all_descendants_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(H, "BLOCK", 3)
    rows = data(150, 6)
    _, par = brute(rows)
    want = []
    for c, k in par:
        at, seen = par[c, k], [k]
        while at is not None and (c, at) in par and at not in seen:
            want.append((c or -1, at, k, len(seen)))
            seen.append(at)
            at = par[c, at]
    got = H.all_descendants(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r[0] or -1, r[1], r[2], r[3]) for r in got) == sorted(want)
