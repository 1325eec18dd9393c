"""Contraction and levels of graphs against brute force, and on long chains."""

import random

import pytest

from featureflow.lineage import graphs as K


def frames(spark, nodes, edges, internal=()):
    one = lambda rows, names: spark.createDataFrame(rows, ", ".join(f"{n} int" for n in names))
    return one(nodes, ["graph_id", "id"]), one(edges, ["graph_id", "source", "target"]), one(list(internal), ["graph_id", "id"])


def plain_contract(nodes, edges, gone):
    out = set()
    after = {}
    for a, b in edges:
        after.setdefault(a, set()).add(b)
    for a in nodes:
        if a in gone:
            continue
        front, seen = list(after.get(a, ())), set()
        while front:
            x = front.pop()
            if x in seen:
                continue
            seen.add(x)
            if x in gone:
                front += after.get(x, ())
            else:
                out.add((a, x))
    return out


def test_contract_by_brute_force(spark):
    rnd = random.Random(7)
    nodes, edges, internal, want = [], [], [], set()
    for g in range(40):
        n = rnd.randrange(2, 16)
        own = {(rnd.randrange(n), rnd.randrange(n)) for _ in range(rnd.randrange(0, 3 * n))}
        gone = {i for i in range(n) if rnd.random() < rnd.choice([0.3, 0.8])}
        nodes += [(g, i) for i in range(n)]
        edges += [(g, a, b) for a, b in own]
        internal += [(g, i) for i in gone]
        want |= {(g, a, b) for a, b in plain_contract(range(n), own, gone)}
    n, e, i = frames(spark, nodes, edges, internal)
    kept, short = K.contract(n, e, i)
    assert {tuple(r) for r in short.select("graph_id", "source", "target").collect()} == want
    assert kept.count() == len(nodes) - len(internal)


def test_a_long_removed_chain_forms_no_pairs(spark, monkeypatch):
    chain, sources = 10_000, 1_000
    edges = [(1, i, i + 1) for i in range(chain)] + [(1, 20_000 + j, j * 10) for j in range(sources)] + [(1, chain, 50_000)]
    gone = [(1, i) for i in range(chain + 1)]
    nodes = [*gone, *((1, 20_000 + j) for j in range(sources)), (1, 50_000)]
    written = []
    staged = K.stage
    monkeypatch.setattr(K, "stage", lambda df, **kw: written.append(out := staged(df, **kw)) or out)
    counts = []
    monkeypatch.setattr(K, "remove_path", lambda spark, path: counts.append(spark.read.parquet(path).count()))
    kept, short = K.contract(*frames(spark, nodes, edges, gone))
    assert {(r.source, r.target) for r in short.collect()} == {(20_000 + j, 50_000) for j in range(sources)}
    assert max(counts) <= 2 * (chain + sources + 2) and len(written) < 80


def test_diamonds_and_cycles_go_without_pairs(spark):
    edges = []
    for k in range(200):  # a ladder of diamonds, a way back at every third
        a = 4 * k
        edges += [(1, a, a + 1), (1, a, a + 2), (1, a + 1, a + 4), (1, a + 2, a + 4)]
        if k % 3 == 0:
            edges.append((1, a + 4, a))
    gone = [(1, i) for i in range(804)]
    edges += [(1, 9000, 0), (1, 9001, 400), (1, 800, 9002)]
    _, short = K.contract(*frames(spark, [*gone, (1, 9000), (1, 9001), (1, 9002)], edges, gone))
    assert {(r.source, r.target) for r in short.collect()} == {(9000, 9002), (9001, 9002)}


def test_a_ladder_takes_one_round(spark, monkeypatch):
    layers = 10_000
    nodes = [(1, i) for i in range(2 * layers)]
    edges = [(1, 2 * k + a, 2 * k + 2 + b) for k in range(layers - 1) for a in (0, 1) for b in (0, 1)]
    written = []
    staged = K.stage
    monkeypatch.setattr(K, "stage", lambda df, **kw: written.append(1) or staged(df, **kw))
    n, e, _ = frames(spark, nodes, edges)
    got = {r.id: r.level for r in K.levels(n, e).collect()}
    assert got == {i: i // 2 for i in range(2 * layers)} and len(written) < 10


@pytest.mark.parametrize("whole", [0, 12, 10_000])
def test_levels_of_small_and_large_graphs(spark, monkeypatch, whole):
    monkeypatch.setattr(K, "WHOLE", whole)
    rnd = random.Random(whole)
    nodes, edges, want = [], [], {}
    for g in range(8):
        n = rnd.randrange(1, 20)
        own = {(rnd.randrange(n), rnd.randrange(n)) for _ in range(rnd.randrange(0, 25))}
        if g % 2:
            own = {(min(a, b), max(a, b)) for a, b in own}
        own |= {(77, 0)} if g % 4 == 3 else set()
        nodes += [(g, i) for i in range(n)]
        edges += [(g, a, b) for a, b in own]
        level, waits = {}, {i: {a for a, b in own if b == i and a != b} for i in range(n)}
        while ready := [i for i in waits if i not in level and all(a in level for a in waits[i])]:
            level.update({i: max((level[a] + 1 for a in waits[i]), default=0) for i in ready})
        want |= {(g, i): level.get(i) for i in range(n)}
    n, e, _ = frames(spark, nodes, edges)
    assert {(r.graph_id, r.id): r.level for r in K.levels(n, e).collect()} == want
