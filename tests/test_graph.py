"""Contraction, components, orders and closures against plain searches."""

import random

import pytest

from srcfacts.operators import graph as G


def reach(edges):
    out = {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)
    seen = {}
    for start in {x for e in edges for x in e}:
        found, todo = set(), [start]
        while todo:
            for b in out.get(todo.pop(), ()):
                if b not in found:
                    found.add(b)
                    todo.append(b)
        seen[start] = found
    return seen


def some_graph(seed):
    rng = random.Random(seed)
    edges = {(rng.randrange(40), rng.randrange(40)) for _ in range(rng.choice([20, 45, 80]))}
    at = 100
    for _ in range(rng.randint(1, 4)):  # chains and rings, hung on the rest or not
        n = rng.randint(2, 30)
        path = list(range(at, at + n))
        at += n
        edges |= set(zip(path, path[1:], strict=False))
        if rng.random() < 0.5:
            edges.add((rng.randrange(40), path[0]))
        if rng.random() < 0.5:
            edges.add((path[-1], rng.choice([rng.randrange(40), path[0], path[n // 2]])))
    return sorted(edges)


def ranks(edges):
    far = reach(edges)
    bad = {x for x in far if x in far[x]}
    bad |= {y for x in bad for y in far[x]}
    memo = {}

    def rank(x):
        if x not in memo:
            memo[x] = max((rank(a) + 1 for a, b in edges if b == x), default=0)
        return memo[x]

    return {x: None if x in bad else rank(x) for x in far}


@pytest.mark.parametrize("seed", [3])
def test_random_graphs(spark, monkeypatch, seed):
    monkeypatch.setattr(G, "FEW", 4)
    monkeypatch.setattr(G, "SHALLOW", 2)
    edges = some_graph(seed)
    df = spark.createDataFrame(edges, "src long, dst long")
    far = reach(edges)
    assert {r.node: r["rank"] for r in G.topo_rank(df).collect()} == ranks(edges)
    rows = G.components(df).collect()
    assert len(rows) == len(far) and {r.node: r.component for r in rows} == {x: min([x, *(y for y in far[x] if x in far[y])]) for x in far}
    seeds = [(q, x) for q in range(3) for x in random.Random(seed + q).sample(sorted(far), 2)] + [(7, 999)]
    got = sorted(map(tuple, G.closure(df, spark.createDataFrame(seeds, "q int, node long")).collect()))
    assert got == sorted({(q, y) for q, x in seeds for y in [x, *far.get(x, ())]})


def test_long_chain_and_ring(spark):
    n = 20_000
    chain = spark.range(n - 1).selectExpr("id as src", "id + 1 as dst")
    ranked = G.topo_rank(chain).cache()
    assert ranked.count() == n and ranked.where("rank is null or rank <> node").isEmpty()
    n = 3000
    chain = spark.range(n - 1).selectExpr("id as src", "id + 1 as dst")
    seeds = spark.createDataFrame([(1, 0), (2, n - 10)], "q int, node long")
    assert {r.q: r["count"] for r in G.closure(chain, seeds).groupBy("q").count().collect()} == {1: n, 2: 10}
    ring = chain.union(spark.createDataFrame([(n - 1, 1000)], "src long, dst long"))
    assert G.has_cycle(ring)
    assert {r.component: r["count"] for r in G.components(ring).groupBy("component").count().where("count > 1").collect()} == {1000: 2000}


def test_removed_hub_is_followed_once(spark):
    edges = [(f"a{i}", "h1", "x") for i in range(50)] + [("h1", "h2", "x"), ("h2", "h1", "x")] + [("h2", f"b{i}", "x") for i in range(50)] + [("a0", "b0", "own")]
    df = spark.createDataFrame(edges, "src string, dst string, label string")
    got = G.eliminate(df, spark.createDataFrame([("h1",), ("h2",)], "node string"), "via").collect()
    assert len(got) == 2500 and {r.label for r in got if (r.src, r.dst) == ("a0", "b0")} == {"own"}
