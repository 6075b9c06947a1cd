"""Lifting, spans and paths against plain walks; deep chains without a row a pair."""

import random

import pytest
from pyspark.sql import functions as F

from srcfacts.operators import facts as K
from srcfacts.operators import tree as T


def made(seed, n=60):
    rng = random.Random(seed)
    rows = []
    for i in range(1, n):
        parent = None if i < 3 else rng.choice([rng.randrange(1, i), i - 1])
        rows.append((i, parent, rng.randrange(5), rng.choice(["if", "for", "kw", "expr"])))
    return rows


def up(parent, x):
    out = [x]
    while parent[out[-1]] is not None:
        out.append(parent[out[-1]])
    return out


@pytest.mark.parametrize("seed", [1])
def test_against_walks(spark, seed):
    rows = made(seed)
    parent = {i: p for i, p, _, _ in rows}
    kind = {i: k for i, _, _, k in rows}
    tree = spark.createDataFrame(rows, "node_id long, parent_id long, ord int, kind string")
    lifted = T.lift(tree).cache()
    assert {r.node_id: r.depth for r in lifted.collect()} == {i: len(up(parent, i)) - 1 for i in parent}
    rng = random.Random(seed)
    sets = [(q, rng.randrange(1, 60)) for q in range(12) for _ in range(1 + q % 4)] + [(99, 5), (99, 1000)]
    members = {}
    for q, x in sets:
        members.setdefault(q, set()).add(x)

    def lca(xs):
        if not all(x in parent for x in xs):
            return None
        ways = [up(parent, x) for x in xs]
        return next((a for a in ways[0] if all(a in w for w in ways)), None)

    df = spark.createDataFrame(sets, "q int, node_id long")
    assert {r.q: r.lca for r in T.common_ancestor(lifted, df).collect()} == {q: a for q, xs in members.items() if (a := lca(xs))}
    pairs = [(rng.randrange(1, 60), rng.randrange(1, 60)) for _ in range(40)]
    got = {(r.a, r.b): (r.lca, r.distance) for r in T.distance(lifted, spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {(a, b): (c, up(parent, a).index(c) + up(parent, b).index(c)) for a, b in pairs if (c := lca([a, b]))}
    path = lambda x, top: [y for y in up(parent, x) if top in up(parent, y)]
    wanted = {(q, y) for q, xs in members.items() if (top := lca(xs)) for x in xs for y in path(x, top)}
    assert sorted(map(tuple, T.path_closure(lifted, df).collect())) == sorted(wanted)
    assert sorted(map(tuple, T.path_closure(lifted, df, to_root=True).collect())) == sorted({(q, y) for q, x in sets if x in parent for y in up(parent, x)})
    rules = {"kw": ["if", "for"], "expr": ["for"]}
    nearest = {i: next((y for y in up(parent, i)[1:] if kind[y] in rules[kind[i]]), None) for i in parent if kind[i] in rules}
    assert {r.node_id: r.anchor for r in T.anchors(tree, rules).collect()} == {i: a for i, a in nearest.items() if a}
    assert {r.node_id: r.path for r in T.kind_path(tree).collect()} == {i: "/".join(kind[y] for y in reversed(up(parent, i))) for i in parent}
    span = {r.node_id: r for r in T.spans(tree, ("ord",)).collect()}
    assert len(span) == len(parent)
    for a in parent:
        for b in parent:
            assert (a in up(parent, b)) == (span[a].root == span[b].root and span[a].begin <= span[b].begin and span[b].end <= span[a].end)
    for i in parent:
        kids = sorted((x for x in parent if parent[x] == i), key=lambda x: ({r[0]: r[2] for r in rows}[x], x))
        assert kids == sorted(kids, key=lambda x: span[x].begin)


def test_deep_chain(spark):
    n = 5000
    tree = spark.range(n).select(F.col("id").alias("node_id"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent_id"), F.lit("k").alias("kind"))
    lifted = T.lift(tree)
    assert lifted.where("depth <> node_id").isEmpty() and lifted.agg(F.max(F.size("ups"))).first()[0] == 13
    pairs = spark.createDataFrame([(4999, 17), (0, 4321)], "a long, b long")
    assert {(r.a, r.lca, r.distance) for r in T.distance(lifted, pairs).collect()} == {(4999, 17, 4982), (0, 0, 4321)}
    uses = tree.select(F.col("node_id").alias("use_id"), F.col("node_id").alias("scope_id"), F.lit("x").alias("name"))
    defs = spark.createDataFrame([(1, 0, "x"), (2, 2500, "x"), (3, 3, "y")], "def_id long, scope_id long, name string")
    found = T.nearest_definition(uses, tree.select(F.col("node_id").alias("scope_id"), "parent_id"), defs)
    assert {r.def_id: r["count"] for r in found.groupBy("def_id").count().collect()} == {1: 2500, 2: 2500}


def test_a_circle_raises(spark, monkeypatch):
    monkeypatch.setattr(T, "MOST_BITS", 5)
    with pytest.raises(RuntimeError):
        T.lift(spark.createDataFrame([(1, 2), (2, 1)], "node_id long, parent_id long"))


def test_spans_of_any_length(spark):
    rng = random.Random(7)
    spans = [(rng.choice("ab"), i, b, b + rng.choice([0, 1, 63, 64, 70, 1000, 10**7])) for i, b in enumerate(rng.randrange(-200, 3000) for _ in range(120))]
    points = [(rng.choice("ab"), rng.randrange(-300, 5000)) for _ in range(200)] + [("a", 10**7), ("c", 1)]
    s = spark.createDataFrame(spans, "file string, id long, begin long, end long")
    got = K.covering(spark.createDataFrame(points, "file string, at long").distinct(), s).select("file", "p.at", "s.id").collect()
    assert sorted(map(tuple, got)) == sorted((f, p, i) for f, p in set(points) for g, i, b, e in spans if f == g and b <= p <= e)
    met = K.overlapping(s, s).select("l.id", F.col("r.id").alias("other")).collect()
    assert sorted(map(tuple, met)) == sorted((i, j) for f, i, b, e in spans for g, j, c, d in spans if f == g and b <= d and c <= e)
    one = spark.createDataFrame([("a", 1, 5, 5 + 10**7)], "file string, id long, begin long, end long")
    assert one.select(F.size(K._cells(F.col("begin"), F.col("end"), 64)).alias("n")).first().n < 40
