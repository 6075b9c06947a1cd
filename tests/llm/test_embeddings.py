import numpy as np

from srcfacts.llm import embeddings as E


def test_against_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((60, 24))
    v = [base[rng.integers(60)] + rng.normal(0, s, 24) for s in (0.0, 0.05, 0.1, 0.2, 0.3) for _ in range(80)]
    v += [v[0]] * 30 + list(rng.standard_normal((80, 24)))
    rows = [(i, [float(np.float32(x)) for x in y], i % 3) for i, y in enumerate(v)]
    n = len(rows)
    rows += [(n, None, 0), (n + 1, [0.0] * 24, 0), (n + 2, [float("nan")] + [1.0] * 23, 0), (n + 3, [None] + [1.0] * 23, 0), (n + 4, [1.0], 0), (n + 5, [2.0], 0), (n + 6, [], 0), (n + 7, [float("inf")] + [1.0] * 23, 0)]
    got = {r.vec_id: r for r in E.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    x = np.array([r[1] for r in rows[:n]])
    cos = (x @ x.T) / np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(x, axis=1))
    link = cos >= 0.95
    np.fill_diagonal(link, False)
    missed = sum(link.sum(axis=1)) - sum(got[i].n_links for i in range(n))
    assert 0 <= missed <= 0.002 * link.sum()
    comp = list(range(n))
    for _ in range(n):
        new = [min([comp[i], *(comp[j] for j in np.nonzero(link[i])[0])]) for i in range(n)]
        if new == comp:
            break
        comp = new
    assert sum(got[i].component_id != comp[i] for i in range(n)) <= 0.01 * n
    assert all(got[i].kept == (got[i].component_id == i) for i in got)
    assert [got[n + k].n_links for k in range(8)] == [0, 0, 0, 0, 1, 1, 0, 0] and got[n + 5].component_id == n + 4


def test_blocks_of_a_large_bucket(spark, monkeypatch):
    rng = np.random.default_rng(4)
    base = rng.standard_normal(16)
    rows = [(i, (base + rng.normal(0, 0.02, 16)).tolist()) for i in range(300)]
    monkeypatch.setattr(E.linked_pairs, "__defaults__", (*E.linked_pairs.__defaults__[:-1], 64))
    got = E.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r.n_links for r in got} == {299} and {r.component_id for r in got} == {0}


def test_empty(spark):
    assert E.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_recall_follows_the_plan():
    k, tables = E.plan(50_000, 0.95, 0.999)
    assert 1 - (1 - E.share_bucket((2 - 1.9) ** 0.5) ** k) ** tables >= 0.999 and 50_000 * E.share_bucket(2**0.5) ** k <= E.MEETINGS


def test_tiny_and_huge_vectors(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((6, 16))
    rows = [(i, (base[i % 6] * 10.0 ** rng.choice([-300, -200, 0, 200, 300]) * (1 + rng.normal(0, 0.01, 16))).tolist()) for i in range(60)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in E.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {i: (9, i % 6) for i in range(60)}


def test_pairs_close_to_the_threshold(spark):
    """Cosines within the rounding of 8 bits are decided in double precision."""
    rng = np.random.default_rng(6)
    rows, want = [], 0
    for i in range(400):
        x, y = rng.standard_normal((2, 32))
        x /= np.linalg.norm(x)
        y -= (x @ y) * x
        y /= np.linalg.norm(y)
        c = 0.95 + rng.choice([-1, 1]) * 10 ** rng.uniform(-9, -2)
        rows += [(2 * i, x.tolist()), (2 * i + 1, (c * x + (1 - c * c) ** 0.5 * y).tolist())]
        want += c >= 0.95
    got = E.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    linked = {r.component_id // 2 for r in got if r.n_links}
    assert linked <= {i for i in range(400) if np.dot(rows[2 * i][1], rows[2 * i + 1][1]) >= 0.95 - 1e-12}
    assert want - len(linked) <= 2


def test_recall_of_every_twentieth_vector(spark):
    """Ids divisible by 20 against all rows, with planted near vectors."""
    rng = np.random.default_rng(7)
    base = rng.standard_normal((2000, 64))
    near = base[::20] + rng.normal(0, 0.2, (100, 64))
    rows = [(i, x.tolist()) for i, x in enumerate(np.concatenate([base, near]))]
    x = E.units(np.array([r[1] for r in rows]))
    asked = [i for i, _ in rows if i % 20 == 0]
    cos = x[asked] @ x.T >= 0.95
    want = cos.sum(axis=1) - 1
    got = {r.vec_id: r.n_links for r in E.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert want.sum() > 50 and sum(got[i] for i in asked) >= 0.99 * want.sum()


def test_clashing_columns(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0], 1, 2, 3), (2, [1.0, 2.0], 1, 2, 3), (None, [1.0, 2.0], 1, 2, 3)], "vec_id long, embedding array<float>, v int, d1 int, n_links int")
    assert sorted((r.vec_id or 0, r.n_links) for r in E.near_duplicates(rows).collect()) == [(0, 0), (1, 1), (2, 1)]
