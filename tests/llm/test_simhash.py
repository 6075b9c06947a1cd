import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from srcfacts.llm import simhash as S


def plain_fingerprint(text, k=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    words = [w for w in low.split(" ") if w]
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] if len(words) >= k else ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def plain_components(rows, tau=2):
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (i, a) in enumerate(rows):
        for j, b in rows[:n]:
            if bin((a ^ b) & (2**64 - 1)).count("1") <= tau:
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return {i: root(i) for i, _ in rows}


def test_fingerprint():
    rng = random.Random(1)
    bits = ["Foo", "bar", "É", "é", " ", " ", "  ", "\n", "\t", "x", "日本"]
    for _ in range(500):
        t = "".join(rng.choice(bits) for _ in range(rng.randint(0, 40)))
        assert S.fingerprint(t) & (2**64 - 1) == plain_fingerprint(t), t
    assert S.fingerprint("") == 0


def test_hash_is_sparks(spark):
    t = "the quick é"
    assert spark.createDataFrame([(t,)], "t string").select(F.xxhash64("t")).first()[0] & (2**64 - 1) == xxhash.xxh64_intdigest(t.encode(), 42)


def _prints(seed, n=260):
    rng = random.Random(seed)
    base = [rng.getrandbits(64) for _ in range(12)]
    out = []
    for _ in range(n):
        x = rng.choice(base) if rng.random() < 0.8 else rng.getrandbits(64)
        for _ in range(rng.randint(0, 4)):
            x ^= 1 << rng.randrange(64)
        out.append(x)
    return out


def test_links_join_what_brute_force_joins(spark):
    """Small buckets go through pairs, a bucket of one forces the one-bit variants; both give every component."""
    for seed, tau, bucket in ((1, 2, 64), (2, 2, 1), (3, 2, 5), (4, 1, 64), (5, 1, 1), (6, 0, 64)):
        prints = sorted(set(_prints(seed)))
        rows = [(i, p) for i, p in enumerate(prints)]
        signed = [(i, p - 2**64 if p >= 2**63 else p) for i, p in rows]
        nodes = spark.createDataFrame(signed, "rep long, fp long").select("fp", "rep")
        found = {r.node: r.component for r in S.components(S.links(nodes, tau, bucket)).collect()}
        want = plain_components(rows, tau)
        assert {i: found.get(i, i) for i, _ in rows} == want, (seed, tau, bucket)


def test_allocation_is_the_cheapest():
    counts = np.array([[5.0, 900.0, 1.0], [0.0, 0.0, 0.0], [900.0, 900.0, 1.0]])
    got = S.allocate(counts, [22, 21, 21], 1000, 2)
    assert (got.sum(axis=1) == 0).all() and got[0][1] == -1 and got[2][0] < 1 and got[2][1] < 1
    assert (got >= -1).all()


def test_rows(spark):
    rows = [(3, "a b c d e"), (3, "a b c d e"), (1, "A  b\nc d e"), (2, None), (4, ""), (None, "a b c d e"), (9, "z " * 5000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("clash")).withColumn("component", F.lit(1))
    got = sorted((r.doc_id or -1, r.component or -1) for r in S.near_duplicates(df).collect())
    assert got == [(-1, -1), (1, 1), (2, 2), (3, 1), (3, 1), (4, 2), (9, 9)]
    assert S.near_duplicates(df.limit(0)).count() == 0


def test_wide_search_finds_pairs_at_four_fifths(spark):
    """Sets of similarity 0.8 exactly, small and large, between unlike ones; blocks of any size and either way of writing."""
    import numpy as np

    rng = np.random.default_rng(4)
    draw = lambda n: rng.integers(0, 1 << 64, n, np.uint64)
    layout = S.wide_layout(200)
    rows, want = [], set()
    for common, a, b in [(4, 1, 0), (12, 2, 1), (80, 10, 10), (200, 50, 0)] * 25:
        x = draw(common + a + b)
        for s in (x[: common + a], np.concatenate([x[:common], x[common + a :]])):
            rows.append((len(rows), len(s), S.wide_fingerprint(s, layout[-1]).tolist()))
        want.add((len(rows) - 2, len(rows) - 1))
    assert S.wide_fingerprint(x, 3)[0] == S.wide_fingerprint(x, 1)[0]
    nodes = spark.createDataFrame(rows, "node long, n long, wide array<long>")
    for most, block in ((4, 1000), (0, 1000), (4, 2)):
        met = S.far_pairs(nodes, layout, most, block).collect()
        pairs = {tuple(sorted((r.a, r.b))) for r in met if r.b is not None}
        assert want <= pairs and len(pairs) < len(want) + 20, (most, block)
        assert {r.a for r in met if r.b is None} == ({x for p in pairs for x in p} if not most else set())


def test_wide_fingerprint_begins_with_the_plain_one():
    import numpy as np

    text = " ".join(f"w{i}" for i in range(600))  # no shingle twice
    assert S.wide_fingerprint(S.shingle_hashes(text, 3), 6)[0] == S.fingerprint(text)
    assert not S.wide_fingerprint(np.empty(0, np.uint64), 6).any()
