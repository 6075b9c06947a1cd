import hashlib
import heapq
import random

from pyspark.sql import functions as F

from srcfacts.llm import mixing as M


def _docs(spark, sizes):
    rows = [(k * 1000 + i, f"s{k}") for k, n in enumerate(sizes) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, source string").withColumn("rank", F.lit("x")).withColumn("slot", F.lit(0))


def test_less_than_one_block_off(spark):
    weights = spark.createDataFrame([("s0", 17), ("s1", 5), ("s2", 40), ("s3", 1), ("s4", 37)], "source string, share int")
    got = M.mix(_docs(spark, [400, 300, 500, 40, 450]), weights, block=4, period=100).collect()
    assert len(got) == 1690 and len({r.position for r in got}) == 1690
    blocks = {(r.source, r.block): r for r in got}
    assert all(r.release <= r.slot < r.deadline for r in blocks.values())
    share = {"s0": 17, "s1": 5, "s2": 40, "s3": 1, "s4": 37}
    horizon = max(r.slot for r in got if r.on_target) + 1
    for t in range(horizon + 1):
        for s, a in share.items():
            n = sum(r.slot < t for (source, _), r in blocks.items() if source == s)
            assert abs(n - a * t / 100) < 1, (s, t)


def test_shares_sum_to_the_period(spark):
    sizes = spark.createDataFrame([(f"s{i}", (i + 1) ** 3) for i in range(30)], "source string, n long")
    got = {r.source: r.share for r in M.shares(sizes, 100).collect()}
    assert sum(got.values()) == 100 and min(got.values()) >= 1


def test_rows(spark):
    rows = [(1, "a"), (1, "a"), (None, "a"), (2, None), (3, "")]
    df = spark.createDataFrame(rows, "doc_id long, source string")
    got = M.mix(df, block=1).collect()
    assert len(got) == 5 and len({r.position for r in got}) == 5
    assert M.mix(df.limit(0)).count() == 0
    zero = spark.createDataFrame([("a", 10)], "source string, share int")
    assert sorted(r.position is None for r in M.mix(df, zero, period=10).collect()) == [False] * 3 + [True] * 2


def test_order_of_the_rows(spark):
    df = _docs(spark, [60, 20]).withColumn("text", F.lit("t"))
    got = [r.doc_id for r in M.in_mix_order(df, block=2).collect()]
    want = [r.doc_id for r in M.mix(df, block=2).orderBy("position").collect()]
    assert got == want


def plain_edf(shares, period):
    """Slot by slot with a heap: (source, nth) -> slot."""
    released = {}
    for s, a in shares.items():
        for i in range(a):
            released.setdefault(i * period // a, []).append((-(-(i + 1) * period // a), a, hashlib.md5(s.encode()).hexdigest(), s, i))
    ready, out = [], {}
    for t in range(period):
        for x in released.get(t, ()):
            heapq.heappush(ready, x)
        if ready:
            _, _, _, s, i = heapq.heappop(ready)
            out[s, i] = t
    return out


def test_schedule_against_a_plain_one(spark):
    rng = random.Random(2)
    for k, period in ((1, 7), (12, 300), (40, 1100)):
        cuts = sorted(rng.sample(range(1, period), k - 1))
        shares = {f"s{i}": b - a for i, (a, b) in enumerate(zip([0, *cuts], [*cuts, period]))}
        got = M.template(spark.createDataFrame(list(shares.items()), "source string, share int"), period).collect()
        assert {(r.source, r.nth): r.slot for r in got} == plain_edf(shares, period)


def test_very_many_sources(spark):
    """20,000 sources: no row holds them all, and each keeps its windows."""
    n = 20_000
    df = spark.range(60_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.pmod(F.col("id") * F.col("id"), F.lit(n))).alias("source"))
    shared = {r.source: r.share for r in M.shares(df.groupBy("source").agg(F.count("*").alias("n")), n).collect()}
    assert sum(shared.values()) == n
    got = M.mix(df, block=1).where("slot < release or slot >= deadline or position is null")
    assert got.count() == 0
    slots = M.template(spark.createDataFrame(list(shared.items()), "source string, share int"), n).agg(F.count("*"), F.count_distinct("slot")).first()
    assert tuple(slots) == (n, n)


def test_ranges_of_odd_ids(spark):
    """Ids that agree in their lower bits, and rows without an id, go to many ranges."""
    docs = spark.range(20_000).select(F.when(F.col("id") % 2 == 0, F.col("id") * (1 << 31)).alias("doc_id"), F.lit("s").alias("source"), F.col("id").alias("n_chars"))
    got = M.ranked(docs, 256)
    assert got.count() == 20_000 and got.select("rank").distinct().count() == 20_000 and got.agg(F.max("rank")).first()[0] == 19_999
    low = M.ranked(spark.range(50).select(F.col("id").alias("doc_id"), F.lit("s").alias("source")), 4).orderBy("rank").collect()
    assert [r.id for r in low] == sorted(range(50), key=lambda i: ((i * 1103515245 + 12356) % 2**31, i))
