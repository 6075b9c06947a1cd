"""Running values in pieces against plain loops."""

import random

from pyspark.sql import functions as F

from srcfacts.operators import facts as K
from srcfacts.operators import logs as L
from srcfacts.operators.scan import pieces, scanned


def made(seed, n=600):
    rng = random.Random(seed)
    rows, at = [], {"a": 0, "b": 0, None: 0}
    for i in range(n):
        f = rng.choice(["a", "a", "a", "b", None])
        at[f] += rng.randint(1, 9)
        rows.append((f, at[f], rng.choice([None, "x", "y", None]), rng.choice([0, 1, None]), i))
    return rows


def looped(rows):
    state, total, out = {}, {}, []
    for f, _, _, k, _ in rows:
        total[f] = total.get(f, 0) + (k or 0)
    for f, n, v, k, i in sorted(rows, key=lambda r: r[1]):
        last, s = state.get(f, (None, 0))
        state[f] = (v if v is not None else last, s + (k or 0))
        out.append((i, *state[f], total[f]))
    return sorted(out)


def test_pieces_of_lines_and_of_any_order(spark):
    rows = made(1)
    df = spark.createDataFrame(rows, "file string, line_no long, v string, k int, i int")
    for order, lines in ((("line_no",), 7), (("line_no",), 1 << 16), (("t", "line_no"), 1)):
        got = scanned(df.withColumn("t", F.col("line_no") * 1.0), last={"last": F.col("v")}, sums={"sum": F.col("k")}, totals={"all": F.col("k")}, order=order, lines=lines)
        assert sorted((r.i, r.last, r["sum"], r["all"]) for r in got.collect()) == looped(rows)
    assert scanned(df.limit(0), sums={"sum": F.col("k")}).count() == 0


def test_one_file_in_many_tasks(spark):
    """A single file is replayed in as many pieces as it has ranges of lines."""
    lines = spark.range(400_000).select(F.lit("f").alias("file"), F.col("id").alias("line_no"), F.when(F.col("id") % 1000 == 0, "INPUT_SPEC").when(F.col("id") % 1000 == 999, "TEST_SUCCESS").otherwise(F.concat(F.lit("k = "), F.col("id"))).alias("line"))
    assert pieces(lines, ("file",), ("line_no",)).select("__piece").distinct().count() == 7
    got = L.trace_records(lines)
    assert got.count() == 400 and got.agg(F.sum(F.col("value").cast("long"))).first()[0] == sum(1000 * t + 998 for t in range(400))


def test_latest_before_one_key(spark):
    rng = random.Random(4)
    starts = sorted({rng.randrange(2000) for _ in range(150)})
    points = [(rng.choice(["k", "z"]), rng.randrange(2000), i) for i in range(500)]
    got = K.latest_before(spark.createDataFrame(points, "file string, line long, id long"), spark.createDataFrame([("k", s) for s in starts] * 2, "file string, begin long"), "file", "line", "begin", "id").collect()
    assert sorted((r.id, r.start) for r in got) == sorted((i, max([s for s in starts if s < at and f == "k"], default=0)) for f, at, i in points)
