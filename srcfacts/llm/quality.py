"""Quality rules: fixed limits, then robust multivariate outliers per language and source.

Every text gives a vector of transformed statistics (symbol density, word length, vocabulary growth, words per line).
For each language and source the minimum-covariance-determinant estimate is found by concentration steps over all
rows: distances from the current centre, the ``h`` part of the rows that lie closest (to the edge of a fine histogram
bin), their mean and covariance, and again. Starts are two robust ones; the smaller determinant wins. A document is
rejected if its squared Mahalanobis distance, scaled so that the ``h`` quantile is that of chi-square, exceeds the
chi-square quantile of ``1 - alpha``.

Every group has an estimate of its own, whatever its size: to its moments those of its language are added with the weight of
``ROWS_PER_STATISTIC`` rows for each statistic, and to a language's those of all rows, and so it is with the counts that give the
``h`` quantile. A few rows say little against their language, thousands speak for themselves; ``own_share`` is a group's own weight. A floor
under each statistic's spread keeps constant columns from making the covariance singular. Null language or source is
a group of its own; null and empty texts have no words and fail the base rules. Extra columns are ignored, repeated
rows keep a row each, an empty table gives an empty result. Whole groups never meet in one task: only sums do.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from srcfacts.llm.base import text_pass
from srcfacts.llm.quality_stats import counts
from srcfacts.session import cut, stored

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_distinct", "n_lines")
#: Least spread of each transformed statistic.
FLOOR = (0.10, 0.03, 0.01, 0.15)
P = len(FLOOR)
ROWS_PER_STATISTIC = 12
STEPS = 3
#: Groups whose estimates (about 250 bytes each) are broadcast.
MOST_BROADCAST = 10_000
BINS_PER_DOUBLING = 32


def chi2_quantile(q: float, p: int = P) -> float:
    """Of an even number of degrees of freedom, by bisection on the closed tail."""
    low, high = 0.0, 1000.0
    for _ in range(200):
        x = (low + high) / 2
        tail = math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(p // 2))
        low, high = (x, high) if tail > 1 - q else (low, x)
    return low


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(id, lang, source, counts) in one pass over the texts."""
    fields = [T.StructField(n, T.LongType()) for n in STATS]
    return text_pass(docs, lambda texts: list(map(list, zip(*map(counts, texts), strict=True))) if texts else [[]] * len(STATS), fields, id_col, text_col, (lang_col, source_col))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def vector() -> list[Column]:
    """Transformed statistics; pseudo-counts hold those of short texts near the middle."""
    n, chars = F.col("n_words"), F.col("word_chars")
    return [
        F.asinh(100 * F.col("n_symbols") / F.greatest(chars, F.lit(1))),
        F.log((chars + 250) / (n + 50)),
        F.log(F.col("n_distinct") + 50) / F.log(n + 50),
        F.log((n + 40) / (F.col("n_lines") + 1)),
    ]


def _solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Mean, inverse covariance and log determinant of each group's moments; one small row per group."""
    pairs = [(i, j) for i in range(P) for j in range(i, P)]
    for b in batches:
        out = []
        for r in b.itertuples(index=False):
            mean = np.array([getattr(r, f"m{i}") for i in range(P)])
            cov = np.zeros((P, P))
            for i, j in pairs:
                cov[i, j] = cov[j, i] = getattr(r, f"m{i}_{j}") - mean[i] * mean[j]
            cov += np.diag(np.square(FLOOR))
            out.append((r.l, r.g, r.start, mean.tolist(), np.linalg.inv(cov).ravel().tolist(), float(np.linalg.slogdet(cov)[1])))
        yield pd.DataFrame(out, columns=["l", "g", "start", "mean", "inverse", "logdet"])


ESTIMATE = "l string, g string, start int, mean array<double>, inverse array<double>, logdet double"
MOMENTS = [f"{i}" for i in range(P)] + [f"{i}_{j}" for i in range(P) for j in range(i, P)]


def _estimates(rows: DataFrame, prior: int) -> DataFrame:
    """Estimates of each group from the rows (l, g, start, x0..): sums are combined before the shuffle, and only sums of groups go
    up to their languages and to all rows, whose moments come back with the weight of ``prior`` rows."""
    power = lambda m: F.col("x" + m) if "_" not in m else F.col("x" + m.split("_")[0]) * F.col("x" + m.split("_")[1])
    sums = stored(rows.groupBy("l", "g", "start").agg(F.count("*").alias("n"), *[F.sum(power(m)).alias(f"s{m}") for m in MOMENTS]))
    up = lambda *keys: sums.groupBy(*keys).agg(F.sum("n").alias("n"), *[F.sum(f"s{m}").alias(f"s{m}") for m in MOMENTS])
    every = up("start").select("start", *[(F.col(f"s{m}") / F.col("n")).alias(f"a{m}") for m in MOMENTS])
    shrunk = lambda own, above: [((F.col(f"s{m}") + prior * F.col(f"{above}{m}")) / (F.col("n") + prior)).alias(f"{own}{m}") for m in MOMENTS]
    by_lang = stored(up("l", "start").join(F.broadcast(every), "start").select("l", "start", *shrunk("b", "a")))  # ``every``: a row a start
    return sums.join(by_lang, ["l", "start"]).select("l", "g", "start", *shrunk("m", "b")).mapInPandas(_solve, ESTIMATE)


def _distance() -> Column:
    diff = [F.col(f"x{i}") - F.col("mean")[i] for i in range(P)]
    return sum((diff[i] * diff[j] * F.col("inverse")[i * P + j] for i in range(P) for j in range(P)), F.lit(0.0))


def _bin() -> Column:
    return F.floor(BINS_PER_DOUBLING * F.log2(F.greatest(F.col("d2"), F.lit(1e-9)))).cast("int")


def _edges(measured: DataFrame, h: float, prior: int = 0) -> DataFrame:
    """(g, start, edge): the first histogram bin up to which lies the part ``h`` of the group's rows, to which the shares of its
    language are added with the weight of ``prior`` rows, and to these those of all rows."""
    counted = measured.groupBy("l", "g", "start", "bin").agg(F.count("*").cast("double").alias("c"))
    if prior:
        counted = stored(counted)
        share = lambda df, *keys: df.withColumn("c", F.col("c") / F.sum("c").over(Window.partitionBy(*keys)))
        every = share(counted.groupBy("start", "bin").agg(F.sum("c").alias("c")), "start")
        langs = counted.select("l", "start").distinct()
        by_lang = counted.groupBy("l", "start", "bin").agg(F.sum("c").alias("c")).union(langs.join(every, "start").select("l", "start", "bin", F.col("c") * prior)).groupBy("l", "start", "bin").agg(F.sum("c").alias("c"))
        by_lang = stored(share(by_lang, "l", "start"))
        groups = counted.select("l", "g", "start").distinct()
        added = groups.join(by_lang, ["l", "start"]).select("l", "g", "start", "bin", F.col("c") * prior)
        counted = counted.union(added).groupBy("l", "g", "start", "bin").agg(F.sum("c").alias("c"))
    whole = Window.partitionBy("g", "start")
    run = counted.withColumn("up_to", F.sum("c").over(whole.orderBy("bin"))).withColumn("all", F.sum("c").over(whole))
    return run.where(F.col("up_to") >= h * F.col("all") * (1 - 1e-12)).groupBy("g", "start").agg(F.min("bin").alias("edge"))


def outlier_distances(stats: DataFrame, h: float = 0.75, prior: int = ROWS_PER_STATISTIC * P, lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``stats`` with ``d2``, the scaled squared distance from the centre of the row's group, and ``own_share``, n / (n + prior) of a group of n."""
    lang, source = (F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in (lang_col, source_col))
    named = stats.withColumn("__l", lang).withColumn("__g", F.concat_ws("\1", lang, source))
    points = cut(named.select(F.col("__l").alias("l"), F.col("__g").alias("g"), *[c.alias(f"x{i}") for i, c in enumerate(vector())]))
    sizes = stored(points.groupBy("g").agg(F.count("*").alias("size")))
    # One row a group: broadcast while there are few groups, else joined by key.
    near = F.broadcast if sizes.count() <= MOST_BROADCAST else lambda df: df

    # Starts: one from coordinate-wise medians of the language, one from all rows.
    medians = points.groupBy("l").agg(*[F.percentile_approx(f"x{i}", F.lit([0.25, 0.5, 0.75]), 1000).alias(f"q{i}") for i in range(P)])
    spread = [F.greatest((F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / 1.349, F.lit(FLOOR[i])) for i in range(P)]
    diagonal = F.array(*[1 / (spread[i] * spread[i]) if i == j else F.lit(0.0) for i in range(P) for j in range(P)])
    middle = stored(medians.select("l", F.lit(0).alias("start"), F.array(*[F.col(f"q{i}")[1] for i in range(P)]).alias("mean"), diagonal.alias("inverse"), F.lit(0.0).alias("logdet")))
    first = points.select("l", "g").distinct().join(middle, "l").select("l", "g", "start", "mean", "inverse", "logdet")
    estimates = stored(first.union(_estimates(points.withColumn("start", F.lit(1)), prior)))
    for _ in range(STEPS):
        measured = points.join(near(estimates.drop("logdet", "l")), "g").withColumn("d2", _distance()).withColumn("bin", _bin()).drop("mean", "inverse")
        edges = stored(_edges(measured, h))
        estimates = stored(_estimates(measured.join(near(edges), ["g", "start"]).where("bin <= edge"), prior))
    best = stored(estimates.groupBy("g").agg(F.min_by(F.struct("start", "mean", "inverse"), F.struct("logdet", "start")).alias("e")).select("g", F.col("e.mean").alias("mean"), F.col("e.inverse").alias("inverse")))
    measured = points.join(near(best), "g").withColumn("start", F.lit(0)).withColumn("d2", _distance()).withColumn("bin", _bin())
    scale = _edges(measured, h, prior).select("g", (chi2_quantile(h) / F.pow(F.lit(2.0), (F.col("edge") + 1) / BINS_PER_DOUBLING)).alias("scale"))
    known = stored(best.join(scale, "g").join(sizes, "g").select(F.col("g").alias("__g"), "mean", "inverse", "scale", (F.col("size") / (F.col("size") + prior)).alias("own_share")))
    xs = {f"x{i}": c for i, c in enumerate(vector())}
    return named.join(near(known), "__g").withColumns(xs).withColumn("d2", _distance() * F.col("scale")).drop("__l", "__g", "mean", "inverse", "scale", *xs)


def verdicts(docs: DataFrame, h: float = 0.75, prior: int = ROWS_PER_STATISTIC * P, alpha: float = 1e-9) -> DataFrame:
    """(doc_id, counts, base_failed, d2, kept) for documents (doc_id, text, lang, source)."""
    stats = cut(statistics(docs))
    found = outlier_distances(stats, h, prior).withColumn("base_failed", base_failed())
    return found.withColumn("kept", ~F.col("base_failed") & (F.col("d2") <= chi2_quantile(1 - alpha)))


def op5_quality(spark, sf_dir: str) -> DataFrame:
    found = verdicts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("d2", 3).alias("distance"), F.round("own_share", 3).alias("own_share"))
