"""Statistics over many projects: build rates, sizes, errors, repositories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from srcfacts.functions import text as X


def _count(c: Column) -> Column:
    return F.sum(F.when(c, 1).otherwise(0))


def build_rate(df: DataFrame, key: str, built: Column, ran: Column, digits: int | None = None) -> DataFrame:
    """(key, total, built, ran, build_rate, run_rate); run rate over the built ones; null over none; digits: cut, not rounded."""
    cut = (lambda c: F.floor(c * 10**digits) / 10**digits) if digits is not None else (lambda c: c)
    found = df.groupBy(key).agg(F.count("*").alias("total"), _count(built).alias("built"), _count(built & ran).alias("ran"))
    return found.withColumn("build_rate", cut(F.try_divide("built", "total"))).withColumn("run_rate", cut(F.try_divide("ran", "built")))


def ratio_by(df: DataFrame, column: str, good: Column) -> DataFrame:
    """(column, n, ratio) of successes at each size."""
    return df.groupBy(column).agg(F.count("*").alias("n"), F.avg(F.when(good, 1.0).otherwise(0.0)).alias("ratio"))


def size_profile(df: DataFrame, key: str, size: str, good: Column) -> DataFrame:
    """Least, largest and mean size of successes and of errors."""
    ok, bad = F.when(good, F.col(size)), F.when(~good, F.col(size))
    return df.groupBy(key).agg(*[f(c).alias(f"{n}_{m}") for m, c in (("success", ok), ("error", bad)) for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg))])


def outcome_ranges(df: DataFrame, key: str, outcome: str, value: str, outcomes: list[str]) -> DataFrame:
    """Least, largest and count of the values of each outcome, one row a kind."""
    return df.groupBy(key).pivot(outcome, outcomes).agg(F.min(value).alias("min"), F.max(value).alias("max"), F.count(value).alias("count"))


def error_histogram(lines: DataFrame) -> DataFrame:
    """(message, n) of compiler error lines, rarest first."""
    errors = lines.where(F.contains("line", F.lit("error:")))
    return errors.groupBy(X.compile_message(F.col("line")).alias("message")).agg(F.count("*").alias("n")).orderBy("n", "message")


def status_counts(df: DataFrame, code: str) -> DataFrame:
    return df.groupBy(X.exit_class(F.col(code)).alias("status")).agg(F.count("*").alias("n"))


def loc_and_asserts(lines: DataFrame, key: str) -> DataFrame:
    """(key, loc, asserts): lines, and lines that hold "assert" in any case."""
    return lines.groupBy(key).agg(F.count("*").alias("loc"), _count(F.col("line").rlike("(?i)assert")).alias("asserts"))


def language_share(df: DataFrame, languages: str, name: str) -> DataFrame:
    """Adds ``share``: the part of a language in the map of bytes by language; null for an empty map."""
    total = F.aggregate(F.map_values(languages), F.lit(0).cast("long"), lambda s, x: s + x)
    return df.withColumn("share", F.try_divide(F.coalesce(F.try_element_at(languages, F.lit(name)), F.lit(0)), total))


# Languages that a repository of C must not hold.
OTHER_LANGUAGES = ("Objective-C", "C++", "Ruby", "Java", "JavaScript")


def filter_c_repos(df: DataFrame, languages: str = "languages", size: str = "size", others: tuple[str, ...] = OTHER_LANGUAGES, least_share: float = 0.7, most_bytes: int = 100_000, most_size: int = 1000) -> DataFrame:
    """Small repositories that are mostly C and hold none of the other languages."""
    has = lambda n: F.coalesce(F.map_contains_key(languages, n), F.lit(False))
    none = F.lit(True)
    for n in others:
        none = none & ~has(n)
    kept = language_share(df, languages, "C").where(has("C") & none & (F.col("share") >= least_share) & (F.try_element_at(languages, F.lit("C")) <= most_bytes) & (F.col(size) <= most_size))
    return kept.drop("share")


def healthy(df: DataFrame, flags: list[str], rate: str = "br", least: float = 50) -> DataFrame:
    """Rows without a failed flag - an absent one passes - and with the rate."""
    for f in flags:
        df = df.where(F.coalesce(f, F.lit(True)))
    return df.where(F.col(rate) >= least)


def top_projects(df: DataFrame, key: str, value: str, n: int | None = 30, min_sum: float | None = None) -> DataFrame:
    """The n largest sums, ties by name; or all sums above a bound, smallest first."""
    sums = df.groupBy(key).agg(F.sum(value).alias("total"))
    if min_sum is not None:
        return sums.where(F.col("total") > min_sum).orderBy("total", key)
    return sums.orderBy(F.desc("total"), key).limit(n)


def patch_size(df: DataFrame, key: str, original: str, patched: str, built: Column) -> DataFrame:
    """Tokens of the selections and of their completions over built segments that had any."""
    rows = df.where(built & (F.col(original) != 0))
    return rows.groupBy(key).agg(
        F.count("*").alias("n"), F.sum(original).alias("original"), F.sum(patched).alias("patched"), _count(F.col(original) == F.col(patched)).alias("unchanged"), F.avg(original).alias("mean_original"), F.avg(patched).alias("mean_patched")
    )


def duplicate_definitions(df: DataFrame, project: str, key: str) -> DataFrame:
    """(project, key, n) defined more than once."""
    return df.groupBy(project, key).agg(F.count("*").alias("n")).where("n > 1")


def removal_verdict(h1: Column, h2: Column, h3: Column) -> Column:
    """Which of three profiles are equal: 123, 12,3 13,2 23,1 or 1,2,3."""
    return F.when((h1 == h2) & (h2 == h3), "123").when(h1 == h2, "12,3").when(h1 == h3, "13,2").when(h2 == h3, "23,1").otherwise("1,2,3")


def removal_verdicts(df: DataFrame, h1: str, h2: str, h3: str) -> DataFrame:
    return df.groupBy(removal_verdict(F.col(h1), F.col(h2), F.col(h3)).alias("verdict")).agg(F.count("*").alias("n"))


def within_limits(df: DataFrame, point: str, order: list[str], most: int, error: Column, most_errors: int) -> DataFrame:
    """A recorded run cut per point: at most ``most`` rows, and none behind the error that reaches the limit."""
    w = Window.partitionBy(point).orderBy(*order)
    before = F.coalesce(F.sum(F.when(error, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return df.withColumn("__n", F.row_number().over(w)).withColumn("__e", before).where((F.col("__n") <= most) & (F.col("__e") < most_errors)).drop("__n", "__e")


def apply_blocklist(projects: DataFrame, lines: DataFrame, name: str = "project") -> DataFrame:
    """Projects that aren't the first word of a line without #."""
    blocked = lines.where(~F.startswith(F.trim("line"), F.lit("#"))).select(F.split(F.trim("line"), r"\s+")[0].alias("__blocked")).where("__blocked <> ''").distinct()
    return projects.join(blocked, F.col(name).cast("string") == F.col("__blocked"), "left_anti")


def join_facts(facts: list[DataFrame], name: str = "name") -> DataFrame:
    """Facts of a project side by side."""
    out = facts[0]
    for f in facts[1:]:
        out = out.join(f, name)
    return out


def first_page_rows(pages: DataFrame, name: str = "name", order: tuple[str, ...] = ("page", "pos")) -> DataFrame:
    """Result pages united, the first row of each name kept."""
    nth = F.row_number().over(Window.partitionBy(name).orderBy(*order))
    return pages.withColumn("__nth", nth).where("__nth = 1").drop("__nth")
