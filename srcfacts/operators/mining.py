"""Mining of rules from recorded values.

A trace is a long table (seg, test, side, key, value): side is ``input`` or ``output``, value is text, missing values are null
or the text NA. Numbers are compared exactly, as decimals. All rules are found per segment; pairs of columns meet on
(seg, test) and are combined before they are shuffled, so that no segment has to fit into a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srcfacts.functions import text as X
from srcfacts.session import stored

MIN_ROWS = 3


def known(trace: DataFrame) -> DataFrame:
    """Without missing values. Rules on pairs of columns take the largest text of a key that a test repeats."""
    return trace.where(F.col("value").isNotNull() & (F.col("value") != "NA"))


def number(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(X.is_number(c), c.try_cast("decimal(18,0)"))


def is_address_key(key: Column) -> Column:
    return key.contains("addr")


def side(trace: DataFrame, which: str, key: str, value: str) -> DataFrame:
    return known(trace).where(F.col("side") == which).select("seg", "test", F.col("key").alias(key), F.col("value").alias(value))


def pairs(trace: DataFrame) -> DataFrame:
    """(seg, test, x, xv, y, yv): every input with every output of the same test.

    One test's values meet in one row and are exploded from there: a single shuffle and no join. A test has as many
    values as its program has variables in reach.
    """
    return _exploded(known(trace).withColumn("v", F.col("value"))).toDF("seg", "test", "x", "xv", "y", "yv")


def _tests(values: DataFrame) -> DataFrame:
    """(seg, test, ins, outs) of (seg, test, side, key, value, v): arrays of (key, v), each key once, with its largest value."""

    def mine(which: str) -> Column:
        cells = F.array_sort(F.collect_list(F.when(F.col("side") == which, F.struct("key", "value", "v"))))
        # sorted by key and value: the last of a key stays
        kept = F.filter(cells, lambda x, i: F.coalesce(F.get(cells, i + 1)["key"] != x["key"], F.lit(True)))
        return F.transform(kept, lambda x: F.struct(x["key"].alias("key"), x["v"].alias("v")))

    return values.groupBy("seg", "test").agg(mine("input").alias("ins"), mine("output").alias("outs"))


def _exploded(values: DataFrame) -> DataFrame:
    """(seg, test, x, a, y, b) of (seg, test, side, key, value, v)."""
    ins = _tests(values).select("seg", "test", "outs", F.explode("ins").alias("i")).select("seg", "test", "outs", F.col("i.key").alias("x"), F.col("i.v").alias("a"))
    return ins.select("seg", "test", "x", "a", F.explode("outs").alias("o")).select("seg", "test", "x", "a", F.col("o.key").alias("y"), F.col("o.v").alias("b"))


def _numbers(trace: DataFrame) -> DataFrame:
    return known(trace).where(~is_address_key(F.col("key"))).withColumn("v", number("value")).where("v is not null")


def number_pairs(trace: DataFrame) -> DataFrame:
    """(seg, test, x, a, y, b): ``pairs`` of the whole-number columns, as decimal(18,0), read once a value."""
    return _exploded(_numbers(trace))


#: Below this numbers are multiplied and summed as longs, exact for up to 2^33 rows; above it as decimals.
SMALL = 1 << 15


def _sum_of_products(p: str, q: str) -> Column:
    small = (F.abs(F.col(p)) < SMALL) & (F.abs(F.col(q)) < SMALL)
    quick = F.sum(F.when(small, F.col(p).cast("long") * F.col(q).cast("long")))
    exact = F.sum(F.when(~small, F.col(p) * F.col(q)))
    zero = F.lit(0).cast("decimal(38,0)")
    return F.coalesce(quick.cast("decimal(38,0)"), zero) + F.coalesce(exact.cast("decimal(38,0)"), zero)


#: Large products are summed in two halves, so that no sum leaves 38 digits.
SPLIT = 10**18


def _split_sums(p: str, q: str) -> list[Column]:
    """smallpq, lowpq and highpq as text: the sum of the products is small + low + SPLIT * high."""
    small = (F.abs(F.col(p)) < SMALL) & (F.abs(F.col(q)) < SMALL)
    product = (F.col(p) * F.col(q)).cast("decimal(38,0)")
    split = F.lit(SPLIT).cast("decimal(19,0)")
    low = product % split
    high = ((product - low) / split).cast("decimal(20,0)")
    text = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).cast("decimal(38,0)").cast("string").alias(f"{name}{p}{q}")
    return [text(F.when(small, F.col(p).cast("long") * F.col(q).cast("long")), "small"), text(F.when(~small, low), "low"), text(F.when(~small, high), "high")]


def select_trials(runs: DataFrame, option: str = "all") -> DataFrame:
    """fail: stopped at the point with a failure; success: stopped there without one; all: reached it."""
    reach, status = F.col("reach_code"), F.col("status_code")
    return runs.where({"fail": (reach == 5) & (status == 1), "success": (reach == 5) & (status == 0), "all": reach >= 5}[option])


def drop_status(runs: DataFrame) -> DataFrame:
    return runs.drop("reach_code", "status_code")


def wide(trace: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One row a test, one column a key named side_key, in the keys' order; missing is null."""
    named = trace.select("seg", "test", F.concat_ws("_", "side", "key").alias("column"), "value")
    pivot = named.groupBy("seg", "test").pivot("column", keys) if keys else named.groupBy("seg", "test").pivot("column")
    return pivot.agg(F.max("value"))


def long(runs: DataFrame, id_cols: tuple[str, ...] = ("seg", "test")) -> DataFrame:
    """Back from ``wide``: (seg, test, side, key, value) of what isn't missing."""
    melted = runs.unpivot(list(id_cols), [c for c in runs.columns if c.startswith(("input_", "output_"))], "column", "value").where("value is not null")
    return melted.select(*id_cols, F.substring_index("column", "_", 1).alias("side"), F.regexp_replace("column", "^(input|output)_", "").alias("key"), "value")


def trial_meta(runs: DataFrame) -> DataFrame:
    """Tests, tests that reached the point, tests that failed at it."""
    reach, status = F.col("reach_code"), F.col("status_code")
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return runs.groupBy("seg").agg(F.count("*").alias("tests"), one(reach >= 5).alias("reached"), one((reach == 5) & (status == 1)).alias("failed"))


def segment_flags(runs: DataFrame) -> DataFrame:
    reach, status = F.col("reach_code"), F.col("status_code")
    return runs.groupBy("seg").agg(F.max(reach >= 5).alias("covered"), F.max((reach == 5) & (status == 1)).alias("triggered"))


def reach_summary(runs: DataFrame) -> DataFrame:
    hit, good = F.col("reach_code") >= 5, F.col("status_code") == 0
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return runs.groupBy("seg").agg(
        one(hit & good).alias("reached_success"), one(hit & ~good).alias("reached_failure"), one(~hit & good).alias("missed_success"), one(~hit & ~good).alias("missed_failure"), F.count("*").alias("total")
    )


def constants(trace: DataFrame, which: str = "output", least: int = MIN_ROWS) -> DataFrame:
    """(seg, key, value, n) of columns with one value in ``least`` rows or more; ``(nil)`` reads nil."""
    found = known(trace).where(F.col("side") == which).groupBy("seg", "key").agg(F.count("value").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
    return found.where((F.col("n") >= least) & (F.col("low") == F.col("high"))).select("seg", "key", F.when(F.col("low") == "(nil)", "nil").otherwise(F.col("low")).alias("value"), "n")


def address_copies(trace: DataFrame) -> DataFrame:
    """(seg, x, y, n): an address that comes out as it went in, in three tests or more."""
    found = pairs(trace).where(is_address_key(F.col("x")) & is_address_key(F.col("y"))).groupBy("seg", "x", "y")
    return found.agg(F.count("*").alias("n"), F.min((F.col("xv") == F.col("yv"))).alias("same")).where((F.col("n") >= MIN_ROWS) & F.col("same")).drop("same")


def _exact(c: Column) -> Column:
    return c.cast("decimal(38,0)")


def linear(trace: DataFrame) -> DataFrame:
    """(seg, y, x, slope, intercept, n, rule): out = k * in + b that holds in every test, k a non-zero integer.

    The fit is exact: (n Sxy - Sx Sy)^2 = (n Sxx - Sx^2)(n Syy - Sy^2), tested as equality of every row with the line
    through the sums, in whole numbers. Columns that are constant have no line; sums that leave 38 digits give none.
    """
    both = number_pairs(trace)
    sums = both.groupBy("seg", "x", "y").agg(
        F.count("*").alias("n"), F.sum("a").cast("decimal(38,0)").alias("sx"), F.sum("b").cast("decimal(38,0)").alias("sy"), *[_exact(_sum_of_products(p, q)).alias(m) for p, q, m in (("a", "a", "sxx"), ("a", "b", "sxy"), ("b", "b", "syy"))]
    )
    n = F.col("n").cast("decimal(10,0)")
    product = lambda p, q: _exact(F.try_multiply(p, q))
    top = product(n, F.col("sxy")) - product(F.col("sx"), F.col("sy"))
    bottom = product(n, F.col("sxx")) - product(F.col("sx"), F.col("sx"))
    spread = product(n, F.col("syy")) - product(F.col("sy"), F.col("sy"))
    fit = sums.where("n >= 3").withColumn("top", _exact(top)).withColumn("bottom", _exact(bottom)).withColumn("spread", _exact(spread)).where("bottom <> 0 and spread <> 0")
    whole = fit.where(F.col("top") % F.col("bottom") == 0).withColumn("k", (F.col("top") / F.col("bottom")).cast("decimal(18,0)")).where("k <> 0")
    # r = 1: the spread of y is k times the common spread
    exact = whole.where(_exact(F.col("k")) * F.col("top") == F.col("spread"))
    intercept = F.round((F.col("sy").cast("double") - F.col("k").cast("double") * F.col("sx").cast("double")) / F.col("n"), 3)
    found = exact.select("seg", "y", "x", F.col("k").cast("long").alias("slope"), intercept.alias("intercept"), "n")
    return found.withColumn("rule", F.concat(F.col("y"), F.lit(" = "), X.formula(F.col("slope"), F.col("intercept"), F.col("x"))))


def linear_two(trace: DataFrame) -> DataFrame:
    """(seg, y, x1, x2, slope1, slope2, intercept, n): out = k1 in1 + k2 in2 + b in every test, both k non-zero integers.

    Normal equations in whole numbers of any size, from exact sums; inputs that depend on each other give no row, and slopes
    beyond 64 bits have no place in the result.
    """
    tests = _tests(_numbers(trace))
    couples = F.flatten(F.transform("ins", lambda p, i: F.transform(F.slice("ins", i + 2, F.size("ins")), lambda q: F.struct(p.alias("p"), q.alias("q")))))
    both = tests.select("seg", "test", "outs", F.explode(couples).alias("i")).select("seg", "test", "i", F.explode("outs").alias("o"))
    two = both.select("seg", F.col("i.p.key").alias("x1"), F.col("i.p.v").alias("a"), F.col("i.q.key").alias("x2"), F.col("i.q.v").alias("b"), F.col("o.key").alias("y"), F.col("o.v").alias("c"))
    products = [x for p, q in ("aa", "bb", "cc", "ab", "ac", "bc") for x in _split_sums(p, q)]
    s = two.groupBy("seg", "x1", "x2", "y").agg(F.count("*").alias("n"), *[F.sum(x).cast("string").alias(f"s{x}") for x in "abc"], *products)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                n, sums = int(r.n), {x: int(getattr(r, f"s{x}")) for x in "abc"}
                v = {p + q: n * sum(int(getattr(r, f"{part}{p}{q}")) * by for part, by in (("small", 1), ("low", 1), ("high", SPLIT))) - sums[p] * sums[q] for p, q in ("aa", "bb", "cc", "ab", "ac", "bc")}
                det = v["aa"] * v["bb"] - v["ab"] ** 2
                if not det or not v["cc"]:
                    continue
                (k1, rest1), (k2, rest2) = divmod(v["ac"] * v["bb"] - v["bc"] * v["ab"], det), divmod(v["bc"] * v["aa"] - v["ac"] * v["ab"], det)
                if not rest1 and not rest2 and k1 and k2 and k1 * v["ac"] + k2 * v["bc"] == v["cc"] and max(abs(k1), abs(k2)) < 1 << 63:
                    out.append((r.seg, r.y, r.x1, r.x2, k1, k2, float(sums["c"] - k1 * sums["a"] - k2 * sums["b"]), n))
            yield pd.DataFrame(out, columns=["seg", "y", "x1", "x2", "slope1", "slope2", "rest", "n"])

    found = s.where("n >= 3").mapInPandas(run, f"seg {trace.schema['seg'].dataType.simpleString()}, y string, x1 string, x2 string, slope1 long, slope2 long, rest double, n long")
    return found.select("seg", "y", "x1", "x2", "slope1", "slope2", F.round(F.col("rest") / F.col("n"), 3).alias("intercept"), "n")


def argument_outputs(trace: DataFrame, argument: str = "argv", least: int = MIN_ROWS, most_missed: float = 0.1) -> DataFrame:
    """(seg, y, n, missed): outputs that equal one of the test's argument values in all but a tenth of the tests."""
    arguments = side(trace, "input", "x", "xv").where(F.col("x").contains(argument)).select("seg", "test", "xv").distinct()
    outs = side(trace, "output", "y", "yv")
    some = arguments.select("seg").distinct()
    hit = outs.join(arguments, (outs["seg"] == arguments["seg"]) & (outs["test"] == arguments["test"]) & (outs["yv"] == arguments["xv"]), "left").select(outs["seg"], "y", F.when(F.col("xv").isNull(), 1).otherwise(0).alias("lost"))
    found = hit.join(some, "seg", "left_semi").groupBy("seg", "y").agg(F.count("*").alias("n"), F.sum("lost").alias("missed"))
    return found.where((F.col("n") >= least) & (F.col("missed") < most_missed * F.col("n")))


def relations(trace: DataFrame, strict: bool = False, least: int = 2, which: tuple[str, str] = ("input", "output")) -> DataFrame:
    """(seg, x, y, op, confidence): x op y in every common row: =, else <= (strict: <), else >= (strict: >)."""
    plain = which == ("input", "output")
    both = pairs(trace) if plain else side(trace, which[0], "x", "xv").join(side(trace, which[1], "y", "yv"), ["seg", "test"])
    both = both.where(is_address_key(F.col("x")) == is_address_key(F.col("y")))
    both = both if which[0] != which[1] else both.where("x < y")
    value = lambda c: F.coalesce(number(c).cast("decimal(20,0)"), X.address_value(F.col(c)))
    rows = both.select("seg", "x", "y", value("xv").alias("a"), value("yv").alias("b")).where("a is not null and b is not null")
    found = rows.groupBy("seg", "x", "y").agg(F.count("*").alias("confidence"), *[F.min(e).alias(n) for n, e in (("eq", F.expr("a = b")), ("lt", F.expr("a < b")), ("gt", F.expr("a > b")), ("le", F.expr("a <= b")), ("ge", F.expr("a >= b")))])
    op = F.when(F.col("eq"), "=")
    op = op.when(F.col("lt"), "<").when(F.col("gt"), ">") if strict else op
    op = op.when(F.col("le"), "<=").when(F.col("ge"), ">=")
    return found.where(F.col("confidence") >= least).withColumn("op", op).where("op is not null").select("seg", "x", "y", "op", "confidence")


def distances(trace: DataFrame, least: int = 2) -> DataFrame:
    """(seg, x, y, distance, n): out - in is the same in every common row, whole numbers and addresses."""
    value = lambda c: F.coalesce(number(c).cast("decimal(20,0)"), X.address_value(F.col(c)))
    both = pairs(trace).where(is_address_key(F.col("x")) == is_address_key(F.col("y"))).select("seg", "x", "y", (value("yv") - value("xv")).alias("d")).where("d is not null")
    found = both.groupBy("seg", "x", "y").agg(F.count("*").alias("n"), F.min("d").alias("low"), F.max("d").alias("high"))
    return found.where((F.col("n") >= least) & (F.col("low") == F.col("high"))).select("seg", "x", "y", F.col("low").cast("long").alias("distance"), "n")


def discovered_constants(trace: DataFrame, least: int = 2) -> DataFrame:
    """(seg, key, value long): whole-number columns, of either side, that never change."""
    both = constants(trace, "input", least).union(constants(trace, "output", least))
    return both.withColumn("value", number("value").cast("long")).where("value is not null").select("seg", "key", "value")


def preconditions(trace: DataFrame, least: int = 2) -> DataFrame:
    """(seg, x, constant, op): relation of each number input with each discovered constant of its segment."""
    found = discovered_constants(trace, least).select("seg", F.col("value").alias("constant")).distinct()
    ranges = side(trace, "input", "x", "xv").where(~is_address_key(F.col("x"))).withColumn("a", number("xv").cast("long")).where("a is not null").groupBy("seg", "x").agg(F.min("a").alias("low"), F.max("a").alias("high"), F.count("*").alias("n"))
    met = ranges.where(F.col("n") >= least).join(found, "seg")
    op = F.when((F.col("low") == F.col("constant")) & (F.col("high") == F.col("constant")), "=").when(F.col("high") <= F.col("constant"), "<=").when(F.col("low") >= F.col("constant"), ">=")
    return met.select("seg", "x", "constant", op.alias("op")).where("op is not null")


OPS = ("=", "==", "!=", "<", "<=", ">", ">=")


def _holds(op: Column, left: Column, right: Column) -> Column:
    return F.when(op.isin("=", "=="), left == right).when(op == "!=", left != right).when(op == "<", left < right).when(op == "<=", left <= right).when(op == ">", left > right).when(op == ">=", left >= right)


def parse_formulas(formulas: DataFrame) -> DataFrame:
    """(formula) to (formula, lhs, op, r1, r2): ``lhs op r1`` or ``lhs op r1 + r2``; names as side_key, numbers as they are."""
    parts = formulas.withColumn("p", X.condition_parts(F.col("formula")))
    terms = F.transform(F.split(F.col("p.rhs"), r"\+"), lambda t: F.trim(t))
    return parts.select("formula", F.col("p.lhs").alias("lhs"), F.col("p.op").alias("op"), terms[0].alias("r1"), F.get(terms, 1).alias("r2")).where("op is not null")


def evaluate(trace: DataFrame, formulas: DataFrame) -> DataFrame:
    """(seg, test, formula, holds) for every test that has all values of the formula. ``(nil)`` and nil are 0.

    A test's named values meet in one row, and every formula - a list written by hand, read by the driver - is decided on it.
    """
    parsed = parse_formulas(formulas).distinct().collect()
    names = sorted({x for f in parsed for x in (f.lhs, f.r1, f.r2) if x is not None})
    value = F.coalesce(number("value").cast("decimal(20,0)"), X.address_value(F.col("value")))
    cells = known(trace).select("seg", "test", F.concat_ws("_", "side", "key").alias("name"), value.alias("v")).where(F.col("name").isin(names) & F.col("v").isNotNull())
    # one column a name; of a repeated key the largest value
    tests = cells.groupBy("seg", "test").agg(*[F.max(F.when(F.col("name") == n, F.col("v"))).alias(f"v{i}") for i, n in enumerate(names)])
    of = {n: F.col(f"v{i}") for i, n in enumerate(names)}

    def term(name: str) -> Column:
        return F.coalesce(of[name], (F.lit(0) if name in ("nil", "(nil)", "NULL") else F.lit(name).try_cast("decimal(20,0)")).cast("decimal(20,0)"))

    decided = [F.struct(F.lit(f.formula).alias("formula"), _holds(F.lit(f.op), of[f.lhs], term(f.r1) + (term(f.r2) if f.r2 is not None else F.lit(0).cast("decimal(20,0)"))).alias("holds")) for f in parsed]
    if not decided:
        return trace.select("seg", "test", F.lit("").alias("formula"), F.lit(True).alias("holds")).limit(0)
    return tests.select("seg", "test", F.explode(F.array(*decided)).alias("d")).select("seg", "test", "d.formula", "d.holds").where("holds is not null")


def check_templates(trace: DataFrame, formulas: DataFrame) -> DataFrame:
    """(seg, formula, n): formulas that hold in every test that has their values."""
    found = evaluate(trace, formulas).groupBy("seg", "formula").agg(F.count("*").alias("n"), F.min("holds").alias("always"))
    return found.where("always").drop("always")


def condition_truth(trace: DataFrame, formulas: DataFrame) -> DataFrame:
    """(seg, formula, truth): always, never or sometimes on the rows at hand; unknown if no row has the values."""
    found = evaluate(trace, formulas).groupBy("seg", "formula").agg(F.min("holds").alias("every"), F.max("holds").alias("some"))
    listed = sorted({r.formula for r in formulas.select("formula").collect() if r.formula is not None})  # written by hand
    asked = trace.select("seg").distinct().select("seg", F.explode(F.array(*map(F.lit, listed)) if listed else F.expr("cast(array() as array<string>)")).alias("formula"))
    truth = F.when(F.col("every"), "always").when(~F.col("some"), "never").when(F.col("some"), "sometimes").otherwise("unknown")
    return asked.join(found, ["seg", "formula"], "left").select("seg", "formula", truth.alias("truth"))


def column_ranges(trace: DataFrame) -> DataFrame:
    """(seg, side, key, n, low, high) of number columns."""
    return known(trace).withColumn("v", number("value").cast("long")).where("v is not null").groupBy("seg", "side", "key").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))


def full_pairs(trace: DataFrame, more_than: int = 5) -> DataFrame:
    """(seg, x, y, op): relation of two columns where neither misses a value in any test and over ``more_than`` rows count."""
    tests = trace.groupBy("seg").agg(F.count_distinct("test").alias("tests"))
    named = known(trace).select("seg", "test", F.concat_ws("_", "side", "key").alias("key"), number("value").cast("long").alias("v")).where("v is not null")
    full = named.groupBy("seg", "key").agg(F.count("*").alias("n")).join(tests, "seg").where("n = tests").where(F.col("n") > more_than).select("seg", "key")
    kept = named.join(full, ["seg", "key"], "left_semi")
    both = kept.select("seg", "test", F.col("key").alias("x"), F.col("v").alias("a")).join(kept.select("seg", "test", F.col("key").alias("y"), F.col("v").alias("b")), ["seg", "test"]).where("x < y")
    found = both.groupBy("seg", "x", "y").agg(F.min(F.expr("a = b")).alias("eq"), F.min(F.expr("a <= b")).alias("le"), F.min(F.expr("a >= b")).alias("ge"))
    return found.select("seg", "x", "y", F.when(F.col("eq"), "=").when(F.col("le"), "<=").when(F.col("ge"), ">=").alias("op")).where("op is not null")


def sign_facts(trace: DataFrame) -> DataFrame:
    """(seg, side, key, fact): sign of number columns, ``not null`` of address columns."""
    signs = column_ranges(trace).select("seg", "side", "key", F.when(F.col("low") > 0, "0<").when(F.col("low") >= 0, "0<=").when(F.col("high") < 0, "<0").when(F.col("high") <= 0, "<=0").alias("fact")).where("fact is not null")
    null = (F.col("value") == "(nil)") | (X.address_value(F.col("value")) == 0)
    filled = known(trace).where(is_address_key(F.col("key"))).groupBy("seg", "side", "key").agg(F.max(F.coalesce(null, F.lit(False))).alias("empty")).where(~F.col("empty")).select("seg", "side", "key", F.lit("not null").alias("fact"))
    return signs.union(filled)


def pair_facts(trace: DataFrame) -> DataFrame:
    """(seg, x, y, fact): number columns of either side where x is never above y in any test that has both: ``<``, or ``<=``
    where they are equal somewhere. Both must have a value in the same number of tests, two at least; x and y are side_key."""
    numbers = _numbers(trace).select("seg", "test", "key", "value", F.col("v"), F.lit("input").alias("side"), F.concat_ws("_", F.col("side"), "key").alias("name")).drop("key").withColumnRenamed("name", "key")
    counts = numbers.groupBy("seg", "key").agg(F.count_distinct("test").alias("n"))
    tests = _tests(numbers).select("seg", F.explode(F.flatten(F.transform("ins", lambda p: F.transform("ins", lambda q: F.struct(p.alias("p"), q.alias("q")))))).alias("i"))
    two = tests.select("seg", F.col("i.p.key").alias("x"), F.col("i.q.key").alias("y"), F.col("i.p.v").alias("a"), F.col("i.q.v").alias("b")).where("x <> y")
    found = two.groupBy("seg", "x", "y").agg(F.count("*").alias("common"), F.min(F.expr("a <= b")).alias("le"), F.max(F.expr("a = b")).alias("eq")).where("le and common >= 2")
    same = found.join(counts.toDF("seg", "x", "nx"), ["seg", "x"]).join(counts.toDF("seg", "y", "ny"), ["seg", "y"]).where("nx = ny")
    return same.select("seg", "x", "y", F.when(F.col("eq"), "<=").otherwise("<").alias("fact"))


def column_classes(trace: DataFrame) -> DataFrame:
    """(seg, side, key, class): unchanged, binary (0 and 1) or changed."""
    found = known(trace).groupBy("seg", "side", "key").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.min(F.col("value").isin("0", "1")).alias("bits"))
    return found.select("seg", "side", "key", F.when(F.col("low") == F.col("high"), "unchanged").when(F.col("bits"), "binary").otherwise("changed").alias("class"))


def features(runs: DataFrame, columns: list[str]) -> DataFrame:
    """Products, quotients, squares and cubes of number columns; squares of the first half only; not finite = null."""
    cols = [F.col(c).cast("double") for c in columns]
    finite = lambda e: F.when(F.abs(e) < float("inf"), e)
    made = {f"{a}_x_{b}": finite(x * z) for i, (a, x) in enumerate(zip(columns, cols, strict=True)) for b, z in list(zip(columns, cols, strict=True))[i + 1 :]}
    made |= {f"{a}_by_{b}": finite(F.try_divide(x, z)) for a, x in zip(columns, cols, strict=True) for b, z in zip(columns, cols, strict=True) if a != b}
    made |= {f"{a}_2": finite(x * x) for a, x in list(zip(columns, cols, strict=True))[: (len(columns) + 1) // 2]}
    made |= {f"{a}_3": finite(x * x * x) for a, x in zip(columns, cols, strict=True)}
    return runs.withColumns(made)


def run_differences(left: DataFrame, right: DataFrame, least: int = MIN_ROWS) -> DataFrame:
    """(key, difference, n): columns whose difference between two runs is constant; inputs (row, key, value)."""
    both = left.select("row", "key", number("value").alias("a")).join(right.select("row", "key", number("value").alias("b")), ["row", "key"]).withColumn("d", F.col("b") - F.col("a")).where("d is not null")
    found = both.groupBy("key").agg(F.count("*").alias("n"), F.min("d").alias("low"), F.max("d").alias("high"))
    return found.where((F.col("n") >= least) & (F.col("low") == F.col("high"))).select("key", F.col("low").cast("long").alias("difference"), "n")


def _output_names(condition: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(condition, F.lit(r"(output_[\w.\[\]]+)"), F.lit(1)))


def used_transfers(transfers: DataFrame, conditions: DataFrame) -> DataFrame:
    """(id, seg, lhs, rhs): the first rhs of each output that a condition names; a constant rhs doesn't count if it is the
    only output. transfers: (seg, lhs, rhs, pos); conditions: (id, condition)."""
    first = transfers.groupBy("seg", "lhs").agg(F.min_by("rhs", "pos").alias("rhs"))
    names = conditions.select("id", _output_names(F.col("condition")).alias("names")).select("id", F.size("names").alias("k"), F.explode("names").alias("lhs"))
    found = names.join(first, "lhs")
    return found.where(~((F.col("k") == 1) & X.is_number(F.col("rhs")))).select("id", "seg", "lhs", "rhs")


def is_entry(rhs: Column) -> Column:
    """All ``input`` names of the text belong to the program's entry."""
    tokens = F.regexp_extract_all(rhs, F.lit(r"(input[\w.\[\]]*)"), F.lit(1))
    return F.forall(tokens, lambda t: t.contains("argc") | t.contains("argv") | t.contains("entry"))


def mappable(transfers: DataFrame, conditions: DataFrame) -> DataFrame:
    """(id, seg, mapped): whether every output of the condition has an rhs that depends only on the entry."""
    names = conditions.select("id", _output_names(F.col("condition")).alias("names")).select("id", F.size("names").alias("k"), F.explode("names").alias("lhs"))
    transfers = stored(transfers.select("seg", "lhs", "rhs").distinct())  # mined once, read twice
    good = transfers.where(is_entry(F.col("rhs"))).select("seg", "lhs").distinct()
    segs = transfers.select("seg").distinct()
    counted = names.join(good, "lhs").groupBy("id", "seg").agg((F.count("*") == F.max("k")).alias("mapped"))
    ids = names.agg(F.collect_set("id").alias("ids")).first().ids  # conditions are written by hand
    asked = segs.select("seg", F.explode(F.lit(ids) if ids else F.lit(ids).cast(f"array<{conditions.schema['id'].dataType.simpleString()}>")).alias("id"))
    return asked.join(counted, ["id", "seg"], "left").select("id", "seg", F.coalesce("mapped", F.lit(False)).alias("mapped"))


def merge_segments(profiles: DataFrame, method: str = "transfer", seed: int = 0) -> DataFrame:
    """(head, merged array): segments of one head with equal profiles; profiles: (seg, head, transfer, transfer_all).

    transfer and transfer-all compare those columns, aggressive merges a head's all, random every second by a seeded
    hash, no none.
    """
    key = {"transfer": F.col("transfer"), "transfer-all": F.col("transfer_all"), "aggressive": F.lit(""), "random": F.pmod(F.xxhash64("seg", F.lit(seed)), F.lit(2)).cast("string"), "no": F.col("seg").cast("string")}[method]
    return profiles.groupBy("head", key.alias("key")).agg(F.array_sort(F.collect_list("seg")).alias("merged")).select("head", "merged")
