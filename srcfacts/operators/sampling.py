"""Seeded samples and tables of test inputs.

Choices follow whole-number arithmetic on ids, so that another engine repeats them; ranks run within groups (files,
functions), and over all rows only for ``at_most``, where the engine's ordered limit does it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from srcfacts.operators.logs import number_rows
from srcfacts.session import cut

MODULUS = 2147483648


def seeded(id_col: Column, seed: int = 0) -> Column:
    """A number in [0, 2^31) that the id and the seed fix."""
    return F.pmod(F.pmod(id_col.cast("long") + seed, F.lit(MODULUS)) * 1103515245 + 12345, F.lit(MODULUS))


#: Rows of a group in one range of its seeded numbers, about.
RANGE_ROWS = 4096


def _lowest(rows: DataFrame, group: str, id_col: str, quotas: DataFrame | None, n: int, seed: int) -> DataFrame:
    """Of each group its quota of rows with the lowest seeded numbers; quotas: (group, __quota), none: n rows each.

    Counts per range of numbers say which ranges lie within the quota; only rows of those are ranked, each range apart.
    """
    placed = rows.select("*", F.struct(group).alias("__g"), seeded(F.col(id_col), seed).alias("__h"))
    largest = placed.groupBy("__g").count().agg(F.max("count")).first()[0] or 0
    placed = placed.withColumn("__range", F.floor(F.col("__h") * max(1, -(-largest // RANGE_ROWS)) / MODULUS))
    counts = placed.groupBy("__g", "__range").agg(F.count("*").alias("__c"))
    counts = counts.withColumn("__before", F.sum("__c").over(Window.partitionBy("__g").orderBy("__range")) - F.col("__c"))
    counts = counts.withColumn("__quota", F.lit(n)) if quotas is None else counts.join(quotas.select(F.struct(group).alias("__g"), "__quota"), "__g")
    within = placed.join(counts.where("__before < __quota").drop("__c"), ["__g", "__range"])
    nth = F.row_number().over(Window.partitionBy("__g", "__range").orderBy("__h", id_col))
    return within.withColumn("__n", nth + F.col("__before")).where("__n <= __quota").select(*rows.columns)


def per_group(rows: DataFrame, group: str, id_col: str, n: int, seed: int = 0) -> DataFrame:
    """n rows of each group without replacement; groups with fewer give all."""
    return _lowest(rows, group, id_col, None, n, seed)


def proportional(rows: DataFrame, group: str, id_col: str, total: int = 1000, seed: int = 0) -> DataFrame:
    """Of each group its size times ``total`` over all rows, in whole numbers."""
    sizes = rows.groupBy(group).agg(F.count("*").alias("__size"))
    everything = sizes.agg(F.sum("__size").alias("s")).first()[0] or 1
    quotas = sizes.select(group, F.floor(F.col("__size") * total / everything).alias("__quota"))
    return _lowest(rows, group, id_col, quotas, 0, seed)


def _twice(number: Column, seed: int) -> Column:
    return seeded(seeded(number, seed), seed)


def random_selections(tokens: DataFrame, k: int, count: int, mode: str = "same function", group: str = "function", id_col: str = "id", seed: int = 0) -> DataFrame:
    """(sel_id, id): selections 0..count-1 of k distinct tokens (function, id) each; where too few are there: empty.

    mode: ``same function``, each selection in one function drawn from those with k tokens or more; ``functions``, over all
    tokens that have a function; ``all``, over all tokens. Draws are by whole-number arithmetic on selection and id.
    """
    spark = tokens.sparkSession
    if mode == "same function":
        fit = tokens.where(F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("n")).where(F.col("n") >= k).select(group)
        numbered = cut(number_rows(fit, [group], "nth", 0))
        n = numbered.count()
        if not n:
            return tokens.select(F.lit(0).cast("long").alias("sel_id"), id_col).limit(0)
        drawn = spark.range(count).select(F.col("id").alias("sel_id"), (_twice(F.col("id") * 4099, seed) % n).alias("nth")).join(numbered, "nth")
        w = Window.partitionBy("sel_id").orderBy(_twice(F.col(id_col) + F.col("sel_id"), seed), id_col)
        return tokens.join(drawn, group).withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= k).select("sel_id", id_col)
    pool = tokens.where(F.col(group).isNotNull()) if mode == "functions" else tokens
    numbered = cut(number_rows(pool.select(id_col), [id_col], "nth", 0))
    n = numbered.count()
    if n < k:
        return tokens.select(F.lit(0).cast("long").alias("sel_id"), id_col).limit(0)
    draw = lambda j: _twice(F.col("sel_id") * 4099 + j, seed)
    if n <= 4 * k:  # nearly all are drawn: the k lowest of the numbers themselves
        order = F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda j: F.struct(draw(j).alias("h"), j.cast("long").alias("nth"))))
        places = F.transform(F.slice(order, 1, k), lambda x: x["nth"])
    else:  # draws with replacement, repeats left out
        places = F.slice(F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(16 * k + 64)), lambda j: draw(j) % n)), 1, k)
    drawn = spark.range(count).select(F.col("id").alias("sel_id")).select("sel_id", F.explode(places).alias("nth"))
    return drawn.join(numbered, "nth").select("sel_id", id_col)


def at_most(rows: DataFrame, id_col: str, n: int, seed: int = 0) -> DataFrame:
    return rows.orderBy(seeded(F.col(id_col), seed), id_col).limit(n)


def one_in(rows: DataFrame, id_col: str, r: int, seed: int = 0, done: DataFrame | None = None, listed: DataFrame | None = None) -> DataFrame:
    """Every r-th row by seeded number; without those done, or only those listed."""
    out = rows.where(seeded(F.col(id_col), seed) % r == 0)
    out = out.join(done.select(id_col), id_col, "left_anti") if done is not None else out
    return out.join(listed.select(id_col), id_col, "left_semi") if listed is not None else out


def random_values(tests: DataFrame, variables: DataFrame, seed: int = 0, low: int = -100, high: int = 100, most_length: int = 10, null_percent: int = 10) -> DataFrame:
    """(test, name, type, value): a value of each variable (name, type) in each test (a number): int, char, bool, string, array
    and pointer. variables is a list of a program's inputs, read by the driver; each test gets each of them."""
    listed = sorted((v["name"], v["type"]) for v in variables.select("name", "type").collect())
    none = F.expr("cast(array() as array<struct<name:string,type:string,at:int>>)")
    cells = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(t).alias("type"), F.lit(i).alias("at")) for i, (n, t) in enumerate(listed)]) if listed else none
    rows = tests.select("test", F.explode(cells).alias("v")).select("test", "v.name", "v.type", "v.at")
    draw = lambda i: seeded(seeded(seeded(F.col("test"), seed) + F.col("at") * 7919) + i)
    # the low bits of such numbers repeat soon: the high ones are used
    below = lambda i, n: F.floor(draw(i) / 1024) % n
    char = lambda i: F.char(F.lit(97) + below(i, 26))
    text = F.substring(F.concat(*[char(i) for i in range(2, 2 + most_length)]), F.lit(1), below(1, most_length + 1).cast("int"))
    number = lambda i: (F.lit(low) + below(i, high - low + 1)).cast("string")
    value = (
        F.when(F.col("type") == "int", number(0)).when(F.col("type") == "char", char(0)).when(F.col("type") == "bool", below(0, 2).cast("string")).when(F.col("type") == "string", text)
        .when(F.col("type") == "array", F.array_join(F.array(*[number(i) for i in range(4)]), ","))
        .when(F.col("type") == "pointer", F.when(below(0, 100) < null_percent, "(nil)").otherwise(F.concat(F.lit("0x"), F.lower(F.hex(draw(1) + 4096)))))
    )
    return rows.withColumn("value", value).drop("at")


def corners(base: Column) -> Column:
    """A base value (array of one or more) and its neighbours up to 2 away, each once, in order."""
    return F.array_sort(F.array_distinct(F.flatten(F.transform(base, lambda v: F.transform(F.sequence(F.lit(-2), F.lit(2)), lambda d: v + d)))))


#: Corner values of any number: 0, and 1 to 512 by doubling.
POWERS = (0, *(2**i for i in range(10)))


def corner_values(bases: DataFrame, key: str, value: str, size: str | None = None) -> DataFrame:
    """(key, value) of each row (key, value): the row's base value, 0, 1..512 by doubling and, where ``size`` is named, the size
    of its buffer, each with its neighbours up to 2 away; nulls bring nothing."""
    given = F.array(F.col(value).cast("long"), *([F.col(size).cast("long")] if size else []), *[F.lit(p).cast("long") for p in POWERS])
    return bases.select(key, F.explode(corners(F.filter(given, lambda v: v.isNotNull()))).alias("value"))


def _combinations(cells: Column) -> Column:
    """Pairs (p, q) of an array, p before q."""
    return F.flatten(F.transform(cells, lambda p, i: F.transform(F.slice(cells, i + 2, F.size(cells)), lambda q: F.struct(p.alias("p"), q.alias("q")))))


def text_number(text: Column) -> Column:
    """A number from the first eight digits of a text's md5, which other engines repeat."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def pairwise_pool(values: DataFrame) -> DataFrame:
    """(test, name, value): for each pair of variables all pairs of their values, the others drawn by the text of the test; one
    variable: its values.

    values: (name, value), the few corner values of a program's inputs: they meet in one row.
    """
    names = values.groupBy("name").agg(F.array_sort(F.collect_set("value")).alias("all"))
    table = names.agg(F.array_sort(F.collect_list(F.struct("name", "all"))).alias("names")).where(F.size("names") > 0)
    single = table.where(F.size("names") == 1).select(F.explode("names").alias("n")).select("n.name", F.explode("n.all").alias("value")).select(F.concat_ws("=", "name", "value").alias("test"), "name", "value")
    met = table.select("names", F.explode(_combinations(F.col("names"))).alias("c"))
    met = met.select("names", "c", F.explode("c.p.all").alias("v1")).select("names", "c", "v1", F.explode("c.q.all").alias("v2"))
    tests = met.select("names", F.col("c.p.name").alias("n1"), "v1", F.col("c.q.name").alias("n2"), "v2")
    tests = tests.withColumn("test", F.concat_ws(",", F.concat_ws("=", "n1", "v1"), F.concat_ws("=", "n2", "v2")))
    every = tests.select("test", "n1", "v1", "n2", "v2", F.explode("names").alias("x")).select("test", "n1", "v1", "n2", "v2", "x.name", "x.all")
    drawn = F.element_at("all", (text_number(F.concat_ws("|", "test", "name")) % F.size("all") + 1).cast("int"))
    value = F.when(F.col("name") == F.col("n1"), F.col("v1")).when(F.col("name") == F.col("n2"), F.col("v2")).otherwise(drawn)
    return every.select("test", "name", value.alias("value")).union(single)


def pair_cases(tests: DataFrame) -> DataFrame:
    """(name1, value1, name2, value2, test): the pairs of values that each test covers, one row each. tests: (test, name, value)."""
    cells = tests.groupBy("test").agg(F.array_sort(F.collect_list(F.struct("name", "value"))).alias("cells"))  # a test's variables
    met = cells.select("test", F.explode(_combinations(F.col("cells"))).alias("c")).where("c.p.name < c.q.name")
    return met.select(F.col("c.p.name").alias("name1"), F.col("c.p.value").alias("value1"), F.col("c.q.name").alias("name2"), F.col("c.q.value").alias("value2"), "test")


def pair_coverage(tests: DataFrame) -> DataFrame:
    """(name1, value1, name2, value2, n): in how many tests each pair of values of two variables occurs, the pairs of the full
    grid that never do included; ``pair_cases`` names the tests."""
    seen = pair_cases(tests).groupBy("name1", "value1", "name2", "value2").agg(F.count("*").alias("n"))
    # each couple of variables once, by the names alone; then the values of one side and the other
    names = tests.select("name").distinct().agg(F.array_sort(F.collect_list("name")).alias("names"))
    couples = names.select(F.explode(_combinations(F.col("names"))).alias("c")).select(F.col("c.p").alias("name1"), F.col("c.q").alias("name2"))
    known = tests.select("name", "value").distinct()
    grid = couples.join(known.toDF("name1", "value1"), "name1").join(known.toDF("name2", "value2"), "name2")
    return grid.join(seen, ["name1", "value1", "name2", "value2"], "left").select("name1", "value1", "name2", "value2", F.coalesce("n", F.lit(0)).alias("n"))
