"""Facts about code: spans, names, includes, libraries, declarations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from srcfacts.functions import text as X
from srcfacts.operators.graph import topo_rank
from srcfacts.operators.scan import scanned
from srcfacts.session import cut, stored

#: Lines of one block when spans meet.
BLOCK = 64
#: Pairs of callers and functions that one part of a name makes, and parts of all names (more pairs a part beyond).
PAIRS, MOST_PARTS = 1 << 24, 4096


def _cells(begin: Column, end: Column, block: int) -> Column:
    """The fewest cells that make up the blocks of a span: (level, at), a cell of a level being 2^level blocks from at * 2^level on.

    At each level an odd first block and an even last block stay, and the blocks between go on in twos: two cells a level at most.
    """
    first, last = F.floor(begin / block).cast("long"), F.floor(F.greatest(begin, end) / block).cast("long")
    cell = "array<struct<level:int,at:bigint>>"
    make = lambda on, level, at: F.when(on, F.array(F.struct(level.cast("int").alias("level"), at.alias("at")))).otherwise(F.array()).cast(cell)

    def step(state: Column, level: Column) -> Column:
        low, high = state["low"], state["high"]
        there = low <= high
        odd = there & (low % 2 != 0)
        even = there & (high % 2 == 0) & (~odd | (high > low))
        found = F.concat(state["cells"], make(odd, level, low), make(even, level, high))
        # floor of (low + 1) / 2 and of (high - 1) / 2, for negative places too
        return F.struct(F.shiftright(low + 1, 1).alias("low"), F.shiftright(high - 1, 1).alias("high"), found.alias("cells"))

    levels = F.sequence(F.lit(0), F.ceil(F.log2((last - first + 2).cast("double"))).cast("int"))
    start = F.struct(first.alias("low"), last.alias("high"), F.array().cast(cell).alias("cells"))
    return F.aggregate(levels, start, step, lambda x: x["cells"])


def covering(points: DataFrame, spans: DataFrame, key: str = "file", block: int = BLOCK, at: str = "at") -> DataFrame:
    """(key, p, s): structs of points (key, at, ..) and of the spans (key, begin, end, ..) of their key around them, ends included;
    spans that end before they begin are around nothing.

    A span stands in the few cells of a dyadic grid that make it up, two a level at most; a point asks the cell around it at each level
    that some span has. They meet by an equi-join, each pair in one cell, however long the spans are.
    """
    some = spans.where("begin <= end")
    longest = some.agg(F.max(F.floor(F.col("end") / block) - F.floor(F.col("begin") / block))).first()[0] or 0  # blocks; a level for each of its bits
    s = some.select(F.col(key), F.struct("*").alias("s"), F.explode(_cells(F.col("begin"), F.col("end"), block)).alias("__cell"))
    ask = F.explode(F.array(*[F.struct(F.lit(x).alias("level"), F.shiftright(F.floor(F.col(at) / block).cast("long"), x).alias("at")) for x in range(max(1, (int(longest) + 1).bit_length()))]))
    p = points.select(F.col(key), F.struct("*").alias("p"), ask.alias("__cell"))
    return p.join(s, [key, "__cell"]).where(F.col(f"p.{at}").between(F.col("s.begin"), F.col("s.end"))).select(key, "p", "s")


def overlapping(left: DataFrame, right: DataFrame, key: str = "file", block: int = BLOCK) -> DataFrame:
    """(key, l, r): structs of rows whose spans [begin, end] share a line, each pair once.

    The later begin of both lies in the other span: each side's begins are points in the spans of the other.
    """
    one = covering(left.where("begin <= end").withColumn("__at", F.col("begin")), right, key, block, "__at")
    two = covering(right.where("begin <= end").withColumn("__at", F.col("begin")), left, key, block, "__at").where("p.begin > s.begin")
    fields = lambda side, df: F.struct(*[F.col(f"{side}.{c}").alias(c) for c in df.columns])
    return one.select(key, fields("p", left).alias("l"), fields("s", right).alias("r")).union(two.select(key, fields("s", left), fields("p", right)))


def enclosing(spans: DataFrame, block: int = BLOCK) -> DataFrame:
    """(src, dst): dst comes before src in the order (begin, end descending) of their file and src begins before dst ends.

    spans: (file, id, begin, end); equal spans are ordered by id.
    """
    met = covering(spans.withColumn("__at", F.col("begin")), spans, block=block, at="__at")  # what comes before begins before: src begins in it
    before = F.struct("s.begin", (-F.col("s.end")).alias("e"), "s.id") < F.struct("p.begin", (-F.col("p.end")).alias("e"), "p.id")
    return met.where(before & (F.col("p.begin") < F.col("s.end"))).select(F.col("p.id").alias("src"), F.col("s.id").alias("dst"))


def select_tokens(selection: DataFrame, spans: DataFrame, block: int = BLOCK) -> DataFrame:
    """(sel_id, id): tokens that a selection touches: a line within their lines, or a location within their span.

    selection: (sel_id, file, line, col or null); spans: (file, id, begin, end, begin_col, end_col).
    """
    met = covering(selection.withColumn("at", F.col("line")), spans, block=block)
    at = F.struct(F.col("p.line").cast("long"), F.col("p.col").cast("long"))
    inside = (F.struct(F.col("s.begin").cast("long"), F.col("s.begin_col").cast("long")) <= at) & (at <= F.struct(F.col("s.end").cast("long"), F.col("s.end_col").cast("long")))
    return met.where(F.col("p.col").isNull() | inside).select("p.sel_id", "s.id").distinct()


def innermost(points: DataFrame, spans: DataFrame, block: int = BLOCK) -> DataFrame:
    """(file, line, id): the smallest span around each (file, line); ties go to the smallest id."""
    met = covering(points.select("file", "line", F.col("line").alias("at")).distinct(), spans, block=block)
    return met.groupBy("file", "p.line").agg(F.min_by("s.id", F.struct(F.col("s.end") - F.col("s.begin"), F.col("s.id"))).alias("id"))


def latest_before(points: DataFrame, starts: DataFrame, key: str, at: str, start: str, id_col: str) -> DataFrame:
    """Points with ``start``: the greatest start of their key that lies before them (0 if none): an as-of merge in pieces.

    Points and starts are merged in one order, points before the starts of their place; pieces of the merge are of one size
    whatever the keys are, and each takes the latest start of the pieces before it along.
    """
    both = points.select(F.col(key), F.col(at).alias("__at"), F.col(id_col).alias("__id"), F.lit(0).alias("__kind")).unionByName(
        starts.select(F.col(key), F.col(start).alias("__at"), F.lit(1).alias("__kind")).distinct(), allowMissingColumns=True
    )
    found = scanned(both, last={"__start": F.when(F.col("__kind") == 1, F.col("__at"))}, keys=(key,), order=("__at", "__kind", "__id")).where("__kind = 0")
    return found.select(F.col(key), F.col("__at").alias(at), F.col("__id").alias(id_col), F.coalesce("__start", F.lit(0)).alias("start"))


def dependences(snippets: DataFrame, keys: DataFrame, own_name: str = "name") -> DataFrame:
    """(src, dst): snippets whose code names a key of another; their own name and themselves are left out.

    snippets: (id, name, code); keys: (id, key).
    """
    used = snippets.select(F.col("id").alias("src"), F.col(own_name).alias("own"), F.explode(X.identifiers(F.col("code"))).alias("key")).where("key <> own")
    return used.join(keys.select("key", F.col("id").alias("dst")), "key").where("src <> dst").select("src", "dst").distinct()


def lookup(snippets: DataFrame, keys: DataFrame, wanted: list[str], kinds: list[str] | None = None) -> DataFrame:
    """Snippets with one of the keys and kinds; no kinds: all."""
    hit = keys.where(F.col("key").isin(wanted)).select("id").distinct()
    found = snippets.join(hit, "id", "left_semi")
    return found.where(F.col("kind").isin(kinds)) if kinds else found


def include_edges(includes: DataFrame, files: DataFrame) -> DataFrame:
    """(src, dst): quoted targets that are path suffixes of project files, all of them, not the file itself.

    includes: (file, target, is_system); files: (file).
    """
    targets = includes.where("not is_system").select(F.col("file").alias("src"), "target", X.last_component(F.col("target")).alias("base"))
    named = files.select(F.col("file").alias("dst"), X.last_component(F.col("file")).alias("base"))
    return targets.join(named, "base").where(X.has_path_suffix(F.col("dst"), F.col("target")) & (F.col("src") != F.col("dst"))).select("src", "dst").distinct()


def header_library(headers: DataFrame, libraries: DataFrame, prefixes: list[str]) -> DataFrame:
    """(target, package): the first library, in catalogue order, with a header of which the target is a suffix and what
    remains is one of the include paths. libraries: (pos, package, header)."""
    asked = headers.select("target").distinct().withColumn("base", X.last_component(F.col("target")))
    known = libraries.select("pos", "package", "header", X.last_component(F.col("header")).alias("base"))
    met = asked.join(known, "base").where(X.has_path_suffix(F.col("header"), F.col("target")))
    met = met.where(X.path_without_suffix(F.col("header"), F.col("target")).isin(prefixes))
    return met.groupBy("target").agg(F.min_by("package", F.struct("pos", "header")).alias("package"))


def unsupported(headers: DataFrame, known: DataFrame) -> DataFrame:
    """Targets that are in no library, or local includes found nowhere."""
    return headers.select("target").distinct().join(known.select("target"), "target", "left_anti")


def call_graph(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """(src, dst): callee names to every function of that name, each pair once. calls: (id, callees array); functions: (id, name).

    A pair comes from the first name that both have, so that the result isn't shuffled. The callers of a name with over ``PAIRS`` pairs are
    dealt into parts, each of which meets all functions of the name.
    """
    none = F.expr("cast(array() as array<string>)")
    sets = lambda df, own, names: df.select(F.col("id").alias(own), F.coalesce(names, none).alias("x")).groupBy(own).agg(F.array_sort(F.array_distinct(F.array_compact(F.flatten(F.collect_list("x"))))).alias("names"))
    caller = sets(calls, "src", F.col("callees")).select("src", F.col("names").alias("called"), F.posexplode("names").alias("at", "name"))
    caller = caller.select("src", "name", F.slice("called", F.lit(1), F.col("at")).alias("before"))
    named = sets(functions, "dst", F.array("name")).select("dst", "names", F.explode("names").alias("name"))
    sizes = caller.groupBy("name").agg(F.count("*").alias("callers")).join(named.groupBy("name").agg(F.count("*").alias("functions")), "name")
    sizes = stored(sizes.withColumn("pairs", F.col("callers") * F.col("functions")))
    total = sizes.agg(F.sum("pairs")).first()[0] or 0
    each = max(PAIRS, total // MOST_PARTS)
    crowded = F.broadcast(sizes.where(F.col("pairs") > each).select("name", F.least(F.ceil(F.col("pairs") / each), "callers").cast("int").alias("parts")))  # MOST_PARTS rows at most
    many = min(MOST_PARTS, max(total // each, int(calls.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    parts = F.coalesce("parts", F.lit(1))
    left = caller.join(sizes.select("name"), "name", "left_semi").join(crowded, "name", "left").select("src", "name", "before", F.pmod(F.xxhash64("src"), parts).cast("int").alias("part"))
    right = named.join(crowded, "name", "left").select("dst", "name", "names", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    met = left.repartition(many, "name", "part").join(right, ["name", "part"])
    return met.where((F.size("names") == 1) | ~F.arrays_overlap("before", "names")).select("src", "dst")


def resolve_types(types: DataFrame, typedefs: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(type, base, stars): a type through its chain of typedefs, counting pointer stars. types: (type text);
    typedefs: (name, target text). Chains longer than ``most_rounds`` (cycles) end where they are, with null base."""
    part = X.type_with_indirection
    links = typedefs.groupBy("name").agg(F.min("target").alias("target")).withColumn("t", part(F.col("target"))).select(F.col("name").alias("base"), F.col("t.name").alias("next"), F.col("t.stars").alias("more"))
    rows = types.select("type").distinct().withColumn("t", part(F.col("type"))).select("type", F.col("t.name").alias("base"), F.col("t.stars").alias("stars"), F.lit(True).alias("open"))
    for _ in range(most_rounds):
        step = rows.join(links, "base", "left").where("open or next is null")
        rows = cut(step.select("type", F.when(F.col("open"), F.coalesce("next", "base")).otherwise(F.col("base")).alias("base"), (F.col("stars") + F.when(F.col("open"), F.coalesce("more", F.lit(0))).otherwise(0)).alias("stars"), (F.col("open") & F.col("next").isNotNull()).alias("open")))
        if rows.where("open").isEmpty():
            return rows.select("type", "base", "stars")
    return rows.select("type", F.when(~F.col("open"), F.col("base")).alias("base"), "stars")


def with_signatures(snippets: DataFrame, signatures: DataFrame) -> DataFrame:
    """Snippets with the sorted set of their (keyword, kind); none: empty."""
    sets = signatures.groupBy("snippet_id").agg(F.array_sort(F.collect_set(F.struct("keyword", "kind"))).alias("signatures"))
    return snippets.join(sets.withColumnRenamed("snippet_id", "id"), "id", "left").withColumn("signatures", F.coalesce("signatures", F.expr("cast(array() as array<struct<keyword:string,kind:string>>)")))


def first_globals(variables: DataFrame) -> DataFrame:
    """(name, id): the first definition of each global variable, and the built-in ``optarg`` (null id) if nothing defines it."""
    found = variables.groupBy("name").agg(F.min("id").alias("id"))
    built_in = variables.sparkSession.range(1).select(F.lit("optarg").alias("name"), F.lit(None).cast(variables.schema["id"].dataType).alias("id"))
    return found.unionByName(built_in).groupBy("name").agg(F.min("id").alias("id"))


def kind_counts(snippets: DataFrame) -> DataFrame:
    return snippets.groupBy("kind").agg(F.count("*").alias("n"))


def snippet_order(snippets: DataFrame, file_rank: DataFrame) -> DataFrame:
    """Snippets by their file's rank in include order, then other files by name, then location."""
    return snippets.join(file_rank.select("file", "rank"), "file", "left").orderBy(F.col("rank").asc_nulls_last(), "file", "begin", F.col("end").desc())


def stored_subset(snippets: DataFrame, ids: DataFrame) -> DataFrame:
    return snippets.join(ids.select("id").distinct(), "id", "left_semi").orderBy("id")


def header_first_order(snippets: DataFrame, include_edges_: DataFrame) -> DataFrame:
    """(file rank and id): headers in dependence order first (what is included comes before), then sources, each by line."""
    ranks = topo_rank(include_edges_.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).withColumnRenamed("node", "file")
    return snippets.join(ranks, "file", "left").orderBy((~F.endswith("file", F.lit(".h"))).cast("int"), F.col("rank").asc_nulls_last(), "file", "begin")


def valid_locations(tokens: DataFrame) -> DataFrame:
    """Tokens without those at 0:0-0:0, which stand for no place in a text."""
    return tokens.where("not (begin = 0 and end = 0)")


def selection_union(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.union(right.select(*left.columns)).distinct()


def added(original: DataFrame, patched: DataFrame) -> DataFrame:
    """Rows of the patch that weren't there."""
    return patched.distinct().join(original, list(patched.columns), "left_anti")


def equal_sets(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """(key, equal): whether both have the same set of values under a key, the empty set included."""
    sets = lambda df, n: df.groupBy(key).agg(F.array_sort(F.collect_set(value)).alias(n))
    return sets(left, "a").join(sets(right, "b"), key, "full").select(key, F.coalesce(F.col("a") == F.col("b"), F.lit(False)).alias("equal"))


def first_per_signature(rows: DataFrame, signature: list[str], id_col: str = "id") -> DataFrame:
    """The row of the lowest id of each signature."""
    w = Window.partitionBy(*signature).orderBy(id_col)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def first_per_kind_and_keys(snippets: DataFrame, keys: DataFrame) -> DataFrame:
    """Of snippets with equal kind and key set the one with the lowest id."""
    sets = keys.groupBy("id").agg(F.array_sort(F.collect_set("key")).alias("keys"))
    return first_per_signature(snippets.join(sets, "id", "left"), ["kind", "keys"]).drop("keys")


def label_members(candidates: DataFrame, members: DataFrame, on: list[str]) -> DataFrame:
    """Candidates with ``in_slice``."""
    hit = members.select(*on, F.lit(True).alias("__hit")).distinct()
    return candidates.join(hit, on, "left").withColumn("in_slice", F.coalesce("__hit", F.lit(False))).drop("__hit")


def slice_sizes(slices: DataFrame, functions: DataFrame) -> DataFrame:
    """(crit, statements, functions): distinct lines without the criterion itself, and distinct functions around them.

    slices: (crit, crit_file, crit_line, file, line); functions: (file, begin).
    """
    lines = slices.select("crit", "file", "line", ((F.col("file") == F.col("crit_file")) & (F.col("line") == F.col("crit_line"))).alias("own"))
    size = lines.groupBy("crit").agg(F.count_distinct("file", "line").alias("n"), F.max("own").alias("own"))
    found = latest_before(lines.select("crit", "file", "line"), functions, "file", "line", "begin", "crit").where("start > 0")
    many = found.groupBy("crit").agg(F.count_distinct("file", "start").alias("functions"))
    return size.join(many, "crit", "left").select("crit", (F.col("n") - F.col("own").cast("int")).alias("statements"), F.coalesce("functions", F.lit(0)).alias("functions"))


def code_of(spans: DataFrame, lines: DataFrame, block: int = BLOCK) -> DataFrame:
    """(id, text): lines begin..end (1-based, both included) of a file. lines: (file, line_no, line)."""
    met = covering(lines.select("file", "line", F.col("line_no").alias("at")), spans, block=block)
    parts = met.groupBy("s.id").agg(F.array_sort(F.collect_list(F.struct("p.at", "p.line"))).alias("x"))
    return parts.select("id", F.array_join(F.transform("x", lambda x: x["line"]), "\n").alias("text"))
