"""Clone classes compared by their recorded values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fragment_values(values: DataFrame) -> DataFrame:
    """(id, in_n, out_n, in_types, out_types, ins, outs): sorted values and types of each fragment; (id, side, type, value)."""
    mine = lambda side, c: F.array_sort(F.collect_list(F.when(F.col("side") == side, F.col(c))))
    n = lambda side: F.count(F.when(F.col("side") == side, 1))
    return values.groupBy("id").agg(n("input").alias("in_n"), n("output").alias("out_n"), mine("input", "type").alias("in_types"), mine("output", "type").alias("out_types"), mine("input", "value").alias("ins"), mine("output", "value").alias("outs"))


#: Fragments of a class that a task pairs with one another.
BLOCK = 512


def _paired(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """(class, type, l, r): structs of the rows (class, type, id, ..) of one class, l.id < r.id.

    A large class is dealt in blocks: one side stays in its block, the other visits all of them.
    """
    sizes = rows.groupBy("class").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("blocks"))
    sized = rows.join(sizes, "class")
    kept = [c for c in rows.columns if c not in ("class", "type")]
    home = sized.select("class", "type", F.struct(*kept).alias("l"), F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"))
    visits = sized.select("class", F.struct(*kept).alias("r"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    return home.join(visits, ["class", "block"]).where("l.id < r.id").select("class", "type", "l", "r")


def pairs(fragments: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """(class, type, id1, id2), id1 < id2, of fragments (class, type, id) in one class; only those with results in ids (id)."""
    kept = fragments.join(ids.select("id").distinct(), "id", "left_semi") if ids is not None else fragments
    return _paired(kept.select("class", "type", "id")).select("class", "type", F.col("l.id").alias("id1"), F.col("r.id").alias("id2"))


def _facts(values: DataFrame) -> DataFrame:
    """(id, in_n, out_n, in_types, out_types, ins, outs) of each fragment, lists as digests."""
    digest = lambda c: F.sha2(F.to_json(F.struct(c)), 256).alias(c)
    return fragment_values(values).select("id", "in_n", "out_n", *[digest(c) for c in ("in_types", "out_types", "ins", "outs")])


def compare(fragments: DataFrame, values: DataFrame) -> DataFrame:
    """(class, type, id1, id2, verdict, clone): arity of inputs and outputs, then sorted inputs, then outputs.

    Each fragment takes its counts and digests along, so that pairs need no look-up.
    """
    met = _paired(fragments.select("class", "type", "id").join(_facts(values), "id").select("class", "type", "id", "in_n", "out_n", "in_types", "out_types", "ins", "outs"))
    same = lambda c: F.col(f"l.{c}") == F.col(f"r.{c}")
    verdict = F.when(~same("in_n"), "input arity").when(~same("out_n"), "output arity").when(~same("ins"), "inputs").when(~same("outs"), "outputs").otherwise("equal")
    return met.select("class", "type", F.col("l.id").alias("id1"), F.col("r.id").alias("id2"), verdict.alias("verdict"), (verdict == "equal").alias("clone"), (same("in_n") & same("out_n")).alias("same_arity"), (same("in_types") & same("out_types")).alias("same_types"))


def results(compared: DataFrame) -> DataFrame:
    return compared.select("class", "type", "id1", "id2", "clone")


def summary(compared: DataFrame) -> DataFrame:
    """Pairs, same arity, same types and same data by clone type."""
    one = lambda c: F.sum(F.col(c).cast("int"))
    return compared.groupBy("type").agg(F.count("*").alias("pairs"), one("same_arity").alias("same_arity"), one("same_types").alias("same_types"), one("clone").alias("same_data"))


#: What two fragments of a class have to share to count in each total.
SHARED = {"pairs": (), "same_arity": ("in_n", "out_n"), "same_types": ("in_types", "out_types"), "same_data": ("in_n", "out_n", "ins", "outs")}


def class_summary(fragments: DataFrame, values: DataFrame) -> DataFrame:
    """``summary`` of all pairs without making any: fragments that share something form a group, and a group of n has n (n - 1) / 2 pairs.

    A class is of one type. Rows that repeat a fragment make pairs with others, none with itself.
    """
    met = fragments.select("class", "type", "id").join(_facts(values), "id")
    rows = met.groupBy("class", "type", "id", "in_n", "out_n", "in_types", "out_types", "ins", "outs").agg(F.count("*").alias("m"))
    keys = F.array(*[F.struct(F.lit(n).alias("total"), F.sha2(F.concat_ws("|", F.lit(n), *cols), 256).alias("key")) for n, cols in SHARED.items()])
    groups = rows.select("class", "type", "m", F.explode(keys).alias("g")).groupBy("class", "type", "g").agg(F.sum("m").alias("n"), F.sum(F.col("m") * F.col("m")).alias("own"))
    # squares of the rows of each fragment leave out pairs of a fragment with itself
    pairs_ = groups.select("type", "g.total", ((F.col("n") * F.col("n") - F.col("own")) / 2).cast("long").alias("pairs"))
    out = pairs_.groupBy("type").agg(*[F.sum(F.when(F.col("total") == n, F.col("pairs"))).alias(n) for n in SHARED])
    return out.where("pairs > 0")
