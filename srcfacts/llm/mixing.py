"""Mixing sources to target weights by Pfair scheduling, with DataFrame functions only.

Weights become whole shares ``a_s`` of a period of ``period`` slots. Block i of source s may run from slot
floor(i * period / a_s) on and must have run before slot ceil((i + 1) * period / a_s). Earliest deadline first over
these windows puts every block inside its window, so that after any number of slots every source has had less than one block
more or less than its share. As the windows repeat with the period, one period is scheduled, and block i takes the slot of
block i mod a_s, i div a_s periods later.

The period is the least multiple of ``PERIOD`` with a slot for each source. Sources of equal share have equal windows and
form a class, a queue in the order of their hashes; a fold over the slots keeps one number pair a class. There are at most
sqrt(2 * period) different shares, so no row holds all sources, and the size of the data plays no part.

Documents of a source form blocks in the order of a seeded hash; ranks come from counts per hash range, so that no
source meets in one task. Nothing is dropped: a source that has run out leaves its slots empty and the rest go on in
their proportions; ``on_target`` marks the slots before the first source ran out, where all weights hold.

Null sources are a source of their own; null ids sort first; repeated rows are separate documents; extra columns are
ignored, whatever their names; sources without a positive weight get no slot (null position) and come last; an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PERIOD = 1000
BLOCK = 8
#: Slots that are scheduled before they are put to the others.
CHUNK = 500
#: Slots of a period that are broadcast; longer periods are joined by key.
MOST_BROADCAST = 100_000
#: Rows of a source in one hash range, about.
RANGE_ROWS = 4096
NO_SOURCE = "(none)"


def numbered(rows: DataFrame, group: list[str], bucket: str, order: list, name: str) -> DataFrame:
    """``name``: the place of each row in its group, from 0, in the order of buckets and then of ``order``. Rows are sorted in
    their bucket only; what is ordered as a whole is one count a bucket."""
    counts = rows.groupBy(*group, bucket).agg(F.count("*").alias("n"))
    before = counts.select(*group, bucket, (F.sum("n").over(Window.partitionBy(*group).orderBy(bucket)) - F.col("n")).alias("before"))
    within = rows.withColumn("nth", F.row_number().over(Window.partitionBy(*group, bucket).orderBy(*order)))
    return within.join(before, [*group, bucket]).withColumn(name, F.col("before") + F.col("nth") - 1).drop("before", "nth")


def shares(sizes: DataFrame, period: int = PERIOD, flatten: float = 0.5) -> DataFrame:
    """(source, share): whole shares of the period in proportion to n ** flatten, 1 at least; what whole numbers leave over
    goes to the largest remainders, in thousandths, ties by md5.

    sizes: (source, n), one row a source; there must be at most ``period`` sources.
    """
    raw = F.pow(F.col("n").cast("double"), F.lit(float(flatten)))
    total, k = sizes.agg(F.sum(raw), F.count("*")).first()
    quota = sizes.withColumn("q", F.round(raw / F.lit(total or 1.0) * (period - k), 6)).withColumn("whole", F.floor("q"))
    left = period - k - (quota.agg(F.sum("whole")).first()[0] or 0)
    ordered = quota.withColumns({"md5": F.md5(F.col("source").cast("binary")), "rest": F.floor((F.col("q") - F.col("whole")) * 1000)}).withColumn("bucket", F.struct((-F.col("rest")).alias("r"), F.substring("md5", 1, 2).alias("h")))
    placed = numbered(ordered.withColumn("all", F.lit(0)), ["all"], "bucket", ["md5", "source"], "place")
    return placed.select("source", (1 + F.col("whole") + (F.col("place") < left).cast("long")).cast("int").alias("share"))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _step(state: Column, slot: Column, period: int) -> Column:
    """One slot: of the blocks released by now the one with the earliest deadline; ties go to the smallest share."""
    ready = F.filter(state["classes"], lambda s: F.floor(s["nth"] * period / s["share"]) <= slot)
    best = F.array_min(F.transform(ready, lambda s: F.struct(F.ceil((s["nth"] + 1) * period / s["share"]).alias("deadline"), s["share"].alias("share"), s["nth"].alias("nth"), s["taken"].alias("taken"))))

    def moved(s: Column) -> Column:
        over = s["taken"] + 1 == s["size"]
        return F.struct(s["share"].alias("share"), s["size"].alias("size"), (s["nth"] + over.cast("long")).alias("nth"), F.when(over, F.lit(0).cast("long")).otherwise(s["taken"] + 1).alias("taken"))

    return _let(
        best,
        lambda b: F.struct(
            F.transform(state["classes"], lambda s: F.when(s["share"] == b["share"], moved(s)).otherwise(s)).alias("classes"),
            F.concat(state["out"], F.array(F.struct(b["share"].alias("share"), b["nth"].alias("nth"), b["taken"].alias("place")))).alias("out"),
        ),
    )


def template(shared: DataFrame, period: int = PERIOD) -> DataFrame:
    """(source, share, nth, slot) of one period; ``shared``: (source, share) with shares that sum to the period."""
    md5 = F.md5(F.col("source").cast("binary"))
    members = shared.where("share > 0").select("source", F.col("share").cast("long").alias("share"), md5.alias("md5"), F.substring(md5, 1, 3).alias("bucket"))
    queue = numbered(members, ["share"], "bucket", ["md5", "source"], "place").select("source", "share", "place")
    sizes = members.groupBy("share").agg(F.count("*").alias("size"))
    zero = F.lit(0).cast("long")
    classes = sizes.groupBy().agg(F.array_sort(F.collect_list(F.struct("share", "size", zero.alias("nth"), zero.alias("taken")))).alias("classes"))  # one a share
    none = F.expr("cast(array() as array<struct<share:bigint,nth:bigint,place:bigint>>)")
    slots_of = lambda c: F.sequence(c * CHUNK, F.least((c + 1) * CHUNK, F.lit(period)) - 1)
    chunk = lambda state, c: F.aggregate(slots_of(c), F.struct(state["classes"].alias("classes"), none.alias("out")), lambda s, t: _step(s, t, period))
    whole = F.aggregate(F.sequence(F.lit(0), F.lit((period - 1) // CHUNK)), F.struct("classes", none.alias("out")), lambda s, c: _let(chunk(s, c), lambda x: F.struct(x["classes"].alias("classes"), F.concat(s["out"], x["out"]).alias("out"))))
    slots = classes.select(F.posexplode(whole["out"]).alias("slot", "e")).select(F.col("slot").cast("long").alias("slot"), "e.share", "e.nth", "e.place").where("share is not null")
    return slots.join(queue, ["share", "place"]).select("source", "share", "nth", "slot")


_SMALL = ("bigint", "int", "smallint", "tinyint", "double", "float", "boolean", "date", "timestamp")


def ranked(docs: DataFrame, ranges: int, id_col: str = "doc_id", source_col: str = "source", seed: int = 11, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, source, rank, row): place of each row in its source, by a seeded hash of the id, then the id; row: a struct
    of the columns to keep."""
    row = F.struct(*[F.col(f"`{c}`") for c in keep]) if keep else F.lit(None).cast("boolean")
    # rows without an id are dealt by what else they hold: what is kept anyway, or columns that cost little to read
    hashed = [c for c, kind in docs.dtypes if c in keep and "map<" not in kind] or [c for c, kind in docs.dtypes if kind in _SMALL] or [source_col]
    of_row = F.xxhash64(*[F.col(f"`{c}`") for c in hashed])
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{source_col}`").cast("string"), F.lit(NO_SOURCE)).alias("source"), row.alias("row"), of_row.alias("of_row"))
    # ids are hashed by whole-number arithmetic that any SQL engine repeats; others by their crc32
    number = F.col("id").cast("long") if dict(docs.dtypes)[id_col] in ("bigint", "int", "smallint", "tinyint") else F.crc32(F.col("id").cast("string").cast("binary"))
    low, high = F.pmod(number, F.lit(1 << 31)), F.pmod(F.shiftright(number, 31), F.lit(1 << 31))
    mixed = F.pmod(low * 1103515245 + high * 69069 + 12345 + seed, F.lit(1 << 31))
    rows = rows.withColumn("hash", F.coalesce(mixed, F.pmod("of_row", F.lit(1 << 31)))).drop("of_row").withColumn("range", F.floor(F.col("hash") * ranges / (1 << 31)))
    return numbered(rows, ["source"], "range", ["hash", "id"], "rank").select("id", "source", "row", "rank")


def mix(docs: DataFrame, weights: DataFrame | None = None, block: int = BLOCK, period: int = PERIOD, flatten: float = 0.5, id_col: str = "doc_id", source_col: str = "source", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, source, block, slot, release, deadline, position, on_target) of every row, and the struct ``row`` of the
    columns to keep. position = slot * block + place in the block; slots of sources that have run out stay empty.

    weights: (source, share), whole numbers that sum to ``period``; else shares from the sources' sizes, of the least
    multiple of ``period`` that has a slot for each source.
    """
    named = docs.select(F.coalesce(F.col(f"`{source_col}`").cast("string"), F.lit(NO_SOURCE)).alias("source"))
    sizes = named.groupBy("source").agg(F.count("*").alias("n"))
    largest, sources = sizes.agg(F.max("n"), F.count("*")).first()
    period = period if weights is not None else period * max(1, -(-sources // period))
    near = F.broadcast if period <= MOST_BROADCAST else lambda df: df  # one row a source or slot, a period at most
    shared = weights if weights is not None else shares(sizes, period, flatten)
    # The first source to run out ends the part in which all weights hold.
    horizon = sizes.join(shared.where("share > 0"), "source").agg(F.min(F.floor(F.ceil(F.col("n") / block) * period / F.col("share")))).first()[0]
    blocks = ranked(docs, max(256, -(-(largest or 0) // RANGE_ROWS)), id_col, source_col, keep=keep).withColumn("block", F.floor(F.col("rank") / block))
    joined = blocks.join(near(shared.where("share > 0")), "source", "left").withColumn("nth", F.col("block") % F.col("share"))
    slots = template(shared, period).select("source", "nth", F.col("slot").alias("first"))
    timed = joined.join(near(slots), ["source", "nth"], "left")
    slot = F.floor(F.col("block") / F.col("share")) * period + F.col("first")
    return timed.select(
        F.col("id").alias(id_col),
        F.col("source"),
        F.col("block"),
        slot.alias("slot"),
        F.floor(F.col("block") * period / F.col("share")).alias("release"),
        F.ceil((F.col("block") + 1) * period / F.col("share")).alias("deadline"),
        (slot * block + F.col("rank") % block).alias("position"),
        F.coalesce(slot < F.lit(horizon or 0), F.lit(False)).alias("on_target"),
        *([F.col("row")] if keep else []),
    )


def in_mix_order(docs: DataFrame, **options) -> DataFrame:
    """All rows with their own columns, in the order of the mix: ranges of positions, sorted inside; rows without a position
    come last, dealt by a hash."""
    placed = mix(docs, keep=tuple(docs.columns), **options).select("position", "row", F.when(F.col("position").isNull(), F.xxhash64("row")).alias("hash"))
    last = [F.col("position").asc_nulls_last(), F.col("hash")]
    return placed.repartitionByRange(*last).sortWithinPartitions(*last).select("row.*")


def op1_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP1_SQL = f"""
WITH RECURSIVE docs AS (SELECT doc_id, coalesce(source, '{NO_SOURCE}') AS source FROM documents),
sizes AS (SELECT source, count(*) AS n FROM docs GROUP BY source),
params AS (SELECT {PERIOD} * greatest(1, (count(*) + {PERIOD - 1}) // {PERIOD}) AS period, count(*) AS k FROM sizes),
quota AS (SELECT source, n, round(pow(n, 0.5) / sum(pow(n, 0.5)) OVER () * (period - k), 6) AS q, period, k FROM sizes, params),
shared AS (
  SELECT source, n, period, CAST(1 + floor(q) + CASE WHEN row_number() OVER (ORDER BY floor((q - floor(q)) * 1000) DESC, md5(source), source)
    <= period - k - sum(floor(q)) OVER () THEN 1 ELSE 0 END AS BIGINT) AS share FROM quota),
edf(slot, source, share, period, nxt, picked) AS (
  SELECT CAST(-1 AS BIGINT), source, share, period, CAST(0 AS BIGINT), false FROM shared
  UNION ALL
  SELECT slot + 1, source, share, period, nxt + CASE WHEN p THEN 1 ELSE 0 END, p FROM (
    SELECT *, ready AND row_number() OVER (ORDER BY CASE WHEN ready THEN deadline ELSE 1000000000 END, share, md5(source), source) = 1 AS p FROM (
      SELECT slot, source, share, period, nxt, nxt * period // share <= slot + 1 AS ready,
        ((nxt + 1) * period + share - 1) // share AS deadline FROM edf WHERE slot + 1 < period))),
slots AS (SELECT source, nxt - 1 AS nth, slot AS first FROM edf WHERE picked),
bits AS (SELECT doc_id, source, (doc_id % 2147483648 + 2147483648) % 2147483648 AS low FROM docs),
hashed AS (SELECT doc_id, source, (low * 1103515245 + ((doc_id - low) // 2147483648 % 2147483648 + 2147483648) % 2147483648 * 69069 + 12356) % 2147483648 AS h FROM bits),
ranks AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY h, doc_id NULLS FIRST) - 1 AS rank FROM hashed),
horizon AS (SELECT min(((n + {BLOCK - 1}) // {BLOCK}) * period // share) AS h FROM shared)
SELECT doc_id, source, block, slot, block * period // share AS release, ((block + 1) * period + share - 1) // share AS deadline,
  slot * {BLOCK} + rank % {BLOCK} AS position, slot < h AS on_target
FROM (
  SELECT r.doc_id, r.source, r.rank, r.rank // {BLOCK} AS block, s.share, s.period, (r.rank // {BLOCK}) // s.share * s.period + t.first AS slot
  FROM ranks r JOIN shared s USING (source) JOIN slots t ON t.source = r.source AND t.nth = (r.rank // {BLOCK}) % s.share), horizon
"""
