"""Merkle manifest of a dataset: leaves in groups, trees of eight, and proofs by descent from the root.

Every row is a leaf, the digest of its fields; the leaves of a group (a language) form a tree in the order of their id, and the
groups' roots form one tree above. What is stored are records digest -> children, found by content. A proof is collected by going
down from the root along the digits of a leaf's rank: each step looks a digest up, takes the wanted child and notes its siblings;
turned round, the notes are the proof. Requests go down together, one row for each node that some of them pass.

Nulls: a field without a value is ``-``; a null group is a group of its own, before all others; null ids come first and are never
tampered with. Rows that are alike in group and id are ordered by their digest; equal rows are leaves each. A text of any length is hashed whole. An
empty table has no leaves and gives no rows. Only the named columns are read, whatever else there is.
"""

from __future__ import annotations

from dataclasses import dataclass
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srcfacts.operators.logs import number_rows
from srcfacts.session import cut

FAN = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest_of(fields: list[Column]) -> Column:
    """Lowercase hex SHA-256 of each value with its length in bytes before it."""
    return F.sha2(F.concat(*[F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c)) for c in (x.cast("string") for x in fields)]), 256)


def leaves(docs: DataFrame, fields: tuple[str, ...] = FIELDS, group: str = "lang", id_col: str = "doc_id", changed: dict[str, Column] | None = None) -> DataFrame:
    """(grp, rank, n, id, leaf, claim): rank from 0 in a group of n, in the order of the id. grp is never null and sorts as the group does.

    ``changed`` replaces columns: claim is the digest of the row with them, by default the leaf itself.
    """
    own = {c: F.col(f"`{c}`") for c in fields}
    claim = digest_of([(own | changed)[c] for c in fields]) if changed else None
    grp = F.when(F.col(f"`{group}`").isNull(), "").otherwise(F.concat(F.lit("="), F.col(f"`{group}`").cast("string")))
    made = docs.select(grp.alias("grp"), F.col(f"`{id_col}`").alias("id"), digest_of(list(own.values())).alias("leaf"), *([claim.alias("claim")] if changed else []), F.monotonically_increasing_id().alias("tie"))
    made = cut(made if changed else made.withColumn("claim", F.col("leaf")))
    placed = number_rows(made, ["grp", "id", "leaf", "tie"], "at", 0)
    sizes = cut(placed.groupBy("grp").agg(F.min("at").alias("first"), F.count("*").alias("n")))
    return cut(placed.join(sizes, "grp").select("grp", (F.col("at") - F.col("first")).cast("long").alias("rank"), "n", "id", "leaf", "claim"))


@dataclass
class Forest:
    """levels[i]: records (digest, children) of the nodes i + 1 above the leaves; roots: (grp, digest, height)."""

    levels: list[DataFrame]
    roots: DataFrame


def climb(nodes: DataFrame) -> Forest:
    """The trees over (grp, idx, digest, n), n nodes in a group: while there are several, each run of eight becomes one node."""
    levels, tops, most, height = [], [], nodes.agg(F.max("n")).first()[0] or 0, 0
    while True:
        tops.append(nodes.where("n = 1").select("grp", "digest", F.lit(height).alias("height")))
        if most <= 1:
            break
        run = nodes.where("n > 1").groupBy("grp", F.floor(F.col("idx") / FAN).cast("long").alias("idx"))
        kids = F.transform(F.array_sort(F.collect_list(F.struct(F.col("idx").alias("i"), "digest"))), lambda x: x["digest"])
        nodes = cut(run.agg(kids.alias("children"), F.ceil(F.max("n") / FAN).cast("long").alias("n")).withColumn("digest", F.sha2(F.array_join("children", ""), 256)))
        levels.append(nodes.select("digest", "children").dropDuplicates(["digest"]))
        most, height = -(-most // FAN), height + 1
    roots = tops[0]
    for t in tops[1:]:
        roots = roots.union(t)
    return Forest(levels, cut(roots))


@dataclass
class Manifest:
    """leaves as ``leaves`` gives them; forest: a tree a group; top: the tree over the groups' roots; order: (grp, idx) of the groups."""

    leaves: DataFrame
    forest: Forest
    top: Forest
    order: DataFrame

    def records(self) -> DataFrame:
        """(digest, children) of all nodes, each digest once: what is to be stored."""
        spark = self.leaves.sparkSession
        out = spark.createDataFrame([], "digest string, children array<string>")
        for level in (*self.forest.levels, *self.top.levels):
            out = out.union(level)
        return out.dropDuplicates(["digest"])

    def root(self) -> DataFrame:
        """(digest): one row, or none of an empty table."""
        return self.top.roots.select("digest")


def build(rows: DataFrame) -> Manifest:
    """The manifest of ``leaves``."""
    forest = climb(rows.select("grp", F.col("rank").alias("idx"), F.col("leaf").alias("digest"), "n"))
    order = cut(number_rows(forest.roots.select("grp", "digest"), ["grp"], "idx", 0).select("grp", F.col("idx").cast("long").alias("idx"), "digest"))
    top = climb(order.select(F.lit("").alias("grp"), "idx", "digest", F.lit(order.count()).cast("long").alias("n")))
    return Manifest(rows, forest, top, order.select("grp", "idx"))


def _step(here: DataFrame, level: DataFrame) -> DataFrame:
    """One digit down: each node's children (grp, idx, digest), the others of the run noted at the end of the path."""
    kids = F.col("children")
    note = F.struct(F.array_join(F.slice(kids, 1, F.col("pos")), "").alias("l"), F.array_join(F.slice(kids, F.col("pos") + 2, FAN), "").alias("r"))
    met = here.join(level, "digest").select(*[c for c in here.columns if c != "digest"], "children", F.posexplode("children").alias("pos", "digest"))
    return met.select(*[c for c in here.columns if c not in ("idx", "path", "digest")], (F.col("idx") * FAN + F.col("pos")).alias("idx"), "digest", F.concat("path", F.array(note)).alias("path"))


def descend(forest: Forest, starts: DataFrame, asked: DataFrame, stop: int = 0) -> DataFrame:
    """Nodes (grp, idx, digest, path, ..) ``stop`` levels above the leaves on the ways down to the leaves asked (grp, rank); ways that end higher are given as they are
    (``height`` says where). starts: (grp, digest, height, path, ..)."""
    starts = cut(starts.withColumn("idx", F.lit(0).cast("long")))  # a row a group
    at, ended = starts.where(F.col("height") == len(forest.levels)), starts.where(F.col("height") <= stop)
    for height in range(len(forest.levels), stop, -1):
        # the digits of the ranks so far: which nodes of the next level some request passes
        wanted = asked.select("grp", F.floor(F.col("rank") / FAN ** (height - 1)).cast("long").alias("idx")).distinct()
        down = _step(at, forest.levels[height - 1]).withColumn("height", F.lit(height - 1)).join(wanted, ["grp", "idx"], "left_semi")
        at = down.unionByName(starts.where(F.col("height") == height - 1))
        ended = ended.unionByName(down) if height - 1 == stop else ended
    return ended


def proofs(made: Manifest, requests: DataFrame) -> DataFrame:
    """(grp, rank, id, leaf, claim, subroot, root, path) of each request (grp, rank, id, claim): the leaf that is stored there and its siblings,
    path array<struct<l, r>> from the leaf to the root; ranks that aren't there give no row."""
    empty = F.array().cast("array<struct<l:string,r:string>>")
    top = made.top.roots.select("grp", "digest", "height", empty.alias("path"), F.col("digest").alias("root"))
    groups = requests.select("grp").distinct().join(made.order, "grp")
    ways = descend(made.top, top, groups.select(F.lit("").alias("grp"), F.col("idx").alias("rank"))).select("idx", "path", "root")
    tall = made.forest.roots.withColumnRenamed("digest", "subroot")
    starts = groups.join(ways, "idx").select("grp", "path", "root").join(tall, "grp").select("grp", F.col("subroot").alias("digest"), "height", "path", "root", "subroot")
    # requests of one run go down as one row; their last digit is read from the run's record
    runs = requests.groupBy("grp", F.floor(F.col("rank") / FAN).cast("long").alias("idx")).agg(F.collect_list(F.struct((F.col("rank") % FAN).cast("int").alias("digit"), "rank", "id", "claim")).alias("asked"))
    ends = descend(made.forest, starts, requests.select("grp", "rank"), stop=1)
    met = ends.join(runs, ["grp", "idx"])
    lone = met.where("height = 0").select("grp", F.col("digest").alias("leaf"), "subroot", "root", "path", F.explode("asked").alias("q")).where("q.rank = 0")
    if not made.forest.levels:
        found = lone
    else:
        kids, digit = F.col("children"), F.col("q.digit")
        note = F.struct(F.array_join(F.slice(kids, 1, digit), "").alias("l"), F.array_join(F.slice(kids, digit + 2, FAN), "").alias("r"))
        low = met.where("height = 1").join(made.forest.levels[0], "digest").select("grp", "children", "subroot", "root", "path", F.explode("asked").alias("q")).where(digit < F.size(kids))
        found = lone.union(low.select("grp", kids[digit].alias("leaf"), "subroot", "root", F.concat("path", F.array(note)).alias("path"), "q"))
    return found.select("grp", "q.rank", "q.id", "leaf", "q.claim", "subroot", "root", F.reverse("path").alias("path"))


def folded(claim: Column, path: Column) -> Column:
    """The root that a claimed leaf and its siblings give."""
    return F.aggregate(path, claim, lambda d, x: F.sha2(F.concat(x["l"], d, x["r"]), 256))


def proof_digest(path: Column) -> Column:
    """Digest of all siblings, from the leaf up, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda x: F.concat(x["l"], x["r"])), ""), 256)


def op11_manifest(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    rows = leaves(docs, changed={"text": F.when(hit, F.translate("text", ascii_uppercase, ascii_lowercase)).otherwise(F.col("text"))})
    found = proofs(build(rows), rows.select("grp", "rank", "id", "claim"))
    back = folded(F.col("claim"), F.col("path"))
    return found.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), back.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


def crc32_sql(text: str) -> str:
    """SQL of the unsigned CRC-32 of a text of single bytes, bit by bit."""
    step = "list_reduce(list_prepend(xor(acc, x), range(8)::UBIGINT[]), lambda a, b: xor(a >> 1, CASE WHEN a & 1 = 1 THEN 3988292384::UBIGINT ELSE 0::UBIGINT END))"
    return f"xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split({text}, ''), lambda c: ascii(c)::UBIGINT)), lambda acc, x: {step}), 4294967295::UBIGINT)"


def _levels_sql(name: str, key: str, count: int) -> str:
    """CTEs <name>1.. of the nodes of each level, and <name>s0.. of the siblings of the level below."""
    out = []
    for i in range(count):
        run = f"PARTITION BY {key}, i // 8 ORDER BY i ROWS BETWEEN"
        out.append(f"{name}s{i} AS (SELECT {key}, i, w, coalesce(string_agg(d, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, coalesce(string_agg(d, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {name}{i})")
        out.append(f"{name}{i + 1} AS (SELECT {key}, i // 8 AS i, CASE WHEN max(w) = 1 THEN max(d) ELSE sha256(string_agg(d, '' ORDER BY i)) END AS d, (max(w) + 7) // 8 AS w FROM {name}{i} GROUP BY {key}, i // 8)")
    return ",\n".join(out)


def _sql(low: int = 7, high: int = 3) -> str:
    """Trees of up to 8^low leaves a group and 8^high groups."""
    field = lambda c: f"coalesce(strlen({c}) || ':' || {c}, '-')"
    row = lambda text: "sha256(" + " || ".join(field(c) for c in ("CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text)) + ")"
    lower = f"CASE WHEN {crc32_sql('CAST(doc_id AS VARCHAR)')} % 3 = 0 THEN translate(text, '{ascii_uppercase}', '{ascii_lowercase}') ELSE text END"
    steps = [("a", i, f"a.k = s.k AND a.i // {8**i} = s.i") for i in range(low)] + [("g", i, f"a.gi // {8**i} = s.i") for i in range(high)]
    walk = ["w0 AS (SELECT doc_id, leaf, k, i, claim AS f, '' AS p, gi, subroot, root FROM ranked JOIN (SELECT k AS gk, i AS gi, d AS subroot FROM g0) ON k = gk, (SELECT d AS root FROM g{0}))".replace("{0}", str(high))]
    for n, (name, i, on) in enumerate(steps):
        walk.append(f"w{n + 1} AS (SELECT doc_id, leaf, a.k, a.i, CASE WHEN s.w > 1 THEN sha256(s.l || f || s.r) ELSE f END AS f, CASE WHEN s.w > 1 THEN p || s.l || s.r ELSE p END AS p, gi, subroot, root FROM w{n} a JOIN {name}s{i} s ON {on})")
    return f"""WITH ranked AS (SELECT doc_id, coalesce('=' || lang, '') AS k, {row('text')} AS leaf, {row(f'({lower})')} AS claim, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS i FROM documents),
a0 AS (SELECT k, i, leaf AS d, count(*) OVER (PARTITION BY k) AS w FROM ranked),
{_levels_sql("a", "k", low)},
g0 AS (SELECT k, '' AS c, row_number() OVER (ORDER BY k) - 1 AS i, d, count(*) OVER () AS w FROM a{low}),
{_levels_sql("g", "c", high)},
{", ".join(walk)}
SELECT doc_id, leaf, subroot, root, sha256(p) AS proof_sha256, f AS folded_root, f = root AS verified FROM w{len(steps)}"""


OP11_SQL = _sql()
