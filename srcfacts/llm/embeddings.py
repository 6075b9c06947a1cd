"""Near-duplicate embeddings by p-stable hashing for Euclidean distance.

Vectors are scaled to length 1; a table's bucket is ``k`` random projections, each moved by a random offset and cut
into steps of ``step``. Cosine c means distance sqrt(2 - 2c), so the chance to share a bucket is known, and ``k`` and
the number of tables follow from the number of vectors and the wanted recall at the threshold.

Vectors travel to their buckets in 8 bits a component, with the length of what was rounded off. Inside a bucket a matrix
product bounds every pair's cosine from both sides; pairs that the bounds leave open are checked by their exact cosine in
double precision, and so no link depends on the rounding. A bucket that many classes share is dealt over tasks as pairs of
blocks, none left out and none larger than about two blocks.

Equal vectors are one class from the start (by 128 bits of hashes): they aren't compared, and each counts as a link of the
others. Lengths are taken after scaling by the largest component, so that tiny and huge vectors have theirs too. Vectors
that are null, of length zero, or hold null or non-finite components, and rows with a null id, link with nothing; vectors
of other dimensions are not comparable. Extra columns are ignored; repeated rows are vectors of their own; an empty table
gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srcfacts.llm.base import components
from srcfacts.session import cut

STEP = 2.0
#: Classes of a block: a task compares two blocks of a bucket at once.
BLOCK = 2048
#: Unrelated vectors that a vector meets in a table, about: a product costs far less than a row in another table.
MEETINGS = 256
#: Large buckets that are broadcast; more are joined by key.
MOST_BROADCAST = 100_000


def share_bucket(distance: float, step: float = STEP) -> float:
    """Chance that one projection puts two points at this distance into one step."""
    r = step / distance
    tail = 0.5 * math.erfc(r / math.sqrt(2))
    return 1 - 2 * tail - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def plan(n: int, threshold: float, recall: float) -> tuple[int, int]:
    """(projections a table, tables): unrelated vectors meet about ``MEETINGS`` times a table, near ones with ``recall``."""
    near, far = share_bucket(math.sqrt(2 - 2 * threshold)), share_bucket(math.sqrt(2))
    k = max(4, math.ceil(math.log(max(n / MEETINGS, 2)) / -math.log(far)))
    return k, math.ceil(math.log(1 - recall) / math.log(1 - near**k))


def _valid(c: Column) -> Column:
    good = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return c.isNotNull() & good & F.exists(c, lambda x: x != 0)


def units(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, by their largest component first: no square overflows or vanishes."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _hashed(classes: DataFrame, k: int, tables: int, seed: int, step: float, packed: bool) -> DataFrame:
    """(t, dims, h) of each class in each table, h a 64-bit key of its bucket; packed: with (rep, q, scale, lost), the unit
    vector being scale * q but for a rest of length ``lost`` at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, tuple] = {}
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                b = whole.slice(at, 2048)
                lists = b.column("v")
                sizes = lists.value_lengths().to_numpy()
                for dims in np.unique(sizes):
                    if dims not in known:
                        rng = np.random.default_rng([seed, int(dims)])
                        known[dims] = rng.standard_normal((int(dims), k * tables)), rng.uniform(0, step, k * tables), rng.integers(1, 1 << 62, k, dtype=np.int64) | 1
                    a, shift, mix = known[dims]
                    rows = np.nonzero(sizes == dims)[0]
                    x = units(lists.take(pa.array(rows)).flatten().to_numpy().astype(np.float64).reshape(len(rows), int(dims)))
                    cells = np.floor((x @ a + shift) / step).astype(np.int64).reshape(len(rows), tables, k)
                    keys = (cells * mix).sum(axis=2)  # wraps around: a hash
                    more = {}
                    if packed:
                        scale = np.abs(x).max(axis=1) / 127
                        q = np.rint(x / scale[:, None]).astype(np.int8)
                        lost = np.linalg.norm(x - scale[:, None] * q, axis=1)
                        more = {"rep": b.column("rep").take(pa.array(rows)), "q": pa.array([r.tobytes() for r in q], pa.binary()), "scale": pa.array(scale), "lost": pa.array(lost)}
                    for t in range(tables):
                        yield pa.RecordBatch.from_pydict({"t": pa.array(np.full(len(rows), t), pa.int32()), "dims": pa.array(np.full(len(rows), dims), pa.int32()), "h": pa.array(keys[:, t]), **more})

    kind = classes.schema["rep"].dataType.simpleString()
    return classes.select("rep", "v").mapInArrow(run, "t int, dims int, h long" + (f", rep {kind}, q binary, scale double, lost double" if packed else ""))


#: What floating-point sums of products of lengths up to 1 may be off by.
SLACK = 1e-6


def _compared(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """(a, b, sure) from rows sorted by (t, dims, h, low, high): pairs whose cosine is or may be ``threshold`` or more. Rows of
    a bucket in one block (low = high) meet one another, of two blocks only across."""

    def pairs(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = pa.Table.from_batches(held).combine_chunks().to_batches()[0] if len(held) > 1 else held[0]
        q = b.column("q")
        n, offsets = b.num_rows, np.frombuffer(q.buffers()[1], np.int32)[q.offset : q.offset + b.num_rows + 1]
        x = np.frombuffer(q.buffers()[2], np.int8)[offsets[0] : offsets[-1]].reshape(n, -1)
        # sums of products of 127 are whole numbers, which 24 bits hold exactly up to some 1,000 components
        x = x.astype(np.float32 if x.shape[1] * 127 * 127 < 1 << 24 else np.float64)
        scale, lost, side = (b.column(c).to_numpy() for c in ("scale", "lost", "mine"))
        long = scale * np.linalg.norm(x.astype(np.float64), axis=1)
        across = b.column("low")[0].as_py() != b.column("high")[0].as_py()
        rows = np.nonzero(side == b.column("low")[0].as_py())[0] if across else np.arange(n)
        others = np.nonzero(side == b.column("high")[0].as_py())[0] if across else rows
        for at in range(0, len(rows), 512):
            some = rows[at : at + 512]
            cos = (x[some] @ x[others].T) * scale[some, None] * scale[others]
            open_ = lost[some, None] * long[others] + (long[some] + lost[some])[:, None] * lost[others] + SLACK
            near = cos + open_ >= threshold
            if not across:
                near &= some[:, None] < others
            i, j = np.nonzero(near)
            if len(i):
                sure = cos[i, j] - open_[i, j] >= threshold
                yield pa.RecordBatch.from_arrays([b.column("rep").take(pa.array(some[i])), b.column("rep").take(pa.array(others[j])), pa.array(sure)], names=["a", "b", "sure"])

    held: list[pa.RecordBatch] = []
    last: tuple = ()
    for b in batches:
        key = np.stack([b.column(c).to_numpy() for c in ("t", "dims", "h", "low", "high")], axis=1)
        edges = [0, *(np.nonzero((key[1:] != key[:-1]).any(axis=1))[0] + 1).tolist(), len(key)]
        for n, (start, end) in enumerate(zip(edges, edges[1:], strict=False)):
            if n == 0 and held and tuple(key[0]) == last:
                held.append(b.slice(start, end - start))
            elif end == len(key) or end - start > 1:
                if sum(x.num_rows for x in held) > 1:
                    yield from pairs(held)
                held = [b.slice(start, end - start)]
        last = tuple(key[-1]) if len(key) else last
    if sum(x.num_rows for x in held) > 1:
        yield from pairs(held)


def linked_pairs(classes: DataFrame, threshold: float = 0.95, recall: float = 0.9995, seed: int = 7, step: float = STEP, block: int = BLOCK) -> DataFrame:
    """(a, b), a < b: classes (rep, v array, all valid) with cosine >= threshold, found with ``recall``."""
    k, tables = plan(classes.count(), threshold, recall)
    bucket = ["t", "dims", "h"]
    large = cut(_hashed(classes, k, tables, seed, step, packed=False).groupBy(*bucket).agg(F.count("*").alias("n")).where(F.col("n") > block))
    many = large.count()
    rows = _hashed(classes, k, tables, seed, step, packed=True)
    # Blocks of a large bucket: a row meets those of its own block and of each other one.
    if many:
        blocks = F.coalesce(F.ceil(F.col("n") / block), F.lit(1)).cast("int")
        dealt = rows.join(F.broadcast(large) if many <= MOST_BROADCAST else large, bucket, "left").withColumn("blocks", blocks).withColumn("mine", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("low", F.least("mine", "other")).withColumn("high", F.greatest("mine", "other")).drop("n", "blocks", "other")
    else:
        dealt = rows.withColumns({c: F.lit(0) for c in ("mine", "low", "high")})
    place = [*bucket, "low", "high"]
    kind = classes.schema["rep"].dataType.simpleString()
    met = dealt.repartition(*place).sortWithinPartitions(*place).mapInArrow(lambda batches: _compared(batches, threshold), f"a {kind}, b {kind}, sure boolean")
    pairs = cut(met.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("sure").alias("sure")))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)
    most = F.array_max(F.transform("v", lambda x: F.abs(x.cast("double"))))
    # held in an array, so that it isn't computed again for each component
    scaled = F.transform(F.array(most), lambda m: F.transform("v", lambda x: x.cast("double") / m))[0]
    open_ = pairs.where("not sure")
    ends = open_.select(F.col("a").alias("rep")).union(open_.select("b")).distinct()
    sides = classes.join(ends, "rep", "left_semi").select("rep", scaled.alias("w")).select("rep", "w", F.sqrt(dot("w", "w")).alias("norm"))
    left, right = sides.toDF("a", "va", "na"), sides.toDF("b", "vb", "nb")
    checked = open_.join(left, "a").join(right, "b").where(dot("va", "vb") / (F.col("na") * F.col("nb")) >= threshold)
    return pairs.where("sure").select("a", "b").union(checked.select("a", "b"))


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, recall: float = 0.9995, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, n_links long, component_id, kept boolean) of every row."""
    as_is = vectors.schema[vector_col].dataType.simpleString() in ("array<float>", "array<double>")
    vector = F.col(f"`{vector_col}`") if as_is else F.col(f"`{vector_col}`").cast("array<double>")
    rows = vectors.select(F.col(f"`{id_col}`").alias("id"), vector.alias("v"))
    valid = F.coalesce(_valid(F.col("v")), F.lit(False)) & F.col("id").isNotNull()
    rows = rows.select("id", "v", valid.alias("valid"), F.xxhash64("v").alias("d1"), F.xxhash64(F.lit(1), "v").alias("d2"))
    classes = cut(rows.where("valid").groupBy("d1", "d2").agg(F.first("v").alias("v"), F.min("id").alias("rep"), F.count("*").alias("size")))
    links = cut(linked_pairs(classes, threshold, recall))
    both = links.union(links.select("b", "a")).toDF("rep", "other")
    degree = both.join(classes.select(F.col("rep").alias("other"), "size"), "other").groupBy("rep").agg(F.sum("size").alias("beyond"))
    found = components(links)
    known = classes.join(degree, "rep", "left").join(found.withColumnRenamed("node", "rep"), "rep", "left").select("d1", "d2", (F.col("size") - 1 + F.coalesce("beyond", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    linked = rows.where("valid").join(known, ["d1", "d2"]).select("id", "n_links", "component_id")
    alone = rows.where("not valid").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.union(alone).select(F.col("id").alias(id_col), F.col("n_links").cast("long").alias("n_links"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def op3_embeddings(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
