"""What the text operators share: Arrow passes over (id, text), the train/held-out split, components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from srcfacts.session import stored

#: Rows handed to a text function at once, and rows of an Arrow batch at most: Spark builds batches outside its heap, by
#: doubling buffers, so that 10,000 rows (its default) with long texts would take gigabytes of an executor.
ROWS_AT_ONCE = 256
ROWS_PER_BATCH = 512
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def bound_batches(df: DataFrame) -> None:
    """Lowers the session's Arrow batch size to ``ROWS_PER_BATCH``; a smaller one set by the user stays."""
    conf = df.sparkSession.conf
    now = int(conf.get(_BATCH))
    if now <= 0 or now > ROWS_PER_BATCH:
        conf.set(_BATCH, str(ROWS_PER_BATCH))


def text_pass(
    docs: DataFrame,
    fn: Callable[[list[str]], list],
    fields: list[T.StructField],
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """One scan of (id, text): ``fn`` maps texts (null read as empty) to one Arrow-convertible list per field.

    Only the id, the text and ``keep`` are read; other columns, whatever their names, play no part.
    """
    bound_batches(docs)
    kept = [id_col, *keep]
    text = text_col if text_col in kept else "__text"
    picked = docs.select(*[F.col(f"`{c}`") for c in kept], *([] if text == text_col else [F.col(f"`{text_col}`").alias(text)]))
    schema = T.StructType([docs.schema[c] for c in kept] + fields)
    names, types = [f.name for f in fields], [f.type for f in to_arrow_schema(T.StructType(fields))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(at, ROWS_AT_ONCE)
                texts = [t or "" for t in batch.column(text).to_pylist()]
                made = [x if isinstance(x, pa.Array) else pa.array(x, type=t) for x, t in zip(fn(texts), types, strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *made], names=[*kept, *names])

    return picked.mapInArrow(run, schema)


def split_of(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 4; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4


def held_out(id_col: str = "doc_id") -> Column:
    return split_of(id_col) == 2


def components(edges: DataFrame, most_rounds: int = 40) -> DataFrame:
    """(node, component) of every node on an edge (a, b); component = its smallest node.

    Alternating large and small stars: each round sends every node's neighbours to the smallest one,
    so that the rounds grow with the logarithm of a component's size. Smallest nodes are combined before the shuffle and written
    before they are joined: both sides of the join are then shuffled for it, so that Spark may split a hub's rows, or the small side
    is broadcast by its measured size. Every round is written to the shared folder. Null ends and self-loops are left out; no edges give an empty result.
    """
    links = stored(edges.select("a", "b").where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())

    def summary(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    seen = summary(links)
    for _ in range(most_rounds if seen[0] else 0):
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stored(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = stored(large)
        least = stored(large.groupBy("a").agg(F.min("b").alias("m")))
        joined = large.join(least, "a")
        small = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        links = stored(small.where("a <> b").distinct())
        now = summary(links)
        if now == seen:
            break
        seen = now
    else:
        if seen[0]:
            raise RuntimeError(f"components not settled after {most_rounds} rounds")
    ends = links.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node")
    return ends.union(links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
