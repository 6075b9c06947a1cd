"""Running values along ordered rows of any number, in pieces: no key has to fit into a task.

Rows of a key are cut into pieces in their order. Every piece gives one summary, the summaries are gone through in order - a row a
piece, not a line - and each piece is replayed on its own from what came before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from srcfacts.session import cut

#: Lines of a piece where rows are ordered by one whole number.
LINES = 1 << 16


def pieces(rows: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], lines: int = LINES) -> DataFrame:
    """Rows with ``__piece``, ascending in the order inside each key.

    By one whole number a piece is a range of it. Other orders are cut where equal shares of the rows begin (by keys and order,
    so that pieces are of one size whatever the keys are), and checkpointed, as the cuts come from a sample.
    """
    if len(order) == 1 and isinstance(rows.schema[order[0]].dataType, T.IntegralType):
        return rows.withColumn("__piece", F.floor(F.col(order[0]) / lines).cast("long"))
    return cut(rows.repartitionByRange(*keys, *order).withColumn("__piece", F.spark_partition_id().cast("long")))


def scanned(
    rows: DataFrame,
    last: dict[str, Column] | None = None,
    sums: dict[str, Column] | None = None,
    totals: dict[str, Column] | None = None,
    keys: tuple[str, ...] = ("file",),
    order: tuple[str, ...] = ("line_no",),
    lines: int = LINES,
) -> DataFrame:
    """Rows with running values of their key, up to and with each row: ``last`` the last value that isn't null, ``sums`` the sum (null counts as 0);
    ``totals`` is the sum over the whole key. Null keys are a key like any other; rows of equal order are taken in any order."""
    last, sums, totals = last or {}, sums or {}, totals or {}
    made = {f"__v_{n}": e for n, e in (last | sums | totals).items()}
    cut_up = pieces(rows.withColumns(made), keys, order, lines)
    place = F.struct(*[F.col(c) for c in order])
    parts = [F.max_by(f"__v_{n}", F.when(F.col(f"__v_{n}").isNotNull(), place)).alias(f"__v_{n}") for n in last] + [F.sum(f"__v_{n}").alias(f"__v_{n}") for n in (sums | totals)]
    before = Window.partitionBy(*keys).orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    earlier = [F.last(f"__v_{n}", ignorenulls=True).over(before).alias(f"__v_{n}") for n in last] + [F.coalesce(F.sum(f"__v_{n}").over(before), F.lit(0)).alias(f"__v_{n}") for n in sums]
    whole = [F.sum(f"__v_{n}").over(Window.partitionBy(*keys)).alias(f"__v_{n}") for n in totals]
    heads = cut_up.groupBy(*keys, "__piece").agg(*parts).select(*keys, "__piece", *earlier, *whole, F.lit(0).alias("__row"))
    both = cut_up.withColumn("__row", F.lit(1)).unionByName(heads, allowMissingColumns=True)
    here = Window.partitionBy(*keys, "__piece").orderBy("__row", *order).rowsBetween(Window.unboundedPreceding, 0)
    out = {n: F.last(f"__v_{n}", ignorenulls=True).over(here) for n in last} | {n: F.sum(f"__v_{n}").over(here) for n in sums} | {n: F.first(f"__v_{n}").over(here) for n in totals}
    own = [c for c in rows.columns if c not in out]
    return both.select(*both.columns, *[c.alias(f"__w_{n}") for n, c in out.items()]).where("__row = 1").select(*own, *[F.col(f"__w_{n}").alias(n) for n in out])
