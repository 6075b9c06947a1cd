"""Inputs of the operators, derived from the generic tables by plain projections; the same in SQL.

``Inputs(spark, sf_dir)`` gives them as DataFrames; ``CTE`` has the SQL of each, and ``with_ctes`` puts those that a
query names in front of it.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from srcfacts.session import shared_folder, table


def _whole(c):
    return F.floor(c).cast("long")


class Inputs:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)

    def folder(self, name: str) -> str:
        """A new folder for files, where all executors see it."""
        return f"{shared_folder(self.spark)}/{name}-{uuid.uuid4().hex}"

    # recorded runs and their values
    def runs(self) -> DataFrame:
        rows = self.table("lineitem").groupBy(F.col("l_suppkey").alias("seg"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("test"))
        return rows.agg(
            F.max("l_quantity").cast("long").alias("qty"),
            F.max("l_linenumber").cast("long").alias("line"),
            F.max("l_partkey").alias("part"),
            F.when(F.max("l_returnflag") == "A", 5).when(F.max("l_returnflag") == "R", 6).otherwise(4).alias("reach_code"),
            F.when(F.max("l_linestatus") == "F", 1).otherwise(0).alias("status_code"),
        )

    def trace(self) -> DataFrame:
        c = F.col
        values = [
            ("input", "int_qty", c("qty")),
            ("input", "int_line", c("line")),
            ("input", "int_argv_1", c("qty") % 7),
            ("input", "addr_p", F.concat(F.lit("0x"), c("part"))),
            ("output", "int_a", (c("seg") % 3 + 1) * c("qty") + c("seg") % 5),
            ("output", "int_b", 2 * c("qty") - 3 * c("line") + c("seg") % 4),
            ("output", "int_c", c("seg") % 9),
            ("output", "int_d", F.when(c("line") != 7, c("qty") % 7)),
            ("output", "int_e", c("qty") * c("line")),
            ("output", "addr_q", F.concat(F.lit("0x"), c("part"))),
            ("output", "addr_n", F.lit("(nil)")),
        ]
        cells = F.array(*[F.struct(F.lit(s).alias("side"), F.lit(k).alias("key"), v.cast("string").alias("value")) for s, k, v in values])
        return self.runs().select("seg", "test", F.explode(cells).alias("x")).select("seg", "test", "x.side", "x.key", "x.value")

    # logs: per user in the order of time
    def log(self) -> DataFrame:
        kind = F.col("event_type")
        line = (
            F.when(kind == "signup", "INPUT_SPEC")
            .when(kind == "view", F.concat(F.lit("in_a = "), _whole(F.col("value"))))
            .when(kind == "click", F.concat(F.lit("out_b = "), _whole(F.col("value")) % 5))
            .when(kind == "purchase", "TEST_SUCCESS")
            .otherwise("TEST_FAILURE")
        )
        return self.table("events").select(F.col("user_id").alias("file"), "ts", "event_id", line.alias("line"))

    # projects with outcomes
    def builds(self) -> DataFrame:
        rows = self.table("orders").select("o_orderkey", F.col("o_custkey").alias("project"), F.col("o_orderstatus").alias("outcome"))
        sizes = self.table("lineitem").groupBy("l_orderkey").agg(F.count("*").alias("size"))
        return rows.join(sizes, rows["o_orderkey"] == sizes["l_orderkey"], "left").select(F.col("o_orderkey").alias("id"), "project", "outcome", F.coalesce("size", F.lit(0)).cast("long").alias("size"))

    # graphs
    def edges(self) -> DataFrame:
        """Each order points to about half its number; the small numbers form cycles."""
        return self.table("orders").select(F.col("o_orderkey").alias("src"), _whole((F.col("o_orderkey") + F.col("o_custkey") % 3) / 2).alias("dst"), F.col("o_orderpriority").alias("label"))

    def dag(self) -> DataFrame:
        n = self.table("part").select((F.col("p_partkey") + 1).alias("n"))
        return n.select(F.col("n").alias("src"), F.explode(F.array(_whole(F.col("n") / 2), _whole(F.col("n") / 3))).alias("dst")).where("dst >= 1 and dst <> src").distinct()

    def tree(self) -> DataFrame:
        n = F.col("p_partkey") + 1
        return self.table("part").select(
            (n % 7).alias("file"), n.alias("node_id"), F.when(n > 7, _whole(n / 14) * 7 + n % 7).alias("up"), F.col("p_brand").alias("kind"), F.col("p_size").cast("long").alias("size")
        ).select("file", "node_id", F.when((F.col("up") >= 1) & (F.col("up") < F.col("node_id")), F.col("up")).alias("parent_id"), "kind", "size")

    def intervals(self) -> DataFrame:
        begin = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date")).cast("long")
        return self.table("orders").select(F.col("o_custkey").alias("file"), F.col("o_orderkey").alias("id"), begin.alias("begin"), (begin + F.col("o_orderkey") % 30).alias("end"))


CTE = {
    "runs": """SELECT l_suppkey AS seg, l_orderkey * 10 + l_linenumber AS test, CAST(max(l_quantity) AS BIGINT) AS qty,
  CAST(max(l_linenumber) AS BIGINT) AS line, max(l_partkey) AS part,
  CASE max(l_returnflag) WHEN 'A' THEN 5 WHEN 'R' THEN 6 ELSE 4 END AS reach_code,
  CASE max(l_linestatus) WHEN 'F' THEN 1 ELSE 0 END AS status_code FROM lineitem GROUP BY 1, 2""",
    "trace": " UNION ALL ".join(
        f"SELECT seg, test, '{s}' AS side, '{k}' AS key, CAST({v} AS VARCHAR) AS value FROM runs"
        for s, k, v in [
            ("input", "int_qty", "qty"),
            ("input", "int_line", "line"),
            ("input", "int_argv_1", "qty % 7"),
            ("input", "addr_p", "'0x' || part"),
            ("output", "int_a", "(seg % 3 + 1) * qty + seg % 5"),
            ("output", "int_b", "2 * qty - 3 * line + seg % 4"),
            ("output", "int_c", "seg % 9"),
            ("output", "int_d", "CASE WHEN line <> 7 THEN qty % 7 END"),
            ("output", "int_e", "qty * line"),
            ("output", "addr_q", "'0x' || part"),
            ("output", "addr_n", "'(nil)'"),
        ]
    ),
    "known": "SELECT * FROM trace WHERE value IS NOT NULL",
    "ins": "SELECT seg, test, key AS x, value AS xv FROM known WHERE side = 'input'",
    "outs": "SELECT seg, test, key AS y, value AS yv FROM known WHERE side = 'output'",
    "pairs": "SELECT * FROM ins JOIN outs USING (seg, test)",
    "numbers": "SELECT seg, test, side, key, CAST(value AS BIGINT) AS v FROM known WHERE NOT contains(key, 'addr')",
    "values_of": "SELECT seg, test, side || '_' || key AS name, CASE WHEN value = '(nil)' THEN 0 ELSE CAST(value AS BIGINT) END AS v FROM known WHERE key NOT IN ('addr_p', 'addr_q')",
    "log": """SELECT user_id AS file, ts, event_id, CASE event_type WHEN 'signup' THEN 'INPUT_SPEC'
  WHEN 'view' THEN 'in_a = ' || CAST(floor(value) AS BIGINT) WHEN 'click' THEN 'out_b = ' || (CAST(floor(value) AS BIGINT) % 5)
  WHEN 'purchase' THEN 'TEST_SUCCESS' ELSE 'TEST_FAILURE' END AS line FROM events""",
    "builds": """SELECT o_orderkey AS id, o_custkey AS project, o_orderstatus AS outcome, coalesce(s.size, 0) AS size
  FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS size FROM lineitem GROUP BY 1) s ON l_orderkey = o_orderkey""",
    "edges": "SELECT o_orderkey AS src, (o_orderkey + o_custkey % 3) // 2 AS dst, o_orderpriority AS label FROM orders",
    "dag": """SELECT DISTINCT n AS src, dst FROM (SELECT p_partkey + 1 AS n, (p_partkey + 1) // 2 AS dst FROM part
  UNION ALL SELECT p_partkey + 1, (p_partkey + 1) // 3 FROM part) WHERE dst >= 1 AND dst <> n""",
    "tree": """SELECT file, node_id, CASE WHEN up >= 1 AND up < node_id THEN up END AS parent_id, kind, size FROM (
  SELECT (p_partkey + 1) % 7 AS file, p_partkey + 1 AS node_id, CASE WHEN p_partkey + 1 > 7 THEN (p_partkey + 1) // 14 * 7 + (p_partkey + 1) % 7 END AS up,
  p_brand AS kind, CAST(p_size AS BIGINT) AS size FROM part)""",
    "anc": """SELECT node_id, node_id AS anc, parent_id AS next, 0 AS up FROM tree
  UNION ALL SELECT a.node_id, t.node_id, t.parent_id, a.up + 1 FROM anc a JOIN tree t ON t.node_id = a.next""",
    "depths": "SELECT node_id, max(up) AS depth FROM anc GROUP BY 1",
    "intervals": """SELECT o_custkey AS file, o_orderkey AS id, date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS begin,
  date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) + o_orderkey % 30 AS "end" FROM orders""",
}


def with_ctes(sql: str) -> str:
    """``sql`` with the stand-ins that it names, in their order."""
    need: set[str] = set()

    def visit(text: str) -> None:
        for name in CTE:
            if name not in need and re.search(rf"\b(FROM|JOIN)\s+{name}\b|,\s*{name}\b(?=\s*(WHERE|$|,|\)))", text):
                need.add(name)
                visit(CTE[name])

    visit(sql)
    own = re.match(r"\s*WITH\s+(RECURSIVE\s+)?", sql)
    ctes = ",\n".join(f"{n} AS ({CTE[n]})" for n in CTE if n in need)
    if not ctes:
        return sql
    return f"WITH RECURSIVE {ctes}" + (",\n" + sql[own.end() :] if own else "\n" + sql)
