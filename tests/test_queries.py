"""Registered queries on small tables of the kinds that large ones bring, against their SQL."""

import datetime
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from srcfacts.operators import facts as K
from srcfacts.operators import mining as M
from srcfacts.operators import tree as T
from srcfacts.plans import registry

DAY = datetime.datetime(1995, 3, 1)
SCHEMAS = {
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate timestamp, o_orderpriority string",
    "customer": "c_custkey long",
    "supplier": "s_suppkey long",
    "part": "p_partkey long, p_brand string, p_size int",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_returnflag string, l_linestatus string",
}


@pytest.fixture
def against_sql(spark, tmp_path):
    def check(name, **tables):
        base, found = duckdb.connect(), {}
        for t, rows in tables.items():
            spark.createDataFrame(rows, SCHEMAS[t]).write.mode("overwrite").parquet(f"{tmp_path}/{t}.parquet")
            base.execute(f"create view {t} as select * from read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
        got = registry.queries()[name](spark, str(tmp_path))
        want = base.execute(registry.oracle_sql()[name])
        at = [got.columns.index(c[0]) for c in want.description]
        plain = lambda x: tuple(x) if isinstance(x, list) else x
        found = Counter(tuple(plain(r[k]) for k in at) for r in got.collect())
        assert found == Counter(tuple(map(plain, r)) for r in want.fetchall())
        return found

    return check


def _orders(keys, customer=lambda k: k % 3, status=lambda k: "P"):
    return [(k, customer(k), status(k), DAY, "5-LOW" if k % 2 else "zz") for k in keys]


def test_orders_with_the_numbers_of_function_ends(against_sql):
    """Orders 1000000 on have the numbers of entries and exits; some lead to such a node and call it as well."""
    customers = [(c,) for c in range(4)]
    orders = _orders([1, 2, 3, 7, *range(1000000, 1000010), 2000004, 2000008], lambda k: 1 if k == 2000004 else 2 if k == 2000008 else k % 5, lambda k: "PPF"[k % 3])
    for name in ("g09_icfg", "g08_eliminate_callsites", "g09_icfg_without_ends"):
        found = against_sql(name, orders=orders, customer=customers)
        assert found


def test_call_graph_without_a_shuffle_of_pairs(spark, against_sql, monkeypatch):
    """A name that all call is dealt into parts; callers and functions with several common names make one pair."""
    monkeypatch.setattr(K, "PAIRS", 10)
    against_sql("j06_call_graph", orders=_orders(range(300), lambda k: k % 60), supplier=[(s,) for s in range(120)])
    calls = spark.createDataFrame([(1, ["a", "b", None, "a"]), (1, ["c"]), (2, None), (None, ["b"]), *[(k, ["b", "c"]) for k in range(5, 40)]], "id int, callees array<string>")
    functions = spark.createDataFrame([(10, "a"), (10, "b"), (10, "b"), (11, "c"), (11, "b"), (12, None), (None, "c"), (13, "z")], "id int, name string")
    found = K.call_graph(calls, functions)
    want = {(1, 10), (1, 11), (1, None), (None, 10), (None, 11)} | {(k, d) for k in range(5, 40) for d in (10, 11, None)}
    assert Counter((r.src, r.dst) for r in found.collect()) == Counter(want)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan.split("Join")[0]  # pairs are made last and not put together again


def test_slice_features_without_a_shuffle_of_pairs(spark, against_sql, monkeypatch):
    """Functions in parts and lots; the chains of bushy and of deep trees give the levels that walking up gives."""
    monkeypatch.setattr(T, "CRITERIA", 4)
    monkeypatch.setattr(T, "LINES", 16)
    found = against_sql("t14_slice_features", part=[(p, f"Brand#{1 + p * 7 % 13}", p * 5 % 50) for p in range(700)])
    assert any(r[-1] for r in found)
    up = {n: None if n in (1, 200) else n - 1 if n < 60 or n % 5 else n // 3 for n in range(1, 260)} | {300: 999, 301: 999, 302: 301}
    tree = spark.createDataFrame(list(up.items()), "node_id int, parent_id int")
    lines = tree.select(F.lit("a").alias("file"), F.lit("f").alias("function"), F.col("node_id").alias("line"), "node_id", F.array(F.lit("x")).alias("variables"), F.lit(1).alias("var_type"), F.lit(True).alias("uses_global"))
    lines = lines.union(spark.createDataFrame([("a", "f", 500, 500, ["y"], 1, True)], lines.schema))  # a line outside of the tree
    got = T.slice_features(lines, lines.select(F.col("line").alias("crit"), "file", "line"), T.lift(tree), lines.where("line % 7 = 0").select((F.col("line") - 1).alias("crit"), "file", "line"))
    way = lambda n: [n, *(way(up[n]) if up.get(n) in up else [])]
    rows = got.collect()
    assert len(rows) == (len(up) + 1) ** 2
    for r in rows:
        a, b = way(r.crit), way(r.line)
        lca = next((x for x in a if x in b and x in up), None)
        assert (r.criterion_to_lca, r.to_lca) == ((a.index(lca), b.index(lca)) if lca else (None, None)), (r.crit, r.line)
        assert r.in_slice == (r.line % 7 == 0 and r.crit == r.line - 1) and r.same_var == ((r.crit == 500) == (r.line == 500))
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join") <= 6


def test_mappable_mines_its_transfers_once(spark):
    transfers = spark.range(40).select((F.col("id") % 4).alias("seg"), F.concat(F.lit("output_"), F.col("id") % 5).alias("lhs"), F.when(F.col("id") % 3 == 0, "input_argv_1").otherwise("input_x").alias("rhs"))
    conditions = spark.createDataFrame([(1, "output_1 > 5"), (2, "output_1 > output_4"), (3, "1 > 2")], "id int, condition string")
    found = M.mappable(transfers, conditions)
    rows = transfers.collect()
    good = {(r.seg, r.lhs) for r in rows if r.rhs == "input_argv_1"}
    want = {(i, s, all((s, n) in good for n in names)) for i, names in ((1, ["output_1"]), (2, ["output_1", "output_4"])) for s in range(4)}
    assert {tuple(r) for r in found.collect()} == want
    assert "Range" not in found._jdf.queryExecution().optimizedPlan().toString()
