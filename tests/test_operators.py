"""Exact small cases of the operators: the queries' SQL covers the rest."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from srcfacts.functions import text as X
from srcfacts.operators import experiments as E
from srcfacts.operators import facts as K
from srcfacts.operators import graph as G
from srcfacts.operators import logs as L
from srcfacts.operators import mining as M
from srcfacts.operators import regression as R
from srcfacts.operators import sampling as N
from srcfacts.operators import tree as T


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first().x


def test_text_functions(spark):
    c = F.col("c")
    assert one(spark, X.split_blank(c), c="  ab  cd \n \t ef") == ["ab", "cd", "ef"]
    assert one(spark, X.split_char(c, "="), c="hello=") == ["hello"] and one(spark, X.split_char(c, "|"), c="|Hello|World|") == ["", "Hello", "World"]
    assert [one(spark, X.is_number(c), c=v) for v in ("442", "10", "-5", "5+2", "SIZE", "")] == [True, True, True, False, False, False]
    assert one(spark, X.has_path_suffix(c, F.lit("world/a.c")), c="/hello/world/a.c") and not one(spark, X.has_path_suffix(c, F.lit("hello/a.c")), c="/hello/world/a.c")
    assert one(spark, X.path_without_suffix(c, F.lit("world/a.c")), c="/hello/world/a.c") == "/hello"
    assert one(spark, X.include_target(c), c="#include <foo/hello.h>") == "foo/hello.h" and one(spark, X.include_target(c), c='# include "hello.h"') == "hello.h"
    assert one(spark, X.identifiers(c), c="int foo\nbar; union false") == ["foo", "bar"] and one(spark, X.identifiers(c, True), c="foo\nbar") == ["foobar"]
    assert one(spark, X.address_value(c), c="0xff") == 255 and one(spark, X.address_value(c), c="(nil)") == 0
    assert one(spark, X.coverage_percent(c), c="93.06% of 72") == 93.06 and one(spark, X.seconds(c), c="0.499 seconds") == 0.499
    assert one(spark, X.function_declaration(c), c="int f(a, b) int a; char *b; {}") == "int f(a, b);"
    assert one(spark, X.typedef_declaration(c), c="typedef struct A2 {\n int x; } A2;") == "typedef struct A2 A2;"
    assert one(spark, X.marked_tokens(c), c="(if (*a) (*b) c)") == 2
    assert one(spark, X.xml_names(c), c="<u><name>a</name><call><name>f</name></call><comment>no</comment>t</u>") == ["a", "f"]
    assert one(spark, X.xml_text(c), c="<u>a<comment>no</comment>t</u>") == "at"
    text = "int b,c;\nint d = 0,\n e; x"
    at = lambda line, col: F.struct(F.lit(line).alias("line"), F.lit(col).alias("col"))
    assert one(spark, X.span(c, at(1, 5), at(2, 5)), c=text) == "b,c;\nint d" and one(spark, X.span_to_semicolon(c, at(2, 1), at(2, 5)), c=text) == "int d = 0,\n e;"
    assert one(spark, X.exit_class(c), c=124) == "timeout" and one(spark, X.repository_id(c), c="https://h.org/a/b.git") == "a--b"


def _trace(spark, rows):
    return spark.createDataFrame([(1, t, s, k, v) for t, values in enumerate(rows) for (s, k), v in values.items()], "seg int, test int, side string, key string, value string")


def test_mining_edges(spark):
    i, o = ("input", "int_x"), ("output", "int_y")
    assert M.linear(_trace(spark, [{i: "1", o: "2"}, {i: "2", o: "4"}])).count() == 0  # two rows
    line = M.linear(_trace(spark, [{i: str(x), o: str(3 * x - 1)} for x in (1, 5, 9)])).first()
    assert (line.slope, line.intercept, line.rule) == (3, -1.0, "int_y = 3 * int_x + -1")
    for f in (lambda x: 7, lambda x: x // 2 + x % 2, lambda x: x * x):
        assert M.linear(_trace(spark, [{i: str(x), o: str(f(x))} for x in range(1, 8)])).count() == 0
    assert M.linear(_trace(spark, [{i: "5", o: str(x)} for x in range(4)])).count() == 0
    rows = [{i: str(x), o: str(x + 2)} for x in range(3)] + [{i: "9", o: "NA"}, {i: None, o: "4"}]
    assert M.linear(_trace(spark, rows)).first().n == 3 and M.distances(_trace(spark, rows)).first().distance == 2
    big = M.linear(_trace(spark, [{i: str(10**8 + x), o: str(2 * (10**8 + x))} for x in (1, 10**8, 3 * 10**8)])).first()
    assert big.slope == 2
    assert M.relations(_trace(spark, rows), strict=True).first().op == "<"
    assert M.constants(_trace(spark, [{("output", "addr_p"): "(nil)"}] * 3)).first().value == "nil"


def test_regression(spark):
    rng = np.random.default_rng(1)
    rows = [{("input", "a"): str(a), ("input", "b"): str(b), ("input", "c"): str(2 * a), ("output", "y"): str(3 * a - 2 * b + 7), ("output", "z"): str(a * a)} for a, b in rng.integers(1, 50, (60, 2))]
    got = {r.y: r for r in R.least_squares(_trace(spark, rows)).collect()}
    assert got["output_y"].xs == ["input_a", "input_b"] and np.allclose(got["output_y"].slopes, [3, -2]) and abs(got["output_y"].intercept - 7) < 1e-6
    sub = [(r.y, r.xs) for r in R.subset_regression(_trace(spark, rows), least_r2=0.999).collect()]
    assert sorted(xs for y, xs in sub if y == "output_y") == [["input_a", "input_b"], ["input_b", "input_c"]]
    assert ["input_a*input_a"] in [xs for y, xs in sub if y == "output_z"] and ["input_a"] not in [xs for y, xs in sub if y == "output_z"]
    bent = [{("input", "a"): str(a), ("input", "b"): str(b), ("output", "y"): str(a if a < 30 else 90 - 2 * a)} for a, b in zip(range(60), rng.permutation(60), strict=True)]
    best = R.piecewise(_trace(spark, bent)).first()
    assert best.x == "a" and best.segments == 2 and best.r2 > 0.999 and best.breaks[0] in (29.0, 30.0)
    flat = [{("input", "a"): str(a), ("output", "y"): "7"} for a in range(5)]
    assert [(r.xs, r.intercept, r.r2) for r in R.least_squares(_trace(spark, flat)).collect()] == [([], 7.0, 1.0)]


def test_all_subsets_and_polynomials(spark):
    rng = np.random.default_rng(2)
    rows = [{("input", "a"): str(a), ("input", "b"): str(b), ("output", "y"): str(5 * a), ("output", "p"): str((a - 25) * (b - 25))} for a, b in rng.integers(1, 50, (80, 2))]
    got = R.subset_regression(_trace(spark, rows), least_r2=0.99).collect()
    assert sorted(r.xs for r in got if r.y == "output_y") == [["input_a"], ["input_a", "input_b"]]
    assert not [r for r in got if r.y == "output_p"]
    square = [{("input", "a"): str(a), ("input", "b"): str(b), ("output", "p"): str(a * a - 3 * a * b)} for a, b in rng.integers(-50, 50, (80, 2))]
    found = R.subset_regression(_trace(spark, square), least_r2=0.999).collect()
    assert [(r.xs, [round(k, 6) for k in r.slopes]) for r in found] == [(["input_a*input_a", "input_a*input_b"], [1.0, -3.0])]
    assert R.subset_regression(_trace(spark, square), least_r2=0.999, polynomial=False).count() == 0


def test_piecewise_keeps_every_value(spark):
    """Over a thousand distinct inputs: the break is where it is, and scatter isn't averaged away."""
    rows = [{("input", "a"): str(a), ("output", "y"): str(a if a < 2345 else 2345 - 3 * (a - 2345))} for a in range(4000)]
    best = R.piecewise(_trace(spark, rows)).first()
    assert best.segments == 2 and best.r2 == 1.0 and best.breaks[0] in (2344.0, 2345.0)
    noisy = [{("input", "a"): str(a), ("output", "y"): str((a * 7919) % 101)} for a in range(4000)]
    assert R.piecewise(_trace(spark, noisy)).first().r2 < 0.05


def test_graph_edges(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c")], "src string, dst string")
    assert [r.node for r in G.topo_rank(edges).orderBy("rank").collect()] == ["a", "b", "c"] and not G.has_cycle(edges)
    ring = edges.union(spark.createDataFrame([("c", "a")], "src string, dst string"))
    assert G.has_cycle(ring) and {r.rank for r in G.topo_rank(ring).collect()} == {None}
    assert G.has_cycle(spark.createDataFrame([("a", "a")], "src string, dst string")) and not G.has_cycle(edges.limit(0))
    seeds = spark.createDataFrame([(1, "a"), (2, "x")], "q int, node string")
    assert sorted(map(tuple, G.closure(ring, seeds).collect())) == [(1, "a"), (1, "b"), (1, "c"), (2, "x")]
    chain = spark.createDataFrame([(i, i + 1) for i in range(6)], "src int, dst int")
    with pytest.raises(RuntimeError):
        G.closure(chain, spark.createDataFrame([(0, 0)], "q int, node int"), most_rounds=3)
    deps = spark.createDataFrame([(3, 2), (2, 1)], "src long, dst long")
    outers = spark.createDataFrame([(1, 9), (9, 9)], "src long, dst long")
    assert {r.node for r in G.resolve_with_deps(spark.createDataFrame([(0, 3)], "q int, node long"), deps, outers).collect()} == {3, 2, 9}
    calls = spark.createDataFrame([(1, "f"), (2, "g")], "node int, callee string")
    owner = spark.createDataFrame([(1, "g"), (2, "f")], "node int, name string")
    assert G.is_recursive(calls, owner)


def test_tree_completion(spark):
    rows = [(1, None, "function", "root"), (2, 1, "compound", "body"), (3, 2, "if", "stmt"), (4, 3, "kw", "keyword"), (5, 3, "expr", "condition"), (6, 3, "compound", "then"), (7, 6, "tok", "brace"), (8, 6, "expr", "stmt"), (9, 2, "expr", "stmt")]
    tree = spark.createDataFrame([(1, n, p, n, k, r) for n, p, k, r in rows], "file int, node_id int, parent_id int, ord int, kind string, role string")
    lifted = T.lift(tree)
    sel = spark.createDataFrame([(0, 3), (0, 4)], "q int, node_id int")
    assert {r.node_id for r in T.complete(tree, lifted, sel).collect()} == {3, 4, 5, 6, 7}
    path = {r.node_id: r.path for r in T.kind_path(tree).collect()}
    assert path[3] == "function/compound/if" and {r.node_id: r.depth for r in T.depths(lifted).collect()}[8] == 4
    assert T.distance(lifted, spark.createDataFrame([(8, 9)], "a int, b int")).first().distance == 4
    lines = spark.createDataFrame([("a", "f", 1, 8, ["x"], 1, False), ("a", "f", 2, 9, ["x", "y"], 2, True), ("a", "g", 3, 5, [], 0, False)], "file string, function string, line int, node_id int, variables array<string>, var_type int, uses_global boolean")
    crit = spark.createDataFrame([(1, "a", 1)], "crit int, file string, line int")
    member = spark.createDataFrame([(1, "a", 2)], "crit int, file string, line int")
    got = {r.line: r for r in T.slice_features(lines, crit, lifted, member).collect()}
    assert set(got) == {1, 2} and got[2].in_slice and got[2].same_var == 1 and got[2].distance == 1 and got[2].ast_distance == 4


def test_log_edges(spark):
    text = ["INPUT_SPEC", "a = 1", "a = 2 = 3", "INPUT_SPEC_END", "POI_INSTRUMENT", "b = (nil)", "POI_INSTRUMENT_END", "TEST_FAILURE", "TEST_SUCCESS", "c = 1"]
    lines = spark.createDataFrame([("f", i + 1, x) for i, x in enumerate(text)], "file string, line_no int, line string")
    got = sorted((r.test, r.side, r.key, r.value, r.reach_code, r.status_code) for r in L.trace_records(lines).where("test = 1").collect())
    assert got == [(1, "input", "a", "2", 5, 1), (1, "output", "b", "(nil)", 5, 1)]
    last = L.trace_records(lines).where("test = 2").collect()
    assert len(last) == 1 and last[0].key is None and last[0].status_code == 0
    blocks = spark.createDataFrame([("f", i, x) for i, x in enumerate(["p", "POI_INSTRUMENT", "1", "POI_INSTRUMENT", "2"])], "file string, line_no int, line string")
    assert [r.line for r in L.last_complete_block(blocks).orderBy("line_no").collect()] == ["p", "POI_INSTRUMENT", "1"]
    assert L.segment_results(lines.limit(0)).count() == 0


def test_small_tables(spark):
    spans = spark.createDataFrame([("f", 1, 1, 9), ("f", 2, 2, 3), ("f", 3, 3, 3), ("f", 4, 9, 12)], "file string, id int, begin int, end int")
    assert sorted(map(tuple, K.enclosing(spans).collect())) == [(2, 1), (3, 1)]
    lib = spark.createDataFrame([(1, "p", "/usr/include/a/x.h"), (0, "q", "/opt/x.h")], "pos int, package string, header string")
    assert K.header_library(spark.createDataFrame([("x.h",)], "target string"), lib, ["/usr/include/a"]).first().package == "p"
    tests = spark.createDataFrame([(t, n, v) for t, row in enumerate([("purple", "Ford"), ("red", "VW"), ("purple", "Ford")], 2) for n, v in zip(("color", "car"), row, strict=True)], "test int, name string, value string")
    cover = {(r.value1, r.value2): r.n for r in N.pair_coverage(tests).collect()}
    assert cover["Ford", "purple"] == 2 and cover["VW", "purple"] == 0
    assert sorted(r.test for r in N.pair_cases(tests).where("value1 = 'Ford' and value2 = 'purple'").collect()) == [2, 4]
    pool = N.pairwise_pool(spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "x"), ("c", "y"), ("c", "z")], "name string, value string"))
    assert pool.select("test").distinct().count() == 2 + 4 + 2 and pool.groupBy("test").count().where("count <> 3").count() == 0
    assert N.pairwise_pool(spark.createDataFrame([("a", "1"), ("a", "2")], "name string, value string")).count() == 2
    bases = spark.createDataFrame([("a", 100, 64), ("b", None, None)], "name string, base int, size int")
    corner = {(r.name, r.value) for r in N.corner_values(bases, "name", "base", "size").collect()}
    assert {("a", v) for v in (98, 102, 512, 514, 62, 66, -2)} | {("b", -2)} <= corner and ("b", 98) not in corner
    values = N.random_values(spark.range(50).withColumnRenamed("id", "test"), spark.createDataFrame([("s", "string"), ("i", "int")], "name string, type string"), low=-3, high=3)
    assert values.count() == 100 and values.where("type = 'int' and (int(value) < -3 or int(value) > 3)").count() == 0
    rate = E.build_rate(spark.createDataFrame([(1, True, True), (1, False, False), (1, True, False), (2, False, False)], "p int, b boolean, r boolean"), "p", F.col("b"), F.col("r"), 2)
    assert {(r.p, r.build_rate, r.run_rate) for r in rate.collect()} == {(1, 0.66, 0.5), (2, 0.0, None)}


def test_two_input_rules_of_large_segments(spark):
    n = F.col("id")
    a, b = F.pmod(F.xxhash64(n, F.lit(1)), F.lit(50)) + 1, F.pmod(F.xxhash64(n, F.lit(2)), F.lit(7)) + 1
    wide = spark.range(40 * 5000).select((n % 40).cast("int").alias("seg"), n.cast("int").alias("test"), a.alias("a"), b.alias("b"))
    big = 10**17  # the last segments have numbers of 18 digits
    base = F.when(F.col("seg") >= 35, F.lit(big)).otherwise(F.lit(0))
    cells = [("input", "int_a", F.col("a") + base), ("input", "int_b", F.col("b")), ("output", "int_y", 2 * (F.col("a") + base) - 3 * F.col("b") + 1), ("output", "int_z", 2 * (F.col("a") + base) - 3 * F.col("b") + (F.col("test") < 40).cast("long"))]
    trace = wide.select("seg", "test", F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.lit(k).alias("key"), v.cast("string").alias("value")) for s, k, v in cells])).alias("x")).select("seg", "test", "x.*")
    got = sorted(M.linear_two(trace).collect())
    assert [tuple(r) for r in got] == [(g, "int_y", "int_a", "int_b", 2, -3, 1.0, 5000) for g in range(40)]


def test_repeated_keys_count_once(spark):
    rows = [(1, t, s, k, v) for t in range(4) for s, k, v in [("input", "int_x", str(t)), ("input", "int_x", str(t + 1)), ("output", "int_y", str(t + 1)), ("output", "int_y", str(t)), ("input", "addr_p", "0x1"), ("output", "addr_p", "0x1"), ("output", "addr_p", "0x0")]]
    trace = spark.createDataFrame(rows, "seg int, test int, side string, key string, value string")
    assert [(r.x, r.y, r.op, r.confidence) for r in M.relations(trace).collect() if r.x == "int_x"] == [("int_x", "int_y", "=", 4)]
    assert [r.n for r in M.address_copies(trace).collect()] == [4] and [r.distance for r in M.distances(trace).collect()] == [0, 0]
    assert [r.n for r in M.linear(trace).collect()] == [4]


def test_repository_filter_with_its_own_values(spark):
    """The languages that rule a repository out, its share and its sizes."""
    of = {"c": {"C": 900, "make": 100}, "ruby": {"C": 900, "Ruby": 1}, "js": {"C": 900, "JavaScript": 1}, "java": {"C": 900, "Java": 1}, "cpp": {"C": 900, "C++": 1}, "objc": {"C": 900, "Objective-C": 1}, "python": {"C": 700, "Python": 300}, "go": {"C": 900, "Go": 100}, "less": {"C": 699, "Python": 301}, "much": {"C": 100_001}, "none": {"Go": 5}}
    rows = [(k, v, 1000) for k, v in of.items()] + [("large", {"C": 900}, 1001), ("empty", None, 1)]
    df = spark.createDataFrame(rows, "name string, languages map<string,long>, size long")
    assert sorted(r.name for r in E.filter_c_repos(df).collect()) == ["c", "go", "python"]


def _grown(spark, rows):
    """(node, parent, kind, role) as a tree."""
    return spark.createDataFrame([(n, p, k, r) for n, p, k, r in rows], "node_id int, parent_id int, kind string, role string")


@pytest.mark.parametrize(
    ("kind", "roles", "selected", "called"),
    [
        ("if", ["keyword", "condition", "then"], ["condition"], ["keyword", "condition", "then"]),
        ("if", ["keyword", "condition", "then"], ["then"], []),
        ("if", ["keyword", "condition", "then", "else keyword", "else"], ["condition"], ["keyword", "condition", "then"]),
        ("if", ["keyword", "condition", "then", "else keyword", "else"], ["else"], []),
        ("if", ["keyword", "condition", "then", "else keyword", "else"], ["else", "condition"], ["keyword", "condition", "then", "else keyword", "else"]),
        ("if", ["keyword", "condition", "then", "else keyword", "else"], ["else keyword"], ["keyword", "condition", "then", "else keyword", "else"]),
        ("for", ["keyword", "init", "condition", "increment", "body"], ["init"], ["keyword", "body"]),
        ("for", ["keyword", "init", "condition", "increment", "body"], ["body"], []),
        ("while", ["keyword", "condition", "body"], ["keyword"], ["keyword", "condition", "body"]),
        ("do", ["keyword", "body", "while", "condition"], [], ["keyword", "body", "while", "condition"]),
        ("do", ["keyword", "body", "while", "condition"], ["body"], []),
        ("return", ["keyword", "value"], ["keyword"], ["keyword", "value"]),
        ("switch", ["keyword", "condition", "case", "case"], ["condition"], ["keyword", "condition"]),
        ("switch", ["keyword", "condition", "case", "case"], ["case"], ["keyword", "condition"]),
        ("compound", ["brace", "stmt", "brace"], [], ["brace", "brace"]),
        ("compound", ["brace", "stmt", "brace"], ["stmt"], []),
        ("compound", ["brace", "stmt", "stmt", "brace"], ["stmt"], ["brace", "brace"]),
    ],
)
def test_what_parents_call_for(spark, kind, roles, selected, called):
    rows = [(1, None, kind, "stmt")] + [(i, 1, "x", r) for i, r in enumerate(roles, 2)]
    chosen = [1] + [n for n, p, _, r in rows if p and r in selected]
    got = T.mandatory(_grown(spark, rows), spark.createDataFrame([(0, n) for n in chosen], "q int, node_id int"))
    role = {n: r for n, _, _, r in rows}
    assert sorted(role[r.node_id] for r in got.collect()) == sorted(called)


def test_a_case_by_its_own_keyword_needs_its_switch(spark):
    rows = [(1, None, "switch", "stmt"), (2, 1, "x", "keyword"), (3, 1, "x", "condition"), (4, 1, "case", "case"), (5, 4, "x", "keyword"), (6, 4, "x", "condition"), (7, 4, "x", "body")]
    call = lambda nodes: sorted(r.node_id for r in T.mandatory(_grown(spark, rows), spark.createDataFrame([(0, n) for n in nodes], "q int, node_id int")).collect())
    assert call([1, 4, 7]) == [5, 6] and call([1, 4, 5]) == [2, 3, 5, 6]


def test_dense_numbers_of_a_hot_key(spark):
    rows = spark.range(3000).select((F.col("id") % 1000 == 0).alias("key"), (F.col("id") * 7919 % 3000).alias("at")).union(spark.createDataFrame([(None, 5)], "key boolean, at long"))
    got = [(r.key, r["at"]) for r in L.number_rows(rows, ["key", "at"], "n", 1).orderBy("n").collect()]
    want = sorted(((r.key, r["at"]) for r in rows.collect()), key=lambda x: (x[0] is not None, bool(x[0]), x[1]))
    assert got == want


def test_selections_by_mode(spark):
    rows = [("f", i) for i in range(50)] + [("g", 100 + i) for i in range(2)] + [(None, 200 + i) for i in range(20)]
    tokens = spark.createDataFrame(rows, "function string, id long")
    for mode, pool in (("same function", range(50)), ("functions", [i for f, i in rows if f]), ("all", [i for _, i in rows])):
        got = {}
        for r in N.random_selections(tokens, 5, 40, mode).collect():
            got.setdefault(r.sel_id, []).append(r.id)
        assert len(got) == 40 and all(len(set(x)) == 5 and set(x) <= set(pool) for x in got.values()), mode
        assert len({tuple(sorted(x)) for x in got.values()}) > 20
    assert N.random_selections(tokens, 60, 3).count() == 0 and N.random_selections(tokens, 80, 3, "all").count() == 0
    assert N.random_selections(tokens, 70, 3, "all").groupBy("sel_id").count().where("count <> 70").count() == 0


def test_groups_give_their_quota(spark, monkeypatch):
    monkeypatch.setattr(N, "RANGE_ROWS", 16)
    rows = spark.range(4000).select(F.when(F.col("id") % 3 == 0, "a").when(F.col("id") < 30, None).otherwise("b").alias("g"), "id")
    got = {r.g: r["count"] for r in N.per_group(rows, "g", "id", 25).groupBy("g").count().collect()}
    assert got == {"a": 25, "b": 25, None: 20}
    plain = sorted((r.id for r in rows.where("g = 'b'").collect()), key=lambda i: ((i % N.MODULUS) * 1103515245 + 12345) % N.MODULUS)[:25]
    assert sorted(r.id for r in N.per_group(rows, "g", "id", 25).where("g = 'b'").collect()) == sorted(plain)


def test_clones_of_a_large_class(spark, monkeypatch):
    monkeypatch.setattr("srcfacts.operators.clones._paired.__defaults__", (16,))
    from srcfacts.operators import clones as C

    fragments = spark.range(100).select((F.col("id") < 90).cast("int").alias("class"), F.lit(2).alias("type"), "id")
    assert C.pairs(fragments).count() == 90 * 89 // 2 + 10 * 9 // 2 and C.pairs(fragments).distinct().count() == 4050


def test_clone_counts_without_pairs(spark):
    from srcfacts.operators import clones as C

    fragments = spark.createDataFrame([(i % 3, 2 + i % 3 % 2, i // 2 if i < 6 else i) for i in range(40)] + [(0, 2, 9)], "class long, type int, id long")
    values = spark.createDataFrame([(i, s, t, str(v)) for i in range(40) for s, t, v in [("input", "int", i % 2), ("output", "int" if i % 3 else "char", i % 4)][: 1 + (i % 5 > 0)]], "id long, side string, type string, value string")
    one = sorted(map(tuple, C.class_summary(fragments, values).collect()))
    two = sorted(map(tuple, C.summary(C.compare(fragments, values)).collect()))
    assert one == two and len(one) == 2
    many = spark.range(200_000).select(F.lit(1).alias("class"), F.lit(2).alias("type"), "id")
    same = many.select("id", F.lit("input").alias("side"), F.lit("int").alias("type"), (F.col("id") % 2).cast("string").alias("value"))
    assert tuple(C.class_summary(many, same).first()) == (2, 200_000 * 199_999 // 2, 200_000 * 199_999 // 2, 200_000 * 199_999 // 2, 2 * (100_000 * 99_999 // 2))
