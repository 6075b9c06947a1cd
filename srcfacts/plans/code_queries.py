"""Registered queries of graphs, trees, spans, clones and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from srcfacts.functions import text as X
from srcfacts.operators import clones as C
from srcfacts.operators import facts as K
from srcfacts.operators import graph as G
from srcfacts.operators import sampling as R
from srcfacts.operators import tree as T
from srcfacts.plans.registry import add
from srcfacts.sources import files as S

# --- graphs
_CLOSURE = "c(q, node) AS (SELECT o_orderkey, o_orderkey FROM orders WHERE o_orderstatus = 'P' UNION SELECT q, dst FROM c JOIN edges ON src = node)"


def _seeds(i):
    """Orders still open in part: each asks for all that it leads to."""
    return _partial(i).select(F.col("node").alias("q"), "node")


def _partial(i):
    return i.table("orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("node"))


add("g01_closure", lambda i: G.closure(i.edges(), _seeds(i)), f"WITH RECURSIVE {_CLOSURE} SELECT q, node FROM c")
add("g01_closure_without_seed", lambda i: G.closure(i.edges(), _seeds(i), keep_seeds=False), f"WITH RECURSIVE {_CLOSURE} SELECT q, node FROM c WHERE q <> node")
add("g02_outermost", lambda i: G.outermost(i.dag().select(F.col("src").alias("q"), F.col("src").alias("node")), i.dag()), "WITH RECURSIVE c(q, node) AS (SELECT src, src FROM dag UNION SELECT q, dst FROM c JOIN dag ON src = node) SELECT q, node FROM c WHERE node NOT IN (SELECT src FROM dag)")
add("g03_resolve", lambda i: G.resolve_with_deps(i.dag().select(F.col("src").alias("q"), F.col("src").alias("node")), i.edges(), i.dag()), """WITH RECURSIVE r(q, node) AS (SELECT src, src FROM dag UNION SELECT q, dst FROM r JOIN (SELECT src, dst FROM edges UNION ALL SELECT src, dst FROM dag) e ON e.src = r.node)
 SELECT DISTINCT q, node FROM r WHERE node NOT IN (SELECT src FROM dag)""")
add("g04_successors", lambda i: G.neighbors(i.edges(), _partial(i)), "SELECT DISTINCT src AS node, dst AS neighbor FROM edges WHERE src IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')")
add("g04_predecessors", lambda i: G.neighbors(i.edges(), _partial(i), "in"), "SELECT DISTINCT dst AS node, src AS neighbor FROM edges WHERE dst IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')")
add("g05_has_cycle", lambda i: i.dag().select(F.lit("dag").alias("graph")).distinct().withColumn("cyclic", F.lit(G.has_cycle(i.dag()))).union(i.edges().select(F.lit("edges").alias("graph")).distinct().withColumn("cyclic", F.lit(G.has_cycle(i.edges())))),
    "WITH RECURSIVE c(q, node) AS (SELECT src, dst FROM edges UNION SELECT q, dst FROM c JOIN edges ON src = node) SELECT 'dag' AS graph, FALSE AS cyclic UNION ALL SELECT 'edges', EXISTS (SELECT 1 FROM c WHERE q = node)")
add("g06_topo_rank", lambda i: G.topo_rank(i.dag()), "WITH RECURSIVE p(node, rank) AS (SELECT src, 0 FROM dag WHERE src NOT IN (SELECT dst FROM dag) UNION SELECT dst, rank + 1 FROM p JOIN dag ON src = node) SELECT node, max(rank) AS rank FROM p GROUP BY 1")
_GONE = "(SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')"
add("g07_eliminate", lambda i: G.eliminate(i.edges(), _partial(i), "through"), f"""WITH RECURSIVE t(q, node) AS (SELECT src, dst FROM edges WHERE src NOT IN {_GONE} AND dst IN {_GONE} UNION SELECT q, dst FROM t JOIN edges ON src = node WHERE node IN {_GONE} AND dst IN {_GONE}),
 u AS (SELECT src, dst, label, 0 AS pos FROM edges WHERE src NOT IN {_GONE} AND dst NOT IN {_GONE} UNION ALL SELECT q, dst, 'through', 1 FROM t JOIN edges ON src = node WHERE dst NOT IN {_GONE})
 SELECT src, dst, arg_min(label, pos) AS label FROM u GROUP BY 1, 2""")
add("g11_drop_out_edges", lambda i: G.drop_out_edges(i.edges(), _partial(i)), f"SELECT * FROM edges WHERE src NOT IN {_GONE}")
add("u05_graph_union", lambda i: G.union(i.edges(), i.dag().withColumn("label", F.lit("dag"))), "SELECT src, dst, arg_min(label, (pos, label)) AS label FROM (SELECT src, dst, label, 0 AS pos FROM edges UNION ALL SELECT src, dst, 'dag', 1 FROM dag) GROUP BY 1, 2")


def _sites(i):
    return i.table("orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("node"), F.concat(F.lit("f"), F.col("o_custkey")).alias("callee"))


def _functions(i):
    return i.table("customer").select(F.concat(F.lit("f"), F.col("c_custkey")).alias("name"), (F.col("c_custkey") * 2 + 1000000).alias("entry"), (F.col("c_custkey") * 2 + 1000001).alias("exit"))


def _apart(i):
    """The functions with their ends below zero: over a million orders have numbers of ends too, and are other nodes."""
    return _functions(i).withColumn("entry", -1 - F.col("entry")).withColumn("exit", -1 - F.col("exit"))


def _numbered(edges):
    """Ends under their own numbers again; an edge between orders comes before one at a function's end."""
    own = lambda c: F.when(F.col(c) < 0, -1 - F.col(c)).otherwise(F.col(c)).alias(c)
    plain = (F.col("src") >= 0) & (F.col("dst") >= 0)
    return G.union(edges.where(plain), edges.where(~plain).select(own("src"), own("dst"), "label"))


_CALLS = "SELECT o_orderkey AS src, o_custkey * 2 + 1000000 AS dst, 'Call' AS label FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'P' UNION ALL SELECT o_custkey * 2 + 1000001, o_orderkey, 'Return' FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'P'"
add("j11_call_edges", lambda i: G.call_edges(_sites(i), _functions(i)), _CALLS)
add("g09_icfg", lambda i: G.icfg(i.edges(), _sites(i), _functions(i)), f"SELECT src, dst, label FROM edges UNION ALL SELECT * FROM ({_CALLS})")
def _bodies(i):
    """The edges with a way through each function."""
    return G.union(i.edges(), _apart(i).select(F.col("entry").alias("src"), F.col("exit").alias("dst"), F.lit("body").alias("label")))


add("g09_icfg_without_ends", lambda i: G.icfg(_bodies(i), _sites(i), _apart(i), remove_ends=True), f"""WITH s AS (SELECT o_orderkey AS node, o_custkey AS fn FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'P'),
 u AS (SELECT src, dst, label, 0 AS pos FROM edges WHERE (src, dst) NOT IN (SELECT (c_custkey * 2 + 1000000, c_custkey * 2 + 1000001) FROM customer) UNION ALL SELECT a.node, b.node, 'Return', 1 FROM s a JOIN s b USING (fn))
 SELECT src, dst, arg_min(label, pos) AS label FROM u GROUP BY 1, 2""")
add("g08_eliminate_callsites", lambda i: _numbered(G.icfg(i.edges(), _sites(i), _apart(i), remove_sites=True)), f"""WITH calls AS ({_CALLS}),
 u AS (SELECT src, dst, label, 0 AS pos FROM edges WHERE src NOT IN {_GONE} AND dst NOT IN {_GONE}
 UNION ALL SELECT e.src, c.dst, 'enter', 1 FROM edges e JOIN calls c ON c.src = e.dst AND c.label = 'Call' WHERE e.src NOT IN {_GONE}
 UNION ALL SELECT c.src, e.dst, 'leave', 1 FROM edges e JOIN calls c ON c.dst = e.src AND c.label = 'Return' WHERE e.dst NOT IN {_GONE}
 UNION ALL SELECT a.src, b.dst, '', 1 FROM edges a JOIN edges b ON a.dst = b.src WHERE a.dst IN {_GONE} AND a.dst NOT IN (SELECT src FROM calls WHERE label = 'Call') AND a.src NOT IN {_GONE} AND b.dst NOT IN {_GONE})
 SELECT src, dst, arg_min(label, (pos, label)) AS label FROM u GROUP BY 1, 2""")
add("g10_context_frontier", lambda i: G.context_frontier(i.dag().select(F.col("dst").alias("q"), F.col("dst").alias("node")), i.dag(), i.edges().select(F.col("src").alias("entry"), F.col("dst").alias("site")), 2), """WITH z AS (SELECT DISTINCT dst AS q, dst AS node FROM dag),
 n1 AS (SELECT q, src AS node FROM z JOIN dag ON dst = node UNION SELECT q, e.dst FROM z JOIN edges e ON e.src = node WHERE node NOT IN (SELECT dst FROM dag)),
 s1 AS (SELECT q, node, 0 AS round FROM z UNION ALL SELECT q, node, 1 FROM n1 WHERE (q, node) NOT IN (SELECT (q, node) FROM z)), h AS (SELECT q, node FROM s1 WHERE round = 1),
 n2 AS (SELECT q, src AS node FROM h JOIN dag ON dst = node UNION SELECT q, e.dst FROM h JOIN edges e ON e.src = node WHERE node NOT IN (SELECT dst FROM dag))
 SELECT q, node, round FROM s1 UNION ALL SELECT q, node, 2 FROM n2 WHERE (q, node) NOT IN (SELECT (q, node) FROM s1)""")
add("j06_call_graph", lambda i: K.call_graph(i.table("orders").select(F.col("o_orderkey").alias("id"), F.array(F.concat(F.lit("f"), F.col("o_custkey")), F.lit("f1")).alias("callees")), i.table("supplier").select(F.col("s_suppkey").alias("id"), F.concat(F.lit("f"), F.col("s_suppkey") % 50).alias("name"))),
    "SELECT DISTINCT o_orderkey AS src, s_suppkey AS dst FROM orders JOIN supplier ON 'f' || (s_suppkey % 50) IN ('f' || o_custkey, 'f1')")

# --- trees
_SETS = "SELECT size AS q, node_id FROM tree"


def _sets(i):
    """Nodes of one size are a selection."""
    return i.tree().select(F.col("size").alias("q"), "node_id")


add("t01_depth", lambda i: T.depths(T.lift(i.tree())), "SELECT node_id, depth FROM depths")
add("t01_deepest", lambda i: T.deepest(T.lift(i.tree()), _sets(i)), f"SELECT q, arg_max(node_id, (depth, -node_id)) AS node_id FROM ({_SETS}) JOIN depths USING (node_id) GROUP BY 1")
add("t02_children", lambda i: T.children(i.tree().withColumn("ord", F.col("size"))), "SELECT parent_id AS node_id, list(node_id ORDER BY size, node_id) AS children FROM tree WHERE parent_id IS NOT NULL GROUP BY 1")
add("p04_leaves", lambda i: T.leaves(i.tree()).select("file", "node_id", "parent_id", "kind", "size"), "SELECT * FROM tree WHERE node_id NOT IN (SELECT parent_id FROM tree WHERE parent_id IS NOT NULL)")
add("t03_tokens", lambda i: T.tokens(i.tree(), ["node_id"]).select("file", "node_id", "token"), "SELECT file, node_id, CAST(row_number() OVER (PARTITION BY file ORDER BY node_id) - 1 AS INTEGER) AS token FROM tree WHERE node_id NOT IN (SELECT parent_id FROM tree WHERE parent_id IS NOT NULL)")
add("t04_descendants", lambda i: T.descendants(T.ancestors(i.tree())), "SELECT anc AS node_id, node_id AS inside FROM anc")
_LCA = f"SELECT q, arg_max(anc, depth) AS lca FROM (SELECT q, anc, count(*) AS n FROM ({_SETS}) s JOIN anc USING (node_id) GROUP BY 1, 2) x JOIN (SELECT size AS q, count(*) AS n FROM tree GROUP BY 1) y USING (q, n) JOIN (SELECT node_id AS anc, depth FROM depths) z USING (anc) GROUP BY 1"


def _small_sets(i):
    """Children of one parent, and the parent's parent: a selection each."""
    return i.tree().where("parent_id is not null").select(F.col("parent_id").alias("q"), "node_id")


_SMALL = "SELECT parent_id AS q, node_id FROM tree WHERE parent_id IS NOT NULL"
_SMALL_LCA = _LCA.replace(_SETS, _SMALL).replace("SELECT size AS q, count(*) AS n FROM tree GROUP BY 1", f"SELECT q, count(*) AS n FROM ({_SMALL}) GROUP BY 1")
add("t05_common_ancestor", lambda i: T.common_ancestor(T.lift(i.tree()), _small_sets(i)), _SMALL_LCA)


def _node_pairs(i):
    return i.tree().select(F.col("node_id").alias("a"), (F.col("node_id") + 7).alias("b"))


_DIST = "SELECT a, b, arg_min(anc, up_a) AS lca, min(up_a) + min(up_b) AS distance FROM (SELECT p.node_id AS a, p.node_id + 7 AS b, x.anc, x.up AS up_a, y.up AS up_b FROM tree p JOIN anc x ON x.node_id = p.node_id JOIN anc y ON y.node_id = p.node_id + 7 AND y.anc = x.anc) GROUP BY 1, 2"
add("t06_distance", lambda i: T.distance(T.lift(i.tree()), _node_pairs(i)), _DIST)
add("t06_distance_both_ends", lambda i: T.distance(T.lift(i.tree()), _node_pairs(i), both_ends=True), f"SELECT a, b, lca, distance + 4 AS distance FROM ({_DIST})")
add("t07_to_root", lambda i: T.path_closure(T.lift(i.tree()), _sets(i), to_root=True), f"SELECT DISTINCT q, anc AS node_id FROM ({_SETS}) JOIN anc USING (node_id)")
add("t07_to_common_ancestor", lambda i: T.path_closure(T.lift(i.tree()), _small_sets(i)), f"SELECT DISTINCT q, anc AS node_id FROM ({_SMALL}) s JOIN anc USING (node_id) JOIN (SELECT node_id AS anc, depth FROM depths) d USING (anc) JOIN ({_SMALL_LCA}) l USING (q) JOIN (SELECT node_id AS lca, depth AS least FROM depths) m USING (lca) WHERE depth >= least")
_RULES = {"Brand#1": ["Brand#2", "Brand#3"], "Brand#4": ["Brand#5"]}


def _kinded(i):
    return i.tree().withColumn("kind", F.substring("kind", 1, 7))


add("t08_anchors", lambda i: T.anchors(_kinded(i), _RULES), """SELECT t.node_id, arg_min(a.anc, a.up) AS anchor FROM tree t JOIN anc a ON a.node_id = t.node_id AND a.up > 0 JOIN tree k ON k.node_id = a.anc
 WHERE (t.kind LIKE 'Brand#1%' AND substring(k.kind, 1, 7) IN ('Brand#2', 'Brand#3')) OR (t.kind LIKE 'Brand#4%' AND k.kind LIKE 'Brand#5%') GROUP BY 1""")
_ROLES = {"Brand#1": ("a", "b"), "Brand#2": ("c",)}


def _roled(i):
    return _kinded(i).withColumn("role", F.when(F.col("size") < 20, "a").when(F.col("size") < 30, "b").otherwise("c"))


_ROLED = "(SELECT *, substring(kind, 1, 7) AS k, CASE WHEN size < 20 THEN 'a' WHEN size < 30 THEN 'b' ELSE 'c' END AS role FROM tree)"
_KINDS = ["function", "compound", "if", "switch", "case", "default", "for", "while", "do", "return", "expr"]
_CHILD_ROLES = ["keyword", "condition", "then", "else keyword", "else", "body", "while", "value", "brace", "case", "type", "name", "parameters"]


def _grammar(i):
    """The tree with kinds and roles of a language's grammar."""
    pick = lambda names, n: F.get(F.array(*map(F.lit, names)), (F.col(n) % len(names)).cast("int"))
    return i.tree().withColumn("kind", pick(_KINDS, "size")).withColumn("role", pick(_CHILD_ROLES, "node_id"))


def _thirds(i):
    return i.tree().where("size % 3 <> 0").select((F.col("size") % 3).alias("q"), "node_id").union(i.tree().select(F.lit(7).cast("long").alias("q"), "node_id"))


_CALLED = "(" + ", ".join(f"('{k}', '{r}', {repr(w) if w else 'NULL'})" for k, r, w in T.MANDATORY).join(["VALUES ", ") m(parent_kind, role, needs)"])
add("t09_mandatory", lambda i: T.mandatory(_grammar(i), _thirds(i)), f"""WITH g AS (SELECT node_id, parent_id, {_KINDS}[size % {len(_KINDS)} + 1] AS kind, {_CHILD_ROLES}[node_id % {len(_CHILD_ROLES)} + 1] AS role, size FROM tree),
 s AS (SELECT size % 3 AS q, g.* FROM g WHERE size % 3 <> 0 UNION ALL SELECT 7, g.* FROM g),
 k AS (SELECT p.q, p.node_id, p.kind, count(c.node_id) AS n, max(c.role) AS only_role, list(c.role) AS roles, max(c.node_id) AS child FROM s p LEFT JOIN s c ON c.q = p.q AND c.parent_id = p.node_id GROUP BY 1, 2, 3),
 a AS (SELECT * FROM k WHERE NOT (n = 1 AND ((kind = 'compound' AND only_role <> 'brace') OR (kind = 'if' AND only_role IN ('then', 'else')) OR (kind IN ('for', 'while', 'do') AND only_role = 'body')
  OR (kind = 'switch' AND only_role = 'case' AND NOT EXISTS (SELECT 1 FROM s o WHERE o.q = k.q AND o.parent_id = k.child AND o.role IN ('brace', 'keyword', 'condition'))))))
 SELECT DISTINCT a.q, g.node_id FROM a JOIN {_CALLED} ON m.parent_kind = a.kind JOIN g ON g.parent_id = a.node_id AND g.role = m.role WHERE m.needs IS NULL OR list_contains(a.roles, m.needs)""")
add("t10_function_headers", lambda i: T.function_headers(_roled(i), T.ancestors(i.tree()), _sets(i), "Brand#3", ("a",)), f"""WITH f AS (SELECT DISTINCT s.size AS q, a.anc AS fn FROM tree s JOIN anc a USING (node_id) JOIN tree k ON k.node_id = a.anc AND k.kind LIKE 'Brand#3%'), w AS (SELECT * FROM f WHERE q IN (SELECT q FROM f GROUP BY q HAVING count(*) >= 2))
 SELECT size AS q, node_id FROM tree UNION SELECT q, fn FROM w UNION SELECT q, c.node_id FROM w JOIN {_ROLED} c ON c.parent_id = fn AND c.role = 'a'""")
add("t11_kind_path", lambda i: T.kind_path(i.tree()), "SELECT a.node_id, string_agg(t.kind, '/' ORDER BY a.up DESC) AS path FROM anc a JOIN tree t ON t.node_id = a.anc GROUP BY 1")
add("t11_nth_of_kind", lambda i: T.nth_of_kind(i.tree(), F.col("size"), ["node_id"]).select("node_id", "nth"), "SELECT node_id, row_number() OVER (PARTITION BY file, kind, size ORDER BY node_id) AS nth FROM tree")
add("a15_selection_distribution", lambda i: T.selection_distribution(_sets(i), _kinded(i), T.ancestors(i.tree()), ["Brand#1", "Brand#2"]), """SELECT s.size AS q, count(DISTINCT s.node_id) AS tokens, count(DISTINCT s.file) AS n_files, count(DISTINCT CASE WHEN k.kind LIKE 'Brand#1%' THEN anc END) AS "n_Brand#1", count(DISTINCT CASE WHEN k.kind LIKE 'Brand#2%' THEN anc END) AS "n_Brand#2",
 count(DISTINCT s.node_id) / nullif(count(DISTINCT CASE WHEN k.kind LIKE 'Brand#1%' THEN anc END), 0) AS "per_Brand#1", count(DISTINCT s.node_id) / nullif(count(DISTINCT CASE WHEN k.kind LIKE 'Brand#2%' THEN anc END), 0) AS "per_Brand#2" FROM tree s JOIN anc USING (node_id) JOIN tree k ON k.node_id = anc GROUP BY 1""")


def _uses(i):
    return i.tree().select(F.col("node_id").alias("use_id"), F.col("node_id").alias("scope_id"), (F.col("size") % 10).cast("string").alias("name"))


def _defs(i):
    return i.tree().select((F.col("node_id") * 10).alias("def_id"), F.col("node_id").alias("scope_id"), (F.col("node_id") % 10).cast("string").alias("name"))


_NEAREST = "SELECT u.node_id AS use_id, arg_min(d.node_id * 10, (a.up, d.node_id * 10)) AS def_id FROM tree u JOIN anc a ON a.node_id = u.node_id JOIN tree d ON d.node_id = a.anc AND d.node_id % 10 = u.size % 10 GROUP BY 1"
add("j09_nearest_definition", lambda i: T.nearest_definition(_uses(i), i.tree().select(F.col("node_id").alias("scope_id"), "parent_id"), _defs(i)), _NEAREST)
add("t12_input_variables", lambda i: T.input_variables(i.tree().select("node_id", (F.col("size") % 10).cast("string").alias("name")), i.tree().where("parent_id is not null").select("node_id", (F.col("size") % 10).cast("string").alias("name"), F.col("parent_id").alias("def_node")), _sets(i), i.table("region").select(F.col("r_regionkey").cast("string").alias("name"))),
    """WITH u AS (SELECT s.size AS q, CAST(s.size % 10 AS VARCHAR) AS name, s.parent_id AS d FROM tree s WHERE s.parent_id IS NULL OR (s.size, s.parent_id) NOT IN (SELECT (size, node_id) FROM tree))
 SELECT q, name, CASE WHEN bool_or(d IS NOT NULL) THEN 'local' WHEN name IN (SELECT CAST(r_regionkey AS VARCHAR) FROM region) THEN 'global' ELSE 'unknown' END AS source FROM u GROUP BY q, name""")

def _feature_lines(i):
    """Nodes as lines: a file of the tree is a file, sizes below and from 25 are its two functions."""
    return i.tree().select("file", F.when(F.col("size") < 25, "f").otherwise("g").alias("function"), F.col("node_id").alias("line"), "node_id", F.array((F.col("size") % 10).cast("string"), (F.col("node_id") % 10).cast("string")).alias("variables"), (F.col("size") % 4).alias("var_type"), (F.col("size") % 2 == 0).alias("uses_global"))


add("t14_slice_features", lambda i: T.slice_features(_feature_lines(i), i.tree().where("kind = 'Brand#11'").select(F.col("node_id").alias("crit"), "file", F.col("node_id").alias("line")), T.lift(i.tree()), i.tree().where("parent_id is not null").select(F.col("parent_id").alias("crit"), "file", F.col("node_id").alias("line"))), """WITH l AS (SELECT *, size < 25 AS fn FROM tree),
 p AS (SELECT c.node_id AS crit, t.node_id AS line, c.size AS cs, t.size AS ts, t.file, t.parent_id FROM l c JOIN l t ON t.file = c.file AND t.fn = c.fn WHERE c.kind = 'Brand#11'),
 w AS (SELECT p.crit, p.line, arg_min(x.anc, x.up) AS lca, min(x.up) + min(y.up) AS d, min(x.up) AS cl, min(y.up) AS tl FROM p JOIN anc x ON x.node_id = p.crit JOIN anc y ON y.node_id = p.line AND y.anc = x.anc GROUP BY 1, 2)
 SELECT p.crit, p.file, p.line, (cs % 10 IN (ts % 10, p.line % 10) OR p.crit % 10 IN (ts % 10, p.line % 10))::INT AS same_var, ts % 4 AS var_type, abs(p.line - p.crit) AS distance, w.d AS ast_distance, w.tl AS to_lca, w.cl AS criterion_to_lca, z.depth AS level, ts % 2 = 0 AS uses_global, coalesce(p.parent_id = p.crit, FALSE) AS in_slice
 FROM p LEFT JOIN w USING (crit, line) LEFT JOIN depths z ON z.node_id = w.lca""")

# --- spans
add("j02_enclosing", lambda i: K.enclosing(i.intervals(), 256), 'SELECT s.id AS src, o.id AS dst FROM intervals s JOIN intervals o ON o.file = s.file AND (o.begin, -o."end", o.id) < (s.begin, -s."end", s.id) AND s.begin < o."end" AND s.begin <= o."end" AND o.begin <= s."end"')


def _points(i):
    return i.table("orders").select(F.col("o_orderkey").alias("sel_id"), F.col("o_custkey").alias("file"), (F.datediff(F.col("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date")) + F.col("o_orderkey") % 7).cast("long").alias("line"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey") % 9).alias("col"))


_POINTS = "(SELECT o_orderkey AS sel_id, o_custkey AS file, date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) + o_orderkey % 7 AS line, CASE o_orderstatus WHEN 'F' THEN o_orderkey % 9 END AS col FROM orders)"
add("j07_select_tokens", lambda i: K.select_tokens(_points(i), i.intervals().withColumn("begin_col", F.col("id") % 5).withColumn("end_col", F.col("id") % 8), 256), f"""SELECT DISTINCT p.sel_id, t.id FROM {_POINTS} p JOIN intervals t ON t.file = p.file AND p.line BETWEEN t.begin AND t."end"
 WHERE p.col IS NULL OR ((t.begin, t.id % 5) <= (p.line, p.col) AND (p.line, p.col) <= (t."end", t.id % 8))""")
add("j08_innermost", lambda i: K.innermost(_points(i), i.intervals(), 256), f'SELECT file, line, arg_min(id, ("end" - begin, id)) AS id FROM (SELECT DISTINCT file, line FROM {_POINTS}) p JOIN intervals t USING (file) WHERE line BETWEEN begin AND "end" GROUP BY 1, 2')
add("j10_latest_before", lambda i: K.latest_before(_points(i), i.intervals(), "file", "line", "begin", "sel_id"), f"SELECT file, line, sel_id, coalesce((SELECT max(begin) FROM intervals t WHERE t.file = p.file AND t.begin < p.line), 0) AS start FROM {_POINTS} p")
add("j17_label_members", lambda i: K.label_members(_points(i).select("file", "line", "sel_id"), i.intervals().select("file", F.col("begin").alias("line")), ["file", "line"]), f"SELECT file, line, sel_id, (file, line) IN (SELECT (file, begin) FROM intervals) AS in_slice FROM {_POINTS}")
add("a18_slice_sizes", lambda i: K.slice_sizes(i.intervals().select((F.col("id") % 100).alias("crit"), F.lit(0).alias("crit_file"), F.lit(0).alias("crit_line"), "file", F.col("end").alias("line")), i.intervals().select("file", "begin")), """WITH s AS (SELECT DISTINCT id % 100 AS crit, file, "end" AS line FROM intervals), f AS (SELECT s.*, (SELECT max(begin) FROM intervals t WHERE t.file = s.file AND t.begin < s.line) AS st FROM s)
 SELECT crit, count(*) - max((file = 0 AND line = 0)::INT) AS statements, count(DISTINCT CASE WHEN st > 0 THEN (file, st) END) AS functions FROM f GROUP BY 1""")
add("c03_code_of", lambda i: K.code_of(i.intervals().select("file", "id", "begin", "end"), i.intervals().select("file", F.col("begin").alias("line_no"), F.concat(F.lit("x"), "begin").alias("line")).distinct(), 256), """SELECT s.id, string_agg('x' || l.begin, chr(10) ORDER BY l.begin) AS text FROM intervals s JOIN (SELECT DISTINCT file, begin FROM intervals) l ON l.file = s.file AND l.begin BETWEEN s.begin AND s."end" GROUP BY 1""")

# --- names
_IDS = r"regexp_extract_all(replace(text, chr(10), ' '), '\b[_a-zA-Z][_a-zA-Z0-9]*\b')"
_KEY_LIST = ", ".join(f"'{k}'" for k in X.KEYWORDS)


def _ascii_docs(i):
    """Texts as code: letters beyond ASCII count as blanks, as the two engines differ on their word breaks."""
    return i.table("documents").select(F.col("doc_id").alias("id"), F.col("source").alias("name"), F.regexp_replace("text", "[^\\x00-\\x7f]", " ").alias("code"))


_CODE = r"(SELECT doc_id AS id, source AS name, regexp_replace(text, '[^\x00-\x7f]', ' ', 'g') AS text FROM documents)"
_USED = f"(SELECT id, name, unnest(list_distinct({_IDS})) AS key FROM {_CODE})"
add("x01_identifiers", lambda i: _ascii_docs(i).select("id", F.array_sort(X.identifiers(F.col("code"))).alias("names")), f"SELECT id, list_sort(list_filter(list_distinct({_IDS}), lambda x: x NOT IN ({_KEY_LIST}))) AS names FROM {_CODE}")


def _shared_words(i):
    """A word that two documents or more hold is a key of the first of them."""
    used = _ascii_docs(i).select("id", F.explode(X.identifiers(F.col("code"))).alias("key"))
    return used.groupBy("key").agg(F.min("id").alias("id"), F.count("*").alias("n")).where("n >= 2").select("id", "key")


add("j01_dependences", lambda i: K.dependences(_ascii_docs(i), _shared_words(i)), f"""WITH u AS (SELECT * FROM {_USED} WHERE key NOT IN ({_KEY_LIST})), k AS (SELECT key, min(id) AS id FROM u GROUP BY 1 HAVING count(*) >= 2)
 SELECT DISTINCT u.id AS src, k.id AS dst FROM u JOIN k USING (key) WHERE u.id <> k.id AND key <> u.name""")
add("t13_p07_lookup", lambda i: K.lookup(i.table("part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("kind")), i.table("part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("key")), ["PROMO", "ECONOMY"], ["Brand#11", "Brand#23"]), "SELECT p_partkey AS id, p_brand AS kind FROM part WHERE p_type IN ('PROMO', 'ECONOMY') AND p_brand IN ('Brand#11', 'Brand#23')")
_HREF = """(SELECT page_id, url, unnest(list_distinct(regexp_extract_all(html, 'href="/([^"]+)"', 1))) AS target FROM pages)"""


def _links(i):
    return i.table("pages").select(F.col("url").alias("file"), F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit('href="/([^"]+)"'), F.lit(1)))).alias("target"), F.lit(False).alias("is_system"))


def _link_files(i):
    """The links themselves name the files: each first target under two folders."""
    return _links(i).select(F.explode(F.array(F.concat(F.lit("src/"), "target"), F.concat(F.lit("x"), "target"))).alias("file")).distinct()


add("j03_include_edges", lambda i: K.include_edges(_links(i), _link_files(i)), f"SELECT DISTINCT url AS src, 'src/' || target AS dst FROM {_HREF}")
add("j04_header_library", lambda i: K.header_library(_links(i), _links(i).select(F.col("target").alias("package"), F.concat(F.lit("/usr/include/"), "target").alias("header"), F.length("target").alias("pos")).distinct(), ["/usr/include", ""]), f"SELECT DISTINCT target, target AS package FROM {_HREF}")
add("j05_unsupported", lambda i: K.unsupported(_links(i), i.table("nation").select(F.col("n_name").alias("target")).union(_links(i).where("length(target) > 4").select("target"))), f"SELECT DISTINCT target FROM {_HREF} WHERE length(target) <= 4 AND target NOT IN (SELECT n_name FROM nation)")
add("j16_with_signatures", lambda i: K.with_signatures(i.table("customer").select(F.col("c_custkey").alias("id")), i.table("orders").select(F.col("o_custkey").alias("snippet_id"), F.col("o_orderpriority").alias("keyword"), F.col("o_orderstatus").alias("kind"))).select("id", F.transform("signatures", lambda s: F.concat_ws(":", s["keyword"], s["kind"])).alias("signatures")),
    "SELECT c_custkey AS id, coalesce((SELECT list_sort(list_distinct(list(o_orderpriority || ':' || o_orderstatus))) FROM orders WHERE o_custkey = c_custkey), []) AS signatures FROM customer")
add("j18_first_globals", lambda i: K.first_globals(i.table("part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("name"))), "SELECT p_brand AS name, min(p_partkey) AS id FROM part GROUP BY 1 UNION ALL SELECT 'optarg', NULL")
add("j15_resolve_types", lambda i: K.resolve_types(i.table("part").select(F.concat(F.lit("t"), F.col("p_partkey"), F.lit(" *")).alias("type")), i.table("part").where("p_partkey > 1").select(F.concat(F.lit("t"), F.col("p_partkey")).alias("name"), F.concat(F.lit("struct t"), F.floor(F.col("p_partkey") / 4).cast("long"), F.when(F.col("p_partkey") % 3 == 0, " *").otherwise("")).alias("target"))),
    "WITH RECURSIVE r(k, n, stars) AS (SELECT p_partkey, p_partkey, 1 FROM part UNION ALL SELECT k, n // 4, stars + CASE n % 3 WHEN 0 THEN 1 ELSE 0 END FROM r WHERE n > 1) SELECT 't' || k || ' *' AS type, 't' || min(n) AS base, max(stars) AS stars FROM r GROUP BY k")
add("a10_kind_counts", lambda i: K.kind_counts(i.table("part").select(F.col("p_brand").alias("kind"))), "SELECT p_brand AS kind, count(*) AS n FROM part GROUP BY 1")
add("o01_snippet_order", lambda i: K.snippet_order(i.intervals(), i.table("customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("file"), (1000000 - F.col("c_custkey")).alias("rank"))).select("file", "id", "begin", "end", "rank"), 'SELECT file, id, begin, "end", CASE WHEN c_custkey IS NOT NULL THEN 1000000 - c_custkey END AS rank FROM intervals LEFT JOIN customer ON c_custkey = file AND c_acctbal > 0')
add("o02_stored_subset", lambda i: K.stored_subset(i.intervals(), i.table("lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id"))).select("file", "id", "begin", "end"), "SELECT * FROM intervals WHERE id IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
add("o03_header_first_order", lambda i: K.header_first_order(i.table("part").select(F.concat(F.col("p_partkey") + 1, F.when(F.col("p_size") < 40, ".h").otherwise(".c")).alias("file"), F.col("p_size").alias("begin")), i.dag().select(F.concat("src", F.lit(".h")).alias("src"), F.concat("dst", F.lit(".h")).alias("dst"))).select("file", "begin", "rank"),
    "WITH RECURSIVE p(node, rank) AS (SELECT dst, 0 FROM dag WHERE dst NOT IN (SELECT src FROM dag) UNION SELECT src, rank + 1 FROM p JOIN dag ON dst = node), r AS (SELECT node || '.h' AS file, max(rank) AS rank FROM p GROUP BY 1), f AS (SELECT (p_partkey + 1) || CASE WHEN p_size < 40 THEN '.h' ELSE '.c' END AS file, p_size AS begin FROM part) SELECT file, begin, rank FROM f LEFT JOIN r USING (file)")
add("u01_selection_union", lambda i: K.selection_union(i.table("lineitem").select("l_orderkey", "l_partkey"), i.table("lineitem").select("l_orderkey", (F.col("l_partkey") + 1).alias("l_partkey"))), "SELECT l_orderkey, l_partkey FROM lineitem UNION SELECT l_orderkey, l_partkey + 1 FROM lineitem")
add("u02_added", lambda i: K.added(i.table("lineitem").select("l_orderkey", "l_partkey"), i.table("lineitem").select("l_orderkey", (F.col("l_partkey") + 1).alias("l_partkey"))), "SELECT l_orderkey, l_partkey + 1 AS l_partkey FROM lineitem EXCEPT SELECT l_orderkey, l_partkey FROM lineitem")
add("u03_equal_sets", lambda i: K.equal_sets(i.table("lineitem").select("l_suppkey", "l_linenumber"), i.table("lineitem").where("l_returnflag <> 'A'").select("l_suppkey", "l_linenumber"), "l_suppkey", "l_linenumber"), "SELECT l_suppkey, list_sort(list_distinct(list(l_linenumber))) = list_sort(list_distinct(list(l_linenumber) FILTER (l_returnflag <> 'A'))) AS equal FROM lineitem GROUP BY 1")
add("u06_first_per_signature", lambda i: K.first_per_signature(i.table("part").select(F.col("p_partkey").alias("id"), "p_brand", "p_size"), ["p_brand", "p_size"]), "SELECT min(p_partkey) AS id, p_brand, p_size FROM part GROUP BY 2, 3")
add("u07_first_per_kind_and_keys", lambda i: K.first_per_kind_and_keys(i.table("orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("kind")), i.table("lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("key"))), "SELECT min(o_orderkey) AS id, o_orderstatus AS kind FROM (SELECT o_orderkey, o_orderstatus, (SELECT list_sort(list_distinct(list(l_linenumber))) FROM lineitem WHERE l_orderkey = o_orderkey) AS keys FROM orders) GROUP BY o_orderstatus, keys")
add("p03_valid_locations", lambda i: K.valid_locations(i.intervals()), 'SELECT * FROM intervals WHERE NOT (begin = 0 AND "end" = 0)')
add("x02_span", lambda i: i.table("documents").select("doc_id", X.span(F.col("text"), F.struct(F.lit(1).alias("line"), F.lit(3).alias("col")), F.struct(F.lit(1).alias("line"), F.lit(20).alias("col"))).alias("code")), "SELECT doc_id, substring(string_split(text, chr(10))[1], 3, 18) AS code FROM documents")

# --- clones
def _fragments(i):  # noqa: E302
    return i.table("orders").select(F.col("o_custkey").alias("class"), (F.col("o_custkey") % 3 + 1).cast("int").alias("type"), F.col("o_orderkey").alias("id"))


def _fragment_values(i):
    both = F.array(F.struct(F.lit("input").alias("side"), F.lit("int").alias("type"), (F.col("l_quantity").cast("long") % 3).cast("string").alias("value")), F.struct(F.lit("output").alias("side"), F.col("l_returnflag").alias("type"), (F.col("l_linenumber") % 2).cast("string").alias("value")))
    return i.table("lineitem").select(F.col("l_orderkey").alias("id"), F.explode(both).alias("v")).select("id", "v.side", "v.type", "v.value")


_CLONES = """(WITH v AS (SELECT l_orderkey AS id, count(*) AS n, list_sort(list(CAST(CAST(l_quantity AS BIGINT) % 3 AS VARCHAR))) AS ins, list_sort(list(CAST(l_linenumber % 2 AS VARCHAR))) AS outs, list_sort(list(l_returnflag)) AS types FROM lineitem GROUP BY 1)
 SELECT a.o_custkey AS class, CAST(a.o_custkey % 3 + 1 AS INTEGER) AS type, a.o_orderkey AS id1, b.o_orderkey AS id2, CASE WHEN x.n <> y.n THEN 'input arity' WHEN x.ins <> y.ins THEN 'inputs' WHEN x.outs <> y.outs THEN 'outputs' ELSE 'equal' END AS verdict, x.n = y.n AND x.ins = y.ins AND x.outs = y.outs AS clone, x.n = y.n AS same_arity, x.n = y.n AND x.types = y.types AS same_types
 FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey JOIN v x ON x.id = a.o_orderkey JOIN v y ON y.id = b.o_orderkey)"""
add("j12_j13_clone_pairs", lambda i: C.pairs(_fragments(i), _fragment_values(i)), f"SELECT class, type, id1, id2 FROM {_CLONES}")
add("c01_compare", lambda i: C.compare(_fragments(i), _fragment_values(i)), f"SELECT * FROM {_CLONES}")
add("c02_results", lambda i: C.results(C.compare(_fragments(i), _fragment_values(i))), f"SELECT class, type, id1, id2, clone FROM {_CLONES}")
add("a19_clone_summary", lambda i: C.class_summary(_fragments(i), _fragment_values(i)), f"SELECT type, count(*) AS pairs, sum(same_arity::INT) AS same_arity, sum(same_types::INT) AS same_types, sum(clone::INT) AS same_data FROM {_CLONES} GROUP BY 1")

# --- samples
_H = "(({0}) % 2147483648 * 1103515245 + 12345) % 2147483648"
_TWICE = lambda x: _H.format(_H.format(x))
_TOKENS = "(SELECT source AS function, doc_id AS id FROM documents)"


def _tokens(i):
    return i.table("documents").select(F.col("source").alias("function"), F.col("doc_id").alias("id"))


add("r01_random_selections", lambda i: R.random_selections(_tokens(i), 3, 200), f"""WITH f AS (SELECT function, row_number() OVER (ORDER BY function) - 1 AS nth, count(*) OVER () AS m FROM (SELECT function FROM {_TOKENS} GROUP BY 1 HAVING function IS NOT NULL AND count(*) >= 3)),
 s AS (SELECT r.range AS sel_id, function FROM range(200) r JOIN f ON nth = {_TWICE("r.range * 4099")} % m)
 SELECT sel_id, id FROM (SELECT sel_id, id, row_number() OVER (PARTITION BY sel_id ORDER BY {_TWICE("id + sel_id")}, id) AS n FROM s JOIN {_TOKENS} t USING (function)) WHERE n <= 3""")
_POOL = f"""WITH n AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS nth, count(*) OVER () AS m FROM {{0}}),
 d AS (SELECT r.range AS sel_id, j.range AS j, {_TWICE("r.range * 4099 + j.range")} % (SELECT max(m) FROM n) AS nth FROM range(200) r, range(113) j),
 f AS (SELECT sel_id, nth, row_number() OVER (PARTITION BY sel_id ORDER BY min(j)) AS k FROM d GROUP BY 1, 2) SELECT sel_id, id FROM f JOIN n USING (nth) WHERE k <= 3"""
add("r01_selections_in_functions", lambda i: R.random_selections(_tokens(i), 3, 200, "functions"), _POOL.format(f"(SELECT * FROM {_TOKENS} WHERE function IS NOT NULL)"))
add("r01_selections_of_all", lambda i: R.random_selections(_tokens(i), 3, 200, "all"), _POOL.format(_TOKENS))
add("r02_proportional", lambda i: R.proportional(i.table("documents").select("doc_id", "source"), "source", "doc_id", 1000), f"SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY {_H.format('doc_id')}, doc_id) AS n, count(*) OVER (PARTITION BY source) AS c, count(*) OVER () AS t FROM documents) WHERE n <= c * 1000 // t")
add("r03_per_group", lambda i: R.per_group(i.table("lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.count("*").alias("n")), "l_suppkey", "l_orderkey", 20, seed=9), f"SELECT l_orderkey, l_suppkey, n FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY {_H.format('l_orderkey + 9')}, l_orderkey) AS k FROM (SELECT l_orderkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY 1, 2)) WHERE k <= 20")
add("r07_at_most", lambda i: R.at_most(i.table("orders").select("o_orderkey"), "o_orderkey", 100), f"SELECT o_orderkey FROM orders ORDER BY {_H.format('o_orderkey')}, o_orderkey LIMIT 100")
add("r08_one_in", lambda i: R.one_in(i.table("orders").select("o_orderkey"), "o_orderkey", 5, done=i.table("orders").where("o_orderstatus = 'F'").select("o_orderkey")), f"SELECT o_orderkey FROM orders WHERE {_H.format('o_orderkey')} % 5 = 0 AND o_orderstatus <> 'F'")
_VARIABLES = [(n, t) for n, t in zip("abcdef", ["int", "char", "bool", "string", "array", "pointer"])]
_DRAW = lambda i: _H.format(f"{_H.format(_H.format('test') + ' + place * 7919')} + {i}")
_BELOW = lambda i, n: f"({_DRAW(i)} // 1024 % {n})"
add("r04_random_values", lambda i: R.random_values(i.table("orders").select(F.col("o_orderkey").alias("test")), i.spark.createDataFrame(_VARIABLES, "name string, type string")), f"""SELECT test, name, type, CASE type WHEN 'int' THEN CAST({_BELOW(0, 201)} - 100 AS VARCHAR) WHEN 'char' THEN chr(CAST(97 + {_BELOW(0, 26)} AS INTEGER)) WHEN 'bool' THEN CAST({_BELOW(0, 2)} AS VARCHAR)
 WHEN 'string' THEN substring({" || ".join(f"chr(CAST(97 + {_BELOW(i, 26)} AS INTEGER))" for i in range(2, 12))}, 1, {_BELOW(1, 11)}) WHEN 'array' THEN {" || ',' || ".join(f"({_BELOW(i, 201)} - 100)" for i in range(4))}
 ELSE CASE WHEN {_BELOW(0, 100)} < 10 THEN '(nil)' ELSE '0x' || lower(to_hex({_DRAW(1)} + 4096)) END END AS value
 FROM (SELECT o_orderkey AS test FROM orders), (VALUES {", ".join(f"('{n}', '{t}', {k})" for k, (n, t) in enumerate(_VARIABLES))}) v(name, type, place)""")
add("r05_corner_values", lambda i: R.corner_values(i.table("orders").withColumn("size", F.col("o_orderkey") % 100 + 1), "o_orderkey", "o_custkey", "size"), f"""SELECT DISTINCT o_orderkey, unnest([v - 2, v - 1, v, v + 1, v + 2]) AS value
 FROM (SELECT o_orderkey, unnest([o_custkey, o_orderkey % 100 + 1, {", ".join(map(str, R.POWERS))}]) AS v FROM orders)""")


def _test_rows(i):
    return i.table("orders").select(F.col("o_orderkey").alias("test"), F.explode(F.array(F.struct(F.lit("prio").alias("name"), F.col("o_orderpriority").alias("value")), F.struct(F.lit("status").alias("name"), F.col("o_orderstatus").alias("value")), F.struct(F.lit("day").alias("name"), (F.col("o_custkey") % 7).cast("string").alias("value")))).alias("v")).select("test", "v.name", "v.value")


_TESTS = "(SELECT o_orderkey AS test, 'prio' AS name, o_orderpriority AS value FROM orders UNION ALL SELECT o_orderkey, 'status', o_orderstatus FROM orders UNION ALL SELECT o_orderkey, 'day', CAST(o_custkey % 7 AS VARCHAR) FROM orders)"
_COVERED = "SELECT p.name AS name1, p.value AS value1, q.name AS name2, q.value AS value2, p.test FROM t p JOIN t q ON p.test = q.test AND p.name < q.name"
add("a21_pair_coverage", lambda i: R.pair_coverage(_test_rows(i)), f"""WITH t AS (SELECT * FROM {_TESTS}), k AS (SELECT DISTINCT name, value FROM t) SELECT a.name AS name1, a.value AS value1, b.name AS name2, b.value AS value2, count(x.test) AS n
 FROM k a JOIN k b ON a.name < b.name LEFT JOIN ({_COVERED}) x ON x.name1 = a.name AND x.value1 = a.value AND x.name2 = b.name AND x.value2 = b.value GROUP BY 1, 2, 3, 4""")
add("a21_pair_cases", lambda i: R.pair_cases(_test_rows(i)), f"WITH t AS (SELECT * FROM {_TESTS}) {_COVERED}")
add("r06_pairwise_pool", lambda i: R.pairwise_pool(_test_rows(i).select("name", "value").distinct()), f"""WITH k AS (SELECT DISTINCT name, value FROM {_TESTS}), n AS (SELECT name, list(value ORDER BY value) AS vs FROM k GROUP BY 1),
 p AS (SELECT a.name || '=' || a.value || ',' || b.name || '=' || b.value AS test, a.name AS n1, a.value AS v1, b.name AS n2, b.value AS v2 FROM k a JOIN k b ON a.name < b.name)
 SELECT test, name, CASE name WHEN n1 THEN v1 WHEN n2 THEN v2 ELSE vs[('0x' || substring(md5(test || '|' || name), 1, 8))::BIGINT % len(vs) + 1] END AS value FROM p, n""")

# --- exports
add("s21_graph_dot", lambda i: S.graph_to_text(i.table("part").select((F.col("p_partkey") + 1).alias("id"), F.col("p_brand").alias("label")), i.dag().withColumn("label", F.lit("up")), "dot"), """SELECT 'digraph {' AS value UNION ALL SELECT '}' UNION ALL SELECT '  "' || (p_partkey + 1) || '" [label="' || p_brand || '"];' FROM part
 UNION ALL SELECT '  "' || src || '" -> "' || dst || '" [label="up"];' FROM dag""")
_NODES = lambda i: i.table("part").select((F.col("p_partkey") + 1).alias("id"), F.concat(F.col("p_brand"), F.lit(' <&"')).alias("label"))
add("s21_graph_grs", lambda i: S.graph_to_text(_NODES(i), i.dag().withColumn("label", F.lit("up")), "grs"), """SELECT 'new graph' AS value UNION ALL SELECT 'show graph' UNION ALL SELECT 'new :Node($="' || (p_partkey + 1) || '", label="' || p_brand || ' <&\\"")' FROM part
 UNION ALL SELECT 'new @("' || src || '")-:Edge(label="up")->@("' || dst || '")' FROM dag""")
add("s21_graph_xml", lambda i: S.graph_to_text(_NODES(i), i.dag().withColumn("label", F.when(F.col("src") % 2 == 0, "back").otherwise("up")), "xml"), """SELECT '<graph>' AS value UNION ALL SELECT '</graph>' UNION ALL SELECT '  <node id="' || (p_partkey + 1) || '" type="' || p_brand || ' &lt;&amp;&quot;"/>' FROM part
 UNION ALL SELECT '  <edge from="' || src || '" to="' || dst || '" type="' || CASE src % 2 WHEN 0 THEN 'backward' ELSE 'forward' END || '" label="' || CASE src % 2 WHEN 0 THEN 'back' ELSE 'up' END || '"/>' FROM dag""")
add("s22_benchmark_of", lambda i: i.table("pages").select("page_id", S.benchmark_of(F.col("url"), "https:/").alias("bench")), "SELECT page_id, string_split(CASE WHEN starts_with(url, 'https:/') THEN substring(url, 8) ELSE url END, '/')[1] AS bench FROM pages")
add("t03_dense_tokens", lambda i: T.dense_tokens(i.tree(), ["node_id"]).select("node_id", F.col("token").cast("long").alias("token")), "SELECT node_id, row_number() OVER (ORDER BY file, node_id) - 1 AS token FROM tree WHERE node_id NOT IN (SELECT parent_id FROM tree WHERE parent_id IS NOT NULL)")
add("x03_span_to_semicolon", lambda i: i.table("part").select("p_partkey", X.span_to_semicolon(F.concat(F.lit("int a\n = "), "p_size", F.lit("; b")), F.struct(F.lit(1).alias("line"), F.lit(1).alias("col")), F.struct(F.lit(1).alias("line"), F.lit(5).alias("col"))).alias("code")), "SELECT p_partkey, 'int a' || chr(10) || ' = ' || p_size || ';' AS code FROM part")
