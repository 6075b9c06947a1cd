"""Syntax trees as tables (file, node_id, parent_id, ord, kind, role, ...), node ids unique over all files.

Depths, common ancestors, distances, paths and anchors go by lifting: every node knows the nodes 1, 2, 4, .. levels above it, found by doubling, so
that a tree of any depth takes as many rounds as its depth has bits and a row a node. ``spans`` numbers a tree in its own order, so that a node
lies in another where its span does. The table of all ancestors is for operators whose result is of that size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from srcfacts.operators.facts import innermost
from srcfacts.operators.logs import number_rows
from srcfacts.session import cut, stored

MOST_DEPTH = 10_000
#: Bits of the depth of the deepest tree; a deeper one, or a circle, raises.
MOST_BITS = 40


def ancestors(tree: DataFrame, most_depth: int = MOST_DEPTH) -> DataFrame:
    """(node_id, anc, up): every node with itself (up 0) and all nodes above it: as many rows as the depths have levels."""
    parent = cut(tree.select("node_id", "parent_id"))
    level = parent.select("node_id", F.col("node_id").alias("anc"), F.lit(0).alias("up"), F.col("parent_id").alias("next"))
    done = level.drop("next")
    for up in range(1, most_depth):
        level = cut(level.where("next is not null").select("node_id", "next").join(parent.toDF("next", "above"), "next").select("node_id", F.col("next").alias("anc"), F.lit(up).alias("up"), F.col("above").alias("next")))
        if level.isEmpty():
            return done
        done = done.union(level.drop("next"))
    raise RuntimeError(f"the tree is deeper than {most_depth}")


def doubled(rows: DataFrame, values: dict[str, tuple[Column, Column]]) -> DataFrame:
    """(node, values..) with what the whole way up gives, rows (node, far, values..), far the next node up or null.

    values: name -> how a row's value and that of the row ``far`` above it (its columns behind ``up_``) make one of both, and what its own becomes where nothing is above. Each
    round doubles how far a row sees; rows that see the end are left alone.
    """
    state = stored(rows.select("node", "far", *values))
    for _ in range(MOST_BITS):
        if state.where("far is not null").isEmpty():
            return state.drop("far")
        above = state.select(F.col("node").alias("far"), F.col("far").alias("next"), *[F.col(n).alias(f"up_{n}") for n in values], F.lit(True).alias("there"))
        moved = state.where("far is not null").join(above, "far", "left").select("node", F.col("next").alias("far"), *[F.when(F.col("there"), both).otherwise(alone).alias(n) for n, (both, alone) in values.items()])
        state = stored(state.where("far is null").unionByName(moved))
    raise RuntimeError(f"the tree is deeper than 2^{MOST_BITS}, or has a circle")


def lift(tree: DataFrame) -> DataFrame:
    """(node_id, depth, ups): a root has depth 0; ups[k] is the node 2^k levels above. Parents that the tree lacks count as a level without a node above."""
    parent = F.col("parent_id")
    rows = tree.select(F.col("node_id").alias("node"), parent.alias("far"), F.when(parent.isNull(), 0).otherwise(1).alias("depth"), F.when(parent.isNull(), F.array().cast(f"array<{tree.schema['node_id'].dataType.simpleString()}>")).otherwise(F.array(parent)).alias("ups"))
    ups = F.when(F.col("next").isNull(), F.col("ups")).otherwise(F.concat("ups", F.array("next")))
    found = doubled(rows, {"depth": (F.col("depth") + F.col("up_depth"), F.col("depth")), "ups": (ups, F.col("ups"))})
    return found.select(F.col("node").alias("node_id"), "depth", "ups")


def depths(lifted: DataFrame) -> DataFrame:
    """(node_id, depth), a root has 0."""
    return lifted.select("node_id", "depth")


def deepest(lifted: DataFrame, sets: DataFrame) -> DataFrame:
    """(q, node_id): the deepest node of each set (q, node_id); ties go to the smallest id."""
    return sets.join(depths(lifted), "node_id").groupBy("q").agg(F.max_by("node_id", F.struct("depth", -F.col("node_id"))).alias("node_id"))


def spans(tree: DataFrame, order: tuple[str, ...] = ()) -> DataFrame:
    """(node_id, root, begin, end): places of a walk round each tree, children by the order and then by id: a node is in another, or is it,
    where its span is inside the other's, and what comes first has the smaller begin.

    The walk comes into each node and goes out of it; which step follows which is known from parents and neighbours, and every step
    finds its distance from the end by doubling. No level and no parent has to fit into a task.
    """
    kids = number_rows(tree.select("node_id", "parent_id", *order), ["parent_id", *order, "node_id"], "n", 0).select("node_id", "parent_id", F.col("n").cast("long").alias("n"))
    kids = cut(kids)
    # walked from the last child to the first, and counted from the end: both turn round
    before = kids.select((F.col("n") + 1).alias("n"), F.col("n").alias("n_before"), F.col("parent_id").alias("p2"))
    up = kids.select(F.col("node_id").alias("parent_id"), F.col("n").alias("n_up"))
    last = kids.where("parent_id is not null").groupBy("parent_id").agg(F.max("n").alias("n_last"))
    known = kids.join(before, "n", "left").join(up, "parent_id", "left").join(last.withColumnRenamed("parent_id", "node_id"), "node_id", "left")
    n = F.col("n")
    same = F.col("parent_id").isNotNull() & F.col("n_up").isNotNull() & F.col("p2").eqNullSafe(F.col("parent_id"))
    into = F.struct((2 * n).alias("node"), F.coalesce(2 * F.col("n_last"), 2 * n + 1).alias("far"))
    out = F.struct((2 * n + 1).alias("node"), F.when(same, 2 * F.col("n_before")).otherwise(2 * F.col("n_up") + 1).alias("far"))
    steps = known.select(F.explode(F.array(into, out)).alias("x")).select("x.node", "x.far", F.lit(0).cast("long").alias("left"), F.col("x.node").alias("end"))
    steps = steps.withColumn("left", F.when(F.col("far").isNull(), 0).otherwise(1).cast("long"))
    places = cut(doubled(steps, {"left": (F.col("left") + F.col("up_left"), F.col("left")), "end": (F.col("up_end"), F.col("end"))}))
    half = places.groupBy(F.floor(F.col("node") / 2).cast("long").alias("n")).agg(F.min("left").alias("begin"), F.max("left").alias("end"), F.floor(F.min("end") / 2).cast("long").alias("n_root"))
    return half.join(kids.select("n", "node_id"), "n").join(kids.select(F.col("n").alias("n_root"), F.col("node_id").alias("root")), "n_root").select("node_id", "root", "begin", "end")


def children(tree: DataFrame, order: str = "ord") -> DataFrame:
    """(node_id, children array) in their order."""
    rows = tree.where("parent_id is not null").groupBy("parent_id").agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("ord"), F.col("node_id").alias("id")))).alias("c"))
    return rows.select(F.col("parent_id").alias("node_id"), F.transform("c", lambda x: x["id"]).alias("children"))


def leaves(tree: DataFrame) -> DataFrame:
    return tree.join(tree.select(F.col("parent_id").alias("node_id")).where("node_id is not null").distinct(), "node_id", "left_anti")


def tokens(tree: DataFrame, order: list[str]) -> DataFrame:
    """Leaves with a dense ``token`` number in each file, in the given order."""
    return leaves(tree).withColumn("token", F.row_number().over(Window.partitionBy("file").orderBy(*order)) - 1)


def dense_tokens(tree: DataFrame, order: list[str]) -> DataFrame:
    """Leaves with one dense number over all files."""
    return number_rows(leaves(tree), ["file", *order], "token", 0)


def descendants(anc: DataFrame) -> DataFrame:
    """(node_id, inside): each node with all nodes in it, itself included."""
    return anc.select(F.col("anc").alias("node_id"), F.col("node_id").alias("inside"))


def _bits(lifted: DataFrame) -> int:
    return lifted.agg(F.max(F.size("ups"))).first()[0] or 0


def common_ancestor(lifted: DataFrame, sets: DataFrame) -> DataFrame:
    """(q, lca): the deepest node above all members of each set (q, node_id); none if they share no root.

    Members rise to the depth of the highest; then all rise as long as they stay apart, from the largest step down.
    """
    lifted = stored(lifted)
    bits, now = _bits(lifted), sets.select("q", "node_id").distinct()
    least = stored(now.join(depths(lifted), "node_id").groupBy("q").agg(F.min("depth").alias("least"), F.count("*").alias("size")))
    asked = now.groupBy("q").agg(F.count("*").alias("asked"))
    least = least.join(asked, "q").where("asked = size").select("q", "least")  # a member outside of the tree: no ancestor
    now = stored(now.join(least, "q").join(lifted, "node_id"))
    for k in range(bits - 1, -1, -1):
        high = F.col("depth") - F.col("least") >= 2**k
        now = now.select("q", F.when(high, F.get("ups", F.lit(k))).otherwise(F.col("node_id")).alias("node_id"), "least").join(lifted, "node_id")
        now = stored(now) if k % 8 == 0 else now
    for k in range(bits - 1, -1, -1):
        above = F.get("ups", F.lit(k))
        apart = now.groupBy("q").agg((~F.min(above).eqNullSafe(F.max(above))).alias("apart"))
        now = stored(now.join(apart, "q").select("q", F.when(F.col("apart"), above).otherwise(F.col("node_id")).alias("node_id")).distinct().join(lifted, "node_id"))
    parent = F.get("ups", F.lit(0))
    found = now.groupBy("q").agg(F.min("node_id").alias("low"), F.max("node_id").alias("high"), F.min(parent).alias("p_low"), F.max(parent).alias("p_high"), F.count(parent).alias("with"), F.count("*").alias("size"))
    return found.select("q", F.when(F.col("low") == F.col("high"), F.col("low")).when((F.col("p_low") == F.col("p_high")) & (F.col("with") == F.col("size")), F.col("p_low")).alias("lca")).where("lca is not null")


def distance(lifted: DataFrame, pairs: DataFrame, both_ends: bool = False) -> DataFrame:
    """(a, b, lca, distance) of node pairs: edges on the way through their common ancestor; both_ends counts both ends and
    that ancestor twice (4 more). Pairs without a common ancestor give no row.

    The deeper node rises to the other's depth, then both rise as long as they stay apart, each row by itself.
    """
    lifted = stored(lifted)
    bits = _bits(lifted)
    at = lambda c: lifted.select(F.col("node_id").alias(c), F.col("ups").alias(f"up_{c}"))
    deep = lambda c: depths(lifted).toDF(c, f"depth_{c}")
    far = F.abs(F.col("depth_a") - F.col("depth_b"))
    ends = F.when(F.col("depth_a") < F.col("depth_b"), F.struct(F.col("b").alias("x"), F.col("a").alias("y"))).otherwise(F.struct(F.col("a").alias("x"), F.col("b").alias("y")))
    now = pairs.select("a", "b").distinct().join(deep("a"), "a").join(deep("b"), "b").select("a", "b", far.alias("far"), ends.alias("e")).select("a", "b", "far", "e.x", "e.y", F.col("far").alias("rest"))
    for k in range(bits - 1, -1, -1):
        high = F.col("rest") >= 2**k
        now = now.join(at("x"), "x").select("a", "b", "far", F.when(high, F.get("up_x", F.lit(k))).otherwise(F.col("x")).alias("x"), "y", F.when(high, F.col("rest") - 2**k).otherwise(F.col("rest")).alias("rest"))
        now = stored(now) if k % 8 == 0 else now
    now = now.withColumn("rose", F.lit(0))
    for k in range(bits - 1, -1, -1):
        above = {c: F.get(f"up_{c}", F.lit(k)) for c in ("x", "y")}
        apart = above["x"].isNotNull() & (above["x"] != above["y"])
        moved = [F.when(apart, above[c]).otherwise(F.col(c)).alias(c) for c in ("x", "y")]
        now = now.join(at("x"), "x").join(at("y"), "y").select("a", "b", "far", *moved, (F.col("rose") + F.when(apart, 2**k).otherwise(0)).alias("rose"))
        now = stored(now) if k % 8 == 0 else now
    parent = {c: F.get(f"up_{c}", F.lit(0)) for c in ("x", "y")}
    same = F.col("x") == F.col("y")
    found = now.join(at("x"), "x").join(at("y"), "y").select("a", "b", F.when(same, F.col("x")).when(parent["x"] == parent["y"], parent["x"]).alias("lca"), (F.col("far") + F.when(same, 0).otherwise(2 * (F.col("rose") + 1))).alias("distance"))
    return found.where("lca is not null").select("a", "b", "lca", (F.col("distance") + F.lit(4 if both_ends else 0)).alias("distance"))


def path_closure(lifted: DataFrame, sets: DataFrame, to_root: bool = False) -> DataFrame:
    """(q, node_id): each set with the nodes on the paths to its common ancestor, or to the root.

    A way of n levels is halved until it is a node long; halves that members share are taken once.
    """
    lifted = cut(lifted)
    now = sets.select("q", "node_id").distinct().join(depths(lifted), "node_id")
    if not to_root:
        top = common_ancestor(lifted, sets).join(depths(lifted).toDF("lca", "least"), "lca").select("q", "least")
        now = now.join(top, "q").withColumn("depth", F.col("depth") - F.col("least"))
    now, done = cut(now.select("q", "node_id", F.col("depth").alias("way"))), []
    for _ in range(MOST_BITS):
        done.append(now.where("way = 0").select("q", "node_id"))
        open_ = now.where("way > 0")
        if open_.isEmpty():
            break
        bit = F.floor(F.log2(F.col("way"))).cast("int")
        halves = open_.join(lifted, "node_id").withColumn("bit", bit).withColumn("step", F.expr("shiftleft(1, bit)"))
        parts = F.array(F.struct("node_id", (F.col("step") - 1).alias("way")), F.struct(F.get("ups", F.col("bit")).alias("node_id"), (F.col("way") - F.col("step")).alias("way")))
        now = cut(halves.select("q", F.explode(parts).alias("x")).select("q", "x.node_id", "x.way").where("node_id is not null").groupBy("q", "node_id").agg(F.max("way").alias("way")))
    out = done[0]
    for d in done[1:]:
        out = out.union(d)
    return out.distinct()


def anchors(tree: DataFrame, rules: dict[str, list[str]]) -> DataFrame:
    """(node_id, anchor): the nearest node above of one of the kinds that belong to the node's kind,
    e.g. {"break": ["for", "while", "do", "switch"], "continue": ["for", "while", "do"], "case": ["switch"], "else": ["if"]}.

    Every node looks up twice as far each round and keeps the nearest node for each rule.
    """
    kinds = list(rules)
    above = tree.select(F.col("node_id").alias("parent_id"), F.col("kind").alias("above"), F.lit(True).alias("known"))
    own = tree.select("node_id", "parent_id", "kind").join(above, "parent_id", "left")
    hits = {f"hit_{i}": F.when(F.col("above").isin(rules[k]), F.col("parent_id")) for i, k in enumerate(kinds)}
    rows = own.select(F.col("node_id").alias("node"), F.when(F.col("known"), F.col("parent_id")).alias("far"), *[h.alias(n) for n, h in hits.items()])
    found = doubled(rows, {n: (F.coalesce(n, f"up_{n}"), F.col(n)) for n in hits})
    picked = F.lit(None)
    for i, k in enumerate(kinds):
        picked = F.when(F.col("kind") == k, F.col(f"hit_{i}")).otherwise(picked)
    asked = tree.where(F.col("kind").isin(kinds)).select(F.col("node_id").alias("node"), "kind")
    return asked.join(found, "node").select(F.col("node").alias("node_id"), picked.alias("anchor")).where("anchor is not null")


# Fixed values of the language's grammar: what a selected parent brings along, as (kind, role, the role that has to be selected
# for it; none: always). What a loop starts with is optional and stays out; an else comes with its keyword.
MANDATORY = (
    ("function", "type", None), ("function", "name", None), ("function", "parameters", None), ("function", "body", None),
    ("compound", "brace", None),
    ("if", "keyword", None), ("if", "condition", None), ("if", "then", None),
    ("if", "else keyword", "else keyword"), ("if", "else keyword", "else"), ("if", "else", "else keyword"), ("if", "else", "else"),
    ("switch", "keyword", None), ("switch", "condition", None),
    ("case", "keyword", None), ("case", "condition", None),
    ("default", "keyword", None),
    ("for", "keyword", None), ("for", "body", None),
    ("while", "keyword", None), ("while", "condition", None), ("while", "body", None),
    ("do", "keyword", None), ("do", "while", None), ("do", "condition", None), ("do", "body", None),
    ("return", "keyword", None), ("return", "value", None),
)
# A parent whose only selected child has this role (none: any) is passed over and brings nothing.
ALONE = (("if", "then"), ("if", "else"), ("for", "body"), ("while", "body"), ("do", "body"), ("switch", "case"), ("compound", None))
#: A brace calls for its partner even alone, and a case that stands by its own keyword or condition for its switch.
OWN = ("brace", "keyword", "condition")


def mandatory(tree: DataFrame, sets: DataFrame, rules=MANDATORY, alone=ALONE) -> DataFrame:
    """(q, node_id): children that the kinds of selected parents call for, by role."""
    spark, chosen = sets.sparkSession, sets.distinct()
    nodes = chosen.join(tree.select("node_id", "parent_id", "kind", "role"), "node_id")
    # of each node, whether some of its own tokens are selected too
    own = nodes.where(F.col("role").isin(*OWN)).select("q", F.col("parent_id").alias("node_id")).distinct().withColumn("own", F.lit(True))
    inside = nodes.where("parent_id is not null").join(own, ["q", "node_id"], "left").select("q", "parent_id", "role", F.coalesce("own", F.lit(False)).alias("own"))
    single = inside.groupBy("q", "parent_id").agg(F.count("*").alias("n"), F.max("role").alias("only"), F.max("own").alias("own")).where("n = 1")
    passed = spark.createDataFrame(list(alone), "parent_kind string, passed string")
    parents = nodes.select("q", F.col("node_id").alias("parent_id"), F.col("kind").alias("parent_kind"))
    over = parents.join(single, ["q", "parent_id"]).join(F.broadcast(passed), "parent_kind").where("(passed is null and only <> 'brace') or (passed = only and not (parent_kind = 'switch' and own))")
    asking = parents.join(over.select("q", "parent_id"), ["q", "parent_id"], "left_anti")
    table = spark.createDataFrame(list(rules), "parent_kind string, role string, needs string")
    wanted = asking.join(F.broadcast(table), "parent_kind")
    always = wanted.where("needs is null")
    if_there = wanted.where("needs is not null").join(inside.select("q", "parent_id", F.col("role").alias("needs")).distinct(), ["q", "parent_id", "needs"], "left_semi")
    called = always.select("q", "parent_id", "role").union(if_there.select("q", "parent_id", "role")).distinct()
    return called.join(tree.select("node_id", "parent_id", "role"), ["parent_id", "role"]).select("q", "node_id").distinct()


def complete(tree: DataFrame, lifted: DataFrame, sets: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(q, node_id): sets closed under paths to the common ancestor and under mandatory children."""
    now, n = cut(sets.select("q", "node_id").distinct()), -1
    for _ in range(most_rounds):
        now = cut(path_closure(lifted, now).union(now).distinct())
        now = cut(now.union(mandatory(tree, now)).distinct())
        if (size := now.count()) == n:
            return now
        n = size
    raise RuntimeError(f"not complete after {most_rounds} rounds")


def function_headers(tree: DataFrame, anc: DataFrame, sets: DataFrame, kind: str = "function", roles: tuple[str, ...] = ("type", "name", "parameters", "body", "brace")) -> DataFrame:
    """Sets that reach into two functions or more get each function's header, body and braces."""
    kinds = tree.where(F.col("kind") == kind).select(F.col("node_id").alias("anc"))
    inside = sets.distinct().join(anc, "node_id").join(kinds, "anc").select("q", F.col("anc").alias("function")).distinct()
    many = inside.groupBy("q").agg(F.count("*").alias("n")).where("n >= 2").select("q")
    wanted = inside.join(many, "q")
    parts = wanted.join(tree.where(F.col("role").isin(*roles)).select("node_id", F.col("parent_id").alias("function")), "function").select("q", "node_id")
    return sets.select("q", "node_id").union(wanted.select("q", F.col("function").alias("node_id"))).union(parts).distinct()


def kind_path(tree: DataFrame) -> DataFrame:
    """(node_id, path): kinds from the root down, apart by "/"."""
    known = tree.select(F.col("node_id").alias("far"), F.lit(True).alias("there"))
    rows = tree.select(F.col("node_id").alias("node"), F.col("parent_id").alias("far"), F.coalesce("kind", F.lit("")).alias("path")).join(known, "far", "left")
    rows = rows.select("node", F.when(F.col("there"), F.col("far")).alias("far"), "path")
    return doubled(rows, {"path": (F.concat_ws("/", "up_path", "path"), F.col("path"))}).select(F.col("node").alias("node_id"), "path")


def nth_of_kind(tree: DataFrame, line: Column, order: list[str]) -> DataFrame:
    """Nodes with ``nth``: their number among those of their kind on a line."""
    w = Window.partitionBy("file", "kind", "__line").orderBy(*order)
    return tree.withColumn("__line", line).withColumn("nth", F.row_number().over(w)).drop("__line")


def selection_distribution(sets: DataFrame, tree: DataFrame, anc: DataFrame, kinds: list[str]) -> DataFrame:
    """(q, tokens, n_files, n_<kind>.., per_<kind>..): how many files and nodes of each kind enclose a selection, and its
    tokens per each; null over none."""
    chosen = sets.distinct()
    around = chosen.join(anc, "node_id").join(tree.select(F.col("node_id").alias("anc"), "kind"), "anc")
    inside = around.groupBy("q").agg(F.count_distinct("node_id").alias("tokens"), *[F.count_distinct(F.when(F.col("kind") == k, F.col("anc"))).alias(f"n_{k}") for k in kinds])
    files = chosen.join(tree.select("node_id", "file"), "node_id").groupBy("q").agg(F.count_distinct("file").alias("n_files"))
    return inside.join(files, "q").select("q", "tokens", "n_files", *[F.col(f"n_{k}") for k in kinds], *[F.try_divide("tokens", f"n_{k}").alias(f"per_{k}") for k in kinds])


def nearest_definition(uses: DataFrame, scopes: DataFrame, defs: DataFrame) -> DataFrame:
    """(use_id, def_id): each used name's definition in the deepest scope around it.

    uses: (use_id, scope_id, name); scopes: (scope_id, parent_id); defs: (def_id, scope_id, name). Scopes become spans of one walk, and a
    name's definitions spans of that name: the smallest around a use is asked for, whatever lies between them.
    """
    walk = cut(spans(scopes.select(F.col("scope_id").alias("node_id"), "parent_id")).withColumnRenamed("node_id", "scope_id"))
    known = defs.groupBy("scope_id", "name").agg(F.min("def_id").alias("id")).join(walk, "scope_id").select(F.struct("root", "name").alias("file"), "id", "begin", "end")
    asked = uses.select("use_id", "scope_id", "name").join(walk, "scope_id").select("use_id", F.struct("root", "name").alias("file"), F.col("begin").alias("line"))
    found = innermost(asked, known)
    return asked.join(found, ["file", "line"]).select("use_id", F.col("id").alias("def_id"))


def input_variables(uses: DataFrame, definitions: DataFrame, sets: DataFrame, globals_: DataFrame) -> DataFrame:
    """(q, name, source): names that a selection uses and defines outside of itself, once each: ``local``, else ``global``, else
    ``unknown``. uses: (node_id, name); definitions: (node_id, name, def_node), as ``nearest_definition`` gives;
    sets: (q, node_id); globals_: (name)."""
    used = sets.distinct().join(uses, "node_id").join(definitions, ["node_id", "name"], "left")
    own = sets.select("q", F.col("node_id").alias("def_node")).distinct()
    outside = used.join(own, ["q", "def_node"], "left_anti")
    named = outside.groupBy("q", "name").agg(F.max(F.col("def_node").isNotNull()).alias("local"))
    known = globals_.select("name", F.lit(True).alias("global")).distinct()
    return named.join(known, "name", "left").select("q", "name", F.when(F.col("local"), "local").when(F.col("global"), "global").otherwise("unknown").alias("source"))


def chain_paths(lifted: DataFrame) -> DataFrame:
    """(node_id, depth, heads, levels): the way from the root to each node by heavy chains, the first node of each and the depth at which the way leaves it.

    A node's heavy child is that with the most nodes under it, so that a way has at most log2(nodes) + 1 chains, however deep the tree is. Two nodes
    have the chains before their common ancestor's, and that one, in common, and it is where the first of their ways leaves that one.
    """
    lifted = stored(lifted)
    sizes = stored(lifted.select("node_id", "ups", F.lit(1).cast("long").alias("size")))
    for k in range(_bits(lifted)):  # sizes of what is less than 2^k levels below, then of twice as much
        below = sizes.select(F.get("ups", F.lit(k)).alias("node_id"), "size").where("node_id is not null").groupBy("node_id").agg(F.sum("size").alias("more"))
        sizes = stored(sizes.join(below, "node_id", "left").select("node_id", "ups", (F.col("size") + F.coalesce("more", F.lit(0))).alias("size")))
    parent = sizes.select("node_id", F.get("ups", F.lit(0)).alias("parent"), "size")
    heavy = parent.where("parent is not null").groupBy("parent").agg(F.max(F.struct("size", "node_id")).alias("h")).join(lifted.select(F.col("node_id").alias("parent")), "parent", "left_semi").select(F.col("h.node_id").alias("node_id"), F.lit(True).alias("heavy"))
    rows = parent.join(heavy, "node_id", "left").select(F.col("node_id").alias("node"), F.when(F.col("heavy"), F.col("parent")).alias("far"), F.coalesce(F.when(F.col("heavy"), F.col("parent")), "node_id").alias("head"))
    heads = stored(doubled(rows, {"head": (F.col("up_head"), F.col("head"))}).join(lifted.select(F.col("node_id").alias("node"), "depth", F.get("ups", F.lit(0)).alias("parent")), "node"))
    step = F.struct(F.col("far").alias("head"), (F.col("depth") - 1).alias("level"))
    chains = heads.where("node = head").select("node", "parent", "depth").join(heads.select(F.col("node").alias("parent"), F.col("head").alias("far")), "parent", "left")
    type_ = f"array<struct<head:{lifted.schema['node_id'].dataType.simpleString()},level:{lifted.schema['depth'].dataType.simpleString()}>>"
    chains = doubled(chains.select("node", "far", F.when(F.col("far").isNull(), F.array()).otherwise(F.array(step)).cast(type_).alias("ways")), {"ways": (F.concat("ways", "up_ways"), F.col("ways"))})
    whole = heads.join(chains.select(F.col("node").alias("head"), "ways"), "head").select("node", "depth", F.reverse(F.concat(F.array(F.struct(F.col("head"), F.col("depth").alias("level"))).cast(type_), "ways")).alias("ways"))
    return whole.select(F.col("node").alias("node_id"), "depth", F.col("ways.head").alias("heads"), F.col("ways.level").alias("levels"))


#: Criteria of a function, and lines of it, that meet in one part.
CRITERIA, LINES = 1024, 1 << 14


def slice_features(lines: DataFrame, criteria: DataFrame, lifted: DataFrame, members: DataFrame) -> DataFrame:
    """(crit, file, line, same_var, var_type, distance, ast_distance, to_lca, criterion_to_lca, level, uses_global, in_slice) for every
    line of the criterion's function: tree distances are null where no node is above both.

    lines: (file, function, line, node_id, variables array, var_type, uses_global); criteria: (crit, file, line);
    members: (crit, file, line) of the slice.

    Pairs are made once and not shuffled: both nodes bring their chains, a line the criteria of the part in whose slices it is.
    """
    paths = stored(chain_paths(lifted))
    most = paths.agg(F.max(F.size("heads"))).first()[0] or 1
    function = ["file", "function"]
    lines = lines.where("file is not null and function is not null")
    crit = criteria.join(lines.select(*function, "line", "node_id", F.col("variables").alias("c_vars")), ["file", "line"])
    crit = stored(crit.join(paths, "node_id", "left").select("crit", *function, F.col("line").alias("c_line"), "c_vars", *[F.col(c).alias(f"c_{c}") for c in ("depth", "heads", "levels")]))
    # criteria in parts, lines in lots: a part meets a lot
    dealt = stored(lines.groupBy(*function).agg(F.ceil(F.count("*") / LINES).cast("int").alias("lots")).join(crit.groupBy(*function).agg(F.ceil(F.count("*") / CRITERIA).cast("int").alias("parts")), function))
    crit = stored(crit.join(dealt, function).withColumn("part", F.pmod(F.xxhash64("crit"), F.col("parts")).cast("int")))
    hits = members.where("crit is not null").select("crit", "file", "line").join(crit.select("crit", *function, "part"), ["crit", "file"]).groupBy(*function, "line", "part").agg(F.collect_set("crit").alias("hits"))
    here = lines.join(dealt, function).join(paths, "node_id", "left").withColumn("lot", F.pmod(F.xxhash64("line", "node_id"), F.col("lots")).cast("int"))
    here = here.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).join(hits, [*function, "line", "part"], "left").drop("parts", "lots")
    both = [*function, "part", "lot"]
    met = here.join(crit.withColumn("lot", F.explode(F.sequence(F.lit(0), F.col("lots") - 1))).drop("parts", "lots"), both)
    head, level = lambda p, i: F.get(f"{p}heads", F.lit(i)), lambda i: F.least(F.get("levels", F.lit(i)), F.get("c_levels", F.lit(i)))
    found = level(most - 1)
    for i in range(most - 1, 0, -1):
        found = F.when(head("", i) == head("c_", i), found).otherwise(level(i - 1))
    met = met.withColumn("level", F.when(head("", 0) == head("c_", 0), found))
    up_c, up_n = F.col("c_depth") - F.col("level"), F.col("depth") - F.col("level")
    return met.select(
        "crit", "file", "line", F.arrays_overlap("variables", "c_vars").cast("int").alias("same_var"), "var_type", F.abs(F.col("line") - F.col("c_line")).alias("distance"), (up_c + up_n).alias("ast_distance"),
        up_n.alias("to_lca"), up_c.alias("criterion_to_lca"), "level", "uses_global", F.coalesce(F.array_contains("hits", F.col("crit")), F.lit(False)).alias("in_slice"),
    )
