"""Directed graphs as edge tables (src, dst, label), one edge a pair.

Fixpoints are loops over frontiers: every round joins only what is new, is checkpointed to the shared folder, and is counted
once. What is long rather than wide is contracted: nodes with one way in and one way out form chains, whose ends find one another by
doubling, so that a chain takes as many rounds as its length has bits. ``most_rounds`` bounds the depth of what is left; a graph that is deeper raises rather
than giving a part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcfacts.session import cut, stored

MOST_ROUNDS = 10_000
#: Rounds after which a closure goes on over the contracted graph.
SHALLOW = 24
#: Nodes below which contraction isn't worth its rounds.
FEW = 64


def chains(edges: DataFrame, bases: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(edges without chains, chain nodes, ring nodes) of edges (src, dst, w, b), one a pair.

    A chain node has one way in and one way out; it is given as (node, root, head, tail, w, b): the first node of its chain, the nodes
    before and behind it. Each chain becomes an edge head -> tail. w and b compose as the function max(x + w, b) of a value
    that goes along the edge; bases (node, base) bounds the value at a node. Nodes of rings that nothing leads into or out of come as (node, root), root the smallest node.
    """
    ins = edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("n_in"), F.min("src").alias("prev"), F.max("w").alias("w"), F.max("b").alias("b"))
    outs = edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n_out"), F.min("dst").alias("next"), F.max("w").alias("w_out"), F.max("b").alias("b_out"))
    inner = ins.join(outs, "node").where("n_in = 1 and n_out = 1 and prev <> node")
    if bases is not None:
        inner = inner.join(bases, "node", "left").withColumn("b", F.greatest("b", "base"))
    inner = stored(inner.select("node", "prev", "next", "w", "b", "w_out", "b_out"))
    mine = inner.select(F.col("node").alias("prev"), F.lit(True).alias("open"))
    state = stored(inner.join(mine, "prev", "left").select("node", F.col("prev").alias("ptr"), F.col("node").alias("root"), F.col("node").alias("least"), "w", "b", F.coalesce("open", F.lit(False)).alias("open")))
    for _ in range(state.count().bit_length() + 1):
        if state.where("open").isEmpty():
            break
        far = state.select(F.col("node").alias("ptr"), F.col("ptr").alias("p2"), F.col("root").alias("r2"), F.col("least").alias("l2"), F.col("w").alias("w2"), F.col("b").alias("b2"), F.col("open").alias("o2"))
        moved = state.where("open").join(far, "ptr").select("node", F.col("p2").alias("ptr"), F.col("r2").alias("root"), F.least("least", "l2").alias("least"), (F.col("w") + F.col("w2")).alias("w"), F.greatest(F.col("b2") + F.col("w"), F.col("b")).alias("b"), F.col("o2").alias("open"))
        state = stored(state.where("not open").union(moved))
    done = state.where("not open").join(inner.select("node", "next", "w_out", "b_out"), "node")
    last = done.join(mine.select(F.col("prev").alias("next")), "next", "left_anti").select("root", F.col("ptr").alias("head"), F.col("next").alias("tail"), (F.col("w") + F.col("w_out")).alias("w"), F.greatest(F.col("b") + F.col("w_out"), "b_out").alias("b"))
    last = stored(last)
    gone = inner.select(F.col("node").alias("src"))
    left = edges.select("src", "dst", "w", "b").join(gone, "src", "left_anti").join(gone.toDF("dst"), "dst", "left_anti").select("src", "dst", "w", "b")
    joined = left.union(last.select("head", "tail", "w", "b")).groupBy("src", "dst").agg(F.max("w").alias("w"), F.max("b").alias("b"))
    nodes = state.where("not open").join(last.select("root", "head", "tail"), "root").select("node", "root", "head", "tail", "w", "b")
    return stored(joined), stored(nodes), state.where("open").select("node", F.col("least").alias("root"))


def _weighted(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").where("src is not null and dst is not null").distinct().select("src", "dst", F.lit(1).cast("long").alias("w"), F.lit(0).cast("long").alias("b"))


def _nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()


def _without(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return edges.join(nodes.select(F.col("node").alias("src")), "src", "left_anti").join(nodes.select(F.col("node").alias("dst")), "dst", "left_anti").select(*edges.columns)


def components(edges: DataFrame, most_rounds: int = MOST_ROUNDS) -> DataFrame:
    """(node, component): of every node on an edge the smallest node that it reaches and that reaches it; itself if there is none.

    In turns: nodes without a way in or out are alone; chains are contracted (a chain belongs to its ends if these belong together);
    each node takes the largest node that reaches it as its colour; who reaches its own colour's node backwards is of its component. Edges
    between colours never close a circle and go.
    """
    left = stored(_weighted(edges).where("src <> dst"))
    todo = stored(_nodes(edges).where("node is not null"))
    alone = todo.select("node", F.col("node").alias("component"))
    found, held = [], []
    for _ in range(most_rounds):
        before = left.count()
        if before == 0:
            break
        on = left.select(F.col("src").alias("node")).intersect(left.select(F.col("dst").alias("node")))  # with a way in and a way out
        left = stored(left.join(on.select(F.col("node").alias("src")), "src", "left_semi").join(on.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst", "w", "b"))
        now = left.count()
        if now >= FEW and now * 8 > before * 7:
            left, nodes, rings = chains(left)
            rings = stored(rings.select("node", F.col("root").alias("component")))
            found.append(rings)
            held.append(nodes)
            left = stored(_without(left.where("src <> dst"), rings))
            now = left.count()
        if now == 0 or now * 8 <= before * 7:
            continue
        colour = stored(_nodes(left).select("node", F.col("node").alias("colour")))
        fresh = colour
        for _ in range(most_rounds):
            sent = fresh.join(left, fresh["node"] == left["src"]).groupBy(F.col("dst").alias("node")).agg(F.max("colour").alias("sent"))
            fresh = stored(sent.join(colour, "node").where("sent > colour").select("node", F.col("sent").alias("colour")))
            if fresh.isEmpty():
                break
            colour = stored(colour.join(fresh.select("node", F.col("colour").alias("more")), "node", "left").select("node", F.coalesce("more", "colour").alias("colour")))
        inside = stored(left.join(colour.select(F.col("node").alias("src"), F.col("colour").alias("c1")), "src").join(colour.select(F.col("node").alias("dst"), F.col("colour").alias("c2")), "dst").where("c1 = c2").select("src", "dst", "w", "b"))
        back = closure(inside.select(F.col("dst").alias("src"), F.col("src").alias("dst")), colour.where("node = colour").select(F.col("colour").alias("q"), "node"), most_rounds=most_rounds, contract=False)
        settled = stored(back.groupBy("q").agg(F.min("node").alias("component")).join(back, "q").select("node", "component"))
        found.append(settled)
        left = stored(_without(inside, settled))
    else:
        raise RuntimeError(f"components not settled after {most_rounds} rounds")
    known = todo.limit(0).withColumn("component", F.col("node"))
    for f in found:
        known = known.unionByName(f)
    known = stored(known)
    for nodes in reversed(held):
        ends = nodes.join(known.select(F.col("node").alias("head"), F.col("component").alias("c1")), "head", "left").join(known.select(F.col("node").alias("tail"), F.col("component").alias("c2")), "tail", "left")
        # a chain whose ends are one node, or of one component, closes a circle; the component may have a smaller node now
        same = stored(ends.where("head = tail or c1 = c2").select("node", F.coalesce("c1", "head").alias("old"), "head"))
        least = same.groupBy("old").agg(F.min("node").alias("least"))
        grown = known.unionByName(same.select(F.col("head").alias("node"), F.col("old").alias("component"))).distinct().unionByName(same.select("node", F.col("old").alias("component")))
        known = stored(grown.join(least.withColumnRenamed("old", "component"), "component", "left").select("node", F.least("component", "least").alias("component")))
    return alone.join(known, "node", "left_anti").unionByName(known)


def closure(edges: DataFrame, seeds: DataFrame, keep_seeds: bool = True, most_rounds: int = MOST_ROUNDS, contract: bool = True) -> DataFrame:
    """(q, node): all nodes reachable from the seeds (q, node) of each question q; without keep_seeds the seeds are left out.

    After ``SHALLOW`` rounds, what is still open goes on over the contracted graph: components as one node, chains as one edge.
    """
    step = cut(edges.select("src", "dst").where("src is not null and dst is not null").distinct())
    start = cut(seeds.select("q", "node").distinct())
    seen, frontier, parts = start, start, int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for i in range(most_rounds):
        if contract and i == SHALLOW:
            seen = cut(seen.union(_far(step, frontier, most_rounds)).distinct())
            return seen if keep_seeds else seen.join(start, ["q", "node"], "left_anti")
        found = frontier.join(step, frontier["node"] == step["src"]).select("q", F.col("dst").alias("node")).distinct()
        frontier = cut(found.join(seen, ["q", "node"], "left_anti"))
        if frontier.isEmpty():
            return seen if keep_seeds else seen.join(start, ["q", "node"], "left_anti")
        seen = seen.union(frontier)  # all parts are checkpointed; written anew only so that they don't become too many
        seen = cut(seen.coalesce(parts)) if i % 16 == 15 else seen
    raise RuntimeError(f"closure is deeper than {most_rounds} steps")


def _far(step: DataFrame, start: DataFrame, most_rounds: int) -> DataFrame:
    """(q, node) of all that the start reaches, over components and chains."""
    part = cut(components(step))
    of = lambda c: part.select(F.col("node").alias(c), F.col("component").alias(f"{c}_of"))
    between = step.join(of("src"), "src").join(of("dst"), "dst").where("src_of <> dst_of").select(F.col("src_of").alias("src"), F.col("dst_of").alias("dst"))
    left, nodes, _ = chains(cut(_weighted(between)))
    asked = cut(start.join(part, "node", "left").select("q", F.coalesce("component", "node").alias("node")).distinct())
    # who begins on a chain passes the rest of it and its tail
    own = cut(asked.join(nodes.select("node", "root", "tail", F.col("w").alias("from")), "node"))
    rest = own.select("q", "root", "from").join(nodes.select("root", "node", "w"), "root").where("w > from").select("q", "node")
    plain = asked.join(nodes.select("node"), "node", "left_anti").select("q", "node").union(own.select("q", F.col("tail").alias("node"))).distinct()
    reached = closure(left.select("src", "dst"), plain, most_rounds=most_rounds, contract=False)
    passed = reached.join(nodes.select(F.col("head").alias("node"), F.col("node").alias("on")), "node").select("q", F.col("on").alias("node"))
    every = asked.union(reached).union(rest).union(passed).distinct()
    return every.join(part.select(F.col("component").alias("node"), F.col("node").alias("member")), "node", "left").select("q", F.coalesce("member", "node").alias("node"))


def outermost(ids: DataFrame, outers: DataFrame, most_rounds: int = MOST_ROUNDS) -> DataFrame:
    """(q, node): each node replaced by those of its enclosing ones that nothing encloses. outers: (src, dst), dst encloses src."""
    everything = closure(outers, ids, most_rounds=most_rounds)
    inner = outers.where("src <> dst").select(F.col("src").alias("node")).distinct()
    return everything.join(inner, "node", "left_anti").select("q", "node")


def resolve_with_deps(ids: DataFrame, deps: DataFrame, outers: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(q, node): closure over dependences and replacement by outermost, in turns until a set comes again."""
    now, seen = cut(ids.select("q", "node").distinct()), set()
    for _ in range(most_rounds):
        now = cut(outermost(closure(deps, now), outers).distinct())
        sign = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("q", "node").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("q", "node"))).first())
        if sign in seen:
            return now
        seen.add(sign)
    raise RuntimeError(f"not settled after {most_rounds} rounds")


def neighbors(edges: DataFrame, ids: DataFrame, direction: str = "out") -> DataFrame:
    """(node, neighbor): successors (out) or predecessors (in) of the given nodes."""
    here, there = ("src", "dst") if direction == "out" else ("dst", "src")
    return edges.join(ids.select(F.col("node").alias(here)).distinct(), here, "left_semi").select(F.col(here).alias("node"), F.col(there).alias("neighbor")).distinct()


def topo_rank(edges: DataFrame, nodes: DataFrame | None = None, most_rounds: int = MOST_ROUNDS) -> DataFrame:
    """(node, rank): sources first, each node behind all that lead to it, by the longest way; nodes on or behind a cycle have a null
    rank. Order by (rank, node).

    Sources are taken off in rounds, the round being their rank. What is left after ``SHALLOW`` rounds goes on with lengths on its
    edges, chains contracted.
    """
    left = cut(edges.select("src", "dst").where("src is not null and dst is not null").distinct())
    every = _nodes(left) if nodes is None else _nodes(left).union(nodes.select("node")).distinct()
    todo, ranked = cut(every.where("node is not null")), []
    for rank in range(min(SHALLOW, most_rounds)):
        free = cut(todo.join(left.select(F.col("dst").alias("node")).distinct(), "node", "left_anti"))
        if free.isEmpty():
            break
        ranked.append(free.withColumn("rank", F.lit(rank).cast("long")))
        todo = cut(todo.join(free, "node", "left_anti"))
        left = cut(left.join(free.withColumnRenamed("node", "src"), "src", "left_anti"))
    else:
        if not todo.isEmpty():
            ranked.append(_deep_ranks(_weighted(left), todo.withColumn("base", F.lit(SHALLOW).cast("long")), most_rounds))
            todo = todo.limit(0)
    known = todo.withColumn("rank", F.lit(None).cast("long"))
    for r in ranked:
        known = known.unionByName(r)
    return known.select("node", F.col("rank").cast("int").alias("rank"))


def _deep_ranks(left: DataFrame, todo: DataFrame, most_rounds: int) -> DataFrame:
    """(node, rank) of nodes (node, base) that are ranked base at least: rounds as in ``topo_rank`` over edges (src, dst, w, b), and chains
    contracted as long as that takes an eighth of the nodes; else it is tried again after twice as many rounds."""
    left, todo, ranked, held, wait, pause = stored(left), stored(todo), [], [], 0, 1
    for _ in range(most_rounds):
        if wait == 0 and (some := todo.count()) >= FEW:
            less, on, rings = chains(left, todo)
            wait = pause = 1 if on.count() * 8 >= some else 2 * pause
            left = stored(_without(less, rings))
            held.append(on.select("node", "head", "w", "b"))
            ranked.append(stored(rings.select("node", F.lit(None).cast("long").alias("rank"))))
            todo = stored(todo.join(on.select("node").union(rings.select("node")), "node", "left_anti").select("node", "base"))
        wait = max(0, wait - 1)
        free = stored(todo.join(left.select(F.col("dst").alias("node")).distinct(), "node", "left_anti").select("node", F.col("base").alias("rank")))
        if free.isEmpty():
            break
        ranked.append(free)
        pushed = left.join(free.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.max(F.greatest(F.col("rank") + F.col("w"), F.col("b"))).alias("pushed"))
        todo = stored(todo.join(free.select("node"), "node", "left_anti").join(pushed, "node", "left").select("node", F.greatest("base", "pushed").alias("base")))
        left = stored(left.join(free.select(F.col("node").alias("src")), "src", "left_anti").select("src", "dst", "w", "b"))
    else:
        raise RuntimeError(f"deeper than {most_rounds} rounds")
    known = todo.select("node", F.lit(None).cast("long").alias("rank"))
    for r in ranked:
        known = known.unionByName(r)
    for on in reversed(held):
        known = stored(known)
        known = known.unionByName(on.join(known.select(F.col("node").alias("head"), "rank"), "head").select("node", F.when(F.col("rank").isNotNull(), F.greatest(F.col("rank") + F.col("w"), F.col("b"))).alias("rank")))
    return known


def has_cycle(edges: DataFrame) -> bool:
    return not topo_rank(edges).where("rank is null").isEmpty()


def union(left: DataFrame, right: DataFrame) -> DataFrame:
    """Edges of both, the label of the first."""
    both = left.select("src", "dst", "label", F.lit(0).alias("pos")).union(right.select("src", "dst", "label", F.lit(1)))
    return both.groupBy("src", "dst").agg(F.min_by("label", F.struct("pos", "label")).alias("label"))


def eliminate(edges: DataFrame, nodes: DataFrame, label: str, most_rounds: int = MOST_ROUNDS) -> DataFrame:
    """Edges without the nodes: whatever led through removed nodes leads on directly, with the label."""
    gone = cut(nodes.select("node").distinct())
    into = edges.join(gone.withColumnRenamed("node", "src"), "src", "left_anti")
    entries = into.join(gone.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", F.col("dst").alias("entry"))
    inside = cut(edges.join(gone.withColumnRenamed("node", "src"), "src", "left_semi").select("src", "dst"))
    # what each entered node leads to, found once for all edges into it
    through = closure(inside.join(gone.withColumnRenamed("node", "dst"), "dst", "left_semi"), entries.select(F.col("entry").alias("q"), F.col("entry").alias("node")), most_rounds=most_rounds)
    exits = cut(through.join(inside, through["node"] == inside["src"]).select(F.col("q").alias("entry"), "dst").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti").distinct())
    new = entries.join(exits, "entry").select("src", "dst", F.lit(label).alias("label")).distinct()
    return union(into.join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti"), new)


def drop_out_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return edges.join(nodes.select(F.col("node").alias("src")), "src", "left_anti").select(*edges.columns)


def call_edges(sites: DataFrame, functions: DataFrame) -> DataFrame:
    """Call site -> callee's entry ("Call") and callee's exit -> call site ("Return"); unknown callees are skipped.

    sites: (node, callee); functions: (name, entry, exit).
    """
    met = sites.join(functions, sites["callee"] == functions["name"])
    return met.select(F.col("node").alias("src"), F.col("entry").alias("dst"), F.lit("Call").alias("label")).union(met.select(F.col("exit"), F.col("node"), F.lit("Return")))


def eliminate_callsites(edges: DataFrame, sites: DataFrame) -> DataFrame:
    """Edges without call sites: what led into a site enters its callees, and their exits lead to what followed it.
    Sites without a callee are passed over with an empty label."""
    site = sites.select("node").distinct()
    calls = edges.where("label = 'Call'").join(site.withColumnRenamed("node", "src"), "src", "left_semi")
    returns = edges.where("label = 'Return'").join(site.withColumnRenamed("node", "dst"), "dst", "left_semi")
    plain = edges.where("label not in ('Call', 'Return')")
    into = plain.select(F.col("src").alias("u"), F.col("dst").alias("node")).join(site, "node")
    out = plain.select(F.col("src").alias("node"), F.col("dst").alias("v")).join(site, "node")
    enter = into.join(calls.select(F.col("src").alias("node"), F.col("dst").alias("entry")), "node").select(F.col("u").alias("src"), F.col("entry").alias("dst"), F.lit("enter").alias("label"))
    leave = out.join(returns.select(F.col("dst").alias("node"), F.col("src").alias("exit")), "node").select(F.col("exit").alias("src"), F.col("v").alias("dst"), F.lit("leave").alias("label"))
    unknown = site.join(calls.select(F.col("src").alias("node")), "node", "left_anti")
    over = into.join(unknown, "node", "left_semi").join(out, "node").select(F.col("u").alias("src"), F.col("v").alias("dst"), F.lit("").alias("label"))
    rest = edges.join(site.withColumnRenamed("node", "src"), "src", "left_anti").join(site.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst", "label")
    new = enter.union(leave).union(over)
    new = new.join(site.withColumnRenamed("node", "src"), "src", "left_anti").join(site.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst", "label")
    return union(rest, new.distinct())


def icfg(edges: DataFrame, sites: DataFrame, functions: DataFrame, remove_sites: bool = False, remove_ends: bool = False) -> DataFrame:
    """Interprocedural graph of function graphs: their edges with calls and returns; optionally without the functions' entry
    and exit nodes - calls lead to what follows an entry, returns from what comes before an exit - and without call sites.
    A call or return stays beside an edge between its two nodes, until one of them is removed."""
    whole = edges.select("src", "dst", "label").union(call_edges(sites, functions))
    if remove_ends:
        whole = cut(eliminate(whole, functions.select(F.col("entry").alias("node")), "Call"))
        whole = cut(eliminate(whole, functions.select(F.col("exit").alias("node")), "Return"))
    return eliminate_callsites(whole, sites) if remove_sites else whole


def is_recursive(sites: DataFrame, owner: DataFrame) -> bool:
    """Whether calls (caller of the site's node in owner (node, name)) form a cycle."""
    return has_cycle(sites.join(owner, "node").select(F.col("name").alias("src"), F.col("callee").alias("dst")))


def context_frontier(starts: DataFrame, edges: DataFrame, calls: DataFrame, k: int, branches: DataFrame | None = None) -> DataFrame:
    """(q, node, round): k rounds backwards from (q, node): predecessors that aren't in the set yet; a node without
    predecessors goes on at the call sites of its function - calls: (entry, site). Branch nodes (node) may come again."""
    seen = cut(starts.select("q", "node", F.lit(0).alias("round")).distinct())
    head = seen.select("q", "node")
    back = edges.select(F.col("dst").alias("node"), F.col("src").alias("prev"))
    up = calls.select(F.col("entry").alias("node"), F.col("site").alias("prev"))
    for i in range(1, k + 1):
        own = head.join(back, "node").select("q", F.col("prev").alias("node"))
        orphan = head.join(back.select("node").distinct(), "node", "left_anti")
        found = own.union(orphan.join(up, "node").select("q", F.col("prev").alias("node"))).distinct()
        new = found.join(seen.select("q", "node"), ["q", "node"], "left_anti")
        if branches is not None:
            new = new.union(found.join(branches.select("node").distinct(), "node", "left_semi").select("q", "node")).distinct()
        head = cut(new)
        if head.isEmpty():
            break
        seen = cut(seen.union(head.withColumn("round", F.lit(i))))
    return seen.groupBy("q", "node").agg(F.min("round").alias("round"))
