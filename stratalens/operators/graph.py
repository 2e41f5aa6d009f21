"""Graph operators over edge tables, as set-at-a-time loops."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

KIND_ORDER = ("launches", "sends_action", "registers_receiver", "uses", "extends")


def ancestor_closure(edges: DataFrame) -> DataFrame:
    """(node, ancestor, depth) over edges (src, dst): every ancestor at its least depth, the node itself left out.

    `seen` ends cycles, so that the loop ends after as many rounds as the longest of the least depths.
    """
    e = edges.select("src", "dst").filter("src <> dst").distinct()
    seen = cut_lineage(e.select(F.col("src").alias("node"), F.col("dst").alias("ancestor"), F.lit(1).alias("depth")))
    front = seen
    for depth in count(2):
        step = front.join(e, F.col("ancestor") == F.col("src")).select("node", F.col("dst").alias("ancestor")).filter("node <> ancestor").distinct()
        front = cut_lineage(step.join(seen, ["node", "ancestor"], "left_anti").withColumn("depth", F.lit(depth)))
        if front.isEmpty():
            break
        seen = cut_lineage(seen.unionByName(front))
    return seen


def assign_roles(links: DataFrame, role_types: DataFrame) -> DataFrame:
    """(role, node, confidence, depth, path) of every node below a role's types.

    `links`: (child, parent, rank 1 to 3, ord); `role_types`: (role, type). The weakest link decides; then the shortest
    path, then the better parent, its name and the edge's order. A node keeps its best label, from the strongest tier down.
    """
    best = cut_lineage(role_types.select("role", F.col("type").alias("node"), F.lit(4).alias("rank"), F.lit(0).alias("depth"), F.array("type").alias("path")))
    ranks = {r.rank for r in links.select("rank").distinct().collect()}  # three at most
    for tier in sorted(ranks, reverse=True):
        front = best  # then only what has changed: the rest was tried before
        while True:
            c = front.alias("b").join(links.alias("l"), F.col("b.node") == F.col("l.parent")).filter(F.least("b.rank", "l.rank") == tier)
            c = c.filter(~F.array_contains("b.path", F.col("l.child"))).select(
                "b.role", F.col("l.child").alias("node"), F.struct(
                    (F.col("b.depth") + 1).alias("depth"), (-F.col("b.rank")).alias("n"), F.col("l.parent").alias("p"), F.col("l.ord").alias("o"),
                    F.concat("b.path", F.array("l.child")).alias("path")).alias("x"))
            c = c.groupBy("role", "node").agg(F.min("x").alias("x")).select("role", "node", F.lit(tier).alias("rank"), "x.depth", "x.path")
            old = best.alias("o")
            better = c.alias("c").join(old, ["role", "node"], "left").filter(
                F.col("o.rank").isNull() | (F.col("o.rank") < tier) | ((F.col("o.rank") == tier) & (F.col("o.depth") > F.col("c.depth")))).select("role", "node", "c.rank", "c.depth", "c.path")
            better = cut_lineage(better)
            if better.isEmpty():
                break
            best = cut_lineage(best.join(better, ["role", "node"], "left_anti").unionByName(better))
            front = better
    return best.filter("depth > 0").select("role", "node", F.col("rank").alias("confidence"), "depth", "path")


def chain_text(closure: DataFrame, arrow: str = " → ") -> DataFrame:
    """(node, chain): a node and its ancestors by depth; for hierarchies with one parent each."""
    return closure.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("depth", "ancestor"))).alias("a")).select(
        "node", F.concat_ws(arrow, F.concat(F.array("node"), F.transform("a", lambda x: x["ancestor"]))).alias("chain"))


def adjacency(edges: DataFrame) -> DataFrame:
    """Edges (src, dst, kind, via, line, rank) with their place `ord` among their source's; self-loops go."""
    kind = F.array_position(F.array(*map(F.lit, KIND_ORDER)), F.col("kind"))
    w = Window.partitionBy("src").orderBy(kind, "dst", F.col("line").asc_nulls_first(), F.col("via").asc_nulls_first(), F.desc("rank"))
    return edges.filter("src <> dst").withColumn("ord", F.row_number().over(w))


def search_paths(edges: DataFrame, entries: DataFrame, targets: DataFrame, max_depth: int = 6, per_target: int = 3, total: int = 30, expansions: int = 3) -> DataFrame:
    """Simple paths (entry, target, length, confidence, nodes, n) from each entry to targets, breadth first.

    A target ends its path; a node expands `expansions` times at most for an entry; paths of one vertex sequence count
    once; `per_target` for each target and `total` for each entry. Order: length, confidence, target, nodes.
    """
    adj = cut_lineage(adjacency(edges).select("src", "dst", "ord", "rank"))
    front = entries.select("entry", F.col("entry").alias("node"), F.array("entry").alias("nodes"), F.expr("cast(array() as array<int>)").alias("rv"), F.lit(3).alias("rank"))
    goal = targets.select(F.col("target").alias("node")).distinct()
    hits = used = None
    for depth in range(max_depth + 1):
        if depth:
            hit = front.join(goal, "node", "left_semi")
            hits = hit if hits is None else hits.unionByName(hit)
            front = front.join(goal, "node", "left_anti")
        if depth == max_depth:
            break
        n = F.row_number().over(Window.partitionBy("entry", "node").orderBy("rv"))
        ranked = front.withColumn("n", n)
        if used is not None:
            ranked = ranked.join(used, ["entry", "node"], "left").withColumn("n", F.col("n") + F.coalesce("m", F.lit(0))).drop("m")
        counts = front.groupBy("entry", "node").agg(F.count("*").alias("m"))
        used = cut_lineage(counts if used is None else used.unionByName(counts).groupBy("entry", "node").agg(F.sum("m").alias("m")))
        nxt = ranked.filter(F.col("n") <= expansions).alias("f").join(adj.alias("a"), F.col("f.node") == F.col("a.src")).filter(
            ~F.array_contains("f.nodes", F.col("a.dst"))).select(
            "entry", F.col("a.dst").alias("node"), F.concat("nodes", F.array("a.dst")).alias("nodes"), F.concat("rv", F.array("a.ord")).alias("rv"), F.least("f.rank", "a.rank").alias("rank"))
        front = cut_lineage(nxt)
        if front.isEmpty():
            break
    if hits is None:  # no entry has an edge
        hits = front.limit(0)
    first = Window.partitionBy("entry", "nodes").orderBy("rv")
    order = [F.size("rv"), F.col("rv")]
    hits = hits.withColumn("k", F.row_number().over(first)).filter("k = 1")
    hits = hits.withColumn("k", F.row_number().over(Window.partitionBy("entry", "node").orderBy(*order))).filter(F.col("k") <= per_target)
    hits = hits.withColumn("k", F.row_number().over(Window.partitionBy("entry").orderBy(*order))).filter(F.col("k") <= total)
    last = Window.partitionBy("entry").orderBy(F.size("rv"), F.desc("rank"), "node", "nodes")
    return hits.select("entry", F.col("node").alias("target"), F.size("rv").alias("length"), F.col("rank").alias("confidence"), "nodes", F.row_number().over(last).alias("n"))


def neighbourhood(edges: DataFrame, start: DataFrame, depth: int, cap: int = 300) -> tuple[DataFrame, DataFrame]:
    """(nodes with depth, induced edges) around the start nodes (node), both directions; `cap` nodes by depth and name."""
    both = edges.select(F.col("src").alias("x"), F.col("dst").alias("y")).unionByName(edges.select(F.col("dst").alias("x"), F.col("src").alias("y"))).distinct()
    seen = start.select("node", F.lit(0).alias("depth"))
    for d in range(1, min(max(depth, 1), 3) + 1):
        step = seen.filter(F.col("depth") == d - 1).join(both, F.col("node") == F.col("x")).select(F.col("y").alias("node")).distinct()
        seen = cut_lineage(seen.unionByName(step.join(seen, "node", "left_anti").withColumn("depth", F.lit(d))))
    nodes = seen.orderBy("depth", "node").limit(cap)
    inside = edges.join(nodes.select(F.col("node").alias("src")), "src", "left_semi").join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi")
    return nodes, inside


def degrees(edges: DataFrame) -> DataFrame:
    """(node, degree): edges in and out."""
    return edges.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))


def group_links(edges: DataFrame, group_of: DataFrame) -> DataFrame:
    """(a, b, links) between different groups; `group_of`: (node, grp)."""
    g = lambda x, y: group_of.select(F.col("node").alias(x), F.col("grp").alias(y))
    return edges.join(g("src", "a"), "src").join(g("dst", "b"), "dst").filter("a <> b").groupBy("a", "b").agg(F.count("*").alias("links"))
