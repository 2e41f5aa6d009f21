"""Overviews and filters: the stats row, lists of findings and classes, exposure predicates, and views of the graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..session import cut_lineage

#: Findings in a list, and nodes in a view.
LISTED = 500
DRAWN = 600


def stats(nodes: DataFrame, edges: DataFrame, findings: DataFrame, components: DataFrame) -> DataFrame:
    """One row of counts. Nodes: id, package, kind, external, resolution, original_name, partial, path."""
    own = ~F.col("external")
    n = nodes.agg(
        F.count_if(own).alias("types"), F.count_if("external").alias("external_types"), F.count_distinct(F.when(own, F.col("package"))).alias("packages"),
        F.count_distinct("path").alias("files"), F.count_if(own & (F.col("kind") == "interface")).alias("interfaces"), F.count_if(own & F.col("original_name").isNotNull()).alias("renamed"),
        F.count_if(own & F.col("partial")).alias("partial"), F.count_if(F.col("resolution") == "ambiguous").alias("ambiguous"), F.count_if(F.col("resolution") == "unresolved").alias("unresolved"))
    e = edges.agg(F.count("*").alias("relations"), F.count_if(F.col("kind") == "extends").alias("extends"), F.count_if(F.col("kind") == "implements").alias("implements"))
    f = findings.agg(F.count("*").alias("findings"), *[F.count_if(F.col("severity") == s).alias(s) for s in S.SEVERITIES])
    c = components.agg(F.count("*").alias("components"), F.count_if(F.col("exported") == "true").alias("exported"), F.count_if(exposed(F.col("exposure"))).alias("exposed"),
                       F.coalesce(F.sum(F.size("deep_links")), F.lit(0)).alias("deep_links"))
    return n.crossJoin(F.broadcast(e)).crossJoin(F.broadcast(f)).crossJoin(F.broadcast(c))  # one row each


def obfuscation(names: DataFrame, name: str, renamed: Column) -> DataFrame:
    """(share, level): classes with a name of up to 2 characters after the last `$`, or renamed."""
    short = F.length(F.element_at(F.split(name, r"\$"), -1)) <= 2
    share = F.round(F.avg((short | renamed).cast("int")), 3)
    return names.agg(share.alias("share")).withColumn("level", S.estimate_level(F.col("share")))


def exposed(exposure: Column) -> Column:
    """Open to other applications, surely or perhaps."""
    return exposure < 6


def potential(exposure: Column) -> Column:
    """Exposed only if a guess holds."""
    return exposure.between(3, 5)


def listed_findings(findings: DataFrame, severity: str = "info", confidence: str = "low", category: str | None = None, cap: int = LISTED) -> DataFrame:
    """Findings of at least that severity and confidence, the most severe first; `cap` of them, which is the list's length."""
    rank = S.rank_of(F.col("severity"), S.SEVERITIES)
    found = findings.filter((rank >= S.SEVERITIES.index(severity)) & (S.rank_of(F.col("confidence"), S.CONFIDENCES) >= S.CONFIDENCES.index(confidence)))
    if category:
        found = found.filter(F.col("category") == category)
    return found.orderBy(rank.desc(), "class_id", "line", "rule").limit(cap)


def listed_classes(nodes: DataFrame, text: str = "", kind: str | None = None, role: str | None = None, library: bool | None = None, size: int = 200) -> DataFrame:
    """Nodes with the text in id, path, original name or alias, with their page within their package."""
    if text:
        nodes = nodes.filter(F.contains(F.lower(F.concat_ws("\n", "id", "path", "original_name", "alias")), F.lit(text.lower())))
    if kind:
        nodes = nodes.filter(F.col("kind") == kind)
    if role:
        nodes = nodes.filter(F.array_contains("roles", role))
    if library is not None:
        nodes = nodes.filter(F.col("library") == library)
    n = F.row_number().over(Window.partitionBy("package").orderBy("id"))
    return nodes.withColumn("page", F.floor((n - 1) / size).cast("int"))


def root_class(edges: DataFrame) -> DataFrame:
    """(node, root): the top of each node's chain of `extends` edges (src, dst); of several parents the first by name. A cycle ends before it repeats."""
    up = cut_lineage(edges.filter("src <> dst").groupBy("src").agg(F.min("dst").alias("dst")))
    now, done = up.select(F.col("src").alias("node"), F.col("dst").alias("root"), F.array("src", "dst").alias("seen")), None
    while True:
        step = now.join(up, now["root"] == up["src"], "left").select("node", "root", "seen", F.when(~F.array_contains("seen", F.col("dst")), F.col("dst")).alias("dst"))
        step = cut_lineage(step)
        ended = step.filter("dst is null").select("node", "root")
        done = ended if done is None else done.unionByName(ended)
        now = step.filter("dst is not null").select("node", F.col("dst").alias("root"), F.concat("seen", F.array("dst")).alias("seen"))
        if now.isEmpty():
            return done


def focus(edges: DataFrame, start: DataFrame, direction: str = "both", depth: int | None = None, cap: int = DRAWN) -> DataFrame:
    """(node, depth, degree) around the start nodes (node), towards parents, children or both; of more than `cap` nodes
    those of the largest degree, the start nodes first: a view draws no more."""
    parts = {"parents": [("src", "dst")], "children": [("dst", "src")], "both": [("src", "dst"), ("dst", "src")]}[direction]
    hops = None
    for a, b in parts:
        h = edges.select(F.col(a).alias("x"), F.col(b).alias("y"))
        hops = h if hops is None else hops.unionByName(h)
    hops = cut_lineage(hops.distinct())
    seen, d = cut_lineage(start.select("node", F.lit(0).alias("depth")).distinct()), 0
    while depth is None or d < depth:
        d += 1
        step = seen.filter(F.col("depth") == d - 1).join(hops, F.col("node") == F.col("x")).select(F.col("y").alias("node")).distinct()
        new = cut_lineage(step.join(seen, "node", "left_anti").withColumn("depth", F.lit(d)))
        if new.isEmpty():
            break
        seen = cut_lineage(seen.unionByName(new))
    degree = edges.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
    return seen.join(degree, "node", "left").fillna(0, ["degree"]).orderBy((F.col("depth") > 0).cast("int"), F.desc("degree"), "node").limit(cap)


def uses(edges: DataFrame, node: str, cap: int = 200) -> tuple[DataFrame, DataFrame]:
    """(out, in): the references (src, dst, ord) of a node in their order, and those to it by name; a page of each."""
    return edges.filter(F.col("src") == node).orderBy("ord").limit(cap), edges.filter(F.col("dst") == node).orderBy("src").limit(cap)


def presence(old: DataFrame, new: DataFrame) -> DataFrame:
    """(project, change): manifests that only one version has."""
    a, b = old.select("project", F.lit(True).alias("a")).distinct(), new.select("project", F.lit(True).alias("b")).distinct()
    both = a.join(b, "project", "full")
    return both.filter("a is null or b is null").select("project", F.when(F.col("a").isNull(), "added").otherwise("removed").alias("change"))


def flag_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(project, flag, old, new, highlight) of flags (project, flag, value) that differ; highlighted if one became true."""
    j = old.select("project", "flag", F.col("value").alias("old")).join(new.select("project", "flag", F.col("value").alias("new")), ["project", "flag"])
    return j.filter("not (old <=> new)").withColumn("highlight", (F.col("new") == "true").eqNullSafe(True))


def chain_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(node, old, new) of chains (node, chain) that differ, for nodes of both versions."""
    j = old.select("node", F.col("chain").alias("old")).join(new.select("node", F.col("chain").alias("new")), "node")
    return j.filter("old <> new")
