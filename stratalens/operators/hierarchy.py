"""The type hierarchy: parent links of project and framework types, ancestors, and roles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from ..sources import framework as data
from .graph import ancestor_closure, assign_roles

LINKS = "child string, parent string, rank int, via string, ord int"


def framework_types(spark: SparkSession) -> DataFrame:
    """(id, kind, parents, source): the fixed table."""
    rows = [[x.strip() for x in line.split("|")] for line in data.FRAMEWORK.strip().splitlines()]
    return spark.createDataFrame([(i, k, a.split() + b.split(), s) for i, k, a, b, s in rows], "id string, kind string, parents array<string>, source string")


def role_types(spark: SparkSession) -> DataFrame:
    """(role, label, type): the types that define a role."""
    rows = [[x.strip() for x in line.split("|")] for line in data.ROLES.strip().splitlines()]
    return spark.createDataFrame([(r, label, t) for r, label, types in rows for t in types.split()], "role string, label string, type string")


def enriched(edges: DataFrame, project: DataFrame) -> DataFrame:
    """(id, kind, source) of the framework types that edges reach and the project does not hold itself."""
    t = framework_types(edges.sparkSession)
    reached = edges.select(F.col("target").alias("id")).distinct()
    return t.join(reached, "id", "left_semi").join(project.select("id"), "id", "left_anti").select("id", "kind", "source")


def parent_links(edges: DataFrame, project: DataFrame) -> DataFrame:
    """(child, parent, rank, via, ord) from edges (source, target, kind, resolution, candidates, ord) and the framework table.

    A known target is high (3); each candidate of an ambiguous one is medium (2) if there are two, else low (1). A
    framework type that the project holds itself keeps its own edges alone.
    """
    sure = edges.filter(F.col("resolution").isin("resolved", "external")).select(F.col("source").alias("child"), F.col("target").alias("parent"), F.lit(3).alias("rank"), F.col("kind").alias("via"), "ord")
    n = F.size("candidates")
    open_ = edges.filter("resolution = 'ambiguous'").select(
        F.col("source").alias("child"), F.explode("candidates").alias("parent"), F.when(n <= 2, 2).otherwise(1).alias("rank"),
        F.concat("kind", F.lit(" (ambiguous: "), n.cast("string"), F.lit(" candidates)")).alias("via"), "ord")
    given = framework_types(edges.sparkSession).join(project.select("id"), "id", "left_anti")
    given = given.select(F.col("id").alias("child"), F.posexplode("parents").alias("ord", "parent"), F.lit(3).alias("rank"), F.concat(F.lit("framework ("), "source", F.lit(")")).alias("via"))
    return sure.unionByName(open_).unionByName(given).select("child", "parent", F.col("rank").cast("int").alias("rank"), "via", F.col("ord").cast("int").alias("ord"))


def ancestors(links: DataFrame) -> DataFrame:
    """(node, ancestors): the set of all that parent links reach, at any confidence."""
    closure = ancestor_closure(links.select(F.col("child").alias("src"), F.col("parent").alias("dst")))
    return closure.groupBy("node").agg(F.collect_set("ancestor").alias("ancestors"))


def chains(links: DataFrame, above: DataFrame) -> DataFrame:
    """(node, ancestors, has_superclass, chain_known): the last is true if a framework class is an ancestor."""
    spark = links.sparkSession
    classes = framework_types(spark).filter("kind <> 'interface'").select(F.col("id").alias("a"))
    known = above.select("node", F.explode("ancestors").alias("a")).join(F.broadcast(classes), "a").select("node").distinct().withColumn("chain_known", F.lit(True))
    super_ = links.filter("via = 'extends' or via like 'extends %'").select(F.col("child").alias("node")).distinct().withColumn("has_superclass", F.lit(True))
    return above.join(known, "node", "left").join(super_, "node", "left").fillna(False, ["chain_known", "has_superclass"])


def roles_of(types: DataFrame, above: DataFrame) -> DataFrame:
    """(type, roles) of the given types (type): the roles that they or their ancestors define."""
    lines = F.concat(F.array("type"), F.coalesce("ancestors", F.expr("cast(array() as array<string>)")))
    each = types.join(above.withColumnRenamed("node", "type"), "type", "left").select("type", F.explode(lines).alias("t"))
    defined = F.broadcast(role_types(types.sparkSession).select("role", F.col("type").alias("t")))
    return each.join(defined, "t").groupBy("type").agg(F.sort_array(F.collect_set("role")).alias("roles"))


def roles_by_short_name(spark: SparkSession) -> DataFrame:
    """(short, roles): of all framework types with that simple name."""
    t = framework_types(spark)
    own = cut_lineage(ancestors(t.select(F.col("id").alias("child"), F.explode("parents").alias("parent"))))
    each = roles_of(t.select(F.col("id").alias("type")), own).select(F.substring_index("type", ".", -1).alias("short"), F.explode("roles").alias("role"))
    return each.groupBy("short").agg(F.sort_array(F.collect_set("role")).alias("roles"))


def project_roles(links: DataFrame, project: DataFrame) -> DataFrame:
    """(role, node, confidence, depth, path) of the project's own types."""
    found = assign_roles(links.select("child", "parent", "rank", "ord"), role_types(links.sparkSession).select("role", "type"))
    return found.join(project.select(F.col("id").alias("node")), "node", "left_semi")
