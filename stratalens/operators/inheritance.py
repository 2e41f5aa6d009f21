"""Inheritance edges from declarations: every written super type is resolved by prioritised candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import framework as data


def candidates(refs: DataFrame, declarations: DataFrame, imports: DataFrame) -> DataFrame:
    """(owner, name, priority, target, known) of each distinct (owner, name)."""
    types = declarations.select("id", "package", "path").dropDuplicates(["id"])
    asked = refs.select("owner", "name").distinct().join(types.select(F.col("id").alias("owner"), "package", "path"), "owner")
    parts = F.split("owner", r"\.")
    depth = F.when(F.col("package") == "", 0).otherwise(F.size(F.split("package", r"\.")))
    # 1: member types of the enclosing classes, innermost first
    scopes = asked.select("owner", "name", F.posexplode(F.transform(F.sequence(F.size(parts), depth + 1, F.lit(-1)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))).alias("i", "scope"))
    lexical = scopes.select("owner", "name", F.col("i").alias("priority"), F.concat("scope", F.lit("."), "name").alias("target"), F.lit(True).alias("must"))
    first, rest = F.substring_index("name", ".", 1), F.expr("substring(name, length(substring_index(name, '.', 1)) + 1)")
    plain = imports.filter("not wildcard").select("path", F.col("simple").alias("s"), "fqn")
    explicit = asked.withColumn("s", first).join(plain, ["path", "s"]).select("owner", "name", F.lit(100).alias("priority"), F.concat("fqn", rest).alias("target"), F.lit(False).alias("must"))
    package = asked.select("owner", "name", F.lit(101).alias("priority"), F.when(F.col("package") == "", F.col("name")).otherwise(F.concat_ws(".", "package", "name")).alias("target"), F.lit(True).alias("must"))
    full = asked.filter(F.contains("name", F.lit("."))).select("owner", "name", F.lit(102).alias("priority"), F.col("name").alias("target"), F.lit(True).alias("must"))
    star = asked.join(imports.filter("wildcard").select("path", "fqn"), "path").select("owner", "name", F.lit(103).alias("priority"), F.concat_ws(".", "fqn", "name").alias("target"), F.lit(True).alias("must"))
    outside = asked.filter(F.col("name").rlike(r"^[a-z][\w$]*\.")).select("owner", "name", F.lit(105).alias("priority"), F.col("name").alias("target"), F.lit(False).alias("must"))
    spark = refs.sparkSession
    # simple names of java.lang count as if imported by a wildcard; a framework type, if one wildcard import alone can mean it
    names = F.broadcast(spark.createDataFrame([(n,) for n in data.JAVA_LANG.split()], "name string"))
    implied = asked.join(names, "name").select("owner", "name", F.lit(103).alias("priority"), F.concat(F.lit("java.lang."), "name").alias("target"), F.lit(False).alias("must"))
    given = F.broadcast(spark.createDataFrame([(x.split("|")[0].strip(),) for x in data.FRAMEWORK.strip().splitlines()], "target string"))
    only = star.join(given, "target", "left_semi").select("owner", "name", F.lit(104).alias("priority"), "target", F.lit(False).alias("must"))
    star = star.unionByName(implied).unionByName(only)
    every = lexical.unionByName(explicit).unionByName(package).unionByName(full).unionByName(star).unionByName(outside)
    known = types.select(F.col("id").alias("target"), F.lit(True).alias("known"))
    return every.join(known, "target", "left").filter(F.col("known") | ~F.col("must")).select("owner", "name", "priority", "target", F.coalesce("known", F.lit(False)).alias("known"))


def resolved(refs: DataFrame, declarations: DataFrame, imports: DataFrame) -> DataFrame:
    """(owner, name, target, status, candidates): resolved, external, ambiguous (with its candidates) or unresolved."""
    c = candidates(refs, declarations, imports)
    least = c.groupBy("owner", "name", "priority").agg(F.min("target").alias("target"), F.count_distinct("target").alias("n"), F.min("known").alias("known"), F.sort_array(F.collect_set("target")).alias("every"))
    best = least.groupBy("owner", "name").agg(F.min(F.struct("priority", "target", "n", "known", "every")).alias("b"))
    return refs.select("owner", "name").distinct().join(best, ["owner", "name"], "left").select(
        "owner", "name", F.when(F.col("b.n") == 1, F.col("b.target")).alias("target"),
        F.when(F.col("b").isNull(), "unresolved").when(F.col("b.n") > 1, "ambiguous").when(F.col("b.known"), "resolved").otherwise("external").alias("status"),
        F.when(F.col("b.n") > 1, F.col("b.every")).otherwise(F.expr("cast(array() as array<string>)")).alias("candidates"))


def edges(refs: DataFrame, declarations: DataFrame, imports: DataFrame) -> DataFrame:
    """(source, target, kind, reference, resolution, candidates, ord); an unknown target stays apart for each owner."""
    j = refs.join(resolved(refs, declarations, imports), ["owner", "name"])
    return j.select(F.col("owner").alias("source"), F.coalesce("target", F.concat(F.lit("?"), "owner", F.lit("::"), "name")).alias("target"), "kind", F.col("name").alias("reference"), F.col("status").alias("resolution"), "candidates", "ord")


def uses(facts: DataFrame, declarations: DataFrame, imports: DataFrame) -> DataFrame:
    """(source, target, line) of the project's types that a class refers to, by `uses` facts; not itself. Names that resolve
    to one target give its first line."""
    first = facts.filter("kind = 'uses'").groupBy("owner", "name").agg(F.min("line").alias("line"))
    known = resolved(first, declarations, imports).filter("status = 'resolved' and target <> owner")
    return first.join(known, ["owner", "name"]).groupBy(F.col("owner").alias("source"), "target").agg(F.min("line").alias("line"))
