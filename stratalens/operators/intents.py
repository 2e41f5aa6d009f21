"""Intent edges between classes, the reasons of those that lead nowhere, and the graph that paths walk.

An intent fact has (ord, source, line, via, traced, target_type, target_name, action): what the sender's method tells of
the intent it hands over. `target_type` is a class literal, `target_name` the text of a class name; `traced` is false where
the intent's value could not be followed. A class literal counts before a name, a name before an action.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Unresolved intents that a report lists.
LISTED = 50


def normalised_class(name: Column, package: Column) -> Column:
    """Id of a class from its written name: a leading dot belongs to the package, a dollar sign is a dot."""
    return F.translate(F.when(name.startswith("."), F.concat(package, name)).otherwise(name), "$", ".")


def decided(facts: DataFrame, classes: DataFrame, declared: DataFrame, package: str) -> DataFrame:
    """The facts with `target`, `confidence` (3 or 2) and `reason`; one row for each class that takes a sent action.

    `classes`: (id); `declared`: (action, class_id) of components linked to a class.
    """
    known = classes.select("id").distinct()
    by_type = known.select(F.col("id").alias("target_type"), F.col("id").alias("of_type"))
    by_name = known.select(F.col("id").alias("_name"), F.col("id").alias("of_name"))
    receivers = declared.filter("class_id is not null").select("action", F.col("class_id").alias("of_action")).distinct()
    asks = F.col("target_type").isNull() & F.col("target_name").isNull() & F.col("traced")
    j = (facts.withColumn("_name", normalised_class(F.col("target_name"), F.lit(package)))
         .join(by_type, "target_type", "left").join(by_name, "_name", "left").drop("_name")
         .withColumn("_action", F.when(asks, F.col("action")))
         .join(receivers.withColumnRenamed("action", "_action"), "_action", "left").drop("_action"))
    target = (F.when(~F.col("traced"), F.lit(None)).when(F.col("target_type").isNotNull(), F.col("of_type"))
              .when(F.col("target_name").isNotNull(), F.col("of_name")).otherwise(F.col("of_action")))
    reason = (F.when(~F.col("traced"), "not traceable")
              .when(F.col("target_type").isNotNull(), F.when(F.col("of_type").isNull(), "target class not in the sources"))
              .when(F.col("target_name").isNotNull(), F.when(F.col("of_name").isNull(), "class name not resolved"))
              .when(F.col("action").isNull(), "without target or action")
              .when(F.col("of_action").isNull(), "no intent-filter declares this action"))
    return j.withColumn("target", target).withColumn("reason", reason).withColumn(
        "confidence", F.when(F.col("target").isNull(), F.lit(None)).when(F.col("target_type").isNotNull(), 3).otherwise(2)).drop("of_type", "of_name", "of_action")


def intent_edges(rows: DataFrame) -> DataFrame:
    """(source, target, kind, via, line, confidence, action) of decided facts, each once, the first fact's."""
    action = F.when(F.col("target_type").isNull() & F.col("target_name").isNull(), F.col("action"))
    kind = F.when(action.isNotNull(), "sends_action").otherwise("launches")
    found = rows.filter("target is not null").select("ord", "source", "target", kind.alias("kind"), "via", "line", "confidence", action.alias("action"))
    first = Window.partitionBy("source", "target", "kind", "via", "line", "action").orderBy("ord")
    return found.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n", "ord")


def receiver_edges(registrations: DataFrame, resolved: DataFrame) -> DataFrame:
    """registers_receiver edges of (source, line, via, name, exact); `resolved`: (owner, name, target, status)."""
    at = resolved.filter("status = 'resolved'").select(F.col("owner").alias("source"), "name", "target")
    return registrations.join(at, ["source", "name"]).select(
        "source", "target", F.lit("registers_receiver").alias("kind"), "via", "line", F.when(F.col("exact"), 3).otherwise(2).alias("confidence"), F.lit(None).cast("string").alias("action")).distinct()


def unresolved(rows: DataFrame, listed: int = LISTED) -> DataFrame:
    """(source, line, via, reason, total) of each source's first unresolved intents, with the number of all of them."""
    found = rows.filter("reason is not null").select("source", "line", "via", "reason")
    order = Window.partitionBy("source").orderBy("line", "via", "reason")
    return found.withColumn("total", F.count("*").over(Window.partitionBy("source"))).withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= listed).drop("_n")


def flow_graph(intents: DataFrame, uses: DataFrame, inheritance: DataFrame | None = None) -> DataFrame:
    """(src, dst, kind, via, line, rank): intent edges, resolved uses (source, target, line) and, if given, resolved parents."""
    out = intents.select(F.col("source").alias("src"), F.col("target").alias("dst"), "kind", "via", "line", F.col("confidence").alias("rank"))
    plain = lambda df, kind, line: df.select(
        F.col("source").alias("src"), F.col("target").alias("dst"), F.lit(kind).alias("kind"), F.lit(kind).alias("via"), line.alias("line"), F.lit(3).alias("rank"))
    out = out.unionByName(plain(uses.filter("source <> target"), "uses", F.col("line")))
    if inheritance is not None:
        parents = inheritance.filter("kind = 'extends' and resolution = 'resolved'")
        out = out.unionByName(plain(parents, "extends", F.lit(None).cast("int")))
    return out


def entry_points(components: DataFrame) -> DataFrame:
    """(entry, reasons) of components (class_id, type, exported, guess, links): exported, perhaps exported, or opened by a link."""
    reasons = F.array_compact(F.array(
        F.when(F.col("exported") == "true", "exported"),
        F.when((F.col("exported") != "true") & F.col("guess"), "perhaps exported"),
        F.when(F.col("links") > 0, "deep link"),
        F.when(F.col("type") == "application", "application")))
    each = components.filter("class_id is not null").select(F.col("class_id").alias("entry"), F.explode(reasons).alias("reason"))
    return each.groupBy("entry").agg(F.array_join(F.sort_array(F.collect_set("reason")), ", ").alias("reasons"))
