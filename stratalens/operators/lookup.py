"""Lists, searches, library marks, name resolution and anonymous names."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def page(rows: DataFrame, key: str, number: int, size: int) -> DataFrame:
    """One page by key, with the total of all rows."""
    size = min(max(size, 1), 1000)
    total = rows.agg(F.count("*").alias("total"))  # one row
    return rows.orderBy(key).offset(max(number, 0) * size).limit(size).crossJoin(F.broadcast(total))


def best_field(rows: DataFrame, key: str, fields: list[str], query: str) -> DataFrame:
    """(key, field, priority, text): for each row the first of `fields` that holds the query, in any case."""
    q = query.lower()
    items = F.array(*[F.struct(F.lit(i).alias("priority"), F.lit(f).alias("field"), F.substring(F.col(f), 1, 160).alias("text"), F.contains(F.lower(F.col(f)), F.lit(q)).alias("hit")) for i, f in enumerate(fields)])
    first = F.get(F.filter(items, lambda x: F.coalesce(x["hit"], F.lit(False))), 0)
    return rows.select(key, first.alias("x")).filter("x is not null").select(key, "x.field", "x.priority", "x.text")


def mark_libraries(rows: DataFrame, name: str, prefixes: DataFrame, own: str | None = None) -> DataFrame:
    """Rows with `library`: whether the name begins with a prefix and not with the own package's.

    Prefixes end at a dot, so that a name can match only one of its own leading parts: an equi-join, not a scan of pairs.
    """
    parts = F.split("_n", r"\.")
    leads = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat(F.array_join(F.slice(parts, F.lit(1), i), "."), F.lit(".")))
    hit = rows.select(F.col(name).alias("_n")).distinct().select("_n", F.explode(leads).alias("prefix")).join(prefixes, "prefix", "left_semi").select("_n").distinct()
    if own:
        hit = hit.filter(~F.col("_n").startswith(own))
    return rows.join(hit.withColumn("_l", F.lit(True)), F.col(name) == F.col("_n"), "left").withColumn("library", F.coalesce("_l", F.lit(False))).drop("_n", "_l")


def resolve(wanted: DataFrame, candidates: DataFrame) -> DataFrame:
    """(name, target, status): the candidates (name, priority, target) of least priority; several distinct ones are ambiguous."""
    least = candidates.groupBy("name", "priority").agg(F.min("target").alias("target"), F.count_distinct("target").alias("n"))
    best = least.groupBy("name").agg(F.min(F.struct("priority", "target", "n")).alias("b"))
    return wanted.join(best, "name", "left").select(
        "name", F.when(F.col("b.n") == 1, F.col("b.target")).alias("target"), F.when(F.col("b").isNull(), "unresolved").when(F.col("b.n") == 1, "resolved").otherwise("ambiguous").alias("status"))


def ranked(rows: DataFrame, order: list[str], name: str = "number") -> DataFrame:
    """`rows` with their place from 1: ranges are sorted apart, and a range's start is the sum of the counts before it (one row a range)."""
    sorted_ = cut_lineage(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id()))
    part, place = F.shiftright("_m", 33).alias("_part"), F.col("_m").bitwiseAND((1 << 33) - 1)
    counts = sorted_.groupBy(part).agg(F.count("*").alias("_c"))
    starts = counts.withColumn("_before", F.coalesce(F.sum("_c").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_c")
    return sorted_.withColumn("_part", part).join(F.broadcast(starts), "_part").withColumn(name, place + F.col("_before") + 1).drop("_m", "_part", "_before")


def numbered(names: DataFrame, name: str, prefix: str, width: int, by: list[str] | None = None) -> DataFrame:
    """(by, name, alias): sorted distinct names with numbered aliases, within `by`."""
    keys = by or []
    found = names.select(*keys, name).distinct()
    if keys:
        found = found.withColumn("number", F.row_number().over(Window.partitionBy(*keys).orderBy(name)))
    else:
        found = ranked(found, [name])
    return found.select(*keys, name, F.concat(F.lit(prefix), F.lpad(F.col("number").cast("string"), width, "0")).alias("alias"))
