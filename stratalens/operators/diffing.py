"""Differences of two versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Strings in a fingerprint: the first ones by name.
STRINGS = 200
_SHAPE = ["kind", "abstract", "roles", "external_parents", "strings", "findings"]


def added_removed(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, change) of the keys that only one side has."""
    o, n = old.select(key).distinct(), new.select(key).distinct()
    return n.join(o, key, "left_anti").withColumn("change", F.lit("added")).unionByName(o.join(n, key, "left_anti").withColumn("change", F.lit("removed")))


def field_changes(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, old, new) of the fields that differ, null-safe."""
    j = old.select(key, *[F.col(f).cast("string").alias(f"o_{f}") for f in fields]).join(new.select(key, *[F.col(f).cast("string").alias(f"n_{f}") for f in fields]), key)
    items = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"o_{f}").alias("old"), F.col(f"n_{f}").alias("new")) for f in fields])
    return j.select(key, F.inline(items)).filter("not (old <=> new)")


def multiset_difference(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, added, removed): how many more rows of an identity one side has."""
    side = lambda df, n: df.groupBy(*keys).agg(F.count("*").alias(n))
    j = side(old, "o").join(side(new, "n"), keys, "full").fillna(0, ["o", "n"])
    return j.select(*keys, F.greatest(F.col("n") - F.col("o"), F.lit(0)).alias("added"), F.greatest(F.col("o") - F.col("n"), F.lit(0)).alias("removed")).filter("added + removed > 0")


def rename_pairs(old: DataFrame, new: DataFrame, key: str, shape: list[str]) -> DataFrame:
    """(old_key, new_key) of keys that vanished and appeared with a shape that is unique on both sides."""
    gone, come = old.join(new, key, "left_anti"), new.join(old, key, "left_anti")
    one = lambda df, name: df.groupBy(*shape).agg(F.min(key).alias(name), F.count("*").alias("c")).filter("c = 1").drop("c")
    return one(gone, "old_key").join(one(come, "new_key"), shape).select("old_key", "new_key")


def triggers(changes: DataFrame, group: str, category: str) -> DataFrame:
    """(group, triggers): sorted distinct categories."""
    return changes.groupBy(group).agg(F.array_join(F.sort_array(F.collect_set(category)), ",").alias("triggers"))


def short_name(name: Column) -> Column:
    """True for names like those that shrinkers give: a simple name of up to 3 characters, or such parts joined by dollar signs."""
    simple = F.substring_index(name, ".", -1)
    return (F.length(simple) <= 3) | simple.rlike(r"^[a-z]{1,3}(\$[a-z0-9]{1,3})*$")


def fingerprints(declarations: DataFrame, edges: DataFrame, roles: DataFrame, findings: DataFrame, strings: DataFrame) -> DataFrame:
    """(id, kind, abstract, roles, external_parents, strings, findings) of each class: what a renaming leaves as it is.

    Parents are those outside the project. `strings`: (id, value). Lists are sorted; a class without any has empty ones.
    """
    own = declarations.dropDuplicates(["id"]).select("id", "kind", "abstract")
    outside = edges.join(own.select(F.col("id").alias("target")), "target", "left_anti").filter("resolution = 'external'")
    listed = lambda df, key, value, name, many=F.collect_list: df.groupBy(F.col(key).alias("id")).agg(F.sort_array(many(value)).alias(name))
    parts = [listed(roles, "node", "role", "roles"), listed(outside, "source", "target", "external_parents"),
             listed(strings, "id", "value", "strings", F.collect_set).withColumn("strings", F.slice("strings", 1, STRINGS)), listed(findings, "class_id", "rule", "findings")]
    for p in parts:
        own = own.join(p, "id", "left")
    return own.withColumns({c: F.coalesce(c, F.expr("cast(array() as array<string>)")) for c in _SHAPE[2:]})


def renamed_classes(old: DataFrame, new: DataFrame, anchors: DataFrame) -> DataFrame:
    """(old_id, new_id, confidence) of classes with short names that vanished and appeared, whose fingerprints are alike and
    unique on both sides; not `anchors` (id), as the manifest names them. Medium with strings, else low; a
    fingerprint without strings, roles and parents proves nothing."""
    telling = (F.size("strings") > 0) | (F.size("roles") > 0) | (F.size("external_parents") > 0)
    side = lambda a, b: a.join(b, "id", "left_anti").join(anchors, "id", "left_anti").filter(short_name(F.col("id")) & telling)
    pairs = rename_pairs(side(old, new), side(new, old), "id", _SHAPE)
    strong = old.select(F.col("id").alias("old_key"), F.when(F.size("strings") > 0, "medium").otherwise("low").alias("confidence"))
    return pairs.join(strong, "old_key").select(F.col("old_key").alias("old_id"), F.col("new_key").alias("new_id"), "confidence")
