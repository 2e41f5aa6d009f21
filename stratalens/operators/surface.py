"""Effective export, exposure and deep links of declared components, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Most deep links of one component.
MAX_LINKS = 50
LEVEL_RANK = {"unknown": 1, "normal": 2, "dangerous": 3}


def qualified(name: Column, package: Column) -> Column:
    """Full name of a declared one: a leading dot or a bare name belongs to the package."""
    return F.when(name.startswith("."), F.concat(package, name)).when(~F.contains(name, F.lit(".")), F.concat(package, F.lit("."), name)).otherwise(name)


def class_id(name: Column) -> Column:
    return F.translate(name, "$", ".")


def tri_state(attribute: Column, default_value: Column, any_true: Column, agree: Column) -> tuple[Column, Column]:
    """(state, guess) of a flag: true, false, or unknown with a guess from the resource's variants.

    `default_value`: of the default variant (null if none); `any_true`, `agree`: over all variants.
    """
    state = F.when(attribute.isin("true", "false"), attribute).when(attribute.isNotNull(), "unknown")
    guess = F.when(default_value.isNotNull() & agree, default_value).when(any_true.isNotNull(), any_true)
    return state, guess


def effective_export(kind: Column, attribute: Column, counted_filters: Column, target_sdk: Column, min_sdk: Column, resource_guess: Column) -> Column:
    """struct(exported, guess, reason, confidence); the first fitting row of the decision table counts."""
    sdk = F.coalesce(target_sdk, min_sdk, F.lit(1))
    implied = counted_filters > 0
    provider = kind == "provider"
    sure = F.when(target_sdk.isNotNull(), "high").otherwise("medium")
    none = F.lit(None).cast("boolean")
    row = lambda e, g, r, c: F.struct(e.alias("exported"), g.alias("guess"), F.lit(r).alias("reason"), c.alias("confidence"))
    text = lambda b: F.when(b, "true").otherwise("false")
    implicit = F.when(provider, sdk < 17).otherwise(implied)
    return (
        F.when(attribute.isin("true", "false"), row(attribute, none, "explicit", F.lit("high")))
        .when(attribute.isNotNull(), row(F.lit("unknown"), F.coalesce(resource_guess, implicit), "resource", F.lit("low")))
        .when(provider, row(text(sdk < 17), none, "provider default", sure))
        .when(implied & (sdk >= 31), row(F.lit("inconsistent"), F.when(min_sdk < 31, True), "filter without attribute", F.lit("low")))
        .otherwise(row(text(implied), none, "filters", sure))
    )


def level_rank(permission: Column, level: Column) -> Column:
    """0 without a permission, then unknown, normal, dangerous; 9 for those bound to a signature."""
    out = F.lit(1)
    for name, r in LEVEL_RANK.items():
        out = F.when(level == name, r).otherwise(out)
    return F.when(permission.isNull(), 0).when(level.rlike("signature|privileged|knownSigner"), 9).otherwise(out)


def weakest_side(read: Column, write: Column, shared: Column, rank: dict[str, Column]) -> Column:
    """Least rank of a provider's two sides, each falling back on the shared permission."""
    side = lambda p, name: F.when(p.isNotNull(), rank[name]).when(shared.isNotNull(), rank["shared"]).otherwise(0)
    return F.least(side(read, "read"), side(write, "write"))


def exposure(exported: Column, guess: Column, rank: Column, enabled: Column) -> Column:
    """0 (open) to 7 (not exported); 3 more if only a guess, 10 more if disabled."""
    unsure = exported.isin("unknown", "inconsistent")
    effective = F.when(unsure, F.coalesce(guess, F.lit(False))).otherwise(exported == "true")
    open_ = F.when(rank == 0, 0).when(rank < 9, 1).otherwise(2) + F.when(unsure, 3).otherwise(0)
    return F.when(effective, open_).when(unsure, 6).otherwise(7) + F.when(enabled == "false", 10).otherwise(0)


def deep_links(parts: DataFrame, keys: list[str], cap: int = MAX_LINKS) -> DataFrame:
    """Product of (keys, schemes, hosts, paths), each an array; uri text, numbered, at most `cap` for each key."""
    or_none = lambda c: F.when(F.size(c) > 0, F.col(c)).otherwise(F.array(F.lit(None).cast("string")))
    each = parts.select(*keys, F.explode("schemes").alias("scheme"), "hosts", "paths").withColumn("host", F.explode(or_none("hosts"))).withColumn("path", F.explode(or_none("paths")))
    uri = F.when(F.col("host").isNull() & F.col("path").isNull(), F.concat("scheme", F.lit(":"))).otherwise(
        F.concat("scheme", F.lit("://"), F.coalesce("host", F.lit("*")), F.coalesce("path", F.lit(""))))
    n = F.row_number().over(Window.partitionBy(*keys).orderBy("scheme", F.col("host").asc_nulls_first(), F.col("path").asc_nulls_first()))
    return each.select(*keys, uri.alias("uri"), n.alias("n")).filter(F.col("n") <= cap)
