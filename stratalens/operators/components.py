"""The attack surface: declared components with effective export, permissions, deep links, classes and roles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from . import surface

VIEW, BROWSABLE = "android.intent.action.VIEW", "android.intent.category.BROWSABLE"
PATHS = ("path", "pathPrefix", "pathPattern", "pathSuffix", "pathAdvancedPattern")
#: What a class must be for its declaration.
EXPECTED = {"activity": "activity", "activity-alias": "activity", "service": "service", "receiver": "receiver", "provider": "provider"}


def flag_values(bools: DataFrame) -> DataFrame:
    """(project, name, settled, any_true, any_false): `settled` if the default and all variants agree."""
    fine = F.col("value").isin("true", "false")
    first = F.max(F.when((F.col("qualifier") == "default") & fine, F.col("value") == "true"))
    found = bools.groupBy("project", "name").agg(
        first.alias("d"), F.count_distinct(F.when(fine, F.col("value"))).alias("n"), F.max(F.coalesce(F.col("value") == "true", F.lit(False))).alias("any_true"),
        F.max(F.coalesce(F.col("value") == "false", F.lit(False))).alias("any_false"))
    return found.select("project", "name", F.when(F.col("n") == 1, F.col("d")).alias("settled"), "any_true", "any_false")


def flagged(rows: DataFrame, attribute: str, values: DataFrame, exported: bool = False) -> DataFrame:
    """`rows` with <attribute>_state (true, false, unknown; null if not set) and <attribute>_guess.

    Variants that disagree count as exported for `exported`, and as set only if none is false for any other flag.
    """
    raw = F.col(attribute)
    name = F.when(raw.rlike(r"^@(?:[^/:]*:)?bool/"), F.regexp_replace(raw, "^[^/]*/", ""))
    v = values.select(F.col("project").alias("_p"), F.col("name").alias("_n"), F.coalesce("settled", F.col("any_true") if exported else ~F.col("any_false")).alias(f"{attribute}_guess"))
    state = F.when(raw.isin("true", "false"), raw).when(raw.isNotNull(), "unknown")
    return rows.withColumn("_name", name).join(v, (F.col("project") == F.col("_p")) & (F.col("_name") == F.col("_n")), "left").withColumn(f"{attribute}_state", state).drop("_p", "_n", "_name")


def app_flags(manifests: DataFrame, bools: DataFrame) -> DataFrame:
    """(project, flag, raw, value, guess) of the application's flags."""
    names = ("debuggable", "allowBackup", "usesCleartextTraffic", "testOnly", "enabled")
    each = manifests.select("project", F.explode(F.array(*[F.struct(F.lit(n).alias("flag"), F.col("application")[n].alias("raw")) for n in names])).alias("x")).select("project", "x.flag", "x.raw")
    return flagged(each, "raw", flag_values(bools)).select("project", "flag", "raw", F.col("raw_state").alias("value"), F.col("raw_guess").alias("guess"))


def alerts(flags: DataFrame, manifests: DataFrame) -> DataFrame:
    """(project, flag, certain): flags of an application that are set and open it; an unset backup flag counts as set."""
    on = (F.col("value") == "true") | ((F.col("value") == "unknown") & F.coalesce("guess", F.lit(False)))
    unset = (F.col("flag") == "allowBackup") & F.col("raw").isNull()
    return flags.filter("flag <> 'enabled'").filter(on | unset).select("project", "flag", (F.col("value") == "true").eqNullSafe(True).alias("certain"))


def _deep_links(filters: Column) -> Column:
    """The first links, at most MAX_LINKS: scheme x host x path of each filter that is viewable from a browser."""
    none = F.lit(None).cast("string")
    open_ = F.filter(filters, lambda f: F.array_contains(f["actions"], VIEW) & F.array_contains(f["categories"], BROWSABLE))

    def of(f: Column) -> Column:
        data = f["data"]
        schemes = F.array_sort(F.array_distinct(F.filter(F.transform(data, lambda d: d["scheme"]), lambda x: x.isNotNull())))
        host = lambda d: F.concat(d["host"], F.when(d["port"].isNotNull(), F.concat(F.lit(":"), d["port"])).otherwise(""))
        hosts = F.array_sort(F.array_distinct(F.filter(F.transform(data, host), lambda x: x.isNotNull())))
        kinds = F.flatten(F.transform(data, lambda d: F.filter(F.array(*[F.struct(F.lit(k).alias("kind"), d[k].alias("path")) for k in PATHS]), lambda x: x["path"].isNotNull())))
        hosts = F.when(F.size(hosts) > 0, hosts).otherwise(F.array(none))
        paths = F.when(F.size(kinds) > 0, kinds).otherwise(F.array(F.struct(none.alias("kind"), none.alias("path"))))
        uri = lambda s, h, p: F.when(h.isNull() & p.isNull(), F.concat(s, F.lit(":"))).otherwise(F.concat(s, F.lit("://"), F.coalesce(h, F.lit("*")), F.coalesce(p, F.lit(""))))
        return F.flatten(F.transform(schemes, lambda s: F.flatten(F.transform(hosts, lambda h: F.transform(paths, lambda p: F.struct(
            s.alias("scheme"), h.alias("host"), p["kind"].alias("path_kind"), p["path"].alias("path"), f["auto_verify"].alias("auto_verify"), uri(s, h, p["path"]).alias("uri")))))))

    return F.flatten(F.transform(open_, of))


def components(rows: DataFrame, bools: DataFrame) -> DataFrame:
    """The decided components of `manifest.component_rows`, with their export, permission, level, deep links and exposure."""
    values = flag_values(bools)
    x = flagged(flagged(rows, "exported", values, True), "enabled", values)
    app = F.col("application")
    name = surface.qualified(F.col("name"), F.col("package"))
    target = F.when(F.col("type") == "activity-alias", surface.qualified(F.col("target_activity"), F.col("package")))
    strict = F.col("type").isin("activity", "activity-alias", "receiver")
    counted = F.when(strict, F.size(F.filter("filters", lambda f: F.size(f["actions"]) > 0))).otherwise(F.size("filters"))
    export = surface.effective_export(F.col("type"), F.col("exported"), counted, F.col("target_sdk"), F.col("min_sdk"), F.col("exported_guess"))
    enabled = F.when(app["enabled"] == "false", "false").otherwise(F.coalesce("enabled_state", F.lit("true")))
    provider = F.col("type") == "provider"
    own, shared = F.col("permission"), app["permission"]
    read, write = F.coalesce("read_permission", own, shared), F.coalesce("write_permission", own, shared)
    level_of = lambda p: F.when(p.isNotNull(), F.coalesce(F.col("levels")[p], F.lit("unknown")))
    rank = lambda p: surface.level_rank(p, level_of(p))
    both = read.isNotNull() & write.isNotNull()
    inherited = F.when(F.col("type") != "activity-alias", shared)
    permission = F.when(provider, F.when(both, F.when(read == write, read).otherwise(F.concat(read, F.lit(" / "), write)))).otherwise(F.coalesce(own, inherited))
    declared = F.coalesce(own, F.col("read_permission"), F.col("write_permission"))
    source = F.when(permission.isNull(), None).when(F.when(provider, declared.isNotNull()).otherwise(own.isNotNull()), "component").otherwise("application")
    level = F.when(provider, F.when(both, F.when(rank(read) <= rank(write), level_of(read)).otherwise(level_of(write)))).otherwise(level_of(permission))
    links = F.when(F.col("type").isin("activity", "activity-alias"), _deep_links(F.col("filters")))
    x = x.select("project", "ord", "type", name.alias("name"), F.coalesce(target, name).alias("raw_name"), surface.class_id(F.coalesce(target, name)).alias("class_id"), "line", "filters",
                 export.alias("e"), enabled.alias("enabled"), permission.alias("permission"), source.alias("permission_source"), level.alias("protection_level"), F.coalesce(links, F.filter(_deep_links(F.col("filters")), lambda _: F.lit(False))).alias("links"))
    exposed = surface.exposure(F.col("e.exported"), F.col("e.guess"), surface.level_rank(F.col("permission"), F.col("protection_level")), F.col("enabled"))
    return x.select("project", "ord", "type", "name", "raw_name", "class_id", "line", "e.exported", "e.guess", "e.reason", "e.confidence", "enabled", "permission", "permission_source", "protection_level",
                    exposed.cast("int").alias("exposure"), F.slice("links", 1, surface.MAX_LINKS).alias("deep_links"), (F.size("links") > surface.MAX_LINKS).alias("links_cut"),
                    F.array_sort(F.array_distinct(F.flatten(F.transform("filters", lambda f: f["actions"])))).alias("actions"))


def linked(found: DataFrame, declarations: DataFrame, roles: DataFrame) -> DataFrame:
    """Components with `class` (null without one) and `role_check` (the confidence, or missing).

    A class is found by its id, else by the name as written (a `$` may be kept), else by its original name; never by a
    simple name alone. `declarations`: (id, original_name); `roles`: (node, role, confidence).
    """
    ids = declarations.select(F.col("id").alias("k"), F.col("id").alias("hit"), F.lit(0).alias("way"))
    old = declarations.filter("original_name is not null").select(F.col("original_name").alias("k"), F.col("id").alias("hit"), F.lit(1).alias("way"))
    keys = F.array(F.struct(F.lit(0).alias("i"), F.col("class_id").alias("k")), F.struct(F.lit(1).alias("i"), F.translate("raw_name", "/", ".").alias("k")), F.struct(F.lit(2).alias("i"), F.col("raw_name").alias("k")))
    asked = found.select("project", "ord", F.explode(keys).alias("x")).select("project", "ord", "x.i", "x.k").join(ids.unionByName(old), "k")
    best = asked.groupBy("project", "ord").agg(F.min(F.struct("way", "i", "hit")).alias("b")).select("project", "ord", F.col("b.hit").alias("class"))
    expected = F.element_at(F.create_map(*[F.lit(v) for kv in EXPECTED.items() for v in kv]), F.col("type"))
    r = roles.select(F.col("node").alias("class"), F.col("role").alias("_role"), S.name_of(F.col("confidence"), S.CONFIDENCES, 1).alias("role_confidence"))
    x = found.join(best, ["project", "ord"], "left").withColumn("_role", expected).join(r, ["class", "_role"], "left")
    return x.withColumn("role_check", F.when(F.col("class").isNotNull(), F.coalesce("role_confidence", F.lit("missing")))).drop("_role", "role_confidence")


def of_class(found: DataFrame) -> DataFrame:
    """(project, class, and the columns of its most exposed declaration, declared_as): several declarations may share a class."""
    first = F.row_number().over(Window.partitionBy("project", "class").orderBy("exposure", "type", "name"))
    names = found.filter("class is not null").groupBy("project", "class").agg(F.array_sort(F.collect_list("name")).alias("declared_as"))
    best = found.filter("class is not null").withColumn("_n", first).filter("_n = 1").drop("_n")
    return best.join(names, ["project", "class"])


def undeclared(roles: DataFrame, found: DataFrame) -> DataFrame:
    """(node): classes with a component's role that no component declares."""
    return roles.filter(F.col("role").isin(*sorted(set(EXPECTED.values())))).select("node").distinct().join(found.select(F.col("class").alias("node")), "node", "left_anti")


def exported_classes(found: DataFrame) -> DataFrame:
    """(class_id): classes of components that are, or may be, exported and enabled."""
    return found.filter("class is not null and exposure < 6").select(F.col("class").alias("class_id")).distinct()
