"""The declarative rules over facts: candidates by name, argument checks, receiver and override confidence, caps.

Rules are a fixed small table, broadcast to the facts; receivers' types are resolved as names written in their class,
and compared with a rule's types by the ancestors of what they resolve to. All steps are joins and expressions.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..session import cut_lineage
from ..sources import framework as data
from . import hierarchy, inheritance
from .rules import CAP, UNKNOWN, capped

_NONE = "cast(array() as array<string>)"
_CHECK = "struct<index: int, form: string, text: string, number: bigint, flag: boolean, texts: array<string>, numbers: array<bigint>, any_case: boolean>"
RULES = (f"rule string, severity string, category string, kind string, names array<string>, types array<string>, hints array<string>, arg_count int, context string, "
         f"returns map<string, string>, roles array<string>, body string, calls array<string>, checks array<{_CHECK}>")


def _check(p: dict) -> tuple:
    form = next(k for k in ("equals", "in", "regex", "notLiteral", "concat", "literalish", "flagsWithout") if k in p)
    v = p[form]
    many = v if isinstance(v, list) else []
    text = v if isinstance(v, str) else p.get("flagName")
    number = v if isinstance(v, int) and not isinstance(v, bool) else None
    return (p["index"], form, text, number, v if isinstance(v, bool) else None, [x for x in many if isinstance(x, str)], [x for x in many if isinstance(x, int)], bool(p.get("ignoreCase")))


def rule_table(spark: SparkSession, rules: list[dict] | None = None) -> DataFrame:
    """The rules as rows; `rules` in the form of the fixed ones, each id once."""
    rules = data.RULES if rules is None else rules
    if len({r["id"] for r in rules}) < len(rules):
        raise ValueError("duplicate rule")
    short = lambda t: t.rsplit(".", 1)[-1]
    rows = [(r["id"], r["severity"], r["category"], r["kind"],
             r["names"] if r["kind"] == "identifier" else r["methods"] if r["kind"] in ("call", "override") else sorted({short(t) for t in r.get("types", [])}),
             r.get("types", []), sorted({*r.get("importHints", []), *r.get("types", [])}), r.get("argCount"), r.get("context"), r.get("returnTypes", {}), r.get("roles", []),
             r.get("body"), r.get("calls", []), [_check(p) for p in r.get("args", [])]) for r in rules]
    return spark.createDataFrame(rows, RULES)


def checked(p: Column, args: Column) -> Column:
    """1, 0 or null (cannot tell) of one check `p` on an array of arguments; a missing argument fails."""
    a = F.get(args, p["index"])
    kind = a["kind"]
    open_ = F.when(kind.isin(*UNKNOWN), F.lit(None)).otherwise(F.lit(False))
    low = lambda c: F.when(p["any_case"], F.lower(c)).otherwise(c)
    equal = F.when(kind == "bool", F.coalesce(a["bval"] == p["flag"], F.lit(False))).when(kind == "string", F.coalesce(a["sval"] == p["text"], F.lit(False))).when(
        kind == "int", F.coalesce(a["ival"] == p["number"], F.lit(False))).otherwise(open_)
    among = F.when(kind == "string", F.array_contains(F.transform(p["texts"], low), low(a["sval"]))).when(kind == "int", F.array_contains(p["numbers"], a["ival"])).otherwise(open_)
    flags = F.when(kind == "int", a["ival"].bitwiseAND(F.coalesce(p["number"], F.lit(0))) == 0).when(kind.isin("field", "flags"), ~F.contains(a["text"], p["text"]))
    form = p["form"]
    result = (F.when(form == "equals", equal).when(form == "in", among).when(form == "regex", F.when(kind == "string", F.regexp(a["sval"], p["text"])).otherwise(open_))
              .when(form == "notLiteral", ~kind.isin("string", "string-concat", "null")).when(form == "concat", kind == "concat")
              .when(form == "literalish", kind.isin("string", "bytes-literal", "array-literal", "int")).when(form == "flagsWithout", flags).otherwise(F.lit(False)))
    return F.when(a.isNull(), 0).otherwise(result.cast("int"))


def argument_cap(checks: Column, args: Column) -> Column:
    """The highest confidence that the checks leave: 3, 1 where one cannot tell, 0 where one fails."""
    results = F.transform(checks, lambda p: F.coalesce(checked(p, args), F.lit(-1)))
    return F.when(F.array_contains(results, 0), 0).when(F.array_contains(results, -1), 1).otherwise(3)


def _short(c: Column) -> Column:
    return F.substring_index(c, ".", -1)


def _prefix(c: Column) -> Column:
    """What stands before the last dot."""
    return F.regexp_replace(c, r"\.[^.]*$", "")


def _written(receiver: Column) -> Column:
    """The type name that a receiver writes: its declared type, a static call's class, or the class of a factory call."""
    name = F.when(receiver["name"].rlike(r"^\p{Lu}") | F.contains(receiver["name"], F.lit(".")), receiver["name"])
    return F.regexp_replace(F.when(receiver["kind"].isin("variable", "new"), receiver["type"]).when(receiver["kind"] == "name", name).when(
        (receiver["kind"] == "call") & (receiver["inner_kind"] == "name"), receiver["inner_name"]), r"\[\]$", "")


def receiver_confidence(r: Column, types: Column, hint: Column, fqn: Column, above: Column, starred: Column, returned: Column, returned_above: Column, implicit: Column) -> Column:
    """0 to 3. `fqn`: what the written type resolves to (null if unknown), `above` its ancestors; `starred`: it comes from a
    wildcard import of one of `types`; `returned`: the return type that the rule gives for the inner call; `implicit`: of a
    call without receiver."""
    written = _written(r)
    is_api = F.array_contains(types, fqn) | F.arrays_overlap(types, above)
    typed = F.when(fqn.isNotNull(), F.when(is_api, 3).otherwise(0)).when(starred, 3)
    plausible = F.exists(types, lambda t: _short(t) == _short(written))
    return (F.when(r["kind"].isin("variable", "new") & r["type"].isNotNull(), F.coalesce(typed, F.when(plausible, hint).otherwise(0)))
            .when(r["kind"] == "name", F.when(written.isNotNull(), F.coalesce(typed, hint)).otherwise(hint))
            .when(r["kind"] == "implicit", implicit)
            .when((r["kind"] == "call") & returned.isNotNull() & (F.array_contains(types, returned) | F.arrays_overlap(types, returned_above)),
                  F.when((r["inner_kind"] == "name") & (fqn == returned), 3).otherwise(2))
            .otherwise(hint))


def findings(facts: DataFrame, declarations: DataFrame, imports: DataFrame, links: DataFrame, roles: DataFrame, exposed: DataFrame, rules: list[dict] | None = None) -> DataFrame:
    """(rule, severity, category, confidence, class_id, path, line, end_line, snippet, in_anonymous, partial, ord) of all call, creation, override and identifier rules.

    `links`: parent links; `roles`: (node, role, confidence) of project types; `exposed`: (class_id) of exported components.
    """
    spark = facts.sparkSession
    none = F.expr(_NONE)
    owners = declarations.select(F.col("id").alias("owner"), "path", "package", "partial").dropDuplicates(["owner"])
    by_name = F.broadcast(rule_table(spark, rules).withColumn("key", F.explode("names")))
    key = F.when(F.col("kind").isin("call", "override"), F.col("method")).when(F.col("kind") == "new", _short(F.col("name"))).when(F.col("kind") == "identifier", F.col("name"))
    hits = facts.filter(F.col("kind").isin("call", "override", "new", "identifier")).withColumn("key", key).withColumnRenamed("calls", "called").withColumnRenamed("body", "shape").join(by_name, ["kind", "key"])
    args = F.coalesce("args", F.expr("filter(args, x -> false)"))
    hits = hits.filter(F.col("arg_count").isNull() | (F.size(args) == F.col("arg_count"))).withColumn("most", F.when(F.col("kind").isin("call", "new"), argument_cap(F.col("checks"), args)).otherwise(3))
    named = exposed.select(F.col("class_id").alias("owner")).distinct().withColumn("exposed", F.lit(True))
    hits = hits.filter("most > 0").join(named, "owner", "left").filter("context is null or exposed").join(owners, "owner")
    struct = F.struct(*[F.lit("new" if c == "kind" else None).cast("string").alias(c) if c != "type" else F.col("name").alias("type") for c in ("kind", "name", "type", "method", "inner_kind", "inner_name")])
    hits = hits.withColumn("r", F.when(F.col("kind") == "new", struct).when(F.col("kind") == "call", F.col("receiver")))
    hits = hits.withColumn("written", F.coalesce(_written(F.col("r")), F.when(F.col("kind") == "override", F.col("anonymous_type"))))
    hits = cut_lineage(hits.withColumn("returned", F.col("returns")[F.col("r.method")]))

    # what written names resolve to, and everything above it
    refs = hits.filter("written is not null").select("owner", F.col("written").alias("name"), F.lit("type").alias("kind")).distinct()
    status = inheritance.resolved(refs, declarations, imports).filter(F.col("status").isin("resolved", "external")).select("owner", F.col("name").alias("written"), F.col("target").alias("fqn"))
    above = cut_lineage(hierarchy.chains(links, hierarchy.ancestors(links)))
    lists = imports.groupBy("path").agg(F.collect_set(F.when(~F.col("wildcard"), F.col("fqn"))).alias("imported"), F.collect_set(F.when(F.col("wildcard"), F.col("fqn"))).alias("stars"))
    x = hits.join(status, ["owner", "written"], "left").join(above.select(F.col("node").alias("fqn"), F.col("ancestors").alias("above")), "fqn", "left")
    x = x.join(above.select(F.col("node").alias("returned"), F.col("ancestors").alias("returned_above")), "returned", "left").join(lists, "path", "left")
    x = x.withColumns({c: F.coalesce(c, none) for c in ("above", "returned_above", "imported", "stars")})
    hint = F.when(F.arrays_overlap("hints", "imported") | F.exists("hints", lambda h: F.array_contains("stars", _prefix(h))), 2).otherwise(1)
    starred = F.exists("types", lambda t: (_short(t) == _short(F.col("written"))) & F.array_contains("stars", _prefix(t)))

    # calls without receiver: the class, its ancestors, and the classes around it
    depth = F.when(F.col("package") == "", 0).otherwise(F.size(F.split("package", r"\.")))
    parts = F.split("owner", r"\.")
    around = owners.select("owner", F.explode(F.transform(F.sequence(depth + 1, F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))).alias("node"))
    around = around.join(above, "node", "left").groupBy("owner").agg(
        F.array_union(F.collect_set("node"), F.flatten(F.collect_list(F.coalesce("ancestors", none)))).alias("lines"), F.max(F.col("has_superclass") & ~F.col("chain_known")).alias("open"))
    x = x.join(around, "owner", "left")
    implicit = F.when(F.arrays_overlap("types", "lines"), 3).when(F.col("open"), 1).otherwise(0)
    by_receiver = receiver_confidence(F.col("r"), F.col("types"), hint, F.col("fqn"), F.col("above"), starred, F.col("returned"), F.col("returned_above"), implicit)

    # overrides: the anonymous type's roles, or the class's own
    found = hierarchy.roles_of(x.filter("kind = 'override' and fqn is not null").select(F.col("fqn").alias("type")).distinct(), above.select("node", "ancestors"))
    x = x.join(found.select(F.col("type").alias("fqn"), F.col("roles").alias("of_type")), "fqn", "left").join(
        F.broadcast(hierarchy.roles_by_short_name(spark).select(F.col("short").alias("sn"), F.col("roles").alias("of_short"))), _short(F.col("anonymous_type")) == F.col("sn"), "left")
    own = roles.groupBy(F.col("node").alias("owner")).agg(F.collect_list(F.struct("role", F.col("confidence").alias("c"))).alias("own"))
    x = x.join(own, "owner", "left")
    mine = F.coalesce(F.array_max(F.transform(F.filter("own", lambda o: F.array_contains("roles", o["role"])), lambda o: o["c"])), F.lit(0))
    overlap = lambda c: F.coalesce(F.arrays_overlap("roles", c), F.lit(False))
    by_role = (F.when(F.col("anonymous_type").isNotNull() & F.col("fqn").isNotNull(), F.when(overlap("of_type"), 3).otherwise(0))
               .when(F.col("anonymous_type").isNotNull(), F.when(overlap("of_short"), 1).otherwise(0)).when(F.col("anonymous"), 0).otherwise(mine))
    fits = F.when(F.col("body").isNotNull(), F.col("shape") == F.col("body")).when(F.size("calls") > 0, F.arrays_overlap("calls", F.coalesce("called", none))).otherwise(True)
    score = F.when(F.col("kind") == "identifier", 2).when(F.col("kind") == "override", F.when(fits, by_role).otherwise(0)).otherwise(F.least(by_receiver, F.col("most")))
    out = x.withColumn("score", score).filter("score > 0").select(
        "rule", "severity", "category", S.name_of(F.col("score"), S.CONFIDENCES, 1).alias("confidence"), F.col("owner").alias("class_id"), "path", "line", "end_line",
        F.substring("snippet", 1, 160).alias("snippet"), F.col("anonymous").alias("in_anonymous"), "partial", "ord")
    return capped(out, ["class_id", "rule"], ["ord"], CAP)


def sorted_findings(found: DataFrame) -> DataFrame:
    """Most severe first, then class, line and rule."""
    return found.orderBy(F.desc(S.rank_of(F.col("severity"), S.SEVERITIES)), "class_id", "line", "rule", "ord")


def rule_summaries() -> str:
    """The rules' public data as JSON."""
    return json.dumps([{k: r[k] for k in ("id", "title", "severity", "category")} for r in data.RULES])
