"""Rule evaluation: text rules, three-valued argument checks, receiver confidence, caps and merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import shannon_entropy

#: Findings of one rule in one class.
CAP = 20
#: Argument shapes of which nothing can be told.
UNKNOWN = ("identifier", "field", "call", "other", "string-concat", "concat", "flags")


def matches(rows: DataFrame, key: list[str], text: str, pattern: str, rule: str, group: int = 0) -> DataFrame:
    """(key, rule, n, value): every match of a pattern in a text, in order."""
    found = F.posexplode(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(group)))
    return rows.filter(F.col(text).rlike(pattern)).select(*key, F.lit(rule).alias("rule"), found.alias("n", "value")).withColumn("n", F.col("n") + 1)


def capped(findings: DataFrame, by: list[str], order: list[str], cap: int = CAP) -> DataFrame:
    return findings.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("_n") <= cap).drop("_n")


def high_entropy(token: Column, least: float = 4.0, shortest: int = 32, longest: int = 256) -> Column:
    """Long, without white space, with lower case, upper case and a digit, and of high entropy."""
    return (F.length(token).between(shortest, longest) & ~token.rlike(r"\s") & token.rlike("[a-z]") & token.rlike("[A-Z]") & token.rlike("[0-9]")
            & (shannon_entropy(token) >= least))


def check(arg: Column, form: str, value: object = None, flag_name: str = "", ignore_case: bool = False) -> Column:
    """1, 0 or null (cannot tell) for an argument struct (kind, sval, ival, bval, text); a missing argument is 0."""
    kind = arg["kind"]
    low = F.lower if ignore_case else (lambda c: c)
    options = value if isinstance(value, list) else [value]
    strings = [v.lower() if ignore_case else v for v in options if isinstance(v, str)]
    numbers = [v for v in options if isinstance(v, int) and not isinstance(v, bool)]
    flags = [v for v in options if isinstance(v, bool)]
    among = lambda c, found: c.isin(*found) if found else F.lit(False)
    open_ = F.when(kind.isin(*UNKNOWN), F.lit(None)).otherwise(F.lit(False))
    literal = F.when(kind == "string", among(low(arg["sval"]), strings)).when(kind == "int", among(arg["ival"], numbers))
    if form == "equals":
        result = literal.when(kind == "bool", among(arg["bval"], flags)).otherwise(open_)
    elif form == "in":
        result = literal.otherwise(open_)
    elif form == "regex":
        result = F.when(kind == "string", arg["sval"].rlike(str(value))).otherwise(open_)
    elif form == "flagsWithout":
        result = F.when(kind == "int", arg["ival"].bitwiseAND(value) == 0).when(kind.isin("field", "flags"), ~F.contains(arg["text"], F.lit(flag_name)))
    else:
        result = {"notLiteral": ~kind.isin("string", "string-concat", "null"), "concat": kind == "concat", "literalish": kind.isin("string", "bytes-literal", "array-literal", "int")}[form]
    return F.when(arg.isNull(), 0).otherwise(result.cast("int"))


def combined(receiver: Column, checks: list[Column]) -> Column:
    """Confidence 0 to 3: the receiver's, at most low where a check cannot tell; 0 where one fails."""
    failed, unsure = F.lit(False), F.lit(False)
    for c in checks:
        failed, unsure = failed | c.eqNullSafe(F.lit(0)), unsure | c.isNull()
    return F.when(failed, 0).when(unsure, F.least(receiver, F.lit(1))).otherwise(receiver)


def severity_counts(findings: DataFrame, by: list[str], severities: tuple[str, ...]) -> DataFrame:
    return findings.groupBy(*by).agg(*[F.count_if(F.col("severity") == s).alias(s) for s in severities])
