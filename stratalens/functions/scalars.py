"""Scalar expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEVERITIES = ("info", "low", "medium", "high")
CONFIDENCES = ("low", "medium", "high")


def rank_of(name: Column, names: tuple[str, ...], first: int = 0) -> Column:
    """Place of an ordered name, from `first`."""
    out = F.lit(None).cast("int")
    for i, n in enumerate(names):
        out = F.when(name == n, first + i).otherwise(out)
    return out


def name_of(rank: Column, names: tuple[str, ...], first: int = 0) -> Column:
    return F.get(F.array(*map(F.lit, names)), rank - first)


def shannon_entropy(text: Column) -> Column:
    """Bits a character."""
    chars = F.split(text, "")
    kinds = F.array_distinct(chars)
    n = F.length(text).cast("double")
    counts = F.transform(kinds, lambda c: (F.length(text) - F.length(F.replace(text, c, F.lit("")))) / n)
    return F.aggregate(counts, F.lit(0.0), lambda a, p: a - p * F.log2(p))


def masked(secret: Column) -> Column:
    """First four characters, an ellipsis and the length."""
    return F.concat(F.substring(secret, 1, 4), F.lit("…[" ), F.length(secret).cast("string"), F.lit(" chars]"))


def snippet_digest(snippet: Column) -> Column:
    """12 hex digits of the SHA-256 of the snippet with its white space made single blanks."""
    return F.substring(F.sha2(F.trim(F.regexp_replace(snippet, r"(?U)\s+", " ")), 256), 1, 12)


def table_cell(text: Column) -> Column:
    """Safe in a Markdown table: no pipes or line ends, 160 characters."""
    return F.substring(F.regexp_replace(F.regexp_replace(text, r"[\r\n]+", " "), r"\|", r"\\|"), 1, 160)


def looks_obfuscated(name: Column) -> Column:
    """Up to 3 characters after the last dollar sign, or short lower-case segments."""
    last = F.element_at(F.split(name, r"\$"), -1)
    return (F.length(last) <= 3) | name.rlike(r"^[a-z]{1,2}(\$[a-z]{1,2})+$")


def estimate_level(share: Column) -> Column:
    return F.when(share < 0.1, "low").when(share < 0.4, "medium").otherwise("high")
