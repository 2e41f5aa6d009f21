"""Anonymous names for packages, classes and hosts, and their use in texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lookup import ranked

#: Shorter names stand as they are: they are parts of too many words.
SHORTEST = 4
#: A name that may be replaced: words joined by dots, slashes or dollar signs.
_NAME = r"[A-Za-z_][A-Za-z0-9_]*(?:[./$][A-Za-z_][A-Za-z0-9_]*)*"
_HOST = r"[a-zA-Z][a-zA-Z0-9+.-]*://([^/\s:'\"`?#\\]+)"


def aliases(declarations: DataFrame, manifest_package: str | None = None) -> DataFrame:
    """(name, alias) of all packages and classes (id, package): pkgNN and pkgNN.ClassNNNN, by name.

    Numbers come from counts of the ranges before a name, so that no window has to hold all names at once.
    """
    return _aliases(declarations, manifest_package).filter(F.length("name") >= SHORTEST)


def _aliases(declarations: DataFrame, manifest_package: str | None) -> DataFrame:
    packages = declarations.select("package")
    if manifest_package:
        packages = packages.unionByName(packages.sparkSession.createDataFrame([(manifest_package,)], "package string"))
    p = _numbered(packages.filter("package <> ''").distinct(), "package").select("package", F.concat(F.lit("pkg"), _padded("number", 2)).alias("p"))
    c = _numbered(declarations.select("id", "package").distinct(), "id").join(p, "package", "left")
    classes = c.select(F.col("id").alias("name"), F.concat(F.coalesce(F.concat("p", F.lit(".")), F.lit("")), F.lit("Class"), _padded("number", 4)).alias("alias"))
    return p.select(F.col("package").alias("name"), F.col("p").alias("alias")).unionByName(classes)


def report_aliases(declarations: DataFrame, manifest_package: str | None = None) -> DataFrame:
    """As `aliases`, with short ones too, and the simple names (name) of SHORTEST letters or more of the first class that has each."""
    every = _aliases(declarations, manifest_package)
    own = declarations.select(F.col("id"), F.col("name").alias("simple")).join(every.withColumnRenamed("name", "id"), "id")
    simple = own.filter(F.length("simple") >= SHORTEST).groupBy("simple").agg(F.min(F.struct("id", "alias")).alias("x"))
    simple = simple.select(F.col("simple").alias("name"), F.substring_index("x.alias", ".", -1).alias("alias")).join(every, "name", "left_anti")
    return every.unionByName(simple).dropDuplicates(["name"])


def _padded(number: str, width: int) -> Column:
    """The number with leading zeros; wider numbers stay whole."""
    text = F.col(number).cast("string")
    return F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text)


def _numbered(rows: DataFrame, key: str) -> DataFrame:
    """`rows` with `number` from 1 in the order of `key`: places within a leading part, after the counts of those before."""
    lead = F.substring(key, 1, 24)
    counts = rows.groupBy(lead.alias("_lead")).agg(F.count("*").alias("_c"))
    before = counts.withColumn("_before", F.sum("_c").over(Window.orderBy("_lead").rowsBetween(Window.unboundedPreceding, -1)))
    within = rows.withColumn("_lead", lead).withColumn("_n", F.row_number().over(Window.partitionBy("_lead").orderBy(key)))
    return within.join(before, "_lead").withColumn("number", F.col("_n") + F.coalesce("_before", F.lit(0))).drop("_lead", "_c", "_before", "_n")


def host_aliases(texts: DataFrame, order: str, text: str) -> DataFrame:
    """(host, alias) of the hosts of URLs: hostN.invalid in the order in which they first occur."""
    found = texts.select(F.col(order).alias("_o"), F.posexplode(F.regexp_extract_all(text, F.lit(_HOST), F.lit(1))).alias("_i", "host"))
    first = found.groupBy(F.lower("host").alias("host")).agg(F.min(F.struct("_o", "_i", F.lower("host"))).alias("_f"))
    return ranked(first, ["_f"]).select("host", F.concat(F.lit("host"), F.col("number").cast("string"), F.lit(".invalid")).alias("alias"))


def hosts_replaced(texts: DataFrame, key: str, text: str, hosts: DataFrame) -> DataFrame:
    """`texts` with the hosts of all URLs in `text` replaced by their alias (host, alias; hosts in lower case). No text holds U+0001."""
    marked = F.regexp_replace(text, "(" + _HOST.replace("(", ")(", 1), "$1\u0001$2\u0001")
    pieces = texts.select(F.col(key).alias("_k"), F.posexplode(F.split(marked, "\u0001")).alias("_i", "piece"))
    named = F.when(F.col("_i") % 2 == 1, F.lower("piece"))  # what lies between the marks
    new = pieces.withColumn("host", named).join(hosts, "host", "left").withColumn("t", F.coalesce("alias", "piece"))
    whole = new.groupBy("_k").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_i", "t"))), lambda x: x["t"]), "").alias("_t"))
    return texts.join(whole, F.col(key) == F.col("_k"), "left").withColumn(text, F.coalesce("_t", F.col(text))).drop("_k", "_t")


def replaced(texts: DataFrame, key: str, text: str, names: DataFrame) -> DataFrame:
    """`texts` with every known name in `text` replaced by its alias; of several that fit, the longest counts.

    A text is cut into dotted words and what lies between. In a dotted word, names are replaced from left to right, the longest
    first, wherever one of its parts begins; they are found by an equi-join, so that the names need not fit into one pattern.
    Slashes and dollar signs count as dots.
    """
    most = names.agg(F.max(F.size(F.split("name", r"\.")))).first()[0]
    if most is None:
        return texts
    marked = F.regexp_replace(text, f"({_NAME})", "\u0001$1\u0001")
    pieces = texts.select(F.col(key).alias("_k"), F.posexplode(F.split(marked, "\u0001")).alias("_i", "piece"))
    words = pieces.filter(F.col("piece").rlike(f"^{_NAME}$")).select("piece").distinct().withColumn("parts", F.split(F.translate("piece", "/$", ".."), r"\."))
    begins = words.select("piece", "parts", F.explode(F.sequence(F.lit(0), F.size("parts") - 1)).alias("i"))
    at = F.length(F.array_join(F.slice("parts", F.lit(1), F.col("i")), ".")) + (F.col("i") > 0).cast("int")
    spans = F.transform(F.sequence(F.lit(1), F.least(F.lit(most), F.size("parts") - F.col("i"))), lambda n: F.array_join(F.slice("parts", F.col("i") + 1, n), "."))
    longest = (begins.select("piece", at.alias("at"), F.explode(spans).alias("name")).join(names, "name")
               .groupBy("piece", "at").agg(F.max(F.struct(F.length("name").alias("n"), "alias")).alias("a")))
    listed = longest.groupBy("piece").agg(F.array_sort(F.collect_list(F.struct("at", "a.n", "a.alias"))).alias("_a"))
    rest = lambda begin, n: F.substring(F.col("piece"), begin + 1, n)
    step = lambda s, x: F.when(x["at"] >= s["p"], F.struct(F.concat(s["t"], rest(s["p"], x["at"] - s["p"]), x["alias"]).alias("t"), (x["at"] + x["n"]).alias("p"))).otherwise(s)
    made = F.aggregate("_a", F.struct(F.lit("").alias("t"), F.lit(0).alias("p")), step, lambda s: F.concat(s["t"], rest(s["p"], F.length("piece"))))
    known = listed.select("piece", made.alias("_new"))
    new = F.coalesce("_new", "piece")
    whole = (pieces.join(known, "piece", "left").groupBy("_k")
             .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_i", new.alias("t")))), lambda x: x["t"]), "").alias("_t")))
    return texts.join(whole, F.col(key) == F.col("_k"), "left").withColumn(text, F.coalesce("_t", F.col(text))).drop("_k", "_t")
