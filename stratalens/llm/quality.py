"""Quality rules whose cutoffs follow the data: quantile sketches per language and source, then a joined filter.

Base counts are computed inside each row. Rows that pass the base rules feed one mergeable quantile sketch per
(lang, source, metric): a log-linear histogram (values under 256 exact, above that 128 cells an octave, so a quantile is
at most 1/128 too low), merged by adding cell counts. A metric's fences follow from three quantiles of the sketch alone:
upper + spread * (upper - median) and, where it has a lower fence, lower - spread * (median - lower); no constant is added to
them. A value is compared by its cell. The upper quantile says how many rows may lie beyond the bulk: a quarter for metrics
of which junk has far more than clean text, a fiftieth for those that clean texts have, too. A quantile
needs `rows_beyond` rows beyond it: a group with fewer uses the merged sketch of its language, then that of all rows.

Defined cases: a null or empty text has no words and fails the base rules; null lang or source is a group of its own;
repeated rows each count and each return; an empty table returns no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ._shared import let, materialize, words

WINDOW = 5
#: Rows that must lie beyond a quantile.
ROWS_BEYOND = 10
#: metric -> (rows beyond the upper quantile in hundredths, spread, also a lower fence)
FENCES = {
    "symbols": (25, 3, False),  # symbols a thousand words
    "word_length": (25, 8, True),  # hundredths of a code point a word
    "dup_lines": (2, 3, False),  # repeated lines a thousand words
    "repeats": (2, 2, False),  # words in repeated windows a thousand words
}


def _covered(w: Column) -> Column:
    """Words of the array `w` that lie in a window which occurs twice or more."""
    last = F.size(w) - (WINDOW - 1)
    found = F.transform(F.sequence(F.lit(1), last), lambda i: F.struct(F.array_join(F.slice(w, i, WINDOW), " ").alias("g"), i.alias("i")))
    twice = let(
        F.sort_array(found),
        lambda s: F.sort_array(F.filter(
            F.transform(s, lambda x, k: F.when((F.get(s, k - 1)["g"] == x["g"]) | (F.get(s, k + 1)["g"] == x["g"]), x["i"])),
            lambda i: i.isNotNull(),
        )),
    )
    return let(twice, lambda p: F.aggregate(
        F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x))


def _repeat_words(w: Column) -> Column:
    last = F.size(w) - (WINDOW - 1)
    hashes = F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.slice(w, i, WINDOW)))
    # all hashes differ: so do all windows, and no text needs comparing
    return F.when(last < 2, 0).otherwise(let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(_covered(w))))


def base_counts(documents: DataFrame) -> DataFrame:
    """doc_id, lang, source and the base counts of each row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counted = documents.select(
        "doc_id",
        "lang",
        "source",
        let(words(F.col("text")), lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            _repeat_words(w).cast("long").alias("n_repeat_words"),
        )).alias("c"),
        F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    )
    n = F.col("c.n_words")
    return counted.select(
        "doc_id", "lang", "source", n.alias("n_words"), "c.word_chars", "n_symbols", "n_dup_lines", "c.n_repeat_words",
        ((n < 10) | (100 * F.col("c.n_repeat_words") > 20 * n)).alias("base_failed"),
    )


def _metrics() -> Column:
    value = {
        "symbols": F.expr("n_symbols * 1000 div greatest(n_words, 1)"),
        "word_length": F.expr("word_chars * 100 div greatest(n_words, 1)"),
        "dup_lines": F.expr("n_dup_lines * 1000 div greatest(n_words, 1)"),
        "repeats": F.expr("n_repeat_words * 1000 div greatest(n_words, 1)"),
    }
    return F.array(*[F.struct(F.lit(k).alias("metric"), value[k].alias("value")) for k in FENCES])


def sketch_cell(value: Column) -> Column:
    """Lower edge of the sketch's cell: the 8 leading bits of a whole number."""
    return let(F.greatest(F.length(F.bin(value)) - 8, F.lit(0)), lambda s: F.call_function("shiftleft", F.call_function("shiftright", value, s), s))


def sketches(counted: DataFrame) -> DataFrame:
    """(lang, source, metric, cell) -> rows, of the rows that pass the base rules."""
    m = counted.filter(~F.col("base_failed")).select("lang", "source", F.explode(_metrics()).alias("m"))
    return m.groupBy("lang", "source", F.col("m.metric").alias("metric"), sketch_cell(F.col("m.value")).alias("cell")).agg(F.count("*").alias("n"))


def thresholds(sketch: DataFrame, rows_beyond: int = ROWS_BEYOND) -> DataFrame:
    """(lang, source) -> the fences of each metric, from the smallest merged sketch with enough rows."""
    levels = {"source": ["lang", "source"], "lang": ["lang"], "all": []}
    groups = sketch.select("lang", "source").distinct()
    beyond = F.create_map(*[x for m, (share, _, _) in FENCES.items() for x in (F.lit(m), F.lit(share))])[F.col("metric")]
    for level, keys in levels.items():
        merged = sketch.groupBy(*keys, "metric", "cell").agg(F.sum("n").alias("n"))
        # a sketch has at most a few hundred cells, so each window below is short
        w = Window.partitionBy(*keys, "metric").orderBy("cell")
        whole = Window.partitionBy(*keys, "metric")
        ranked = merged.withColumn("upto", F.sum("n").over(w)).withColumn("total", F.sum("n").over(whole)).withColumn("share", beyond)
        least = lambda hundredths: F.min(F.when(F.col("upto") * 100 >= F.col("total") * hundredths, F.col("cell")))
        q = ranked.groupBy(*keys, "metric").agg(
            (F.max("total") * F.max("share") >= 100 * rows_beyond).alias("enough"), least(F.col("share")).alias("lo"), least(F.lit(50)).alias("mid"),
            least(100 - F.col("share")).alias("hi"))
        pairs = q.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("metric", F.struct("enough", "lo", "mid", "hi")))).alias(f"q_{level}"))
        groups = groups.crossJoin(F.broadcast(pairs)) if not keys else _null_safe(groups, pairs, keys)  # one row
    cols = []
    for metric, (_, spread, low) in FENCES.items():
        found = [F.col(f"q_{x}")[metric] for x in levels]
        best = F.coalesce(*[F.when(f["enough"], f) for f in found], found[-1])
        cols.append((best["hi"] + spread * (best["hi"] - best["mid"])).alias(f"max_{metric}"))
        if low:
            cols.append((best["lo"] - spread * (best["mid"] - best["lo"])).alias(f"min_{metric}"))
    return groups.select("lang", "source", *cols)


def _null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    r = right.select(*[F.col(k).alias(f"_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return left.join(r, on, how).drop(*[f"_{k}" for k in keys])


def quality_rules(documents: DataFrame, rows_beyond: int = ROWS_BEYOND) -> DataFrame:
    """Base counts, `base_failed` and `kept` of every row, with the fences that were applied."""
    counted = materialize(base_counts(documents), "quality")
    fences = thresholds(sketches(counted), rows_beyond)
    joined = _null_safe(counted, fences, ["lang", "source"])
    values = _metrics()
    fine = F.lit(True)
    for k, (metric, (_, _, low)) in enumerate(FENCES.items()):
        value = sketch_cell(values[k]["value"])
        fine = fine & (value <= F.col(f"max_{metric}"))
        if low:
            fine = fine & (value >= F.col(f"min_{metric}"))
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & F.coalesce(fine, F.lit(False))).alias("kept"),
        "max_symbols", "max_word_length", "min_word_length", "max_dup_lines", "max_repeats",
    )
