"""Mix sources to target weights by capped water-filling, and sample whole and fractional repetitions.

Each source's share of the budget (all words) follows its weight; a source that would be repeated more than
`max_epochs` times is clamped there, and what it gives up is shared out again by weight until no source is above. The
clamped sources are the first ones by cap / weight, so the final level is the greatest of (budget - caps so far) /
(weights left) along that order. A source's documents are then all repeated the whole number of times, and a seeded
random order of them is repeated once more until the target is met, the last one in part.

Where that order is cut is found from the sums of 4096 hash blocks of each source and the rows of the one block in which the
cut falls. Each source's cut is one row; compared with it in place, a document needs neither to be sorted nor moved.

Defined cases: a null or empty text has no words and takes none; a null source is a source, the last in order; rows without
an id are placed by their text; rows that repeat an id stand next to each other in the seeded order, by size and text,
and if the cut falls on rows that are alike in all that, they take equal parts; an empty table returns no rows; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import BROADCAST_IDS, materialize, words

MAX_EPOCHS = 3
SEED = "mix-1"


def water_fill(sources: DataFrame, weight: Column, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """`target` for each row of (source, source_size); `weight` may use `place`, the source's place from 0."""
    ranked = sources.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    capped = ranked.withColumn("weight", weight.cast("long")).withColumn("cap", F.col("source_size") * max_epochs)
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), "place").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(by_level), F.lit(0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(by_level), F.lit(0)))
    return capped.withColumn("level", level).withColumn("level", F.max("level").over(everything)).select(
        "source", "source_size", "place", F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")).alias("target"))


def _placed(documents: DataFrame, seed: str, names: dict[str, str]) -> DataFrame:
    """The columns `names` by their new names, and each row's source, size and place in the seeded order."""
    by = F.coalesce(F.col("doc_id").cast("string"), F.md5("text"), F.lit(""))
    return documents.select(
        *[F.col(f"`{c}`").alias(n) for c, n in names.items()], F.col("source").alias("_source"), F.size(words(F.col("text"))).cast("long").alias("_size"),
        F.md5(F.concat(F.lit(f"{seed}:"), by)).alias("_order"), F.xxhash64("text").alias("_tie"))


def _cuts(placed: DataFrame, max_epochs: int) -> DataFrame:
    """A row for each source: source_size, target, whole repetitions, and the place and part of the cut (null if there is none)."""
    block = F.substring("_order", 1, 3).alias("_block")
    sums = materialize(placed.groupBy("_source", block).agg(F.sum("_size").alias("_sum")), "mix-blocks")
    targets = water_fill(sums.groupBy(F.col("_source").alias("source")).agg(F.sum("_sum").alias("source_size")), F.col("place") % 3 + 1, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    targets = targets.withColumn("_whole", whole).withColumn("_need", F.floor(F.col("target") - F.col("_whole") * F.col("source_size")).cast("long"))
    targets = materialize(targets.select(F.col("source").alias("_s"), "source_size", "target", "_whole", "_need"), "mix-targets")
    upto = Window.partitionBy("_source").orderBy("_block").rowsBetween(Window.unboundedPreceding, 0)
    ends = sums.withColumn("_end", F.sum("_sum").over(upto))
    of = F.col("_source").eqNullSafe(F.col("_s"))
    crossed = ends.join(targets, of).filter("_end > _need").groupBy("_s").agg(F.min(F.struct("_block", (F.col("_end") - F.col("_sum")).alias("start"))).alias("b"))
    crossed = materialize(crossed.select("_s", F.col("b._block").alias("_b"), F.col("b.start").alias("_start")), "mix-crossed")
    inside = placed.withColumn("_block", block).join(_small(crossed), of & (F.col("_block") == F.col("_b")))
    alike = inside.groupBy("_source", "_start", "_order", "_size", "_tie").agg(F.count("*").alias("_g"))
    run = Window.partitionBy("_source").orderBy("_order", "_size", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    alike = alike.withColumn("_end", F.col("_start") + F.sum(F.col("_size") * F.col("_g")).over(run))
    place = F.struct("_order", "_size", "_tie").alias("place")
    part = F.floor((F.col("_need") - F.col("_end") + F.col("_size") * F.col("_g")) / F.col("_g")).alias("part")
    cut = alike.join(targets, of).filter("_end > _need").groupBy("_s").agg(F.min(F.struct(place, part)).alias("cut"))
    cut = cut.select(F.col("_s").alias("_t"), F.col("cut.place").alias("_cut"), F.col("cut.part").alias("_cut_part"))
    return materialize(targets.join(cut, F.col("_s").eqNullSafe(F.col("_t")), "left").drop("_t", "_need"), "mix-cuts")


def _small(df: DataFrame) -> DataFrame:
    """`df`, sent to all tasks if its rows are few; it has one for each source."""
    return F.broadcast(df) if df.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else df


def _taken(placed: DataFrame, cuts: DataFrame) -> DataFrame:
    """`placed` with its source's row, and _part: the words of the last copy."""
    place = F.struct("_order", "_size", "_tie")
    part = F.when(place < F.col("_cut"), F.col("_size")).when(place == F.col("_cut"), F.col("_cut_part")).otherwise(0)
    return placed.join(_small(cuts), F.col("_source").eqNullSafe(F.col("_s"))).withColumn("_part", part.cast("long"))


def mix(documents: DataFrame, seed: str = SEED, max_epochs: int = MAX_EPOCHS, keep: list[str] | None = None) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies (whole), part (words of the last copy) and the `keep` columns."""
    kept = {c: f"_keep_{i}" for i, c in enumerate(keep or [])}
    placed = materialize(_placed(documents, seed, {"doc_id": "doc_id"} | kept), "mix-sizes")
    return _taken(placed, _cuts(placed, max_epochs)).select(
        "doc_id", F.col("_size").alias("size"), "source_size", "target", (F.col("_whole") * F.col("_size") + F.col("_part")).alias("taken"),
        F.col("_whole").alias("copies"), F.col("_part").alias("part"), *[F.col(n).alias(c) for c, n in kept.items()])


def mixed_documents(documents: DataFrame, seed: str = SEED, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """The documents themselves, each as often as the mix takes it; a part is the text's first words, by one space.

    Texts are not shuffled: the cuts are found on sizes alone, and a second scan repeats the documents in place.
    """
    cols = documents.columns
    names = {c: f"_c{i}" for i, c in enumerate(cols)}
    cuts = _cuts(materialize(_placed(documents, seed, {}), "mix-sizes"), max_epochs)
    taken = _taken(_placed(documents, seed, names), cuts)
    none = F.expr("cast(array() as array<bigint>)")
    copies = F.concat(F.when(F.col("_whole") > 0, F.array_repeat(F.col("_size"), F.col("_whole").cast("int"))).otherwise(none),
                      F.when(F.col("_part") > 0, F.array(F.col("_part"))).otherwise(none))
    out = taken.select(*names.values(), "_size", F.explode(copies).alias("_n"))
    short, text = F.col("_n") < F.col("_size"), names["text"]
    out = out.withColumn(text, F.when(short, F.array_join(F.slice(words(F.col(text)), 1, F.col("_n").cast("int")), " ")).otherwise(F.col(text)))
    if "n_chars" in cols:
        n = names["n_chars"]
        out = out.withColumn(n, F.when(short, F.length(text).cast(documents.schema["n_chars"].dataType)).otherwise(F.col(n)))
    return out.select(*[F.col(n).alias(c) for c, n in names.items()])


ORACLE_SQL = f"""
with sized as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as size,
         md5('{SEED}:' || coalesce(cast(doc_id as varchar), '')) as ord
  from documents),
sources as (select source, sum(size)::bigint as source_size from sized group by source),
ranked as (select *, row_number() over (order by source nulls last) - 1 as place, source_size * {MAX_EPOCHS} as cap from sources),
weighted as (select *, place % 3 + 1 as weight from ranked),
levels as (
  select *, (sum(source_size) over () - coalesce(sum(cap) over b, 0))::double
          / (sum(weight) over () - coalesce(sum(weight) over b, 0))::double as lvl
  from weighted window b as (order by cap::double / weight::double, place rows between unbounded preceding and 1 preceding)),
targets as (select source, source_size, least(cap::double, (select max(lvl) from levels) * weight) as target from levels),
placed as (
  select s.doc_id, s.size, t.source_size, t.target,
         sum(s.size) over (partition by s.source order by s.ord, s.size rows between unbounded preceding and current row)::bigint - s.size as start
  from sized s join targets t on s.source is not distinct from t.source),
whole as (select *, case when source_size > 0 then floor(target / source_size)::bigint else 0 end as copies from placed)
select doc_id, size, source_size, target,
       (copies * size + greatest(0, least(size, floor(target - copies * source_size)::bigint - start)))::bigint as taken,
       copies::bigint as copies, greatest(0, least(size, floor(target - copies * source_size)::bigint - start))::bigint as part
from whole
"""
