"""Shard documents by a minimax contiguous partition of atomic groups.

Equal texts form a group that no cut splits; groups stand in the order of their texts' SHA-256, so neighbours are
unrelated and a shard is a fair sample. The smallest capacity under which `shards` contiguous runs hold all groups is
found by binary search, each candidate checked by greedy filling. Only the sums of at most `MAX_BLOCKS` blocks of groups and the
prefix sums of the few blocks in which a candidate's cuts fall reach the driver: some megabytes.
Within that capacity a cut is placed where the rest would be shared out evenly, so that one giant group does not leave
later shards empty.

Defined cases: a null text counts no bytes, and all null texts form one group; repeated rows and null ids get slots of
their own; an empty table returns no rows; fewer groups than shards leave the last shards empty; other columns are
ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import materialize

SHARDS = 40
OVERHEAD = 16
#: Groups in a block, at least; blocks grow rather than exceed their number.
BLOCK_GROUPS = 16_384
MAX_BLOCKS = 65_536
#: Blocks whose prefix sums the driver keeps at a time.
KEPT_BLOCKS = 48
#: Rows of one group that are numbered in one task.
NUMBERED_TOGETHER = 65_536
HOT_GROUPS = 1000


class _Ends:
    """Where groups end, in bytes before: sums of blocks, and on demand the ends within a block."""

    def __init__(self, blocks: list[tuple[int, int]], total: int, read: Callable[[list[int]], dict[int, list[int]]]):
        self.ids = [b for b, _ in blocks]
        self.starts = [s for _, s in blocks]
        self.total, self.read = total, read
        self.kept: dict[int, list[int]] = read(self.ids) if len(self.ids) <= KEPT_BLOCKS else {}

    def last(self, limit: int) -> int:
        """The last group end that is at most `limit`."""
        if limit >= self.total:
            return self.total
        k = bisect_right(self.starts, limit) - 1
        if k < 0:
            return 0
        block = self.ids[k]
        if block not in self.kept:
            if len(self.kept) >= KEPT_BLOCKS:
                self.kept.pop(next(iter(self.kept)))
            self.kept |= self.read([block])
        ends = self.kept[block]
        at = bisect_right(ends, limit)
        return ends[at - 1] if at else self.starts[k]


def _fits(ends: _Ends, at: int, shards: int, capacity: int) -> bool:
    for _ in range(shards):
        if at >= ends.total:
            return True
        at = ends.last(at + capacity)
    return at >= ends.total


def smallest_capacity(ends: _Ends, shards: int, largest: int) -> int:
    low = max(-(-ends.total // shards), largest)
    high = -(-ends.total // shards) + largest  # greedy filling always fits below this
    while low < high:
        mid = (low + high) // 2
        if _fits(ends, 0, shards, mid):
            high = mid
        else:
            low = mid + 1
    return low


def cut(ends: _Ends, shards: int, capacity: int) -> list[int]:
    """The byte positions at which shards 0, 1, ... end; no shard holds more than `capacity`."""
    at, out = 0, []
    for left in range(shards, 0, -1):
        furthest = ends.last(at + capacity)
        even = ends.last(at + min(capacity, -(-(ends.total - at) // left)))
        at = even if even > at and _fits(ends, even, left - 1, capacity) else furthest
        out.append(at)
    return out


def shard_documents(documents: DataFrame, shards: int = SHARDS, block_groups: int = BLOCK_GROUPS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = materialize(documents.select(
        "doc_id", F.monotonically_increasing_id().alias("rid"),
        (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.when(F.col("text").isNull(), F.unhex(F.lit(""))).otherwise(F.unhex(F.sha2("text", 256))).alias("grp"),
    ), "shard-base")
    groups = materialize(base.groupBy("grp").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")), "shard-groups")
    n, total, largest = groups.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0)), F.coalesce(F.max("bytes"), F.lit(0))).first()
    n_blocks = min(MAX_BLOCKS, max(1, -(-n // block_groups)))
    lead = F.coalesce(F.conv(F.hex(F.substring("grp", 1, 4)), 16, 10).cast("long"), F.lit(0))
    blocked = groups.withColumn("block", F.call_function("shiftright", lead * n_blocks, F.lit(32)))
    sums = blocked.groupBy("block").agg(F.sum("bytes").alias("b"), F.sum("rows").alias("r"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # one row for each block of groups
    offsets = sums.select("block", F.coalesce(F.sum("b").over(before), F.lit(0)).alias("b0"), F.coalesce(F.sum("r").over(before), F.lit(0)).alias("r0"))
    inside = Window.partitionBy("block").orderBy("grp").rowsBetween(Window.unboundedPreceding, 0)
    placed = materialize(
        blocked.withColumn("b1", F.sum("bytes").over(inside)).withColumn("r1", F.sum("rows").over(inside)).join(offsets, "block").select(
            "block", "grp", "rows", (F.col("b0") + F.col("b1") - F.col("bytes")).alias("start"), (F.col("b0") + F.col("b1")).alias("end"),
            (F.col("r0") + F.col("r1") - F.col("rows")).alias("first_row")), "shard-placed")

    def read(ids: list[int]) -> dict[int, list[int]]:
        found: dict[int, list[int]] = {i: [] for i in ids}
        for b, ends_ in placed.filter(F.col("block").isin(ids)).groupBy("block").agg(F.sort_array(F.collect_list("end"))).collect():
            found[b] = ends_
        return found

    ends = _Ends([tuple(r) for r in placed.groupBy("block").agg(F.min("start")).orderBy("block").collect()], total, read)
    cuts = cut(ends, shards, smallest_capacity(ends, shards, largest)) if n else []
    edges = F.array(*[F.lit(c).cast("long") for c in cuts[:-1]]) if len(cuts) > 1 else F.expr("cast(array() as array<bigint>)")
    sharded = placed.select("grp", "rows", "first_row", F.size(F.filter(edges, lambda c: c <= F.col("start"))).alias("shard"))
    first = sharded.groupBy("shard").agg(F.min("first_row").alias("shard_row"))  # one row for each shard
    sharded = sharded.join(F.broadcast(first), "shard")
    # fewer than HOT_GROUPS groups have more than this share of the rows: they go to the rows, which stay spread
    share = F.col("rows") * HOT_GROUPS > groups.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    sharded = materialize(sharded, "shard-groups")
    hot = F.broadcast(sharded.filter(share))
    rows = base.join(F.broadcast(hot.select("grp")), "grp", "left_anti").join(sharded.filter(~share), "grp").unionByName(base.join(hot, "grp"))
    # rows without an id come last in their group and are dealt out by row, as they are alike
    parts_ = F.expr(f"rows div {NUMBERED_TOGETHER} + 1")
    rows = rows.withColumn("part", F.when(F.col("doc_id").isNotNull(), F.pmod(F.xxhash64("doc_id"), parts_)).otherwise(parts_ + F.pmod(F.xxhash64("rid"), parts_)))
    single = rows.filter("rows = 1").withColumn("rank", F.lit(0))
    several = rows.filter("rows > 1")
    parts = several.groupBy("grp", "part").agg(F.count("*").alias("m"))
    skip = parts.select("grp", "part", F.coalesce(F.sum("m").over(
        Window.partitionBy("grp").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("skip"))
    several = several.join(skip, ["grp", "part"]).withColumn(
        "rank", F.col("skip") + F.row_number().over(Window.partitionBy("grp", "part").orderBy("doc_id")) - 1).drop("skip")
    return single.unionByName(several).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"),
        (F.col("first_row") - F.col("shard_row") + F.col("rank")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
