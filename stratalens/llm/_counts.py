"""Exact sums of counts by hash over all batches of a corpus, with a fixed fan-out.

A batch is one row: its sorted distinct hashes and, in the same order, their counts. Each batch learns the sums of its own
hashes over all batches. The hash space is cut into ranges, and every batch sends one message to each: ranges of about
`BUCKET` hashes up to `FAN` of them, then `FAN` wider ones, up to `SHARE` buckets each. A range's task holds its messages in
narrow arrays and adds them up about `BUCKET` hashes at a time. Beyond that the work goes by levels of an even fan-out f, at
most `FAN`: a batch sends one message to each of f wide ranges, groups of about f batches merge there into one, and what they
merge into is cut again. A merged message is thus about as large as a batch, whatever f is. The messages of a level
are f a batch, however many batches there are, and no task holds more than about `SHARE` buckets or a batch. A hash that stands
in many documents is one number in each batch's message, so no hash is hot.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import materialize

FAN = 1024
BUCKET = 1 << 20
SHARE = 8
_U = np.uint64


def packed(a: np.ndarray) -> bytes:
    """Compressed array; byte planes put the like bytes of numbers side by side."""
    a = np.ascontiguousarray(a)
    planes = a.view(np.uint8).reshape(len(a), a.itemsize).T if len(a) else a.view(np.uint8)
    return zstandard.compress(np.ascontiguousarray(planes).tobytes(), 1)


def unpacked(b: bytes, dtype: str) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(b), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(dtype).itemsize, -1).T).reshape(-1).view(dtype)


def packed_hashes(h: np.ndarray) -> bytes:
    """Sorted uint64 hashes by their differences."""
    return packed(np.diff(h, prepend=_U(0)))


def unpacked_hashes(b: bytes) -> np.ndarray:
    return np.cumsum(unpacked(b, "<u8"), dtype=_U)


def trim() -> None:
    """Give a worker's free memory back to the system; idle workers keep it otherwise."""
    pa.default_memory_pool().release_unused()
    if hasattr(c := ctypes.CDLL(None), "malloc_trim"):
        c.malloc_trim(0)


Message = tuple[np.ndarray, list[np.ndarray]]


def _message(names: list[str]) -> Callable[[dict], Message]:
    return lambda row: (unpacked_hashes(row["h"]), [unpacked(row[c], "<u8") for c in names])


def _split(n: int, step: int, names: list[str], message: Callable[[dict], Message]):
    """One row for each range of `step` buckets in which a batch has hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for i in range(rb.num_rows):
                row = rb.slice(i, 1).to_pylist()[0]
                h, counts = message(row)
                part = ((h >> _U(32)) * _U(n) >> _U(32)).astype(np.int64) // step
                cuts = np.flatnonzero(np.diff(part, prepend=-1))
                pieces = [(int(part[a]), row["batch"], packed_hashes(h[a:b]), *[packed(c[a:b]) for c in counts]) for a, b in zip(cuts, [*cuts[1:], len(h)], strict=True)]
                del row, h, counts, part
                if pieces:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, pa.int64() if i < 2 else pa.binary()) for i, c in enumerate(zip(*pieces, strict=True))], names=["part", "batch", "h", *names])
                del pieces
                trim()

    return run


def _narrow(a: np.ndarray) -> np.ndarray:
    """The same numbers in the narrowest unsigned type that holds them."""
    return a.astype(np.min_scalar_type(int(a.max(initial=0))))


def _messages(table: pa.Table, names: list[str]) -> list[Message]:
    columns = [table.column(c) for c in ["h", *names]]
    return [(unpacked_hashes(h.as_py()), [_narrow(unpacked(c.as_py(), "<u8")) for c in counts]) for h, *counts in zip(*columns, strict=True)]


def _summed(messages: list[Message], bucket: int) -> Iterator[tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]]:
    """For about `bucket` hashes at a time, ascending: the distinct ones, their sums, and the place of each message's hashes among them."""
    lo, hi = int(min(h[0] for h, _ in messages)), int(max(h[-1] for h, _ in messages))
    k = -(-sum(len(h) for h, _ in messages) // bucket)
    edges = np.array([lo + (hi - lo) * j // k for j in range(1, k)], _U)
    cuts = [[0, *np.searchsorted(h, edges).tolist(), len(h)] for h, _ in messages]
    for j in range(k):
        slices = [slice(*c[j : j + 2]) for c in cuts]
        u, inv = np.unique(np.concatenate([h[x] for (h, _), x in zip(messages, slices, strict=True)]), return_inverse=True)
        sums = []
        for i in range(len(messages[0][1])):
            s = np.zeros(len(u), np.int64)
            np.add.at(s, inv, np.concatenate([c[i][x] for (_, c), x in zip(messages, slices, strict=True)]).astype(np.int64))
            sums.append(s)
        ends = np.cumsum([0, *[x.stop - x.start for x in slices]])
        yield u, sums, [inv[a:b] for a, b in zip(ends, ends[1:], strict=False)]


def _answers(table: pa.Table, names: list[str], found: list[list[list[np.ndarray]]], kinds: int) -> pa.Table:
    """The rows for the messages of `table`, from the pieces `found` of each name and message."""
    trim()
    return pa.table({
        "batch": table.column("batch"), "part": table.column("part"),
        "kinds": pa.array([kinds if i == 0 else 0 for i in range(table.num_rows)], pa.int64()),  # once for all messages of a range
        **{c: pa.array([packed(np.concatenate(x).astype(_U)) for x in pieces], pa.binary()) for c, pieces in zip(names, found, strict=True)}})


def totals(batches: DataFrame, names: list[str], hashes: int, n_batches: int, message: Callable[[dict], Message] | None = None) -> DataFrame:
    """batch, part, kinds and the sums of `names`, which put together by part follow the order of the batch's hashes.

    `batches`: batch, h (packed_hashes) and the counts `names` (packed uint64), or whatever `message` makes sorted distinct
    hashes and counts (uint64) from; `hashes`: about their number over all batches.
    `kinds` adds up to the number of distinct hashes below 2^63 that have a count above 0.
    """
    n, levels, fan = max(1, -(-hashes // BUCKET)), 1, 2
    if n > FAN:
        n = max(FAN, -(-hashes // (BUCKET * SHARE)))
    while FAN**levels < n:
        levels += 1
    while fan**levels < n:
        fan += 1
    return _level(batches if message else batches.select("batch", "h", *names), names, n, fan, levels, n_batches, message or _message(names))


def _level(batches: DataFrame, names: list[str], n: int, fan: int, levels: int, n_batches: int, message: Callable[[dict], Message]) -> DataFrame:
    step = fan ** (levels - 1)
    binary = lambda xs: "".join(f", {c} binary" for c in xs)
    sent = batches.mapInArrow(_split(n, step, names, message), f"part long, batch long{binary(['h', *names])}")
    back = f"batch long, part long, kinds long{binary(names)}"
    if step == 1:

        def add(table: pa.Table) -> pa.Table:
            messages, kinds = _messages(table, names), 0
            found = [[[] for _ in messages] for _ in names]
            for u, sums, places in _summed(messages, BUCKET):
                kinds += int(((sum(sums) > 0) & (u < _U(1 << 63))).sum())
                for s, pieces in zip(sums, found, strict=True):
                    for x, p in zip(pieces, places, strict=True):
                        x.append(_narrow(s[p]))
            del messages, u, sums, places
            return _answers(table, names, found, kinds)

        return sent.groupBy("part").applyInArrow(add, back)
    groups = max(1, -(-n_batches // fan))
    sent = materialize(sent.withColumn("grp", F.pmod(F.xxhash64("batch"), F.lit(groups))), "sent")

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        us, sums = zip(*[(u, x) for u, x, _ in _summed(_messages(table, names), BUCKET)], strict=True)
        return pa.table({"batch": pa.array([key[0].as_py() * groups + key[1].as_py()], pa.int64()), "h": pa.array([packed_hashes(np.concatenate(us))], pa.binary()),
                         **{c: pa.array([packed(np.concatenate(x).astype(_U))], pa.binary()) for c, x in zip(names, zip(*sums, strict=True), strict=True)}})

    def give_back(_: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        above, at = answers.sort_by("part"), 0
        sums = [np.concatenate([unpacked(x.as_py(), "<u8") for x in above.column(c)]) for c in names]
        messages = _messages(table, [])
        found = [[[] for _ in messages] for _ in names]
        for u, _, places in _summed(messages, BUCKET):
            for s, pieces in zip(sums, found, strict=True):
                for x, p in zip(pieces, places, strict=True):
                    x.append(_narrow(s[at + p]))
            at += len(u)
        return _answers(table, names, found, sum(above.column("kinds").to_pylist()))

    merged = materialize(sent.groupBy("part", "grp").applyInArrow(merge, f"batch long{binary(['h', *names])}"), "merged")
    above = _level(merged, names, n, fan, levels - 1, groups, _message(names)).select(
        F.expr(f"batch div {groups}").alias("up"), F.expr(f"batch % {groups}").alias("grp"), "part", "kinds", *names)
    return sent.groupBy("part", "grp").cogroup(above.groupBy("up", "grp")).applyInArrow(give_back, back)
