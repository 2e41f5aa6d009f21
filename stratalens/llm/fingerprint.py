"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A text's paragraphs (lines, cut at sentence ends and, where long, every 120 characters) are hashed to 64-bit digests; a
repeated paragraph counts as another element. A sketch adds each digest to three cells, which hold a count and the
exclusive or of digests and of their checks. The difference of two sketches is peeled: a cell with one element gives it
up, which may leave others with one. If cells remain, both sketches are built again with twice the cells. The recovered
digests are the exact difference, so likeness is 1 - difference / (both sizes).

The edit that the query makes needs the next document: rows are sorted into ranges of ids, so the next one is the next
row, and the last row of each range takes the first text of the range that follows.

Defined cases: a null or empty text has no paragraphs, and two such texts have likeness 1; rows without an id come last;
equal ids are ordered by a hash of their text; a single row is its own next document; an empty table returns no rows;
other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import materialize, ship, small_slices, texts

CELLS = 12
LONG = 240
CHUNK = 120
ROWS = 256
OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_NAMES = [c.split()[0] for c in OUT.split(", ")]
_U = np.uint64


def _mix(h: np.ndarray, seed: int) -> np.ndarray:
    h = (h ^ _U(seed * 0x9E3779B97F4A7C15 % 2**64)) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(29))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(32))


def paragraphs(text: str) -> list[str]:
    out = []
    for p in text.replace(". ", ".\n").split("\n"):
        if len(p) > LONG:
            out += [p[i : i + CHUNK] for i in range(0, len(p), CHUNK)]
        elif p:
            out.append(p)
    return out


def digests(many: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text's place, digest) of all paragraphs; the n-th repetition within a text has a digest of its own."""
    import xxhash

    parts = [paragraphs(t) for t in many]
    own = np.repeat(np.arange(len(many)), [len(p) for p in parts])
    d = np.array([xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass")) for p in parts for x in p], _U)
    if len(d):
        order = np.lexsort((d, own))
        o, s = own[order], d[order]
        first = np.concatenate([[True], (o[1:] != o[:-1]) | (s[1:] != s[:-1])])
        at = np.arange(len(d))
        nth = at - np.maximum.accumulate(np.where(first, at, 0))
        again = nth > 0
        s[again] = _mix(s[again] + nth[again].astype(_U) * _U(0xD6E8FEB86659FD93), 99)
        own, d = o, s
    return own, d


class Sketches:
    """One sketch of `cells` cells for each of n texts."""

    def __init__(self, n: int, cells: int):
        self.n, self.cells = n, cells
        self.count, self.key, self.check = np.zeros(n * cells, np.int64), np.zeros(n * cells, _U), np.zeros(n * cells, _U)

    def add(self, own: np.ndarray, d: np.ndarray, sign: np.ndarray | int = 1) -> Sketches:
        third = self.cells // 3
        check = _mix(d, 7)
        for i in range(3):
            pos = own * self.cells + i * third + (_mix(d, self.cells * 3 + i) % _U(third)).astype(np.int64)
            np.add.at(self.count, pos, sign)
            np.bitwise_xor.at(self.key, pos, d)
            np.bitwise_xor.at(self.check, pos, check)
        return self

    def minus(self, other: Sketches) -> Sketches:
        out = Sketches(self.n, self.cells)
        out.count, out.key, out.check = self.count - other.count, self.key ^ other.key, self.check ^ other.check
        return out

    def peel(self) -> tuple[np.ndarray, np.ndarray]:
        """(recovered digests, all recovered) for each text; the sketches are used up."""
        found = np.zeros(self.n, np.int64)
        while True:
            at = np.flatnonzero((np.abs(self.count) == 1) & (self.check == _mix(self.key, 7)))
            if not len(at):
                break
            own, d, sign = at // self.cells, self.key[at], self.count[at]
            order = np.lexsort((d, own))  # an element may be alone in several of its cells
            own, d, sign = own[order], d[order], sign[order]
            keep = np.concatenate([[True], (own[1:] != own[:-1]) | (d[1:] != d[:-1])])
            own, d, sign = own[keep], d[keep], sign[keep]
            found += np.bincount(own, minlength=self.n)
            self.add(own, d, -sign)
        left = (self.count.reshape(self.n, -1) != 0).any(1) | (self.key.reshape(self.n, -1) != 0).any(1)
        return found, ~left

    def strings(self) -> list[str]:
        cell = np.zeros(self.n * self.cells, [("n", "<u2"), ("k", "<u8"), ("c", "<u4")])
        cell["n"], cell["k"], cell["c"] = self.count & 0xFFFF, self.key, self.check & _U(0xFFFFFFFF)
        raw, size = cell.tobytes(), 14 * self.cells
        return [base64.b64encode(raw[i * size : (i + 1) * size]).decode() for i in range(self.n)]


def likeness(n: int, a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """1 - size of the difference / size of both, for n pairs of digest sets."""
    both = np.bincount(a[0], minlength=n) + np.bincount(b[0], minlength=n)
    differ = np.zeros(n, np.int64)
    todo, cells = np.flatnonzero(both), CELLS
    while len(todo):
        place = np.full(n, -1)
        place[todo] = np.arange(len(todo))
        side = lambda x: Sketches(len(todo), cells).add(*(lambda m: (place[x[0][m]], x[1][m]))(place[x[0]] >= 0))  # noqa: B023, E731
        found, done = side(a).minus(side(b)).peel()
        differ[todo[done]] = found[done]
        todo, cells = todo[~done], 2 * cells
    return np.where(both > 0, 1 - differ / np.maximum(both, 1), 1.0)


def edited(text: str, nxt: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + nxt[:half]


def _results(ids: list, own: list[str], nxt: list[str]) -> pa.RecordBatch:
    new = [edited(a, b) for a, b in zip(own, nxt, strict=True)]
    n, a, b, c = len(own), digests(own), digests(new), digests(nxt)
    return pa.RecordBatch.from_arrays([
        pa.array(ids, pa.int64()), pa.array(list(map(len, own)), pa.int64()),
        pa.array([hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in new], pa.string()),
        pa.array(Sketches(n, CELLS).add(*a).strings(), pa.string()), pa.array(Sketches(n, CELLS).add(*b).strings(), pa.string()),
        pa.array(likeness(n, a, b), pa.float64()), pa.array(likeness(n, a, c), pa.float64())], names=_NAMES)


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results of all rows of a sorted range but the last; then a row with the range's first text and its last row."""
    first = last = None
    for batch in small_slices(batches, ROWS):
        ids, own = batch.column("doc_id").to_pylist(), texts(batch)
        if first is None:
            first = own[0] if own else None
        if last is not None:
            ids, own = [last[0], *ids], [last[1], *own]
        if len(own) > 1:
            yield _padded(_results(ids[:-1], own[:-1], own[1:]), None, None, None)
        if own:
            last = (ids[-1], own[-1])
    if last is not None:
        yield _padded(None, TaskContext.get().partitionId(), first, last)


def _padded(batch: pa.RecordBatch | None, part: int | None, first: str | None, last: tuple | None) -> pa.RecordBatch:
    schema = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    cols = list(batch.columns) if batch else [pa.array([last[0]], pa.int64()), *[pa.nulls(1, t) for t in schema[1:]]]
    n = len(cols[0])
    extra = [pa.array([v] * n, t) for v, t in ((part, pa.int32()), (first, pa.string()), (last and last[1], pa.string()))]
    return pa.RecordBatch.from_arrays([*cols, *extra], names=[*_NAMES, "part", "first", "last"])


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_slices(batches, ROWS):
        yield _results(batch.column("doc_id").to_pylist(), texts(batch, "last"), texts(batch, "nxt"))


def fingerprints(documents: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edit, and how alike they are."""
    ship(documents.sparkSession)
    order = [F.col("doc_id").desc_nulls_last(), F.col("h")]
    ranged = documents.select("doc_id", "text", F.xxhash64("text").alias("h")).repartitionByRange(*order).sortWithinPartitions(*order)
    done = materialize(ranged.mapInArrow(_ranges, f"{OUT}, part int, first string, last string"), "fingerprints")
    # ranges may be empty: each one's successor is settled on their numbers alone, and texts are joined to it
    ranges = materialize(done.filter("part is not null").select("part", "doc_id", "first", "last"), "ranges")
    w = Window.orderBy("part")
    after = ranges.select("part").withColumn("following", F.coalesce(
        F.lead("part").over(w), F.first("part").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    firsts = ranges.select(F.col("part").alias("following"), F.col("first").alias("nxt"))
    edges = ranges.select("part", "doc_id", "last").join(after, "part").join(firsts, "following").select("doc_id", "last", "nxt")
    return done.filter("part is null").select(*_NAMES).unionByName(edges.mapInArrow(_edges, OUT))
