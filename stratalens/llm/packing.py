"""Pack token sequences: first-fit decreasing with a tournament tree of bin capacities, in randomised groups.

A document's ids (and one end id) are cut into pieces of `capacity` and a remainder. Whole pieces are sequences of
their own. Remainders are dealt to groups by a hash of their document, salted with the piece's digest, so that a group
holds a bounded number of them whatever the input's size; each group is packed alone: longest first, into the first bin
with room, found by walking down a tournament tree over the bins' free room.

Defined cases: a null or empty text is the end id alone; rows with the same id or text are documents of their own; a
null id packs like any other; an empty table returns no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import materialize, ship, small_slices, texts

CAPACITY = 1024
GROUP_PIECES = 8192
END_ID = 0
CACHE_WORDS = 300_000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class Encoder:
    """Byte-level BPE ids as little-endian 32-bit bytes.

    No token crosses a space between two characters that are not white space, so that texts are encoded in such parts
    and a bounded table keeps the parts' ids. Other texts, and those with the special token's string, are encoded whole.
    """

    def __init__(self, name: str = "byte_bpe_50k"):
        import base64

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.part = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.kept: dict[str, bytes] = {}

    def _missing(self, parts: list[str]) -> bool:
        """Encode the parts that the table lacks; False if one of them has white space at an edge."""
        for p in parts:
            if p not in self.kept:
                if not p or p[0].isspace() or p[-1].isspace():
                    return False
                self.kept[p] = np.array(self.part.encode_ordinary(" " + p), "<u4").tobytes()
        return True

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if any(s in text for s in self.special):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if len(self.kept) > CACHE_WORDS:
            self.kept.clear()
        first, *parts = text.split(" ")
        if not first or first[0].isspace() or first[-1].isspace():
            return np.array(self.part.encode_ordinary(text), "<u4").tobytes()
        head = np.array(self.part.encode_ordinary(first), "<u4").tobytes()
        try:
            return head + b"".join(map(self.kept.__getitem__, parts))
        except KeyError:
            if self._missing(parts):
                return head + b"".join(map(self.kept.__getitem__, parts))
        return np.array(self.part.encode_ordinary(text), "<u4").tobytes()


_ENCODERS: dict[str, Encoder] = {}


def encoder(name: str = "byte_bpe_50k") -> Encoder:
    """One for each Python worker, which runs many tasks."""
    if name not in _ENCODERS:
        _ENCODERS[name] = Encoder(name)
    return _ENCODERS[name]


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    enc, end = encoder(), np.array([END_ID], "<u4").tobytes()
    for batch in small_slices(batches, 1024):
        rows: tuple[list, ...] = ([], [], [], [], [])
        for doc, text in zip(batch.column("doc_id").to_pylist(), texts(batch), strict=True):
            ids = enc.encode(text) + end
            n = len(ids) // 4
            for at in range(0, n, CAPACITY):
                part = ids[4 * at : 4 * (at + CAPACITY)]
                for col, v in zip(rows, (doc, at, len(part) // 4, zlib.crc32(part), n), strict=True):
                    col.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in rows], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])


def first_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each item; items longest first, ties by place; each goes to the first bin with room."""
    n = len(lengths)
    size = 1
    while size < max(n, 1):
        size *= 2
    room = [capacity] * (2 * size)  # a node's value is the most room below it; leaves are bins
    where, offset = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in np.argsort(-lengths, kind="stable").tolist():
        need, node = int(lengths[i]), 1
        while node < size:
            node *= 2
            if room[node] < need:
                node += 1
        where[i], offset[i] = node - size, capacity - room[node]
        room[node] -= need
        node //= 2
        while node:
            best = room[2 * node] if room[2 * node] >= room[2 * node + 1] else room[2 * node + 1]
            if room[node] == best:
                break
            room[node] = best
            node //= 2
    return where, offset


def _pack_group(table: pa.Table) -> pa.Table:
    if not table.num_rows:
        return table
    table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
    where, offset = first_fit_decreasing(table.column("length").to_numpy())
    return table.append_column("bin", pa.array(where)).append_column("offset", pa.array(offset))


def pack(documents: DataFrame, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of each piece."""
    spark = documents.sparkSession
    ship(spark)
    cut = materialize(documents.select("doc_id", "text").mapInArrow(_pieces, PIECES), "pieces")
    rest = cut.filter(F.col("length") < CAPACITY)
    full = cut.filter(F.col("length") == CAPACITY)
    groups = max(1, -(-rest.count() // group_pieces))
    # the salt deals out rows that share an id; the piece's place in its task tells equal rows apart
    key = F.xxhash64("doc_id", "ids_crc32", "doc_tokens", F.monotonically_increasing_id() % 1024)
    packed = rest.withColumn("grp", F.pmod(key, F.lit(groups))).groupBy("grp").applyInArrow(
        _pack_group, f"{PIECES}, grp long, bin long, offset long")
    # sequence ids: group * stride + bin; whole pieces follow in numbers of their own, beyond all groups
    stride = 1 << 32
    packed = packed.select(*_names(), (F.col("grp") * stride + F.col("bin")).alias("sequence_id"), "offset")
    alone = full.select(*_names(), (F.lit(1 << 62) + F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(alone)


def _names() -> list[str]:
    return [c.split()[0] for c in PIECES.split(", ")]
