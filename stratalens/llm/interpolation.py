"""Language-model scores by deleted interpolation.

P(w | v) mixes the maximum-likelihood bigram and unigram estimates and a uniform share. The mixture weights belong to
the bucket of the context's frequency (powers of two) and are learnt by expectation-maximisation: counts of a deleted
part of the training documents are predicted from counts of the rest; the counts of both then make the final model.

Counting is by batches, so that no row for each token is ever shuffled. A batch of documents is written once as an
encoded row: its distinct words' hashes and each token's place among them. Each batch learns the counts of its distinct words and
bigrams over all batches, by a fixed fan-out (see `_counts`). Joined with its batch again, that gives every token's
counts. All of it grows with the corpus and is spread over batches and ranges of hashes; only the histogram of
quantised estimates, bounded by its bins, reaches the driver for the learning of weights. Words and bigrams are known by 63-bit hashes.

Defined cases: a null or empty text is the end token alone; the first token's context is the end token; rows without an
id are training rows by the hash of the empty text; rows that repeat an id are scored each; an empty table returns no
rows; without training tokens every estimate is the uniform share; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._counts import packed, totals, trim, unpacked
from ._shared import VECTORED, materialize, setting, ship, shuffles_dropped, small_slices, texts

#: Characters of text in a batch.
BATCH_CHARS = 4_000_000
BUCKETS_OF_CONTEXT = 24
#: Steps of an octave to which estimates are rounded for the learning of weights.
STEPS = 8
ROUNDS = 40
OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
_ENCODED = "batch long, ids binary, words binary, tokens binary, ends binary, part binary"
_END = 0x7F4A7C15D6E8FEB8
_U = np.uint64


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    seq = 0
    ids: list = []
    place: dict[bytes, int] = {}
    tokens: list[np.ndarray] = []
    chars = 0

    def flush() -> pa.RecordBatch:
        nonlocal seq, chars
        words = np.array([xxhash.xxh3_64_intdigest(w) for w in place], _U)
        words = np.concatenate([[_U(_END)], words]) if len(words) else np.array([_END], _U)
        ends = np.cumsum([len(t) for t in tokens], dtype=np.int64)
        # of each document: 1 is held out, 4 is deleted from the counts that weights are learnt on
        part = np.array([zlib.crc32(b"" if i is None else str(i).encode()) % 5 for i in ids], np.uint8)
        known = np.array([i is not None for i in ids], np.int64)
        row = [(TaskContext.get().partitionId() << 32) + seq, packed(np.array([i or 0 for i in ids], np.int64)) , packed(words), packed(np.concatenate(tokens).astype(np.uint32)), packed(ends), packed(np.where(known == 1, part, part + 8).astype(np.uint8))]
        seq, chars = seq + 1, 0
        ids.clear(), place.clear(), tokens.clear()
        trim()
        return pa.RecordBatch.from_arrays([pa.array([v], pa.int64() if k == 0 else pa.binary()) for k, v in enumerate(row)], names=["batch", "ids", "words", "tokens", "ends", "part"])

    for batch in small_slices(batches):
        for i, text in zip(batch.column("doc_id").to_pylist(), texts(batch), strict=True):
            w = text.encode("utf-8", "surrogatepass").lower().split()
            for x in w:
                if x not in place:
                    place[x] = len(place) + 1
            t = np.zeros(len(w) + 1, np.int64)
            t[:-1] = [place[x] for x in w]
            tokens.append(t)
            ids.append(i)
            chars += len(text) + 1
            if chars >= BATCH_CHARS:
                yield flush()
    if ids:
        yield flush()


class _Batch:
    """A decoded batch; place 0 among its words is the end token."""

    def __init__(self, row: dict):
        self.key = row["batch"]
        self.ids, self.words = unpacked(row["ids"], "<i8"), unpacked(row["words"], "<u8")
        self.tokens, self.ends = unpacked(row["tokens"], "<u4").astype(np.int64), unpacked(row["ends"], "<i8")
        part = unpacked(row["part"], "u1")
        self.null, self.part = part >= 8, part % 8
        self.lengths = np.diff(self.ends, prepend=0)
        before = np.concatenate([[0], self.tokens[:-1]])
        before[np.concatenate([[0], self.ends[:-1]])] = 0
        self.pair, self.pair_of = np.unique(before * len(self.words) + self.tokens, return_inverse=True)
        self.own = np.repeat(self.part, self.lengths)
        v, w = self.pair // len(self.words), self.pair % len(self.words)
        h = (self.words[v] * _U(0x9E3779B97F4A7C15)) ^ (self.words[w] + _U(0x165667B19E3779F9))
        h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        self.pair_hash = h ^ (h >> _U(27)) * _U(0x94D049BB133111EB)
        self.v, self.w = v, w

    def kinds(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of words (below 2^63) and bigrams in one sorted list, and the place there of each word and bigram."""
        h = np.concatenate([self.words >> _U(1), self.pair_hash >> _U(1) | _U(1 << 63)])
        found, at = np.unique(h, return_inverse=True)
        return found, at.reshape(-1)

    def counts(self, of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(kept, deleted) training counts of n kinds."""
        kept = np.bincount(of[(self.own != 1) & (self.own != 4)], minlength=n)
        return kept, np.bincount(of[self.own == 4], minlength=n)


def _message(row: dict) -> tuple[np.ndarray, list[np.ndarray]]:
    """A batch's words and bigrams with their counts."""
    b = _Batch(row)
    h, at = b.kinds()
    counts = zip(b.counts(b.tokens, len(b.words)), b.counts(b.pair_of, len(b.pair)), strict=True)
    return h, [np.bincount(at, np.concatenate(x), len(h)).astype(np.uint64) for x in counts]


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each batch: an upper bound of its words and bigrams, and its training tokens, kept and deleted."""
    for rb in batches:
        for row in rb.to_pylist():
            part = np.repeat(unpacked(row["part"], "u1") % 8, np.diff(unpacked(row["ends"], "<i8"), prepend=0))
            yield pa.RecordBatch.from_arrays([pa.array([int(x)], pa.int64()) for x in (len(part), ((part != 1) & (part != 4)).sum(), (part == 4).sum())],
                                             names=["hashes", "n_kept", "n_deleted"])


def _known(b: _Batch, back: list[dict], columns: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of the batch's words and bigrams, of all `columns` together."""
    _, at = b.kinds()
    rows = sorted(back, key=lambda r: r["part"])
    found = sum(np.concatenate([unpacked(r[c], "<u8") for r in rows]).astype(np.int64) for c in columns)[at]
    return found[: len(b.words)], found[len(b.words) :]


def _context_bucket(c: np.ndarray) -> np.ndarray:
    return np.minimum(np.where(c > 0, np.floor(np.log2(np.maximum(c, 1))) + 1, 0), BUCKETS_OF_CONTEXT - 1).astype(np.int64)


def _estimates(b: _Batch, words: np.ndarray, pairs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Context bucket, bigram and unigram estimates of each distinct bigram."""
    c = words[b.v]
    return _context_bucket(c), pairs / np.maximum(c, 1), words[b.w] / max(n, 1)


def _histogram(n: int):
    """How often the deleted tokens have a (bucket, bigram estimate, unigram estimate), in rounded logarithms."""

    def run(_: tuple, encoded: pa.Table, back: pa.Table) -> pa.Table:
        trim()
        b = _Batch(encoded.to_pylist()[0])
        words, pairs = _known(b, back.to_pylist(), ("kept",))
        ctx, f2, f1 = _estimates(b, words, pairs, n)
        often = np.bincount(b.pair_of[b.own == 4], minlength=len(b.pair))
        q = lambda f: np.where(f > 0, np.round(np.log2(np.maximum(f, 1e-300)) * STEPS), -9999).astype(np.int64)
        rows, inv = np.unique(np.stack([ctx, q(f2), q(f1)], 1)[often > 0], axis=0, return_inverse=True)
        m = np.bincount(inv.reshape(-1), often[often > 0], len(rows)).astype(np.int64)
        return pa.table({"ctx": rows[:, 0], "q2": rows[:, 1], "q1": rows[:, 2], "m": m})

    return run


def learn_weights(rows: list[tuple[int, int, int, int]], vocabulary: int) -> np.ndarray:
    """Weights (bigram, unigram, uniform) of each context bucket by expectation-maximisation."""
    out = np.tile([0.3, 0.6, 0.1], (BUCKETS_OF_CONTEXT, 1))
    out[0] = [0.0, 0.9, 0.1]  # an unseen context has no bigram estimate
    data = np.array(rows, float).reshape(-1, 4)
    back = lambda q: np.where(q > -9999, 2.0 ** (np.maximum(q, -2000) / STEPS), 0.0)
    for ctx in range(BUCKETS_OF_CONTEXT):
        d = data[data[:, 0] == ctx]
        if not len(d):
            continue
        f = np.stack([back(d[:, 1]), back(d[:, 2]), np.full(len(d), 1 / (vocabulary + 1))], 1)
        w = out[ctx]
        for _ in range(ROUNDS):
            share = f * w
            w = (d[:, 3:] * share / share.sum(1, keepdims=True)).sum(0)
            w = (w + [0, 0, 1e-3]) / (w.sum() + 1e-3)  # the uniform share stays above 0
        out[ctx] = w
    return out


def _scores(n: int, vocabulary: int, weights: np.ndarray):
    def run(_: tuple, encoded: pa.Table, back: pa.Table) -> pa.Table:
        trim()
        b = _Batch(encoded.to_pylist()[0])
        words, pairs = _known(b, back.to_pylist(), ("kept", "deleted"))
        ctx, f2, f1 = _estimates(b, words, pairs, n)
        w = weights[ctx]
        logp = np.log10(w[:, 0] * f2 + w[:, 1] * f1 + w[:, 2] / (vocabulary + 1))
        base = np.log10((words + 0.5) / (n + 0.5 * (vocabulary + 1)))
        starts = np.concatenate([[0], b.ends[:-1]])
        total = lambda x: np.add.reduceat(x, starts)
        return pa.table({
            "doc_id": pa.array(b.ids, mask=b.null), "held_out": b.part == 1, "n_tokens": b.lengths,
            "n_known": total((words[b.tokens] > 0).astype(np.int64)), "train_tokens": np.full(len(b.ids), n, np.int64),
            "base_score": total(base[b.tokens]), "score": total(logp[b.pair_of])})

    return run


def lm_scores(documents: DataFrame) -> DataFrame:
    """The contract's columns of every row."""
    spark = documents.sparkSession
    ship(spark)
    both = lambda f, schema: encoded.groupBy("batch").cogroup(back.groupBy("batch")).applyInArrow(f, schema)
    plain = {VECTORED: "false"}  # for the scores too, which are computed after this function
    with shuffles_dropped(spark), setting(spark, VECTORED, "false"):
        encoded = materialize(documents.select("doc_id", "text").mapInArrow(_encode, _ENCODED), "lm-batches", **plain)
        n_batches, hashes, n_kept, n_deleted = encoded.select("part", "ends").mapInArrow(_sizes, "hashes long, n_kept long, n_deleted long").agg(
            F.count("*"), *[F.coalesce(F.sum(c), F.lit(0)) for c in ("hashes", "n_kept", "n_deleted")]).first()
        back = materialize(totals(encoded, ["kept", "deleted"], hashes, n_batches, _message), "lm-counts", **plain)
        n, vocabulary = n_kept + n_deleted, int(back.agg(F.coalesce(F.sum("kinds"), F.lit(0))).first()[0])
        # at most BUCKETS_OF_CONTEXT x (bins of an estimate) ^ 2 rows; in practice some thousands
        hist = both(_histogram(n_kept), "ctx long, q2 long, q1 long, m long").groupBy("ctx", "q2", "q1").agg(F.sum("m").alias("m")).orderBy("ctx", "q2", "q1")
        weights = learn_weights([tuple(r) for r in hist.collect()], vocabulary)
    return both(_scores(n, vocabulary, weights), OUT)
