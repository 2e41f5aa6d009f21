"""Toxicity scores over text restored by a noisy-channel decoder.

A character trigram model is counted over the words of all documents. Words that hide letters (digits or signs among
them, letters set apart by single spaces, or runs of one letter) are restored by Viterbi search over a lattice of what
each character may stand for: itself, a letter it looks like, nothing (a separator), or a repetition of the letter
before. A logistic model over words and word beginnings then scores the restored words.

Labels are learnt from a bounded sample of the labelled rows that may be used (`labelled_rows`); neither ids nor other
columns are inputs. A token above `MAX_DECODED` characters that hides letters is decoded in overlapping windows, without
its separators and with its runs shortened; any word of up to `LONGEST` letters, each of them doubled or with a sign
behind it, lies whole in a window. Texts are read whole.

Defined cases: a null or empty text gets the score of the bias alone; rows that repeat an id each return; labels
without a row or document are ignored; without any toxic label every score is the smoothed share of toxic labels; an
empty table returns no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import hash_bucket, materialize, ship, small_slices, texts

THRESHOLD = 0.3
LABELLED_ROWS = 50_000
FEATURES = 4_096
#: Least G statistic of a feature.
MIN_GAIN = 24.0
#: Most features that are sent to all tasks for counting; more are joined.
SENT_FEATURES = 200_000
MAX_DECODED = 32
#: Letters of the longest word that is looked for where words have no bounds.
LONGEST = 14
PREFIXES = range(3, 8)
CACHE_WORDS = 300_000

# The alphabet of the character model, and the letters that signs may stand for.
LETTERS = "abcdefghijklmnopqrstuvwxyzàáâãäåæçèéêëìíîïñòóôõöøùúûüýÿßœ"
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "¡": "i", "(": "c", "<": "c",
}
_EDGES = ".,;:?\"'()[]{}#*%&<>_-~=/\\`^…«»“”„’"
_ALPHABET = frozenset(LETTERS)
#: Log probabilities of the channel.
_SAME, _LOOK, _GAP, _SIGN_GAP, _REPEAT = (math.log(p) for p in (0.9, 0.5, 0.5, 1e-4, 0.02))


class CharModel:
    """Interpolated trigram model; ^ stands for the two places before a word, $ for its end."""

    def __init__(self, trigrams: dict[str, int]):
        tri, bi, uni = Counter(), Counter(), Counter()
        for g, n in trigrams.items():
            tri[g] += n
            bi[g[1:]] += n
            uni[g[2]] += n
        tri_of, bi_of = Counter(), Counter()
        for g, n in tri.items():
            tri_of[g[:2]] += n
        for g, n in bi.items():
            bi_of[g[0]] += n
        self.tri, self.bi, self.uni, self.tri_of, self.bi_of, self.total = tri, bi, uni, tri_of, bi_of, sum(uni.values())
        self.known: dict[str, float] = {}

    def logp(self, context: str, c: str) -> float:
        g = context + c
        if g not in self.known:
            p = 0.7 * self.tri[g] / max(1, self.tri_of[context]) + 0.25 * self.bi[g[1:]] / max(1, self.bi_of[g[1]])
            self.known[g] = math.log(p + 0.05 * (self.uni[c] + 1) / (self.total + len(LETTERS) + 1))
        return self.known[g]

    def decode(self, token: str, best: int = 3) -> list[str]:
        """The `best` most likely words behind a token, by Viterbi search over the last two letters."""
        states = {"^^": [(0.0, "")]}
        for c in token.lower():
            nxt: dict[str, list[tuple[float, str]]] = {}

            def put(score: float, word: str, letter: str, ctx: str, nxt: dict = nxt) -> None:
                if letter:
                    score, word, ctx = score + self.logp(ctx, letter), word + letter, ctx[1] + letter
                nxt.setdefault(ctx, []).append((score, word))

            for ctx, kept in states.items():
                for score, word in kept:
                    if c in _ALPHABET:
                        put(score + _SAME, word, c, ctx)
                        if word and word[-1] == c:
                            put(score + _REPEAT, word, "", ctx)
                    else:
                        looks = LOOKALIKES.get(c, "")
                        for x in looks:
                            put(score + _LOOK, word, x, ctx)
                            if word and word[-1] == x:
                                put(score + _REPEAT, word, "", ctx)
                        put(score + (_SIGN_GAP if looks else _GAP), word, "", ctx)
            states = {ctx: sorted(set(kept), reverse=True)[:best] for ctx, kept in nxt.items()}
        found = sorted(((s + self.logp(ctx, "$"), w) for ctx, kept in states.items() for s, w in kept if w), reverse=True)
        return list(dict.fromkeys(w for _, w in found))[:best]


_THREE = re.compile(r"(.)\1\1", re.DOTALL).search


class Restorer:
    """Restored words of a text, with a bounded table of what tokens stand for."""

    def __init__(self, model: CharModel):
        self.model = model
        self.kept: dict[str, tuple[str, ...]] = {}

    def token(self, token: str) -> tuple[str, ...]:
        w = token.lower()
        if not w.isalpha():
            w = w.strip(_EDGES)
            if len(w) > 2 and w[-1] in "!$" and w[-1] == w[-2]:
                w = w.rstrip("!$")
        if not w:
            return ()
        if w.isalpha() and not _THREE(w):
            return (w,)
        return (*self.model.decode(w),) if len(w) <= MAX_DECODED else (w, *sorted(self._unbounded(w)))

    def words(self, text: str) -> set[str]:
        if len(self.kept) > CACHE_WORDS:
            self.kept.clear()
        tokens = text.lower().split()
        distinct = set(tokens)
        kept = self.kept
        out = self.spelled(tokens, distinct)
        for t in distinct:
            if t.isalpha() and not _THREE(t):
                out.add(t)
                continue
            found = kept.get(t)
            if found is None:
                found = self.token(t)
                if len(t) <= MAX_DECODED:  # longer ones may stand for many words
                    kept[t] = found
            out.update(found)
        return out

    def spelled(self, tokens: list[str], distinct: set[str]) -> set[str]:
        """Words that runs of single characters spell; `distinct`: the set of the tokens."""
        out: set[str] = set()
        run: list[str] = []
        if not _ONE.isdisjoint(distinct):
            for t in [*tokens, ""]:
                if len(t) == 1:
                    run.append(t)
                else:
                    if len(run) >= 4:
                        out.update(self._spaced("".join(run)))
                    run.clear()
        return out

    def _spaced(self, run: str, width: int = MAX_DECODED) -> set[str]:
        """Words that single characters spell, wherever they begin and end."""
        out = set()
        for at in range(0, len(run), width // 2):
            for w in self.model.decode(run[at : at + width], 1):
                out |= {w[i:j] for i in range(len(w)) for j in range(i + 4, min(len(w), i + LONGEST) + 1)}
        return out

    def _unbounded(self, token: str) -> set[str]:
        """Words behind a long token. Characters that can only be separators go; a run stands for one letter or two."""
        out: set[str] = set()
        said = "".join(c for c in token if c in _ALPHABET or c in LOOKALIKES)
        for run in {_RUN.sub(r"\1", said), _RUN.sub(r"\1\1", said)}:
            out |= self._spaced(run, 2 * MAX_DECODED)
            if len(run) <= MAX_DECODED:
                out.update(self.model.decode(run))
        return out


_RUN = re.compile(r"(.)\1+", re.DOTALL)
_ONE = frozenset([*LETTERS, *LETTERS.upper(), *LOOKALIKES])


def features(words: Iterable[str]) -> Iterator[str]:
    """A word, and the beginnings of longer ones."""
    for w in words:
        yield w
        for n in PREFIXES:
            if len(w) > n:
                yield w[:n] + "*"


class _Trigrams:
    """Counts the character trigrams of words, by array operations over whole texts.

    A word counts if it is letters alone once the signs of _STRIPPED are taken from its ends.
    """

    def __init__(self) -> None:
        # class of each code point: 0 other, 1 white space, 2 stripped sign, 3 + place of a letter
        self.kind = np.zeros(0x110000, np.uint8)
        self.kind[[c for c in range(0x3001) if chr(c).isspace()]] = 1
        self.kind[[ord(c) for c in _STRIPPED]] = 2
        self.kind[[ord(c) for c in LETTERS]] = np.arange(len(LETTERS)) + 3
        self.side = len(LETTERS) + 2
        self.counts = np.zeros(self.side**3, np.int64)

    def add(self, found: list[str]) -> None:
        if not found:
            return
        k = self.kind[np.frombuffer(f" {' '.join(found)} ".lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
        letter = k >= 3
        edge = np.flatnonzero(letter[1:] != letter[:-1]) + 1
        start, end = edge[::2], edge[1::2]  # of each run of letters
        spaces = np.flatnonzero(k == 1)
        in_word = np.concatenate([[0], np.cumsum((k == 0) | letter)])
        before, after = spaces[np.searchsorted(spaces, start) - 1], spaces[np.searchsorted(spaces, end)]
        fine = (in_word[start] == in_word[before]) & (in_word[end] == in_word[after])
        start, end = start[fine], end[fine]
        lengths = end - start
        if not len(lengths):
            return
        # each word with two marks before it and one behind, one after the other
        at = np.cumsum(lengths + 3) - (lengths + 3)
        chars = np.full(int((lengths + 3).sum()), self.side - 2, np.int64)
        shift = np.repeat(at + 2 - start, lengths)
        source = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(start, lengths)
        chars[source + shift] = k[source].astype(np.int64) - 3
        chars[at + lengths + 2] = self.side - 1
        codes = (chars[:-2] * self.side + chars[1:-1]) * self.side + chars[2:]
        whole = np.ones(len(chars), bool)
        whole[at], whole[at + 1] = False, False  # trigrams end in a letter or in the mark behind
        self.counts += np.bincount(codes[whole[2:]], minlength=len(self.counts))

    def rows(self) -> pa.RecordBatch:
        marks = LETTERS + "^$"
        at = np.flatnonzero(self.counts)
        grams = [marks[c // self.side**2] + marks[c // self.side % self.side] + marks[c % self.side] for c in at.tolist()]
        return pa.RecordBatch.from_arrays([pa.array(grams, pa.string()), pa.array(self.counts[at], pa.int64())], names=["g", "n"])


_STRIPPED = ".,;:?!\"'"


def count_trigrams(documents: DataFrame) -> dict[str, int]:
    """Character trigrams of all documents' words; at most (letters + 2) ^ 3 of them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = _Trigrams()
        for batch in small_slices(batches):
            grams.add(texts(batch))
        yield grams.rows()

    rows = documents.select("text").mapInArrow(count, "g string, n long").groupBy("g").agg(F.sum("n").alias("n"))
    return {r.g: r.n for r in rows.collect()}


@dataclass
class ToxicModel:
    trigrams: dict[str, int]
    bias: float
    weights: dict[str, float] = field(default_factory=dict)


def _fit(idx: np.ndarray, lengths: np.ndarray, y: np.ndarray, times: np.ndarray, n: int, steps: int = 400, l2: float = 0.05) -> tuple[float, np.ndarray]:
    """Logistic regression over presences, by gradient steps with momentum and one step size for each weight.

    Row i has `lengths[i]` features in a row of `idx`, the label y[i], and stands for times[i] documents.
    """
    some = np.flatnonzero(lengths)  # rows without features have the bias alone
    starts = (np.cumsum(lengths) - lengths)[some]
    own = np.repeat(np.arange(len(lengths)), lengths)
    y, times = y.astype(float), times.astype(float)
    w, b = np.zeros(n), math.log((times @ y + 1) / (times @ (1 - y) + 1))
    scale = 4 / (np.bincount(idx, times[own], minlength=n) + l2)
    vel, vel_b, z = np.zeros(n), 0.0, np.zeros(len(y))
    for _ in range(steps):
        if len(some):
            z[some] = np.add.reduceat(w[idx], starts)
        p = 1 / (1 + np.exp(-np.clip(b + z, -30, 30)))
        vel = 0.8 * vel - 0.1 * scale * (np.bincount(idx, (times * (p - y))[own], minlength=n) + l2 * w)
        vel_b = 0.8 * vel_b - 0.1 * 4 * (times @ (p - y)) / times.sum()
        w, b = w + vel, b + vel_b
        if max(np.abs(vel).max(initial=0.0), abs(vel_b)) < 1e-4:
            break
    return b, w


def train(documents: DataFrame, labels: DataFrame, labelled_rows: int = LABELLED_ROWS) -> ToxicModel:
    """Fit on labelled rows whose crc32(doc_id as text) mod 4 is not 2."""
    spark = documents.sparkSession
    ship(spark)
    trigrams = count_trigrams(documents)
    usable = labels.filter(~hash_bucket("doc_id", 2, 4) & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    # bounded by labelled_rows, so it may go to every executor
    sample = usable.groupBy("doc_id").agg(F.max("toxic").alias("y")).orderBy(F.xxhash64("doc_id")).limit(labelled_rows)
    shared = spark.sparkContext.broadcast(trigrams)

    def restore(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = Restorer(CharModel(shared.value))
        for batch in small_slices(batches):
            words = [sorted(r.words(t)) for t in texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(words, pa.list_(pa.string()))], names=["y", "ws"])

    labelled = documents.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select(F.col("y").cast("int").alias("y"), "text")
    labelled = materialize(labelled.mapInArrow(restore, "y int, ws array<string>"), "labelled")
    n, n_pos = labelled.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    prior = math.log((n_pos + 1) / (n - n_pos + 1))
    if not n_pos:
        return ToxicModel(trigrams, prior)

    def count(y: int, among: frozenset[str] | None = None) -> DataFrame:
        """f, n: rows with a feature, in parts; only features in `among`, if it is given."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: Counter[str] = Counter()
            known = None if among is None else _Known(among)
            for batch in small_slices(batches):
                for ws in batch.column("ws").to_pylist():
                    if among is None:
                        seen.update(set(features(ws)))
                    else:
                        seen.update({f for w in ws for f in known[w]})
                if len(seen) > 4 * CACHE_WORDS:
                    yield flush(seen)
            yield flush(seen)

        def flush(seen: Counter[str]) -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["f", "n"])
            seen.clear()
            return out

        return labelled.filter(F.col("y") == y).select("ws").mapInArrow(run, "f string, n long")

    # every feature of three toxic rows or more is weighed; only the best reach the driver
    pos = materialize(count(1).groupBy("f").agg(F.sum("n").alias("pos")).filter("pos >= 3"), "toxic-features")
    if pos.limit(SENT_FEATURES + 1).count() <= SENT_FEATURES:
        others = count(0, frozenset(pos.select("f").toArrow().column("f").to_pylist()))
    else:
        others = count(0).join(pos, "f", "left_semi")
    neg = others.groupBy("f").agg(F.sum("n").alias("neg"))
    both = pos.join(neg, "f", "left").select("f", "pos", F.coalesce("neg", F.lit(0)).alias("neg"))
    gains = both.withColumn("gain", _gain(F.col("pos"), F.col("neg"), n_pos, n - n_pos)).filter(F.col("gain") > MIN_GAIN)
    chosen = [r.f for r in gains.orderBy(F.desc("gain"), "f").limit(FEATURES).select("f").collect()]
    place = {f: i for i, f in enumerate(chosen)}

    def represent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Known(place)
        for batch in small_slices(batches):
            rows = [sorted({place[f] for w in ws for f in known[w]}) for ws in batch.column("ws").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(rows, pa.list_(pa.int64()))], names=["y", "x"])

    # equal rows are one row with a count; most have no feature at all
    same = labelled.mapInArrow(represent, "y int, x array<long>").groupBy("y", "x").agg(F.count("*").alias("n")).orderBy("y", "x").toArrow()
    x = same.column("x").combine_chunks()
    bias, weights = _fit(x.flatten().to_numpy(), np.diff(x.offsets.to_numpy()), same.column("y").to_numpy(), same.column("n").to_numpy(), len(chosen))
    return ToxicModel(trigrams, bias, {f: float(weights[i]) for f, i in place.items() if abs(weights[i]) > 1e-6})


def _firsts(found: Iterable[str]) -> frozenset[str]:
    """The first three letters of features: a word has one of them only if it begins so."""
    return frozenset(f[:3] for f in found)


class _Known(dict):
    """word -> those of its features that are in `among`; bounded."""

    def __init__(self, among: Iterable[str]):
        super().__init__()
        self.among = among if isinstance(among, (dict, frozenset)) else frozenset(among)
        self.firsts = _firsts(self.among)

    def __missing__(self, w: str) -> tuple[str, ...]:
        if len(self) > CACHE_WORDS:
            self.clear()
        found = self[w] = tuple(f for f in features((w,)) if f in self.among) if w[:3] in self.firsts else ()
        return found


def _gain(pos: Column, neg: Column, n_pos: int, n_neg: int) -> Column:
    """Signed G statistic of a presence; positive where toxic texts have it more often."""
    n, k = n_pos + n_neg, pos + neg
    cells = ((pos, n_pos * k), (neg, n_neg * k), (n_pos - pos, n_pos * (n - k)), (n_neg - neg, n_neg * (n - k)))
    total = sum((F.when((o > 0) & (e > 0), o * F.log(o * float(n) / e)).otherwise(0.0) for o, e in cells), F.lit(0.0))
    return F.when(pos * n_neg <= neg * n_pos, 0.0).otherwise(2 * total)


class _Scorer:
    """Sums weights over the distinct restored words of a text. Tokens without a weight are remembered as a set."""

    def __init__(self, model: ToxicModel):
        self.restorer, self.model = Restorer(CharModel(model.trigrams)), model
        self.weighty: dict[str, tuple[str, ...]] = {}
        self.plain: set[str] = set()
        self.firsts = _firsts(model.weights)

    def _weighted(self, words: Iterable[str]) -> tuple[str, ...]:
        return tuple(f for w in words if w[:3] in self.firsts for f in features((w,)) if f in self.model.weights)

    def score(self, text: str) -> float:
        if len(self.weighty) + len(self.plain) > CACHE_WORDS:
            self.weighty.clear()
            self.plain.clear()
        tokens = text.lower().split()
        distinct = set(tokens)
        hits = set(self._weighted(self.restorer.spelled(tokens, distinct)))
        new = distinct - self.plain
        odd = [t for t in new if t[:3] in self.firsts or not t.isalpha() or _THREE(t)]
        self.plain |= new.difference(odd)
        for t in odd:
            found = self.weighty.get(t)
            if found is None:
                found = self._weighted(self.restorer.token(t))
                if not found:
                    self.plain.add(t)
                    continue
                self.weighty[t] = found
            hits.update(found)
        z = self.model.bias + sum(self.model.weights[f] for f in sorted(hits))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def score(documents: DataFrame, model: ToxicModel) -> DataFrame:
    """All columns of `documents`, and `score`."""
    spark = documents.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)
    cols = documents.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = _Scorer(shared.value)
        for batch in small_slices(batches):
            scores = pa.array([s.score(t) for t in texts(batch)], pa.float64())
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(cols))], scores], names=[*cols, "score"])

    from pyspark.sql import types as T

    return documents.mapInArrow(run, T.StructType([*documents.schema.fields, T.StructField("score", T.DoubleType())]))


def toxicity(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    scored = score(documents.select("doc_id", "text"), train(documents, labels))
    return scored.select(
        "doc_id", hash_bucket("doc_id", 2, 4).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def without_toxic(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows that score below the threshold; the other columns may have any names."""
    cols = {c: f"c{i}" for i, c in enumerate(documents.columns)}
    named = documents.select(*[F.col(f"`{c}`").alias("text" if c == "text" else n) for c, n in cols.items()])
    kept = score(named, train(documents, labels)).filter(F.col("score") < THRESHOLD)
    return kept.select(*[F.col("text" if c == "text" else n).alias(c) for c, n in cols.items()])
