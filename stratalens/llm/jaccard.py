"""N-gram Jaccard join by prefix filters under several global token orders.

A document's set holds its distinct 5-word shingles as 64-bit hashes. Two sets with a Jaccard similarity of t or more
share a token among the first n - ceil(t n) + 1 of each, under any one order of all tokens. Three orders are used:

1. rarity among the sets that are left, then hash. It makes the candidates.
2. ascending hash and 3. descending hash: their prefixes are the ends of the sorted set.

A candidate pair must share prefix tokens under all three; that is settled on pairs of ids and the prefixes, and only the
pairs that remain read whole sets. A pair's prefixes are as short as its two sizes allow.

A set of which more than n - ceil(t n) tokens stand in no other set has no partner. Two rounds find such sets: the
first counts the lowest 3/8 of the hash space over all documents, the second counts all tokens of the sets that
are left. Counting goes by batches of documents (see `_counts`); texts are turned into sets in the first round, and again
for those that are left, so that the sets of all documents are never stored.

All pairs of a large group are never made. Every token first pairs its documents with two leaders, one of them the document
in whose prefix it stands first (that with the fewest rare tokens, which stands near a group's centre); the verified links
give components. In each round after that, a token pairs the documents outside its largest component with a few random
members of it, until few are left. Last, each token pairs all documents of different components: the members of its
largest component are not paired with each other, as their links cannot change the result. What is left out is a link
inside a component. A join row is made only if the two sets' parity bitmaps differ in no more bits than linked sets can: each token flips
one bit, so that the sets' symmetric difference has at least as many tokens as the bitmaps have differing bits. No link is lost by this.

Equal texts form one class, found by a 128-bit hash; copies are set aside before shingling. A key (text or token) that holds more
than a thousandth of all rows is joined by broadcast: there are fewer than a thousand of them, so no task gets a hot key.
Hash collisions (2^-64 a pair of tokens, 2^-128 a pair of texts) are the only source of error.

Defined cases: null texts and texts without words have an empty set and are linked with nothing, themselves included;
texts with fewer than five words have one shingle; rows that repeat an id are nodes of their own where their texts
differ; an empty table returns no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._counts import packed, packed_hashes, totals, unpacked, unpacked_hashes
from ._shared import BROADCAST_IDS, materialize, release, ship, small_slices, texts

SHINGLE = 5
#: Similarity in hundredths.
THRESHOLD = 75
#: Hashes below this are counted in the first round.
CLASS_0 = -(1 << 63) + 3 * (1 << 61)
#: Tokens in a batch.
BATCH_TOKENS = 1 << 20
LEADERS = 2
#: Most rounds of more leaders for what is left over, and how many in each; they go on while a left-over row has more than FEW partners.
ROUNDS = 4
MEMBERS = 4
FEW = 8
#: A key with more than this share of all rows is hot; so there are fewer than this many.
HOT_KEYS = 1000
#: 64-bit words of a set's parity bitmap.
BITMAP = 8
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
_TOP = np.uint64(1 << 63)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 100_000:  # workers keep it from task to task
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


_HASHES = _Hashes()


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str) -> np.ndarray:
    """Sorted distinct hashes (signed) of a text's shingles. bytes.lower() and bytes.split() know ASCII alone."""
    w = text.encode("utf-8", "surrogatepass").lower().split()
    a = np.fromiter(map(_HASHES.__getitem__, w), np.uint64, len(w))
    if not w:
        return np.zeros(0, np.int64)
    if len(w) < SHINGLE:
        return _mixed((a * _ODD[: len(w)]).sum(keepdims=True) + np.uint64(len(w))).view(np.int64)
    n = len(w) - SHINGLE + 1
    h = a[:n] * _ODD[0]
    for i in range(1, SHINGLE):
        h = h + a[i : i + n] * _ODD[i]
    return np.unique(_mixed(h).view(np.int64))


def prefix_length(n):
    """Tokens in the prefix of a set of n tokens; of each, for an array."""
    return n - -(-THRESHOLD * n // 100) + 1


def bitmap(s: np.ndarray) -> np.ndarray:
    """Parity of the tokens that fall on each bit."""
    parity = np.bincount((s & (64 * BITMAP - 1)).astype(np.int64), minlength=64 * BITMAP) & 1
    return np.packbits(parity.astype(np.uint8)).view(np.int64)


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, parts)], dtype=np.int64).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64)))


_BATCH = "batch long, tokens long, ids binary, n binary, e binary, place binary, h binary, c binary"


def _batched(docs: Iterable[tuple[bytes, int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Rows of _BATCH from (id, size of the set, sorted tokens that count) of each document; an id counts once in a batch.

    ids, n: of each document; e: how many of its tokens count; place: of each of these among the batch's distinct tokens h;
    c: how many documents have each of h.
    """
    seq, kept, held = 0, {}, 0

    def flush() -> pa.RecordBatch:
        nonlocal seq, held
        tokens = np.concatenate([t for _, t in kept.values()]) if kept else np.zeros(0, np.int64)
        h, place, c = np.unique(tokens.view(np.uint64) ^ _TOP, return_inverse=True, return_counts=True)
        row = [(TaskContext.get().partitionId() << 32) + seq, len(h), b"".join(kept), packed(np.array([n for n, _ in kept.values()], np.int64)),
               packed(np.array([len(t) for _, t in kept.values()], np.int64)), packed(place.astype(np.uint32)), packed_hashes(h), packed(c.astype(np.uint64))]
        seq, held = seq + 1, 0
        kept.clear()
        return pa.RecordBatch.from_arrays([pa.array([v], pa.int64() if i < 2 else pa.binary()) for i, v in enumerate(row)], names=[x.split()[0] for x in _BATCH.split(", ")])

    for key, n, tokens in docs:
        if key not in kept:
            kept[key] = (n, tokens)
            held += len(tokens)
            if held >= BATCH_TOKENS:
                yield flush()
    if kept:
        yield flush()


def _text_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def docs() -> Iterator[tuple[bytes, int, np.ndarray]]:
        for batch in small_slices(batches):
            for k, t in zip(batch.column("k").to_pylist(), texts(batch), strict=True):
                s = shingles(t)
                yield k, len(s), s[: np.searchsorted(s, CLASS_0)].copy()

    yield from _batched(docs())


def _set_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def docs() -> Iterator[tuple[bytes, int, np.ndarray]]:
        for batch in small_slices(batches):
            ids, sets = batch.column("id").to_pylist(), batch.column("s")
            for i, x in enumerate(ids):
                s = sets[i].values.to_numpy()
                yield x.to_bytes(8, "little"), len(s), s

    yield from _batched(docs())


def _sums(batches: DataFrame) -> DataFrame:
    n, tokens = batches.agg(F.count("*"), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    return totals(batches, ["c"], tokens, n)


def _counted(encoded: pa.Table, back: pa.Table) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """ids, n, own (the document of each token), place, and the number of documents that have each token."""
    row = encoded.to_pylist()[0]
    pieces = sorted(zip(back.column("part").to_pylist(), back.column("c").to_pylist(), strict=True))
    df = np.concatenate([np.zeros(0, np.uint64), *[unpacked(c, "<u8") for _, c in pieces]])
    n, e, place = unpacked(row["n"], "<i8"), unpacked(row["e"], "<i8"), unpacked(row["place"], "<u4").astype(np.int64)
    return row["ids"], n, np.repeat(np.arange(len(n)), e), place, df


def _partnerless(n: np.ndarray, own: np.ndarray, df: np.ndarray) -> np.ndarray:
    """True for the sets of which more tokens are in no other set than a linked one can have."""
    return np.bincount(own[df == 1], minlength=len(n)) >= prefix_length(n)


def _first_round(_: tuple, encoded: pa.Table, back: pa.Table) -> pa.Table:
    ids, n, own, place, df = _counted(encoded, back)
    return pa.table({"k": pa.array([ids[i : i + 16] for i in range(0, len(ids), 16)], pa.binary()), "n": n, "left": (n > 0) & ~_partnerless(n, own, df[place])})


def _second_round(_: tuple, encoded: pa.Table, back: pa.Table) -> pa.Table:
    """tok, id, n, r: the shared tokens in the prefixes of order 1, and their places there."""
    ids, n, own, place, df = _counted(encoded, back)
    h = (unpacked_hashes(encoded.column("h")[0].as_py()) ^ _TOP).view(np.int64)
    often = df[place]
    out = _partnerless(n, own, often)
    order = np.lexsort((place, often, own))  # the places of h ascend with the tokens
    own, place, often = own[order], place[order], often[order]
    r = np.arange(len(own)) - np.searchsorted(own, own) + 1
    m = (r <= prefix_length(n)[own]) & (often > 1) & ~out[own]
    return pa.table({"tok": h[place[m]], "id": np.frombuffer(ids, "<i8")[own[m]], "n": n[own[m]].astype(np.int32), "r": r[m].astype(np.int32)})


def _joined(batches: DataFrame, of, schema: str) -> DataFrame:
    """`of` each batch and the counts of its tokens over all batches."""
    cols = [c for c in batches.columns if c not in ("c", "tokens") and (c != "h" or of is _second_round)]
    return batches.select(*cols).groupBy("batch").cogroup(_sums(batches).select("batch", "part", "c").groupBy("batch")).applyInArrow(of, schema)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """k, n, s, lo, hi, bits: a text's sorted set of n tokens, its prefixes under orders 2 and 3, and its bitmap."""
    for batch in small_slices(batches):
        sets = [shingles(t) for t in texts(batch)]
        p = [prefix_length(len(s)) for s in sets]
        yield pa.RecordBatch.from_arrays(
            [batch.column("k"), pa.array([len(s) for s in sets], pa.int64()), _lists(sets), _lists([s[:i] for s, i in zip(sets, p, strict=True)]),
             _lists([s[len(s) - i :][::-1] for s, i in zip(sets, p, strict=True)]), _lists([bitmap(s) for s in sets])],
            names=["k", "n", "s", "lo", "hi", "bits"])


def _at_most(df: DataFrame) -> DataFrame:
    """`df`, with a broadcast hint if it has few rows; else Spark joins by shuffling."""
    return F.broadcast(df) if df.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else df


def text_key(text: Column) -> Column:
    """Known by 128 bits; null for null."""
    return F.unhex(F.md5(text))


def _by_key(rows: DataFrame, answers: DataFrame, key: str, many: str, total: int, how: str = "inner") -> DataFrame:
    """`rows` with the one answer of their key. Keys with `many` above a share of `total`, fewer than HOT_KEYS of them, go by broadcast."""
    hot = answers.filter(F.col(many) > total / HOT_KEYS)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(answers.filter(F.col(many) <= total / HOT_KEYS), key, how)
    return rest.unionByName(rows.join(F.broadcast(hot), key))


def _need(nx: Column, ny: Column) -> Column:
    """The least overlap of linked sets of these sizes."""
    return F.ceil((nx + ny) * THRESHOLD / (100 + THRESHOLD))


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of sets that are similar enough. Whole sets are read only for pairs that pass orders 2 and 3."""
    na, nb = F.col("na"), F.col("nb")
    for cols in (["n", "lo", "hi"], ["n", "s"]):
        of = lambda x: sets.select(F.col("id").alias(x), *[F.col(c).alias(c + x) for c in cols])  # noqa: B023, E731
        both = pairs.select("a", "b").join(of("a"), "a").join(of("b"), "b")
        if "s" in cols:
            break
        for c in ("lo", "hi"):
            cut = lambda x, n: F.slice(x, F.lit(1), (n - _need(na, nb) + 1).cast("int"))
            both = both.filter(F.arrays_overlap(cut(F.col(c + "a"), na), cut(F.col(c + "b"), nb)))
        pairs = materialize(both.select("a", "b"), "pairs")
    found = both.withColumn("i", F.size(F.array_intersect("sa", "sb"))).filter(100 * F.col("i") >= THRESHOLD * (na + nb - F.col("i"))).select("a", "b")
    out = materialize(found, "links")
    release(pairs)
    return out


def _in_prefixes() -> Column:
    """True if the token stands in the prefixes that sizes of x and y ask for, with room for the needed overlap behind it."""
    nx, ny, rx, ry = F.col("x.n"), F.col("y.n"), F.col("x.r"), F.col("y.r")
    need = _need(nx, ny)
    return (rx <= nx - need + 1) & (ry <= ny - need + 1) & (100 * F.least(nx, ny) >= THRESHOLD * F.greatest(nx, ny))


def _near_bitmaps() -> Column:
    """False only if the bitmaps of x and y differ in more bits than the symmetric difference of linked sets can have."""
    differ = sum((F.bit_count(F.get("bits", F.lit(i)).bitwiseXOR(F.get("bits_y", F.lit(i)))) for i in range(BITMAP)), F.lit(0))
    return (100 + THRESHOLD) * differ <= (100 - THRESHOLD) * (F.col("x.n") + F.col("y.n"))


def _pairs(rows: DataFrame) -> DataFrame:
    """Distinct (a, b) of the rows (x, y) that may be linked."""
    rows = rows.filter((F.col("x.id") != F.col("y.id")) & _in_prefixes())
    return rows.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of `edges` (a, b): the smallest node that links reach. Alternating large and small stars."""
    both = lambda e: e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    e = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    while True:
        # large star: each neighbour above a node moves to the least of the node and its neighbours
        n = both(e)
        least = n.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = n.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # nodes that are their neighbourhood's least keep what they have through their neighbours
        large = large.filter("a <> b").distinct()
        # small star: a node and its neighbours below move to the least of them
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.col("b").alias("x"), "m").unionByName(down.select(F.col("a").alias("x"), "m"))
        nxt = materialize(small.filter("x <> m").select(F.col("x").alias("a"), F.col("m").alias("b")).distinct(), "edges")
        state = nxt.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        release(e)
        e = nxt
        if state == seen:
            break
        seen = state
    roots = e.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
    return materialize(roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct()), "roots")


def _one_of_each(documents: DataFrame, classes: DataFrame, least: DataFrame, total: int) -> DataFrame:
    """k and text of one copy of each text."""
    spare = _by_key(classes, least, "k", "m", total).filter(~F.col("doc_id").eqNullSafe(F.col("least"))).select("k", "doc_id").distinct()
    spare = materialize(spare, "spare")
    n = spare.limit(BROADCAST_IDS + 1).count()
    keyed = documents.select("doc_id", "text", text_key(F.col("text")).alias("k")).filter("text is not null")
    if n == 0:
        return keyed.select("k", "text")
    s = spare.select(F.col("k").alias("_k"), F.col("doc_id").alias("_d"))
    on = (F.col("k") == F.col("_k")) & F.col("doc_id").eqNullSafe(F.col("_d"))
    return keyed.join(F.broadcast(s) if n <= BROADCAST_IDS else s, on, "left_anti").select("k", "text")


def _links(prefix: DataFrame, sets: DataFrame) -> DataFrame | None:
    """(node, root) of all linked sets, from the rows (tok, id, n, r) of order 1."""
    total = prefix.count()
    if not total:
        return None
    row = F.struct("id", "n", "r")
    chosen = lambda seeds: [F.min(F.struct((F.xxhash64(F.lit(i), F.col("x.id")) if i else F.col("x.r").cast("long")).alias("h"), F.col("x"))).alias(f"l{i}") for i in seeds]
    rows = prefix.select("tok", row.alias("x"))
    leaders = rows.groupBy("tok").agg(F.count("*").alias("m"), *chosen(range(LEADERS)))
    led = _by_key(rows, leaders, "tok", "m", total).select("x", F.explode(F.array(*[F.col(f"l{i}.x") for i in range(LEADERS)])).alias("y"))
    links = _linked(_pairs(led), sets)
    root = components(links)
    for i in range(ROUNDS + 1):
        placed = rows.join(root, F.col("x.id") == F.col("node"), "left").select("tok", "x", F.coalesce("root", "x.id").alias("c"))
        seeds = range(LEADERS + i * MEMBERS, LEADERS + (i + 1) * MEMBERS)
        sizes = placed.groupBy("tok", "c").agg(F.count("*").alias("m"), *chosen(seeds))
        some = F.array(*[F.col(f"l{j}.x") for j in seeds])
        major = sizes.groupBy("tok").agg(F.max(F.struct("m", "c", some.alias("some"))).alias("top"), F.sum("m").alias("all"), F.count("*").alias("cs")).filter("cs > 1")
        major = materialize(major.select("tok", F.col("top.c").alias("major"), F.col("top.some").alias("some"), F.col("all")), "major")
        open_ = materialize(_by_key(placed, major, "tok", "all", total), "open")
        minor = open_.filter("c <> major")
        pairs, left = minor.agg(F.coalesce(F.sum("all"), F.lit(0)), F.count("*")).first()
        if not left:
            break
        last = i == ROUNDS or pairs <= FEW * left
        if not last:
            tried = minor.select("x", F.explode("some").alias("y"))
        else:
            # what is left: pairs of different components that share a token
            bits = sets.select(F.col("id").alias("_b"), "bits")
            seen = open_.select("tok", "x", "c", "major").join(bits, F.col("x.id") == F.col("_b")).drop("_b")
            other = seen.select("tok", F.col("x").alias("y"), F.col("c").alias("cy"), F.col("bits").alias("bits_y"))
            tried = seen.filter("c <> major").join(other, "tok").filter(
                (F.col("c") != F.col("cy")) & ((F.col("cy") == F.col("major")) | (F.col("x.id") < F.col("y.id"))) & _in_prefixes() & _near_bitmaps())
        more = _linked(_pairs(tried), sets)
        links = root.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more)
        root = components(links)
        release(open_, major)
        if last:
            break
    return root


def jaccard_join(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and k (the text's class; null for a null text) of every row."""
    ship(documents.sparkSession)
    rows_ = materialize(documents.select("doc_id", text_key(F.col("text")).alias("k")), "classes")
    classes = rows_.filter("k is not null")
    total = rows_.count()
    least = materialize(classes.groupBy("k").agg(F.min("doc_id").alias("least"), F.count("*").alias("m")), "least")
    one = _one_of_each(documents, classes, least, total)

    batches = materialize(one.mapInArrow(_text_batches, _BATCH), "batches")
    sized = materialize(_joined(batches, _first_round, "k binary, n long, left boolean"), "sized")
    release(batches)
    wanted = _at_most(materialize(sized.filter("left").select("k").distinct(), "wanted"))
    numbered = one.join(wanted, "k", "left_semi").mapInArrow(_sets, "k binary, n long, s array<long>, lo array<long>, hi array<long>, bits array<long>")
    sets = materialize(numbered.withColumn("id", F.monotonically_increasing_id()), "sets")
    ids = sets.groupBy("k").agg(F.min("id").alias("id"))
    if sets.groupBy("k").count().filter("count > 1").limit(1).count():  # rows that repeat an id and a text left theirs twice
        ids = materialize(ids, "ids")
        sets = materialize(sets.join(ids.select("id"), "id", "left_semi"), "sets")
    batches = materialize(sets.select("id", "s").mapInArrow(_set_batches, _BATCH), "batches")
    prefix = materialize(_joined(batches, _second_round, "tok long, id long, n int, r int"), "prefix")
    release(batches)
    root = _links(prefix, sets)

    named = least.join(sized.groupBy("k").agg(F.min("n").alias("n_shingles")), "k")
    if root is not None:
        linked = ids.join(root, F.col("id") == F.col("node")).select("k", "root").join(least.select("k", "least"), "k")
        of_root = linked.groupBy("root").agg(F.min("least").alias("component_id"))
        named = named.join(linked.select("k", "root").join(of_root, "root").select("k", "component_id"), "k", "left")
    else:
        named = named.withColumn("component_id", F.lit(None).cast("long"))
    named = materialize(named.select("k", "m", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("component_id", "least")).alias("component_id")), "named")
    found = _by_key(classes, named, "k", "m", total).select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "k")
    null = rows_.filter("k is null").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"), "k")
    return found.unionByName(null)


def one_of_each_group(documents: DataFrame) -> DataFrame:
    """The rows of which each group of linked documents keeps one: that with the smallest id, or any of equal ones.

    A row goes by its id and its text: where an id is repeated with another text, the other row stays if nothing is
    linked with it. Documents without words are linked with nothing and all stay, as do rows without an id.
    """
    joined = materialize(jaccard_join(documents), "joined")
    gone = joined.filter(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("_d"), F.col("k").alias("_k")).distinct()
    on = (documents["doc_id"] == F.col("_d")) & (text_key(documents["text"]) == F.col("_k"))
    kept = documents.join(_at_most(materialize(gone, "gone")), on, "left_anti")
    # rows that repeat an id and a text: one stays
    again = documents.groupBy("doc_id").count().filter("count > 1 and doc_id is not null").select("doc_id")
    again = _at_most(materialize(again, "again"))
    several = kept.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(again, "doc_id", "left_anti").unionByName(several).select(*documents.columns)


#: Of whole tables of a thousand documents or so: it makes all pairs that share a shingle.
ORACLE_SQL = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
s as (
  select distinct doc_id, array_to_string(ws[i:i + 4], ' ') as g
  from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) as i from w where len(ws) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
pairs as (select x.doc_id as a, y.doc_id as b, count(*) as i from s x join s y on x.g = y.g and x.doc_id <> y.doc_id group by 1, 2),
links as (select a, b from pairs join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * i >= 75 * (na.n + nb.n - i)),
reach(doc_id, r) as (select doc_id, doc_id from documents union select reach.doc_id, b from reach join links on a = r)
select reach.doc_id, coalesce(any_value(n.n), 0)::bigint as n_shingles, min(r)::bigint as component_id
from reach left join n on n.doc_id = reach.doc_id group by reach.doc_id
"""
