"""Incremental secret scans over a content-addressed blob ledger.

Every historical version of a text is addressed by the SHA-256 of its UTF-8 bytes. The ledger holds one row for each
(blob, rules version) that has been scanned, with its findings; a scan reads only blobs whose pair the ledger lacks,
each once, however many paths (documents) hold it, and then joins the findings back to all of them. A ledger is kept
as a Parquet table by `append_ledger` and read by `stored_ledger`.

Defined cases: a null text is the empty blob; repeated rows each return; an empty table returns no rows; other
columns are ignored. Spans are code points, end exclusive. Texts are scanned whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import BROADCAST_IDS, materialize, ship, small_slices, texts

RULES_VERSION = "1"
LEDGER = "blob binary, rules_version string, n_assign long, n_access long, n_hex long, base string, spans string"

# The base kinds, then those that this scan adds, in the order in which equal starts are listed.
_ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")  # the runs of [0-9a-f]+ that are long enough
_ADDED = {
    "pem": re.compile(r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    "jwt": re.compile(r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    "github": re.compile(r"\bgh[pousr]_[A-Za-z0-9]{36,}"),
    "slack": re.compile(r"\bxox[abprs]-[A-Za-z0-9-]{10,}"),
    "google": re.compile(r"\bAIza[A-Za-z0-9_-]{35}"),
}
_ADDED_HINTS = {"pem": "-----BEGIN ", "jwt": "eyJ", "github": "gh", "slack": "xox", "google": "AIza"}
KINDS = ("assign", "access", "hex", *_ADDED)
_HINTS = ("passw", "secret", "token", "api")


def scan_text(text: str) -> list[tuple[int, int, int]]:
    """(start, place of the kind in KINDS, end) of every span, sorted."""
    found = []
    low = text.lower()
    # only these letters have other cases outside ASCII, which the pattern does not take
    if any(h in low for h in _HINTS):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    for k, (kind, pattern) in enumerate(_ADDED.items(), 3):
        if _ADDED_HINTS[kind] in text:
            found += [(m.start(), k, m.end()) for m in pattern.finditer(text)]
    return sorted(found)


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_slices(batches, 1024):
        rows = [scan_text(x) for x in texts(batch)]
        base = [[s for s in r if s[1] < 3] for r in rows]
        count = lambda k: pa.array([sum(s[1] == k for s in r) for r in base], pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column("blob"), pa.array([RULES_VERSION] * len(rows), pa.string()), count(0), count(1), count(2),
             pa.array([_joined(r) for r in base], pa.string()), pa.array([_joined(r) for r in rows], pa.string())],
            names=["blob", "rules_version", "n_assign", "n_access", "n_hex", "base", "spans"])


def addressed(documents: DataFrame) -> DataFrame:
    """Each version's path (doc_id) and blob."""
    return documents.select("doc_id", F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)).alias("blob"))


def _one_copy(documents: DataFrame, wanted: DataFrame, paths: DataFrame) -> DataFrame:
    """blob, text: one copy of each blob in `wanted` (blob, doc_id of the copy to read)."""
    both = documents.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    spare = paths.select("doc_id").join(wanted.select("doc_id"), "doc_id", "left_anti").filter("doc_id is not null").distinct()
    n = spare.limit(BROADCAST_IDS + 1).count()
    if n <= BROADCAST_IDS:  # the ids to skip fit in memory, and the texts needn't move
        both = both.join(F.broadcast(spare), "doc_id", "left_anti")
    else:
        # rows without an id match no id: they are read besides
        both = both.join(wanted.select("doc_id"), "doc_id", "left_semi").unionByName(both.filter("doc_id is null"))
    return both.select(F.unhex(F.sha2("text", 256)).alias("blob"), "text")


def _scan_missing(documents: DataFrame, ledger: DataFrame | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(paths, the ledger that was given or an empty one, what it lacks)."""
    spark = documents.sparkSession
    ship(spark)
    paths = materialize(addressed(documents), "paths")
    seen = empty_ledger(spark) if ledger is None else ledger
    # null ids can't be told apart by id: such rows are all read, and their blobs merge in the ledger
    first = paths.groupBy("blob").agg(F.min("doc_id").alias("doc_id"))
    if ledger is not None:
        first = materialize(first.join(seen.filter(F.col("rules_version") == RULES_VERSION), "blob", "left_anti"), "unseen")
        todo = _one_copy(documents, first, paths).join(first.select("blob"), "blob", "left_semi")
    else:
        todo = _one_copy(documents, first, paths)
    # a document id that two rows share, or no id, may bring a blob twice
    return paths, seen, materialize(todo.mapInArrow(_scan, LEDGER), "scanned").dropDuplicates(["blob", "rules_version"])


def scan_unseen(documents: DataFrame, ledger: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(paths, ledger): every path's blob, and the ledger with the pairs that this scan added.

    `ledger`: rows of LEDGER from earlier scans; pairs of another rules version do not count as seen.
    """
    paths, seen, found = _scan_missing(documents, ledger)
    return paths, found if ledger is None else seen.unionByName(found)


def stored_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger at `path`; empty if nothing was stored there yet."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return empty_ledger(spark)
    return spark.read.schema(LEDGER).parquet(path)


def append_ledger(documents: DataFrame, path: str) -> DataFrame:
    """Scan what the ledger at `path` lacks, add that to it, and return the paths (doc_id, blob).

    Only new pairs are written, as files of their own. A run that is repeated after a failure may add a pair twice; a
    blob's findings under one rules version are always the same, and readers take one of them.
    """
    paths, _, fresh = _scan_missing(documents, stored_ledger(documents.sparkSession, path))
    fresh.select(*[x.split()[0] for x in LEDGER.split(", ")]).write.mode("append").parquet(path)
    return paths


def findings(ledger: DataFrame) -> DataFrame:
    """One row for each blob with findings under the present rules."""
    hits = ledger.filter((F.col("rules_version") == RULES_VERSION) & (F.col("spans") != "")).drop("rules_version")
    return hits.dropDuplicates(["blob"])


def secret_spans(documents: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """doc_id and the findings of its text, for every row."""
    paths, ledger = scan_unseen(documents, ledger)
    # blobs without findings need no row in the join
    hits = findings(ledger)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return paths.join(hits, "blob", "left").select(
        "doc_id", zero("n_assign"), zero("n_access"), zero("n_hex"),
        F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"))


def _redact_text(text: str, spans: str) -> str:
    out, at = [], 0
    for part in spans.split(","):
        kind, start, end = part.split(":")
        if int(end) > at:  # spans of several kinds may overlap
            if int(start) >= at:
                out += [text[at:int(start)], f"[{kind}]"]
            at = int(end)
    return "".join([*out, text[at:]])


def redact_secrets(documents: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """The same rows and columns with every span replaced by its kind in brackets; n_chars follows the new text.

    The scan is that of `scan_unseen`: each distinct text once, and none that the ledger holds.
    """
    ship(documents.sparkSession)
    _, ledger = scan_unseen(documents, ledger)
    hits = materialize(findings(ledger).select("blob", "spans"), "hits")
    few = hits.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    cols = documents.columns
    at = {c: f"c{i}" for i, c in enumerate(cols)}  # names of other columns must not clash
    keyed = documents.select(*[F.col(c).alias(n) for c, n in at.items()], F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("blob"))
    found = keyed.join(F.broadcast(hits) if few else hits, "blob", "left").drop("blob")
    text = cols.index("text")

    def redact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_slices(batches):
            spans = batch.column("spans").to_pylist()
            arrays = [batch.column(i) for i in range(len(cols))]
            if any(spans):
                new = [_redact_text(x, s) if s else x for x, s in zip(arrays[text].to_pylist(), spans, strict=True)]
                arrays[text] = pa.array(new, pa.string())
                if "n_chars" in cols:
                    k = cols.index("n_chars")
                    arrays[k] = pa.array([len(x) if s else n for x, s, n in zip(new, spans, arrays[k].to_pylist(), strict=True)], arrays[k].type)
            yield pa.RecordBatch.from_arrays(arrays, names=list(at.values()))

    schema = keyed.drop("blob").schema
    return found.mapInArrow(redact, schema).select(*[F.col(n).alias(c) for c, n in at.items()])


def base_digest(text: str) -> str:
    """base_sha256 of one text, for checks."""
    return hashlib.sha256(_joined([s for s in scan_text(text) if s[1] < 3]).encode()).hexdigest()


def empty_ledger(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], LEDGER)
