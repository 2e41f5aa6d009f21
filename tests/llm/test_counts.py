"""Exact counts over batches, by one level and by several."""

from __future__ import annotations

import random
import threading
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F
from stratalens.llm import _counts, _shared, interpolation, jaccard
from test_whole import components_of


@pytest.mark.parametrize(("fan", "bucket"), [(512, 1 << 21), (3, 40), (2, 10)])
def test_totals(spark, monkeypatch, fan, bucket):
    """Fixed fan-outs of 2 and 3 need several levels."""
    monkeypatch.setattr(_counts, "FAN", fan)
    monkeypatch.setattr(_counts, "BUCKET", bucket)
    r = random.Random(1)
    batches, total = [], Counter()
    for b in range(23):
        h = sorted({r.getrandbits(64) for _ in range(20)} | {(i * 0x9E3779B97F4A7C15) % 2**64 for i in r.sample(range(60), 15)})
        c = [r.randint(0, 3) for _ in h]
        total.update(dict(zip(h, c, strict=True)))
        batches.append((b, h, c))
    rows = [(b, bytearray(_counts.packed_hashes(np.array(h, np.uint64))), bytearray(_counts.packed(np.array(c, np.uint64)))) for b, h, c in batches]
    df = spark.createDataFrame(rows, "batch long, h binary, c binary").repartition(3)
    got = _counts.totals(df, ["c"], sum(len(h) for _, h, _ in batches), len(batches)).collect()
    for b, h, _ in batches:
        back = np.concatenate([_counts.unpacked(x.c, "<u8") for x in sorted((x for x in got if x.batch == b), key=lambda x: x.part)])
        assert back.tolist() == [total[x] for x in h]
    assert sum(x.kinds for x in got) == sum(v > 0 for h, v in total.items() if h < 1 << 63)


@pytest.mark.parametrize(("fan", "share", "levels"), [(16, 1, 1), (16, 1, 2), (16, 1, 3), (4, 100, 1), (5, 1, 3)])
def test_memory_of_totals(spark, monkeypatch, fan, share, levels):
    """Just above the hashes that `levels` - 1 hold (or, shared, above one bucket a range), what merges into one message is about a batch."""
    each, batches, merged = 40, 64, []
    bucket = 8 if share > 1 else -(-each * batches // (fan ** (levels - 1) + 1))
    for k, v in {"FAN": fan, "BUCKET": bucket, "SHARE": share}.items():
        monkeypatch.setattr(_counts, k, v)
    plain = _counts.materialize
    monkeypatch.setattr(_counts, "materialize", lambda df, name: merged.append((name, plain(df, name))) or merged[-1][1])
    r = random.Random(levels)
    common = [r.getrandbits(64) for _ in range(5)]
    rows, total = [], Counter()
    for b in range(batches):
        h = sorted({*common, *[r.getrandbits(64) for _ in range(each - 5)]})
        rows.append((b, h, [r.choice([0, 1, 300]) for _ in h]))
        total.update(dict(zip(h, rows[-1][2], strict=True)))
    df = spark.createDataFrame([(b, bytearray(_counts.packed_hashes(np.array(h, np.uint64))), bytearray(_counts.packed(np.array(c, np.uint64)))) for b, h, c in rows],
                               "batch long, h binary, c binary").repartition(3)
    got = _counts.totals(df, ["c"], each * batches, batches).collect()
    for b, h, _ in rows:
        back = np.concatenate([_counts.unpacked(x.c, "<u8") for x in sorted((x for x in got if x.batch == b), key=lambda x: x.part)])
        assert back.tolist() == [total[x] for x in h]
    assert sum(x.kinds for x in got) == sum(v > 0 for h, v in total.items() if h < 1 << 63)
    sizes = [len(_counts.unpacked_hashes(x.h)) for name, m in merged if name == "merged" for x in m.collect()]
    assert bool(sizes) == (levels > 1) and max(sizes, default=0) <= 4 * each


def test_sums_take_turns():
    """A range's hashes are added up in turns of about a bucket, and each message's answers keep their order."""
    r = np.random.default_rng(1)
    common = r.integers(0, 1 << 63, 50, dtype=np.uint64)
    messages = [(h := np.unique(np.concatenate([common, r.integers(0, 1 << 63, 200, dtype=np.uint64)])), [np.arange(len(h), dtype=np.uint16)]) for _ in range(40)]
    total = Counter()
    for h, (c,) in messages:
        total.update(dict(zip(h.tolist(), c.tolist(), strict=True)))
    found, most = [[] for _ in messages], 0
    for _, (s,), places in _counts._summed(messages, 1000):
        most = max(most, sum(map(len, places)))
        for x, p in zip(found, places, strict=True):
            x += s[p].tolist()
    assert found == [[total[x] for x in h.tolist()] for h, _ in messages] and most < 2000


def test_shuffles_dropped(spark):
    """Shuffled messages do not lie beside the later steps' shuffles."""
    held = lambda: len(list(Path(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()[0]).rglob("shuffle_*.data")))
    setting, before = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", held()
    was = spark.conf.get(setting)
    with _shared.shuffles_dropped(spark):
        rows = spark.range(0, 1000, 1, 3).groupBy((F.col("id") % 7).alias("k")).applyInArrow(lambda t: t, "id long").groupBy("id").count().collect()
    assert len(rows) == 1000 and held() <= before and spark.conf.get(setting) == was


def test_direct_buffers(spark, tmp_path):
    """Reading documents and batches holds no copy of what is read outside the heap."""
    r = random.Random(3)
    rows = [(i, " ".join(f"{r.getrandbits(48):x}" for _ in range(40_000))) for i in range(20)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.option("compression", "none").parquet(f"{tmp_path}/documents.parquet")
    pool = next(p for p in spark._jvm.java.lang.management.ManagementFactory.getPlatformMXBeans(spark._jvm.java.lang.Class.forName("java.lang.management.BufferPoolMXBean")) if p.getName() == "direct")
    most, done = [before := pool.getMemoryUsed()], threading.Event()

    def watch():
        while not done.wait(0.02):
            most.append(pool.getMemoryUsed())

    watcher = threading.Thread(target=watch)
    watcher.start()
    try:
        assert interpolation.lm_scores(_shared.read_documents(spark, str(tmp_path))).count() == 20
    finally:
        done.set()
        watcher.join()
    assert max(most) - before < 1_000_000


def test_several_near_copy_groups(spark, monkeypatch):
    """Groups of different sizes, some of whose members are linked only through others, and a text that many rows hold."""
    monkeypatch.setattr(jaccard, "BATCH_TOKENS", 300)
    monkeypatch.setattr(jaccard, "ROUNDS", 1)
    r = random.Random(9)
    texts = []
    for g, m in enumerate((2, 5, 40, 70)):
        base = [f"g{g}w{i}" for i in range(70)]
        for i in range(m):
            w = list(base)
            for j in r.sample(range(70), r.choice([0, 1, 2, 3])):
                w[j] = f"x{i}_{j}"
            texts.append(" ".join(w))
    passage = " ".join(f"p{i}" for i in range(30))
    texts += [f"{passage} " + " ".join(f"own{i}_{j}" for j in range(r.randrange(5, 60))) for i in range(40)]
    texts += [texts[0]] * 60
    got = {x.doc_id: x.component_id for x in jaccard.jaccard_join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)).collect()}
    assert [got[i] for i in range(len(texts))] == components_of(texts)
