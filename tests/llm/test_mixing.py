"""Mixing of whole rows: ties, repeated and missing ids, clashing names."""

from __future__ import annotations

from collections import Counter, defaultdict

from stratalens.llm import mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, size string, target int, copies int, part string, source_size int, taken int, place int, _size int, _part int, _cut int"


def rows():
    texts = [" ".join(f"w{i}_{j}" for j in range(3 + i % 17)) for i in range(120)]
    ids = [i if i % 4 else None if i % 8 else 4 for i in range(120)]
    plain = [(d, t, "en", ["a", "b", "b", "b", None][k % 5], len(t), "z", 1, 2, "p", 3, 4, 5, 6, 7, 8) for k, (d, t) in enumerate(zip(ids, texts, strict=True))]
    return [*plain, *plain[:30], *[plain[3]] * 25, (None, None, None, None, None, *[None] * 10)]


def test_mixed_documents(spark):
    data = rows()
    docs = spark.createDataFrame(data, SCHEMA).repartition(4)
    runs = [mixing.mixed_documents(df) for df in (docs, docs.repartition(7))]
    assert runs[0].columns == docs.columns and runs[0].schema["n_chars"].dataType == docs.schema["n_chars"].dataType
    got, again = (Counter(tuple(r) for r in x.collect()) for x in runs)
    assert got == again
    size = lambda t: len((t or "").split())
    total, per = sum(size(r[1]) for r in data), defaultdict(int)
    for r, n in got.items():
        per[r[3]] += n * size(r[1])
        assert r[1] is None or r[4] == len(r[1])
        assert any(r[0] == d[0] and (d[1] or "").startswith(r[1] or "") for d in data)
    targets = {r.source: r.target for r in mixing.mix(docs, keep=["source"]).collect()}
    alike = max(Counter(data).values())
    assert abs(sum(targets.values()) - total) < 1e-6
    assert all(abs(per[s] - t) <= alike for s, t in targets.items())
    most = Counter(data)
    whole = Counter()
    for r, n in got.items():
        whole[(r[0], r[1], r[3])] += n
    assert all(whole[(d[0], d[1], d[3])] <= 3 * n for d, n in most.items())


def test_mix_agrees_with_a_plain_running_sum(spark):
    import hashlib
    import math

    data = [(i, "w " * (1 + i * 7 % 23), "abc"[i % 3] if i % 7 else None) for i in range(200)]
    got = {r.doc_id: (r.taken, r.target, r.source_size) for r in mixing.mix(spark.createDataFrame(data, "doc_id long, text string, source string")).collect()}
    by = defaultdict(list)
    for i, t, s in data:
        by[s].append((hashlib.md5(f"{mixing.SEED}:{i}".encode()).hexdigest(), len(t.split()), i))
    for x in by.values():
        total, at = sum(n for _, n, _ in x), 0
        target = got[x[0][2]][1]
        k = math.floor(target / total)
        need = math.floor(target - k * total)
        for _, n, i in sorted(x):
            assert got[i][0] == k * n + max(0, min(n, need - at)) and got[i][2] == total
            at += n
