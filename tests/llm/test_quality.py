"""Verdicts of the quality rules against a plain version."""

from __future__ import annotations

import random
from collections import defaultdict

from stratalens.llm import quality


def rows():
    r = random.Random(4)
    words = {"en": ["river", "stone", "cloud", "tree"], "de": ["Donaudampfschiff", "Wasserstrasse", "Landschaft", "Fluss"]}
    out = []
    for i in range(900):
        lang = ["en", "de", None][i % 3]
        source = "code" if i % 5 == 0 else "rare" if i == 7 else "web"
        w = [r.choice(words[lang or "en"]) + str(r.randrange(400)) for _ in range(r.randrange(12, 90))]
        if source == "code":
            w += ["#|&"[r.randrange(3)] for _ in range(r.randrange(3, 12))]
        if i % 11 == 0:
            w += ["#$%&*"] * 5 + ["|||<>"] * 4 if i % 2 else ["x" * 40] * 4
        lines = [" ".join(w[j : j + 9]) for j in range(0, len(w), 9)]
        if i % 13 == 0:
            lines += lines[:1] * r.choice([1, 6])
        out.append((i, "\n".join(lines), lang, source))
    return [*out, (None, None, None, None), (1, "", "en", "web")]


def cell(v):
    s = max(len(f"{v:b}") - 8, 0)
    return v >> s << s


def test_verdicts(spark):
    docs = spark.createDataFrame(rows(), "doc_id long, text string, lang string, source string")
    base = quality.base_counts(docs).collect()
    values = lambda x: {
        "symbols": x.n_symbols * 1000 // max(x.n_words, 1), "word_length": x.word_chars * 100 // max(x.n_words, 1),
        "dup_lines": x.n_dup_lines * 1000 // max(x.n_words, 1), "repeats": x.n_repeat_words * 1000 // max(x.n_words, 1)}
    of = defaultdict(list)
    for x in base:
        if not x.base_failed:
            for m, v in values(x).items():
                for g in ((x.lang, x.source), (x.lang,), ()):
                    of[g, m].append(cell(v))

    def fences(x, m):
        share, spread, low = quality.FENCES[m]
        for g in ((x.lang, x.source), (x.lang,), ()):
            if len(of[g, m]) * share >= 100 * quality.ROWS_BEYOND or not g:
                s = sorted(of[g, m])
                q = lambda h: next(v for i, v in enumerate(s, 1) if i * 100 >= len(s) * h)  # noqa: B023, E731
                return (q(share) - spread * (q(50) - q(share)) if low else -1), q(100 - share) + spread * (q(100 - share) - q(50))

    want = {}
    for x in base:
        verdict = not x.base_failed and all(lo <= cell(v) <= hi for m, v in values(x).items() for lo, hi in [fences(x, m)])
        want.setdefault((x.doc_id, x.n_words), verdict)
    got = quality.quality_rules(docs).collect()
    assert {(r.doc_id, r.n_words): r.kept for r in got} == want and len(got) == len(base)
    assert 20 < sum(not r.kept and not r.base_failed for r in got) < 400


def test_fences_follow_the_groups(spark):
    docs = spark.createDataFrame(rows(), "doc_id long, text string, lang string, source string")
    got = {(r.lang, r.source): r for r in quality.thresholds(quality.sketches(quality.base_counts(docs))).collect()}
    assert got["en", "code"].max_symbols > 3 * got["en", "web"].max_symbols
    assert got["de", "web"].max_word_length > got["en", "web"].max_word_length


def test_fences_differ_on_the_given_tables(spark):
    d = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    got = quality.thresholds(quality.sketches(quality.base_counts(d)))
    assert all(got.select(c).distinct().count() > 1 for c in ("max_word_length", "min_word_length", "max_repeats"))
