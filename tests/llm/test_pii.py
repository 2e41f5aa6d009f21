"""Surrogates: long and crowded inputs, scripts, coreference, distinctness."""

from __future__ import annotations

import re

from stratalens.llm import pii


def replaced(spark, texts):
    got = pii.replace_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    return [r.text for r in sorted(got, key=lambda r: r.doc_id)], [r.entities for r in sorted(got, key=lambda r: r.doc_id)]


def test_long_runs(spark):
    run, host = "a1" * 500_000, "x@" + "ab." * 10_000 + "com"
    texts, spans = replaced(spark, [run, f"see {host} now", f"{run}@mail.org", "a@" * 50_000, "é" * 100_000 + " " + "." * 100_000])
    assert texts[0] == run and spans[0] == "" and texts[3] == "a@" * 50_000 and spans[4] == ""
    assert spans[1] == f"email:4:{4 + len(host)}" and len(texts[1]) == len(host) + 8 and "ab.ab.ab" not in texts[1]
    assert texts[2].endswith(".org") and texts[2][:1000] != run[:1000]


def test_crowded_names(spark):
    """All 676 short forms really occur: longer ones are free."""
    names = [f"{a}{b}" for a in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for b in "abcdefghijklmnopqrstuvwxyz"]
    texts, _ = replaced(spark, [f"Mr {n} was here" for n in names])
    new = [re.fullmatch(r"Mr (\w+) was here", t)[1] for t in texts]
    assert len(set(new)) == len(names) and not set(new) & set(names)


def test_crowded_numbers(spark):
    texts, _ = replaced(spark, [f"call 555-{i:03d}-0000" for i in range(300)])
    new = [t.removeprefix("call ") for t in texts]
    assert len(set(new)) == 300 and not set(new) & {f"555-{i:03d}-0000" for i in range(300)}


def test_scripts(spark):
    old = ["Herr Größe", "Sr Núñez", "Mr Çelik", "Mr Παπαδόπουλος", "господин Ёлкин", "中文名字@例子.com", "Mr O’Brien", "شخص@مثال.com"]
    texts, spans = replaced(spark, old)
    for a, b, s in zip(old, texts, spans, strict=True):
        assert s
        name = a.split()[-1].split(".com")[0]
        kept = [x for x, y in zip(name, b.split()[-1], strict=False) if x == y and x.isalpha() and not x.isascii()]
        assert len(kept) <= 1, (a, b)  # a letter may be drawn for itself
    assert re.search(r"[Α-Ω][α-ω]+", texts[3]) and re.search(r"[А-Я][а-я]+", texts[4]) and re.search(r"[一-鿿]{4}@", texts[5])


def test_coreference(spark):
    texts, spans = replaced(spark, ["Mr. John Smith met Mr Smith and Mrs. Anna Smith", "Mr Smith called Mr. John Doe", "mail A.B@x.org or a.b@X.org, +1 (017) 555-7713 or +1 017 555 7713"])
    a = re.fullmatch(r"Mr\. (\w+) (\w+) met Mr (\w+) and Mrs\. (\w+) (\w+)", texts[0])
    b = re.fullmatch(r"Mr (\w+) called Mr\. (\w+) (\w+)", texts[1])
    assert a[2] == a[3] == a[5] == b[1] and a[1] == b[2] and b[3] != a[2] and a[4] in pii._GIVEN["latin"]["f"]
    assert spans[0] == "name:0:14,name:19:27,name:32:47"
    c = re.fullmatch(r"mail (\S+) or (\S+), (.+) or (.+)", texts[2])
    assert c[1].lower() == c[2].lower() and re.sub(r"\D", "", c[3]) == re.sub(r"\D", "", c[4])


def test_distinct_on_the_given_table(spark):
    """Against the originals: one form for each entity, no two alike, and none that really occurs."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    before = {r.doc_id: r.text for r in docs.collect()}
    canon = lambda k, m: re.sub(r"\D", "", m) if k in ("card", "phone", "ssn") else m.lower()
    forms, real = {}, set()
    for r in pii.replace_pii(docs).collect():
        spans = [(k, int(i), int(j)) for k, i, j in (x.split(":") for x in filter(None, r.entities.split(",")))]
        old, ends = before[r.doc_id] or "", [0, *(j for _, _, j in spans)]
        gaps = [old[a:b] for a, b in zip(ends, [*(i for _, i, _ in spans), len(old)], strict=True)]
        new = re.fullmatch("(.+?)".join(map(re.escape, gaps)), r.text or "", re.DOTALL)
        assert new
        for (k, i, j), x in zip(spans, new.groups(), strict=True):
            if k != "name":
                real.add((k, canon(k, old[i:j])))
                forms.setdefault((k, canon(k, old[i:j])), set()).add((k, canon(k, x)))
    assert len(forms) > 20 and all(len(x) == 1 for x in forms.values())
    new = [next(iter(x)) for x in forms.values()]
    assert len(set(new)) == len(new) and not set(new) & real
