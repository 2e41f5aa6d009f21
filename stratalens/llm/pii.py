"""Surrogates for personal data: keyed, type-consistent, distinct and the same wherever an entity recurs.

Entities are found by patterns inside each row. A surrogate keeps the entity's type and format: digits become digits,
letters become letters of the same case and script, separators stay; card numbers keep their first digit and whether
their check digit is right; addresses keep four octets; an e-mail address keeps its top-level domain. A name keeps its title;
its given and its family name are entities of their own, so that "Mr. John Smith" and "Mr Smith" share a surrogate, and
a given name of that title's gender and script replaces the given one. The letters come from a keyed hash of the
entity's canonical form, so that one entity has one surrogate in any document and any notation.

Distinctness is checked over all entities: where two would share a surrogate, or one would get a form that really
occurs, it is drawn again. From the draw `ROOM` on a form also gets longer with every draw (a name by letters, an address by
letters in front, a number by an extension), so that there is always a free one, however crowded the short forms are.
Only rows with entities take part in that; the others pass through unchanged.

Everything runs as DataFrame expressions. The patterns start where a run of characters starts and repeat no groups, so their
time is in proportion to the text. Defined cases: null and empty texts pass unchanged with no entities; repeated
rows each return; an empty table returns no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import BROADCAST_IDS, let, materialize

KEY = "surrogates-1"
#: The draw from which on forms get longer.
ROOM = 3
# The patterns, in the order in which they are tried; titles; the names that replace names.
_MR, _MS = r"(?:Mr|Herr|Monsieur|Señor|Sr|господин)", r"(?:Mrs|Ms|Miss|Frau|Madame|Señora|Sra|госпожа)"
_NAME = r"\p{Lu}[\p{Ll}\p{M}]*+(?:[-'’]\p{L}[\p{Ll}\p{M}]++)?(?<=[\p{Ll}\p{M}])"
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}][\p{L}\p{N}.-]*\.\p{L}{2,}",
    "ip": r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9])(?!\.[0-9])",
    "phone": r"\+[0-9]{1,3}[ -]?\(?[0-9]{2,4}\)?[ -]?[0-9]{3}[ -]?[0-9]{3,4}(?![0-9])|(?<![0-9])\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?![0-9])|(?<![0-9-])[0-9]{3}-[0-9]{3}-[0-9]{4}(?![0-9-])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "card": r"(?<![0-9A-Za-z])[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{1,7}(?![0-9A-Za-z])",
    "name": rf"(?<![\p{{L}}])(?:{_MS}|{_MR})(?![\p{{L}}])\.? {_NAME}(?: (?!(?:{_MS}|{_MR})(?![\p{{L}}])){_NAME})?",
}
_GIVEN = {
    "latin": {"m": "Adam Bruno David Emil Felix Hugo Ivan Jonas Karl Leo Martin Oscar Paul Simon Tom Victor",
              "f": "Anna Bella Clara Diana Emma Flora Greta Helena Irene Julia Laura Maria Nora Paula Rosa Vera"},
    "cyrillic": {"m": "Антон Борис Виктор Глеб Денис Егор Иван Кирилл", "f": "Алла Вера Галина Дарья Елена Зоя Ирина Ксения"},
}
#: script -> the letters that stand for its letters; those of large scripts by a rule.
_LOWER = {"Greek": "αβγδεζηθικλμνξοπρστυφχψω", "Cyrillic": "абвгдежзиклмнопрстуфхцчшщыьэюя", "Latin": "abcdefghijklmnopqrstuvwxyz"}
_CASELESS = {
    "Han": "".join(chr(0x4E00 + 7 * i) for i in range(128)), "Hiragana": "あいうえおかきくけこさしすせそたちつてとなにぬねの", "Katakana": "アイウエオカキクケコサシスセソタチツテトナニヌネノ",
    "Hangul": "".join(chr(0xAC00 + 28 * i) for i in range(128)), "Arabic": "بتثجحخدرزسشصطعغفقكلمنهوي", "Hebrew": "אבגדהוזחטיכלמנסעפצקרשת", "Devanagari": "कखगघचछजझटठडढतथदधनपफबभमयरलवशसह", "Thai": "กขคงจชซดตถทนบปผพฟมยรลวสหอ",
}
_ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())


def kind(m: Column) -> Column:
    out = F.lit("card")
    for k in ("ssn", "phone", "ip", "email", "name"):
        out = F.when(m.rlike(f"^(?:{PATTERNS[k]})$"), k).otherwise(out)
    return out


def canonical(m: Column, k: Column) -> Column:
    """What makes two notations the same entity: digits of numbers, lower case of addresses and names."""
    return F.when(k.isin("card", "phone", "ssn"), F.regexp_replace(m, "[^0-9]", "")).otherwise(F.lower(m))


def _byte(stream: Column, i: Column) -> Column:
    """Number 0 to 255 at place i of a stream of 64 hex digits, which repeats with a shift."""
    return F.conv(F.substring(F.sha2(F.concat(stream, F.floor(i / 32).cast("string")), 256), ((i % 32) * 2 + 1).cast("int"), F.lit(2)), 16, 10).cast("int")


def _of(alphabet: str, v: Column) -> Column:
    return F.substring(F.lit(alphabet), (v % len(alphabet) + 1).cast("int"), F.lit(1))


def _letter(c: Column, v: Column) -> Column:
    """A digit for a digit, a letter of its script and case for a letter; letters of other scripts become Latin ones."""
    drawn = _of(_LOWER["Latin"], v)
    for script in ("Greek", "Cyrillic"):
        drawn = F.when(c.rlike(rf"\p{{Is{script}}}"), _of(_LOWER[script], v)).otherwise(drawn)
    drawn = F.when(c.rlike(r"\p{Lu}"), F.upper(drawn)).otherwise(drawn)
    for script, alphabet in _CASELESS.items():
        drawn = F.when(c.rlike(rf"\p{{Is{script}}}"), _of(alphabet, v)).otherwise(drawn)
    return F.when(c.rlike(r"\p{N}"), (v % 10).cast("string")).when(c.rlike(r"\p{L}"), drawn).when(c.rlike(r"\p{M}"), "").otherwise(c)


def _spelt(m: Column, stream: Column) -> Column:
    """Each letter and digit of `m` drawn anew; that at place i takes the stream's byte i."""
    return F.array_join(F.transform(F.split(m, ""), lambda c, i: _letter(c, _byte(stream, i))), "")


def _digits(m: Column, stream: Column) -> Column:
    """Each digit of the short text `m` drawn anew; the n-th of them takes the stream's n-th byte, whatever stands between."""
    place = lambda i: F.length(F.regexp_replace(F.substring(m, F.lit(1), (i + 1).cast("int")), "[^0-9]", "")) - 1
    new = lambda c, i: F.when(c.rlike("[0-9]"), (_byte(stream, F.greatest(place(i), F.lit(0))) % 10).cast("string")).otherwise(c)
    return F.array_join(F.transform(F.split(m, ""), new), "")


def _luhn(digits: Column) -> Column:
    """Sum whose last digit is 0 for a right check digit."""
    return F.aggregate(F.reverse(F.split(digits, "")), F.struct(F.lit(0).alias("s"), F.lit(0).alias("i")), lambda a, c: F.struct(
        (a["s"] + let(c.cast("int") * (a["i"] % 2 + 1), lambda d: d - F.when(d > 9, 9).otherwise(0))).alias("s"), (a["i"] + 1).alias("i")))["s"]


def _card(m: Column, stream: Column) -> Column:
    drawn = F.concat(F.substring(m, 1, 1), F.substring(_digits(m, stream), F.lit(2), F.length(m)))
    body = F.substring(drawn, F.lit(1), F.length(m) - 1)
    digits = lambda x: F.regexp_replace(x, "[^0-9]", "")
    last = (10 - _luhn(F.concat(digits(body), F.lit("0"))) % 10) % 10
    right = _luhn(digits(m)) % 10 == 0
    return F.concat(body, F.when(right, last).otherwise((last + 1 + F.pmod(F.xxhash64(stream), F.lit(9))) % 10).cast("string"))


def _one(names: str, stream: Column) -> Column:
    found = names.split()
    return F.element_at(F.array(*map(F.lit, found)), (_byte(stream, F.lit(31)) % len(found) + 1).cast("int"))


def _given(m: Column, female: Column, stream: Column, draw: Column) -> Column:
    """A name of that gender and script; one that is drawn again is spelt anew."""
    pick = lambda script: F.when(female, _one(_GIVEN[script]["f"], stream)).otherwise(_one(_GIVEN[script]["m"], stream))
    known = F.when(m.rlike(r"^\p{IsCyrillic}"), pick("cyrillic")).otherwise(pick("latin"))
    return F.when((draw == 0) & m.rlike(r"^[\p{IsCyrillic}\p{IsLatin}]"), known).otherwise(_spelt(m, stream))


def surrogate(m: Column, k: Column, canon: Column, draw: Column, key: str = KEY) -> Column:
    """What replaces the notation `m` of an entity at its n-th draw."""
    stream = F.sha2(F.concat_ws("|", F.lit(key), k, canon, draw.cast("string")), 256)
    return let(stream, lambda s: _form(m, k, s, draw))


def _form(m: Column, k: Column, stream: Column, draw: Column) -> Column:
    ip = F.array_join(F.transform(F.split(m, r"\."), lambda _, i: (_byte(stream, i) % 254 + 1).cast("string")), ".")
    top = F.regexp_extract(m, r"\.\p{L}+$", 0)
    email = F.concat(_spelt(F.substring(m, F.lit(1), F.length(m) - F.length(top)), stream), top)
    name = F.when(k == "family", _spelt(m, stream)).otherwise(_given(m, k == "given-f", stream, draw))
    number = F.when(k == "ip", ip).when(k == "card", _card(m, stream)).otherwise(_digits(m, stream))
    # the room that forms get: more letters, of the name's last one's kind, or an extension
    more = F.greatest(draw - (ROOM - 1), F.lit(0))
    times = lambda c: F.when(more > 0, _spelt(F.repeat(c, more), F.concat(stream, F.lit("+")))).otherwise("")
    return F.when(k == "email", F.concat(times(F.lit("a")), email)).when(k.isin("family", "given-m", "given-f"), F.concat(name, times(F.substring(m, -1, 1)))).otherwise(
        F.concat(number, F.when(more > 0, F.concat(F.lit(" x"), times(F.lit("0")))).otherwise("")))


def _entity(k: Column, canon: Column) -> Column:
    return F.unhex(F.sha2(F.concat_ws("|", k, canon), 256))


def _few(df: DataFrame) -> DataFrame:
    """`df` of fixed-size rows, broadcast if they are few."""
    return F.broadcast(df) if df.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else df


def _drawn(entities: DataFrame, key: str) -> DataFrame:
    """(e, draw) of the entities whose first surrogate was taken. `entities`: e, k, canon, m, one notation of each."""
    real = entities.select(F.col("e").alias("form"), F.lit(True).alias("real"))
    settled, now, out = None, entities.withColumn("draw", F.lit(0)), None
    while True:
        s = canonical(surrogate(F.col("m"), F.col("k"), F.col("canon"), F.col("draw"), key), F.col("k"))
        # given names of either gender are names: a form must be free of both
        now = materialize(now.withColumn("form", _entity(F.col("k"), s)), "draws")
        owner = now.groupBy("form").agg(F.min("e").alias("owner"))
        taken = real if settled is None else real.unionByName(settled.select("form", F.lit(True).alias("real")))
        seen = now.join(owner, "form").join(taken.distinct(), "form", "left")
        seen = materialize(seen.withColumn("again", F.col("real").isNotNull() | (F.col("owner") != F.col("e"))), "draws")
        fine = seen.filter(~F.col("again")).select("e", "form", "draw")
        settled = fine if settled is None else settled.unionByName(fine)
        now = seen.filter("again").select("e", "k", "canon", "m", (F.col("draw") + 1).alias("draw"))
        if not now.limit(1).count():
            return settled.filter("draw > 0").select("e", "draw")


def _pieces(m: Column, k: Column) -> Column:
    """The entities of a mention: what stands before each, its type and notation. A name has one for each of its names."""
    title = F.regexp_extract(m, rf"^(?:{_MS}|{_MR})\.? ", 0)
    rest = F.substring(m, F.length(title) + 1, F.length(m))
    given, family = F.regexp_extract(rest, r"^([^ ]+) ", 1), F.regexp_extract(rest, r"([^ ]+)$", 1)
    sex = F.when(m.rlike(rf"^{_MS}(?![\p{{L}}])"), "given-f").otherwise("given-m")
    piece = lambda p, pre, kind_, m_: F.struct(F.lit(p).alias("p"), pre.alias("pre"), kind_.alias("k"), m_.alias("m"))
    none = F.lit("")
    return F.when(k != "name", F.array(piece(0, none, k, m))).when(given == "", F.array(piece(0, title, F.lit("family"), family))).otherwise(
        F.array(piece(0, title, sex, given), piece(1, F.lit(" "), F.lit("family"), family)))


def replace_pii(documents: DataFrame, key: str = KEY) -> DataFrame:
    """doc_id, text with surrogates, n_entities, and entities (type:start:end, in code points of the original)."""
    found = F.regexp_extract_all(F.col("text"), F.lit(_ANY), F.lit(0))
    # every pattern has a digit, an @ or a title in it
    likely = F.col("text").rlike(rf"[0-9]|@|\b(?:{_MS}|{_MR})\b")
    docs = documents.select("doc_id", "text", F.when(likely, found).otherwise(F.expr("cast(array() as array<string>)")).alias("ms"))
    plain = docs.filter("text is null or size(ms) = 0").select("doc_id", "text", F.lit(0).cast("long").alias("n_entities"), F.lit("").alias("entities"))
    with_ids = materialize(docs.filter("size(ms) > 0").withColumn("row", F.monotonically_increasing_id()), "pii")
    each = with_ids.select("row", F.posexplode("ms").alias("i", "m")).withColumn("kind", kind(F.col("m")))
    each = each.select("row", "i", "kind", F.length("m").alias("len"), F.explode(_pieces(F.col("m"), F.col("kind"))).alias("x"))
    each = each.select("row", "i", "kind", "len", "x.p", "x.pre", "x.k", "x.m").withColumn("canon", canonical(F.col("m"), F.col("k")))
    each = materialize(each.withColumn("e", _entity(F.col("k"), F.col("canon"))), "mentions")
    again = _drawn(each.groupBy("e").agg(F.min("k").alias("k"), F.min("canon").alias("canon"), F.min("m").alias("m")), key)
    new = each.join(_few(again), "e", "left").withColumn("s", surrogate(F.col("m"), F.col("k"), F.col("canon"), F.coalesce("draw", F.lit(0)), key))
    rows = new.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("i", "p", "kind", "len", "pre", "s"))).alias("es"))
    joined = with_ids.join(rows, "row").withColumn("gaps", F.split("text", _ANY, -1))
    between = lambda e: F.when(e["p"] == 0, F.get("gaps", e["i"])).otherwise("")
    text = F.concat(F.array_join(F.transform("es", lambda e: F.concat(between(e), e["pre"], e["s"])), ""), F.element_at("gaps", -1))
    firsts = F.filter("es", lambda e: e["p"] == 0)
    spans = F.aggregate(firsts, F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<string>)").alias("out")),
                        lambda a, e: let(a["at"] + F.length(F.get("gaps", e["i"])), lambda at: F.struct((at + e["len"]).alias("at"), F.array_append(
                            a["out"], F.concat_ws(":", e["kind"], at.cast("string"), (at + e["len"]).cast("string"))).alias("out"))),
                        lambda a: F.array_join(a["out"], ","))
    changed = joined.select("doc_id", text.alias("text"), F.size(firsts).cast("long").alias("n_entities"), spans.alias("entities"))
    return plain.unionByName(changed)
