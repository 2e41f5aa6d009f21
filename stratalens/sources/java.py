"""Tolerant Java reader: declarations, references, calls, creations, literals and identifiers of one file.

A lexer splits the text into tokens with their lines; a stack of scopes then follows braces. A file that ends inside a
scope or closes one too many is marked partial, and its good declarations stay.

A call's receiver is described by its form (implicit, variable with its declared type, name, call, creation), an argument by its
kind and literal value; a method by the shape of its body. Fields and constants count for their whole class, wherever they are
declared: a first walk collects them, the second one uses them. Types that a class creates, declares variables of or calls static methods
of are facts of kind `uses`, each once with its first line; string constants are facts of kind `constant`.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from . import expressions as X

#: Larger files are skipped with a warning.
MAX_BYTES = 8 << 20
SKIPPED = (".git", ".venv", "node_modules")
_TOKEN = re.compile(
    r'(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<text>"""(?:\\.|.)*?(?:"""|\Z))|(?P<string>"(?:\\.|[^"\\\n])*"?)|(?P<char>\'(?:\\.|[^\'\\\n])*\'?)'
    r"|(?P<num>0[xX][0-9a-fA-F_]+[lL]?|0[bB][01_]+[lL]?|\d[\d_]*(?:\.\d+)?[a-zA-Z]*)|(?P<word>[^\W\d][\w$]*|\$[\w$]*)|(?P<sign>\.\.\.|->|::|[^\s\w])", re.S)
_TYPES = ("class", "interface", "enum", "record")
#: Types that no `uses` fact names.
PLAIN = frozenset("int long short byte char boolean float double void var String Object".split())
#: Fixed forms of the comments that decompilers put above a declaration.
_RENAMED = re.compile(r"/\*\s*(?:JADX INFO:\s*)?renamed from:\s*([^,*\s]+)")
_COMPILED = re.compile(r"/\*\s*(?:JADX INFO:\s*)?compiled from:\s*([^*\s]+)")
_KEYWORDS = frozenset("if for while switch catch synchronized return throw new super this assert else do try instanceof case".split())
DECLARATIONS = "path string, ord int, id string, name string, package string, owner string, kind string, abstract boolean, line int, end_line int, declaration string, original_name string, source_file string, partial boolean"
REFS = "owner string, ord int, name string, kind string"
_RECEIVER = "kind string, name string, type string, method string, inner_kind string, inner_name string"
_ARGUMENT = "kind string, sval string, ival bigint, bval boolean, text string, constant string"
FACTS = (f"owner string; ord int; kind string; method string; name string; value string; receiver struct<{_RECEIVER}>; args array<struct<{_ARGUMENT}>>; body string; "
         "calls array<string>; anonymous_type string; anonymous boolean; line int; end_line int; snippet string")
IMPORTS = "path string, simple string, fqn string, wildcard boolean"


@dataclass
class Token:
    kind: str
    text: str
    line: int
    at: int


@dataclass
class Declaration:
    id: str
    name: str
    owner: str | None
    kind: str
    abstract: bool
    line: int
    end_line: int
    declaration: str
    original_name: str | None
    source_file: str | None
    refs: list[tuple[str, str]] = field(default_factory=list)


@dataclass
class Unit:
    package: str = ""
    imports: list[tuple[str, str, bool]] = field(default_factory=list)
    declarations: list[Declaration] = field(default_factory=list)
    facts: list[dict] = field(default_factory=list)
    partial: bool = False


def lex(source: str) -> list[Token]:
    out, line, last = [], 1, 0
    for m in _TOKEN.finditer(source):
        line += source.count("\n", last, m.start())
        last = m.start()
        out.append(Token(m.lastgroup or "sign", m[0], line, m.start()))
    return out


def _skip(tokens: list[Token], i: int, opening: str, closing: str) -> int:
    """Place after the bracket that closes the one at i."""
    depth = 0
    while i < len(tokens):
        depth += (tokens[i].text == opening) - (tokens[i].text == closing)
        i += 1
        if not depth:
            break
    return i


def _name(tokens: list[Token], i: int) -> tuple[str, int]:
    """A dotted name from i, without generics and annotations."""
    parts = []
    while i < len(tokens):
        if tokens[i].text == "@":
            _, i = _name(tokens, i + 1)
            if i < len(tokens) and tokens[i].text == "(":
                i = _skip(tokens, i, "(", ")")
        elif tokens[i].kind == "word":
            parts.append(tokens[i].text)
            i += 1
            if i < len(tokens) and tokens[i].text == "<":
                i = _skip(tokens, i, "<", ">")
            if i >= len(tokens) or tokens[i].text != ".":
                break
            i += 1
        else:
            break
    return ".".join(parts), i


def _arguments(tokens: list[Token], i: int, constants: dict[str, dict]) -> list[dict]:
    """Each argument of the bracket at i."""
    end = _skip(tokens, i, "(", ")") - 1
    return [X.argument(p, constants) for p in X.split_top(tokens[i + 1 : end], ",") if p]


@dataclass
class Anonymous:
    """An anonymous body; `type` is None for a local class."""

    type: str | None


def parse(source: str) -> Unit:
    everything, fields, constants = lex(source), {}, {}
    _walk(source, everything, fields, constants, False)
    return _walk(source, everything, fields, constants, True)


def _walk(source: str, everything: list[Token], fields: dict[int, dict[str, str]], constants: dict[int, dict[str, dict]], second: bool) -> Unit:
    """One walk over the tokens; `fields` and `constants` of each class body, by the place of its brace."""
    unit = Unit()
    tokens = [t for t in everything if t.kind != "comment"]
    notes = [t for t in everything if t.kind == "comment"]
    note_places = [t.at for t in notes]
    used: set[tuple[str, str]] = set()
    stack: list[Declaration | Anonymous | None] = []  # a type, an anonymous body, None for any other brace
    scopes: list[tuple[int, dict[str, str]]] = []  # of each open brace: its place, and the variables declared in it
    coming: dict[str, str] = {}  # variables declared in brackets, for the brace that follows
    waiting: Declaration | Anonymous | None = None
    anonymous_at: dict[int, str] = {}
    i, paren = 0, 0

    def type_of(name: str) -> str | None:
        if name in coming:
            return coming[name]
        for (at, own), s in zip(reversed(scopes), reversed(stack), strict=True):
            found = own.get(name) or (fields.get(at, {}).get(name) if s is not None else None)
            if found:
                return found
        return None

    def literals() -> dict[str, dict]:
        out: dict[str, dict] = {}
        for (at, _), s in zip(scopes, stack, strict=True):
            if s is not None:
                out |= constants.get(at, {})
        return out

    def owner() -> Declaration | None:
        return next((s for s in reversed(stack) if isinstance(s, Declaration)), None)

    def fact(kind: str, t: Token, **more: object) -> None:
        o = owner()
        if o:
            above = [x for x in stack[stack.index(o) :] if isinstance(x, Anonymous)]
            start = source.rfind("\n", 0, t.at) + 1
            end = source.find("\n", t.at)
            unit.facts.append({"owner": o.id, "kind": kind, "line": t.line, "end_line": t.line, "anonymous": bool(above), "anonymous_type": above[-1].type if above else None, "method": None, "name": None,
                               "receiver": None, "value": None, "args": None, "body": None, "calls": None, "snippet": source[start : end if end >= 0 else len(source)].strip()[:400]} | more)

    def use(name: str, t: Token) -> None:
        name, o = name.replace("[]", ""), owner()
        if second and o and name and name not in PLAIN and name != o.name and (o.id, name) not in used:
            used.add((o.id, name))
            fact("uses", t, name=name)

    while i < len(tokens):
        t = tokens[i]
        before = tokens[i - 1].text if i else ""
        nxt = tokens[i + 1].text if i + 1 < len(tokens) else ""
        if t.text == "@" and nxt == "interface":
            i += 1
            continue
        if t.text == "@" and tokens[i + 1 : i + 2] and tokens[i + 1].kind == "word":
            _, i = _name(tokens, i + 1)  # literals of annotations are no facts
            if i < len(tokens) and tokens[i].text == "(":
                i = _skip(tokens, i, "(", ")")
            continue
        if t.text in ("package", "import") and not stack:
            j = i + 1 + (nxt == "static")
            name, j = _name(tokens, j)
            star = j < len(tokens) and tokens[j].text == "*"
            if t.text == "package":
                unit.package = name
            else:
                unit.imports.append((name.rsplit(".", 1)[-1], name, star or tokens[j - 1].text == "*"))
            while j < len(tokens) and tokens[j].text != ";":
                j += 1
            i = j + 1
            continue
        is_type = t.text in _TYPES and before != "." and tokens[i + 1 : i + 2] and tokens[i + 1].kind == "word" and nxt not in _KEYWORDS
        if is_type and t.text == "record" and not (i + 2 < len(tokens) and tokens[i + 2].text in "(<"):
            is_type = False
        if is_type:
            local = bool(stack) and not isinstance(stack[-1], Declaration)
            j, refs, kind = i + 2, [], "annotation" if before == "@" else t.text
            if j < len(tokens) and tokens[j].text == "<":
                j = _skip(tokens, j, "<", ">")
            if j < len(tokens) and tokens[j].text == "(":
                j = _skip(tokens, j, "(", ")")
            while j < len(tokens) and tokens[j].text not in "{;":
                word = tokens[j].text
                if word in ("extends", "implements", "permits"):
                    while True:
                        name, k = _name(tokens, j + 1)
                        if name and word != "permits":
                            refs.append((name, word))
                        j = k
                        if j >= len(tokens) or tokens[j].text != ",":
                            break
                else:
                    j += 1
            first = i
            while first and (tokens[first - 1].kind == "word" or tokens[first - 1].text == "@") and tokens[first - 1].text not in ("{", "}", ";"):
                first -= 1
            o = owner()
            full = f"{o.id}.{nxt}" if o else f"{unit.package}.{nxt}" if unit.package else nxt
            top = _with_annotations(tokens, first)
            low = bisect_right(note_places, tokens[top - 1].at) if top else 0
            close = [n.text for n in notes[low : bisect_left(note_places, tokens[top].at)]]
            note, origin = (next((m[1] for n in reversed(close) for m in [form.search(n)] if m), None) for form in (_RENAMED, _COMPILED))
            d = Declaration(full, nxt, o.id if o else None, kind, kind == "interface" or "abstract" in {x.text for x in tokens[first:i]}, t.line, t.line,
                            source[tokens[first].at : tokens[j].at if j < len(tokens) else len(source)].strip(), note, origin, refs)
            waiting = None if local else d
            if local:
                waiting = Anonymous(None)
            else:
                unit.declarations.append(d)
            i = j
            continue
        if t.text == "{":
            if i in anonymous_at:
                waiting = Anonymous(anonymous_at[i])
            stack.append(waiting)
            scopes.append((i, coming))
            waiting, coming = None, {}
        elif t.text == "}":
            if stack:
                top = stack.pop()
                scopes.pop()
                if isinstance(top, Declaration):
                    top.end_line = t.line
            else:
                unit.partial = True
        elif t.text in "()":
            paren += 1 if t.text == "(" else -1
        elif t.text == ";" and not paren:
            coming = {}
        elif t.text == "new" and tokens[i + 1 : i + 2] and tokens[i + 1].kind == "word":
            name, j = _name(tokens, i + 1)
            if j < len(tokens) and tokens[j].text == "(":
                use(name, t)
                if second:
                    fact("new", t, name=name, args=_arguments(tokens, j, literals()))
                k = _skip(tokens, j, "(", ")")
                if k < len(tokens) and tokens[k].text == "{":
                    anonymous_at[k] = name
        elif t.kind in ("string", "text"):
            if second:
                fact("string", t, value=X.unescaped(t.text))
        elif t.kind == "word" and nxt == "(" and t.text not in _KEYWORDS and before != "new" and stack:
            declares = isinstance(stack[-1], (Declaration, Anonymous))
            after = _skip(tokens, i + 1, "(", ")")
            if not (declares and i and (tokens[i - 1].kind == "word" or before in (">", "]"))):
                use(_static_receiver(tokens, i), t)
                if second:
                    fact("call", t, method=t.text, name=t.text, receiver=X.receiver(tokens, i, type_of), args=_arguments(tokens, i + 1, literals()))
            elif second:
                while after < len(tokens) and tokens[after].text not in "{;":
                    after += 1  # throws
                shape, calls = "abstract", []
                if after < len(tokens) and tokens[after].text == "{":
                    shape, calls = X.body_shape(tokens, after, _skip(tokens, after, "{", "}") - 1)
                fact("override", t, method=t.text, name=t.text, body=shape, calls=calls)
        elif t.kind == "word":
            declared = X.declared_type(tokens, i) if t.text not in _KEYWORDS else None
            if nxt == "->":
                declared = "?"
            if declared and stack:
                if declared != "?" and (not paren or (nxt == "=" and _opens_for(tokens, i))):
                    use(declared, t)
                if paren or not scopes:
                    coming[t.text] = declared
                elif stack[-1] is not None:
                    at = scopes[-1][0]
                    fields.setdefault(at, {}).setdefault(t.text, declared)
                    own = constants.setdefault(at, {})
                    _constant(tokens, i, own)
                    if second and own.get(t.text, {}).get("kind") == "string" and isinstance(stack[-1], Declaration):
                        fact("constant", t, name=t.text, value=own[t.text]["sval"])
                else:
                    scopes[-1][1][t.text] = declared
            elif t.text.isupper() and len(t.text) > 2 and second:
                fact("identifier", t, name=t.text)
        elif t.text == "->" and before == ")":
            at = X.before_bracket(tokens, i - 1)
            for x in X.split_top(tokens[at + 1 : i - 1], ","):
                if len(x) == 1:
                    coming[x[0].text] = "?"
        i += 1
    unit.partial = unit.partial or bool(stack) or paren != 0
    return unit


def _with_annotations(tokens: list[Token], first: int) -> int:
    """Place of the first annotation that stands before the modifiers at `first`."""
    while first:
        k = first - 1
        if tokens[k].text == ")":
            k = X.before_bracket(tokens, k) - 1
        while k > 1 and tokens[k].kind == "word" and tokens[k - 1].text == ".":
            k -= 2
        if k < 1 or tokens[k].kind != "word" or tokens[k - 1].text != "@":
            if tokens[first - 1].kind != "word":
                return first
            k = first  # a modifier
        first = k - 1
    return first


def _static_receiver(tokens: list[Token], i: int) -> str:
    """The dotted name before the method at i, where it can name a type: a capital or a dot in it; else empty."""
    k, parts = i, []
    while k > 1 and tokens[k - 1].text == "." and tokens[k - 2].kind == "word":
        parts.append(tokens[k - 2].text)
        k -= 2
    if k and tokens[k - 1].text in (".", "::"):
        return ""  # begins with a call or a bracket
    return ".".join(reversed(parts)) if len(parts) > 1 or (parts and parts[0][:1].isupper()) else ""


def _opens_for(tokens: list[Token], i: int) -> bool:
    """True if the variable at i is declared in the head of a `for`."""
    while i and (tokens[i].kind == "word" or tokens[i].text in "<>,.[]?&"):
        i -= 1
    return i > 0 and tokens[i].text == "(" and tokens[i - 1].text == "for"


def _constant(tokens: list[Token], i: int, found: dict[str, dict]) -> None:
    """The literal of a static final field declared at i."""
    if tokens[i + 1].text != "=":
        return
    k = i
    while k and tokens[k - 1].text not in ("{", "}", ";"):
        k -= 1
    if not {"static", "final"} <= {t.text for t in tokens[k:i]}:
        return
    depth, end = 0, i + 2
    while end < len(tokens) and (depth or tokens[end].text not in (";", ",")):
        depth += (tokens[end].text in X.OPEN) - (tokens[end].text in X.CLOSE)
        end += 1
    value = X.argument(tokens[i + 2 : end], {}) if end > i + 2 else {"kind": "other"}
    if value["kind"] in ("string", "int", "bool", "array-literal", "bytes-literal"):
        found[tokens[i].text] = value


def read_sources(spark: SparkSession, root: str) -> DataFrame:
    """(path, content, length) of all .java files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.java").load(root)
    for name in SKIPPED:
        files = files.filter(~F.contains("path", F.lit(f"/{name}/")))
    return files.select("path", F.decode("content", "utf-8").alias("content"), "length")


def warnings(files: DataFrame) -> DataFrame:
    return files.filter(F.octet_length("content") > MAX_BYTES).select("path", F.lit("file above the size limit").alias("message"))


def parsed(files: DataFrame) -> DataFrame:
    """One row for each file: declarations, refs, facts and imports as arrays; read each with `entity`."""
    return _parsed(files, "path", "")


def parsed_versions(files: DataFrame) -> DataFrame:
    """As `parsed`, with the version (path, mtime, size) of each file; works on streams too."""
    return _parsed(files, "path, mtime, size", "path string, mtime bigint, size bigint, ")


def _parsed(files: DataFrame, keep: str, ddl_of_kept: str) -> DataFrame:
    ship(files.sparkSession)
    fields = lambda s: [c.strip() for c in s.split(";" if ";" in s else ",")]
    struct = lambda s: "struct<" + ", ".join(c.replace(" ", ": ", 1) for c in fields(s)) + ">"

    # the same names and types as Spark's, for the workers' batches
    kinds = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
    record = lambda s: pa.struct([(c.split(" ")[0], kinds[c.split(" ")[1]]) for c in s.split(", ")])
    kinds |= {f"struct<{_RECEIVER}>": record(_RECEIVER), f"array<struct<{_ARGUMENT}>>": pa.list_(record(_ARGUMENT))}
    of = lambda s: pa.list_(pa.struct([(c.split(" ", 1)[0], kinds[c.split(" ", 1)[1]]) for c in fields(s)]))
    kept = [c.strip() for c in keep.split(",")] if ddl_of_kept else []
    target = pa.schema([*[(c, pa.string() if c == "path" else pa.int64()) for c in kept], ("declarations", of(DECLARATIONS)), ("refs", of(REFS)), ("facts", of(FACTS)), ("imports", of(IMPORTS))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.to_pylist():
                path, u = file["path"], parse(file["content"] or "")
                row = {c: file[c] for c in kept} | {
                    "declarations": [{"path": path, "ord": k, "package": u.package, "partial": u.partial} | {x: getattr(d, x) for x in ("id", "name", "owner", "kind", "abstract", "line", "end_line", "declaration", "original_name", "source_file")} for k, d in enumerate(u.declarations)],
                    "refs": [{"owner": d.id, "ord": k, "name": n, "kind": kind} for d in u.declarations for k, (n, kind) in enumerate(d.refs)],
                    "facts": [f | {"ord": k} for k, f in enumerate(u.facts)],
                    "imports": [{"path": path, "simple": s, "fqn": n, "wildcard": w} for s, n, w in u.imports]}
                yield pa.RecordBatch.from_pylist([row], schema=target)

    ddl = ddl_of_kept + f"declarations array<{struct(DECLARATIONS)}>, refs array<{struct(REFS)}>, facts array<{struct(FACTS)}>, imports array<{struct(IMPORTS)}>"
    return files.filter(F.octet_length("content") <= MAX_BYTES).selectExpr(*[c.strip() for c in keep.split(",")], "content").mapInArrow(run, ddl)


def entity(rows: DataFrame, name: str) -> DataFrame:
    return rows.select(F.inline(name))
