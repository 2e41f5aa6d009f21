"""What the tokens of an expression say: argument kinds, receivers, declared types and body shapes."""

from __future__ import annotations

import re
from collections.abc import Callable

OPEN, CLOSE = {"(": ")", "[": "]", "{": "}"}, {")": "(", "]": "[", "}": "{"}
_INT = re.compile(r"(0[xX][0-9a-fA-F_]+|0[bB][01_]+|\d[\d_]*)[lL]?")
_ESCAPE = re.compile(r"\\(u+[0-9a-fA-F]{4}|[0-3]?[0-7]{1,2}|.)", re.S)
_NAMED = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "s": " ", "0": "\0"}
NOT_TYPES = frozenset("return new throw else case assert yield package import extends implements instanceof goto if while do in final static public private protected abstract".split())


def unescaped(literal: str) -> str:
    """The value of a string literal or text block."""
    block = literal.startswith('"""')
    body = literal[3 : -3 if literal.endswith('"""') and len(literal) > 5 else None] if block else literal[1 : -1 if len(literal) > 1 and literal.endswith('"') else None]
    if block:
        body = body.split("\n", 1)[-1]

    def one(m: re.Match) -> str:
        e = m[1]
        if e[0] == "u" and len(e) > 4:
            return chr(int(e.lstrip("u"), 16))
        return chr(int(e, 8)) if e[0] in "01234567" else _NAMED.get(e, e)

    return _ESCAPE.sub(one, body)


def integer(text: str) -> int | None:
    """The value of an integer literal."""
    if not _INT.fullmatch(text):
        return None
    raw = text.rstrip("lL").replace("_", "")
    try:
        return int(raw, 0) if raw[:2].lower() in ("0x", "0b") else int(raw, 8 if len(raw) > 1 and raw[0] == "0" else 10)
    except ValueError:
        return None


def before_bracket(tokens: list, i: int) -> int:
    """Place of the bracket that the one at i closes; -1 if there is none."""
    depth = 0
    while i >= 0:
        depth += (tokens[i].text in CLOSE) - (tokens[i].text in OPEN)
        if not depth:
            return i
        i -= 1
    return -1


def split_top(tokens: list, sign: str) -> list[list]:
    """Parts between the signs that stand outside brackets."""
    parts, depth = [[]], 0
    for t in tokens:
        depth += (t.text in OPEN) - (t.text in CLOSE)
        if t.text == sign and not depth and t.kind == "sign":
            parts.append([])
        else:
            parts[-1].append(t)
    return parts


def argument(tokens: list, constants: dict[str, dict]) -> dict:
    """kind, value and text of an argument; a constant's name stands for its literal."""
    text = " ".join(t.text for t in tokens)
    shape = lambda kind, **more: {"kind": kind, "sval": None, "ival": None, "bval": None, "text": text[:120], "constant": None} | more
    first, last = tokens[0], tokens[-1]
    if len(tokens) == 1:
        if first.kind in ("string", "text"):
            return shape("string", sval=unescaped(first.text))
        if first.text in ("true", "false"):
            return shape("bool", bval=first.text == "true")
        if first.text == "null":
            return shape("null")
        if first.kind == "num":
            n = integer(first.text)
            return shape("other") if n is None or not -(1 << 63) <= n < 1 << 63 else shape("int", ival=n)
        if first.kind == "word":
            return constants[first.text] | {"constant": first.text} if first.text in constants else shape("identifier")
        return shape("other")
    top, depth = [], 0
    for k, t in enumerate(tokens):
        if not depth and t.kind == "sign":
            top.append((k, t.text))
        depth += (t.text in OPEN) - (t.text in CLOSE)
    signs = [s for _, s in top]
    doubled = {s for (i, s), (j, u) in zip(top, top[1:], strict=False) if s == u and j == i + 1}
    generic = first.text == "new"
    if "?" in signs or "->" in signs or "::" in signs or ("=" in signs and not generic) or "|" in doubled or "&" in doubled:
        return shape("other")
    if "|" in signs:
        return shape("flags")
    if not generic and ({"^", "&", "<", ">"} & set(signs)):
        return shape("other")
    binary = [s for i, s in top if s in "+-" and i and (tokens[i - 1].kind != "sign" or tokens[i - 1].text in CLOSE)]
    if binary:
        if binary[-1] != "+":
            return shape("other")
        leaves = split_top(tokens, "+")
        plain = all(len(x) == 1 and (x[0].kind in ("string", "char") or (x[0].kind == "num" and integer(x[0].text) is not None)) for x in leaves)
        return shape("string-concat" if plain else "concat")
    if generic or first.text == "{":
        if last.text == "}":
            inner = tokens[before_bracket(tokens, len(tokens) - 1) + 1 : -1]
            array = first.text == "{" or "[" in signs
            if array:
                items = [x for x in split_top(inner, ",") if x]
                literal = bool(items) and all(x[-1].kind in ("num", "char") and len(x) <= 2 and (len(x) == 1 or x[0].text in "-+~") for x in items)
                return shape("array-literal" if literal else "array")
        return shape("array" if last.text == "]" else "other")
    if last.text == ")":
        at = before_bracket(tokens, len(tokens) - 1)
        if at > 0 and tokens[at - 1].kind == "word":
            if tokens[at - 1].text == "getBytes" and at == 3 and first.kind == "string":
                return shape("bytes-literal", sval=unescaped(first.text))
            return shape("call") if first.text != "(" or signs.count("(") > 1 else shape("other")
        return shape("other")
    if all(t.kind == "word" for t in tokens[::2]) and all(t.text == "." for t in tokens[1::2]) and len(tokens) % 2:
        return shape("field")
    return shape("other")


def declared_type(tokens: list, i: int) -> str | None:
    """Type before the name at i, if the name is declared there; without generics, with [] for arrays."""
    after = tokens[i + 1].text if i + 1 < len(tokens) else ""
    if after not in ("=", ";", ",", ")", ":", "["):
        return None
    k, array = i - 1, ""
    while k >= 0 and tokens[k].text in ("]", "..."):
        array, k = "[]", k - (2 if tokens[k].text == "]" else 1)
    if k >= 0 and tokens[k].text == ">":
        depth = 0
        while k >= 0:
            depth += (tokens[k].text == ">") - (tokens[k].text == "<")
            if tokens[k].text not in ("<", ">", ",", ".", "?", "&", "[", "]") and tokens[k].kind != "word":
                return None
            k -= 1
            if not depth:
                break
    parts = []
    while k >= 0 and tokens[k].kind == "word" and tokens[k].text not in NOT_TYPES:
        parts.append(tokens[k].text)
        if k and tokens[k - 1].text == ".":
            k -= 2
        else:
            break
    return ".".join(reversed(parts)) + array if parts else None


def receiver(tokens: list, i: int, type_of: Callable[[str], str | None]) -> dict:
    """What the method called at i is called on; `type_of` a name: its declared type, "?" if unknown, None if no variable."""
    none = {"kind": "implicit", "name": None, "type": None, "method": None, "inner_kind": None, "inner_name": None}
    if i < 2 or tokens[i - 1].text != ".":
        return none
    t = tokens[i - 2]
    known = lambda x: None if x in (None, "?") else x
    if t.kind == "string":
        return none | {"kind": "new", "type": "String"}
    if t.text == ")":
        at = before_bracket(tokens, i - 2)
        if at > 0 and tokens[at - 1].kind == "word":
            k, parts = at - 1, []
            while k >= 0 and tokens[k].kind == "word":
                parts.append(tokens[k].text)
                if k > 1 and tokens[k - 1].text == ".":
                    k -= 2
                else:
                    break
            if k and tokens[k - 1].text == "new":
                return none | {"kind": "new", "type": ".".join(reversed(parts))}
            inner = receiver(tokens, at - 1, type_of)
            return none | {"kind": "call", "method": tokens[at - 1].text, "inner_kind": inner["kind"], "inner_name": inner["name"]}
        return none | {"kind": "expression"}
    if t.kind != "word":
        return none | {"kind": "expression"}
    k, parts = i - 2, []
    while k >= 0 and tokens[k].kind == "word":
        parts.append(tokens[k].text)
        if k > 1 and tokens[k - 1].text == ".":
            k -= 2
            if tokens[k].kind != "word":
                return none | {"kind": "expression"}
        else:
            break
    parts.reverse()
    if parts == ["this"]:
        return none
    if parts == ["super"]:
        return none | {"kind": "expression"}
    if len(parts) == 1:
        declared = type_of(parts[0])
        return none | ({"kind": "variable", "name": parts[0], "type": known(declared)} if declared else {"kind": "name", "name": parts[0]})
    if len(parts) == 2 and parts[0] == "this":
        return none | {"kind": "variable", "name": parts[1], "type": known(type_of(parts[1]))}
    return none | {"kind": "name", "name": ".".join(parts)}


def body_shape(tokens: list, at: int, end: int) -> tuple[str, list[str]]:
    """(empty, returns-true, throws or other; names of the calls) of the body between the braces at `at` and `end`."""
    inside = tokens[at + 1 : end]
    calls, k = [], 0
    while k < len(inside):
        t = inside[k]
        opens_class = t.text == "{" and k and inside[k - 1].text in (")", "->") and _is_nested(inside, k)
        if opens_class:
            depth = 0
            while k < len(inside):
                depth += (inside[k].text == "{") - (inside[k].text == "}")
                k += 1
                if not depth:
                    break
            continue
        if t.kind == "word" and inside[k + 1 : k + 2] and inside[k + 1].text == "(" and not _is_creation(inside, k) and t.text not in ("if", "for", "while", "switch", "catch", "synchronized", "try", "return", "super", "this"):
            calls.append(t.text)
        k += 1
    if not inside:
        return "empty", calls
    if [t.text for t in inside] == ["return", "true", ";"]:
        return "returns-true", calls
    statements = [x for x in split_top(inside, ";") if x]
    return ("throws" if all(x[0].text == "throw" for x in statements) else "other"), calls


def _is_creation(tokens: list, k: int) -> bool:
    while k > 1 and tokens[k - 1].text == ".":
        k -= 2
    return k > 0 and tokens[k - 1].text == "new"


def _is_nested(tokens: list, k: int) -> bool:
    """True if the brace at k opens an anonymous class or a lambda."""
    if tokens[k - 1].text == "->":
        return True
    at = before_bracket(tokens, k - 1)
    return at > 1 and tokens[at - 1].kind == "word" and _is_creation(tokens, at - 1)
