"""Classes of a source text: their names, the classes and interfaces they build on, and the methods they declare."""

from __future__ import annotations

import re
from typing import NamedTuple


class Class(NamedTuple):
    name: str
    bases: list[str]
    methods: list[str]


_TOKEN = re.compile(
    r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"\"\".*?(?:\"\"\"|\Z)|\"(?:[^\"\\\n]|\\.)*\"|`[^`]*`|'(?:[^'\\\n]|\\.)'|(?P<word>[A-Za-z_$][\w$]*)|(?P<mark>::|->|=>|\n|[^\s\w])|\d\w*", re.S
)
_WORD = re.compile(r"[A-Za-z_$]")
#: Words that begin a class, by language; what may stand among bases without being one.
_OPENERS = {"java": ("class", "interface", "enum", "record"), "javascript": ("class",), "cpp": ("class", "struct"), "c": ("class", "struct"), "rust": ("trait", "impl"), "go": ("type",)}
_NO_BASE = frozenset("public private protected virtual final sealed permits typename dyn Sized where".split())
_NO_METHOD = frozenset("if for while switch catch return throw sizeof synchronized do else match loop".split())


def _without_generics(head: list[str]) -> list[str]:
    out, depth = [], 0
    for t in head:
        depth += (t == "<") - (t == ">" and depth > 0)
        if not depth and t != ">":
            out.append(t)
    return out


def _names(tokens: list[str]) -> list[str]:
    """The last component of each name between commas or plus signs."""
    out, last = [], ""
    for t in [*tokens, ","]:
        if t in ",+&":
            if last:
                out.append(last)
            last = ""
        elif _WORD.match(t) and t not in _NO_BASE:
            last = t
    return out


def _header(head: list[str], language: str) -> tuple[str, list[str]] | None:
    """Name and bases if what stands before a brace begins a class."""
    head = _without_generics([t for t in head if t != "\n"])
    at = next((k for k, t in enumerate(head) if t in _OPENERS[language]), None)
    if at is None or "(" in head[:at] or "=" in head[:at]:
        return None
    rest = head[at + 1 :]
    if language == "rust" and head[at] == "impl":
        if "where" in rest:
            rest = rest[: rest.index("where")]
        if "for" in rest:
            owner, trait = _names(rest[rest.index("for") + 1 :]), _names(rest[: rest.index("for")])
            return (owner[-1], trait) if owner else None
        owner = _names(rest)
        return (owner[-1], []) if owner else None
    if language == "go":
        return (rest[0], []) if len(rest) > 1 and rest[-1] in ("struct", "interface") else None
    if language in ("c", "cpp"):
        own = rest[: rest.index(":")] if ":" in rest else rest
        names = [t for t in own if _WORD.match(t) and t != "final"]
        if not names or "(" in own:
            return None
        return names[-1], _names(rest[rest.index(":") + 1 :]) if ":" in rest else []
    if not rest or not _WORD.match(rest[0]):
        return None
    name, bases = rest[0], []
    if language == "rust":
        return name, _names(rest[rest.index(":") + 1 :]) if ":" in rest else []
    for k, t in enumerate(rest):
        if t in ("extends", "implements"):
            stop = next((n for n in range(k + 1, len(rest)) if rest[n] in ("extends", "implements", "permits")), len(rest))
            bases += _names(rest[k + 1 : stop])
    return name, bases


def _method(head: list[str]) -> str | None:
    head = [t for t in head if t != "\n"]
    if "(" not in head:
        return None
    k = head.index("(")
    return head[k - 1] if k and _WORD.match(head[k - 1]) and head[k - 1] not in _NO_METHOD and "=" not in head[:k] else None


def classes(text: str | None, language: str | None) -> list[Class]:
    """The classes of a text, each with its direct bases and methods; a class that is opened twice comes twice. Nothing for
    languages without classes, null texts, and unfinished headers."""
    if not text:
        return []
    if language == "python":
        return _python(text)
    if language not in _OPENERS:
        return []
    out: list[Class] = []
    open_: list[Class | None] = []  # the class of each open brace
    head: list[str] = []
    for m in _TOKEN.finditer(text):
        t = m["word"] or m["mark"]
        if t is None:
            continue
        if t == "{":
            inside = open_[-1] if open_ else None
            found = _header(head, language)
            if found:
                new = Class(found[0], list(dict.fromkeys(found[1])), [])
                out.append(new)
                open_.append(new)
            else:
                if inside is not None and (name := _method(head)):
                    inside.methods.append(name)
                open_.append(None)
            head = []
        elif t in ";}":
            inside = open_[-1] if open_ else None
            if inside is not None and (name := _method(head)):
                inside.methods.append(name)
            if t == "}" and open_:
                open_.pop()
            head = []
        elif t == "\n":
            if language == "go":
                inside = open_[-1] if open_ else None
                line = [x for x in head if x != "*"]
                if inside is not None:
                    if line and all(_WORD.match(x) or x == "." for x in line) and (len(line) == 1 or len(line) == 3 and line[1] == "."):
                        inside.bases.append(line[-1])
                    elif name := _method(head):
                        inside.methods.append(name)
                head = []
        elif t == ":" and language == "cpp" and head and head[-1] in ("public", "private", "protected") and len(head) == 1:
            head = []
        else:
            head.append(t)
    return out


_PY_CLASS = re.compile(r"([ \t]*)class\s+(\w+)\s*(?:\(((?:[^()]|\([^()]*\))*)\))?\s*:")
_PY_METHOD = re.compile(r"([ \t]*)(?:async\s+)?def\s+(\w+)")
_PY_TEXT = re.compile(r"\"\"\".*?(?:\"\"\"|\Z)|'''.*?(?:'''|\Z)|#[^\n]*", re.S)


def _python(text: str) -> list[Class]:
    out: list[Class] = []
    open_: list[tuple[int, Class]] = []
    text = _PY_TEXT.sub(lambda m: "\n" * m.group().count("\n"), text.replace("\r\n", "\n"))
    at = 0
    while at < len(text):
        end = text.find("\n", at)
        end = len(text) if end < 0 else end
        if m := _PY_CLASS.match(text, at):
            indent = len(m[1].expandtabs())
            while open_ and open_[-1][0] >= indent:
                open_.pop()
            bases = [b.strip() for b in (m[3] or "").split(",")]
            new = Class(m[2], list(dict.fromkeys(b.rpartition(".")[2].partition("[")[0] for b in bases if b and "=" not in b and _WORD.match(b))), [])
            out.append(new)
            open_.append((indent, new))
            end = max(end, text.find("\n", m.end() - 1)) if "\n" in m.group() else end
        elif m := _PY_METHOD.match(text, at):
            indent = len(m[1].expandtabs())
            while open_ and open_[-1][0] >= indent:
                open_.pop()
            if open_:
                open_[-1][1].methods.append(m[2])
        at = end + 1
    return out


_CPP_OWNER = re.compile(r"(\w+)\s*(?:<[^<>(){};]*>)?\s*::\s*~?(\w+)\s*\(")
_GO_OWNER = re.compile(r"^func\s*\(\s*(?:\w+\s+)?\*?\s*(\w+)(?:\[[^\]]*\])?\s*\)\s*(\w+)", re.M)


def owner(text: str | None, language: str | None, name: str | None) -> str | None:
    """The class that a captured method itself names: ``X::f`` in C++, a receiver in Go."""
    pattern = {"cpp": _CPP_OWNER, "go": _GO_OWNER}.get(language or "")
    if not pattern or not text or not name:
        return None
    return next((m[1] for m in pattern.finditer(text) if m[2] == name), None)
