"""Functions with their documentation: extraction from a captured text, cleaning, and what counts as trivial."""

from __future__ import annotations

import re
from typing import NamedTuple

from weftgraph.llm.syntax import language_of

# fixed words and patterns: the tags of documentation tools, placeholders, tool directives and licence phrases
_TAG = re.compile(
    r"^\s*(?:[@\\](?:param(?:eter)?|arg|tparam|returns?|retval|throws?|exception|raises?|see|since|version|author|deprecated|brief|details?|note|in|out|type|rtype|yields?|type|private|public|internal|inner|function|method|class|static|async)(?:\[[\w,]*\])?\b|"
    r":(?:param|type|returns?|rtype|raises?|yields?|arg|var|ivar|cvar|meta)\b[^:\n]*:)"
)
_NAMED = re.compile(r"^\s*(?:[@\\](?:param|arg|tparam|throws?|exception|raises?|retval)(?:\[[\w,]*\])?\s+(?:\{[^}]*\}\s*)?[\w.$*&\[\]<>:-]+|:(?:param|type|raises?|arg|var|ivar|cvar)\b[^:\n]*:|[@\\]\w+(?:\[[\w,]*\])?|:\w+:)\s*[-:–—]?\s*")
_INLINE_TAG = re.compile(r"\{@\w+[^}]*\}|<[^<>]{1,60}>")
_INHERIT = re.compile(r"\{@inheritDoc\}|@inheritDoc\b|\\copydoc\b|@copydoc\b|@inheritdoc\b", re.I)
_MARKER = re.compile(r"^\W*(?:TODO|FIXME|XXX|HACK|TBD|TBA|WIP|BUG|NB|@todo|\\todo)\b", re.I)
_PLACEHOLDER = re.compile(
    r"^\W*(?:n\.?/?a|none|nil|null|tbd|tba|todo|wip|summary|description|desc|documentation|doc|docstring|comment|placeholder|no (?:description|documentation|docs|comment)(?: (?:yet|available|provided|needed))?|"
    r"undocumented|not documented|missing(?: docs?)?|empty|unknown|see (?:above|below|header|code|name)|self[- ]explanatory|as (?:above|below)|same as above|ditto|lorem ipsum.*|(?:add|write|insert|fill in) (?:docs?|documentation|description)(?: here)?|"
    r"\w+ (?:helpers?|functions?|section|utilities|stuff|implementation|api|methods?)|(?:end)?region\b.*|(?:begin|end|start) of \w+|helpers?|internal|private|public|static|deprecated|hidden|unused|autogenerated|auto[- ]generated.*|type your .*|automatically added.*|method stub|auto-generated method stub)\W*$",
    re.I,
)
_DIRECTIVE = re.compile(
    r"^\W*(?:nolint\w*\b|noqa\b|pylint\b|flake8\b|mypy\s*:|type\s*:\s*ignore|pyright\b|ruff\b|isort\b|fmt\s*:|yapf\b|clang-(?:format|tidy)\b|eslint\b|eslint-\w+|tslint\b|jshint\b|jslint\b|prettier-ignore|@ts-\w+|@flow\b|istanbul\b|c8 ignore|"
    r"go:\w+|\+build\b|cgo\b|export \w+$|coverity\b|cppcheck\b|lint\b|splint\b|pragma\b|nosec\b|nosonar\b|checkstyle\b|@?suppress\w*|spell-?checker\b|cspell\b|vim?\s*:|-\*-.*-\*-|IWYU\b|rustfmt\b|clippy\b|allow\(|deny\(|sourcery\b|codacy\b|LCOV_\w+|GCOV\w*|PRQA\b|"
    r"!?\$NON-NLS|CHECKSTYLE|NOSONAR|skipcq|sonar|rubocop|@formatter|shellcheck|language=\w+|exported? by|@codegen|@ts-nocheck|@jsx|webpack\w*\s*:|#__PURE__)",
    re.I,
)
_LICENCE = re.compile(r"\bSPDX-|\bcopyright\b|licen[sc]ed under|all rights reserved|redistribution and use|^\W*\(c\)|©|\blicen[cs]e\b.*\b(?:MIT|BSD|GPL|Apache|MPL|LGPL)\b|\b(?:MIT|BSD|GPL|Apache|MPL|LGPL) licen[cs]e\b", re.I)
_CODE = re.compile(
    r"^\s*(?:[\w.\->:\[\]*&]+\s*\([^()]*(?:\([^()]*\)[^()]*)*\)\s*(?:;|\{|$)|.*[;{}]\s*$|(?:if|for|while|switch|return|else|elif|import|from|def|class|var|let|const|fn|func|int|void|char|static|#\w+)\b.*[=(){}:;].*[);{}:]\s*$|[\w.\->\[\]*&]+\s*[-+*/|&^%]?=[^=].*|@\w+\(.*\)\s*$)"
)
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
_WIDE = re.compile(r"[぀-ヿ㐀-鿿가-힯฀-๿]")
#: Words that add nothing to a function's name.
_FILLER = frozenset(
    "a an the this that these it its is are was be being been do does did done to of for in on at by with from into and or as function functions method methods routine procedure helper helpers def call calls called used use uses using implementation impl main which we you i will should can may".split()
)


class Pair(NamedTuple):
    code: str
    description: str  # documentation in words of its own, cleaned; empty without any
    raw: str  # the documentation as it stands, cleaned of comment signs
    inherits: bool


def _stem(w: str) -> str:
    w = w.lower()
    for end in ("ies", "ing", "ed", "es", "s", "e"):
        if w.endswith(end) and len(w) - len(end) >= 3:
            w = w[: -len(end)]
            break
    if w.endswith("y") or w.endswith("i"):
        w = w[:-1]
    return w[:-1] if len(w) > 3 and w[-1] == w[-2:-1] else w


def _parts(name: str) -> set[str]:
    return {_stem(p) for p in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+", name or "")} | {_stem(name or "")}


_BREAK = re.compile(r"\s+(?=[@\\\\](?:param|arg|tparam|returns?|retval|throws?|exception|raises?|see|since)\b|:(?:param|returns?|rtype|raises?|type)\b)")
#: A mark with a colon or a plain word behind it takes its sentence with it; before a new sentence it stands alone.
_LONE_MARK = re.compile(r"^\W*(?:TODO|FIXME|XXX|HACK|TBD|TBA|WIP)\s+(?=[^\W\d_a-z]|(?:\S+\s+){6})")


_AFTER_NAME = re.compile(r"\s*(?:\(\))?\s*(?:[-–—:]+\s*|(?=\s)|$)")


def own_words(doc: str, name: str) -> str:
    """The parts of a documentation that say something beyond tags, marks, directives, licences, code and the name."""
    kept, parts = [], _parts(name)
    for line in _BREAK.sub("\n", doc).split("\n"):
        text = _INHERIT.sub("", line).strip()
        if name and text.startswith(name) and (after := _AFTER_NAME.match(text, len(name))):
            text = text[after.end() :]
        if not text or _DIRECTIVE.match(text) or _LICENCE.search(text):
            continue
        if _TAG.match(text):
            text = _NAMED.sub("", text, count=1)
        text = _INLINE_TAG.sub(" ", text).strip()
        if not text or _PLACEHOLDER.match(text) or _CODE.match(text):
            continue
        # one sentence at a time, so that a mark or a repetition of the name doesn't hide the next
        new = []
        for sentence in re.split(r"(?<=[.!?])\s+", text):
            sentence = _LONE_MARK.sub("", sentence)
            if _PLACEHOLDER.match(sentence) or _MARKER.match(sentence) or _DIRECTIVE.match(sentence):
                continue
            words = _WORD.findall(sentence)
            own = [w for w in words if w.lower() not in _FILLER and _stem(w) not in parts]
            if len(_WIDE.findall(sentence)) >= 4 or own and len(words) >= 2 and sum(map(len, own)) >= 3:
                new.append(sentence)
        if new:
            kept.append(" ".join(new))
    return "\n".join(kept).strip()


_SIGNS = re.compile(r"^\s*(?:/{2,}[!<]?|#+!?|;+|@(?=\s)|--)\s?|^\s*\*+(?!/)\s?")


def strip_signs(comment: str) -> str:
    """A comment without the signs that make it one."""
    t = comment.replace("\r", "")
    if t.startswith("/*"):
        t = re.sub(r"^/\*+!?<?", "", t)
        t = re.sub(r"\**/\s*$", "", t)
        return "\n".join(re.sub(r"^\s*\*(?!\*)\s?", "", x).strip() for x in t.split("\n")).strip()
    return "\n".join(_SIGNS.sub("", x, count=1).strip() for x in t.split("\n")).strip()


_PIECE = re.compile(
    r"(?P<space>\s+)|(?P<line>//[^\n]*)|(?P<block>/\*(?:[^*/]|\*(?!/)|/(?!\*)|/\*(?:[^*]|\*(?!/))*\*/)*\*/|/\*.*?\*/)|(?P<raw>b?r(#+)\".*?\"\5|R\"([^(]*)\(.*?\)\6\")|(?P<text>\"(?:[^\"\\\n]|\\.)*\"|`[^`]*`|'(?:[^'\\\n]|\\.){1,8}')|(?P<word>[A-Za-z_$][\w$]*)|(?P<other>.)",
    re.S,
)
_ATTRIBUTE = {
    "rust": re.compile(r"#!?\[(?:[^\[\]\"]|\"(?:[^\"\\]|\\.)*\"|\[[^\]]*\])*\]"),
    "java": re.compile(r"@(?!interface\b)[A-Za-z_][\w.]*(?:\s*\((?:[^()\"]|\"(?:[^\"\\]|\\.)*\"|\([^()]*\))*\))?"),
    "javascript": re.compile(r"@[A-Za-z_][\w.]*(?:\((?:[^()]|\([^()]*\))*\))?"),
    "cpp": re.compile(r"\[\[.*?\]\]|template\s*<(?:[^<>]|<[^<>]*>)*>|__attribute__\s*\(\(.*?\)\)", re.S),
}
_ATTRIBUTE["c"] = _ATTRIBUTE["cpp"]
_DOC_ATTR = re.compile(r"#!?\[\s*doc\s*=\s*\"((?:[^\"\\]|\\.)*)\"\s*\]")


def _braces(text: str, language: str, name: str) -> Pair | None:
    """The definition of ``name`` in a language with braces, and the comment directly before it."""
    pos, end = 0, len(text)
    doc: list[str] = []  # comments directly before what comes next
    kind = ""
    start = None  # where the definition with its attributes begins
    fresh = True  # nothing but space stands before on this line
    attribute = _ATTRIBUTE.get(language)
    while pos < end:
        m = _PIECE.match(text, pos)
        if m["space"]:
            if m["space"].count("\n") > 1 and start is None:
                doc, kind = [], ""
            fresh = fresh or "\n" in m["space"]
            pos = m.end()
            continue
        if m["line"] or m["block"]:
            if fresh and start is None:
                now = "line" if m["line"] else "block"
                if now == "block" or kind == "block":
                    doc = []
                doc.append(m.group())
                kind = now
            elif fresh and start is not None:  # between the attributes: belongs to it as well
                doc.append(m.group())
            pos = m.end()
            continue
        if attribute and (a := attribute.match(text, pos)):
            start = pos if start is None else start
            if d := _DOC_ATTR.match(a.group()):
                doc.append("//" + re.sub(r"\\(.)", r"\1", d[1]))
            pos = a.end()
            fresh = False
            continue
        if m.group() == "#" and language in ("c", "cpp"):
            line = re.compile(r"#(?:[^\n\\]|\\\r?\n|\\.)*").match(text, pos)
            pos, doc, kind, start, fresh = line.end(), [], "", None, False
            continue
        begin = pos if start is None else start
        stop, body, named = _declaration(text, pos, language, name)
        if body and named:
            raw = "\n".join(strip_signs(c) for c in doc)
            return Pair(text[begin:stop].strip(), own_words(raw, name), raw, bool(_INHERIT.search(raw)))
        if body and not named and _INNER.match(text, pos):  # a class around it
            pos = text.index("{", pos) + 1
        else:
            pos = max(stop, pos + 1)
        doc, kind, start, fresh = [], "", None, False
    return None


_INNER = re.compile(r"(?:(?:public|private|protected|static|final|abstract|export|default|pub|unsafe)\s+)*(?:class|interface|struct|namespace|impl|trait|enum|mod|extern\s+\"C\")\b[^;{(]*\{")


def _declaration(text: str, pos: int, language: str, name: str) -> tuple[int, bool, bool]:
    """Its end, whether it has a body, and whether it defines ``name``."""
    depth, end = 0, len(text)
    named = parens = False
    last = ""
    assigned = False
    while pos < end:
        m = _PIECE.match(text, pos)
        t = m.group()
        pos = m.end()
        if m["space"]:
            if depth == 0 and "\n" in t and language in ("go", "javascript") and last not in (",", "", "=", "+", "(", "{", ".") and not re.compile(r"\s*[{.]").match(text, pos):
                return pos - len(t), False, named
            continue
        if m["line"] or m["block"]:
            continue
        if m["word"]:
            named = named or t == name and depth == 0
        elif t in "([":
            parens = parens or t == "(" and depth == 0
            depth += 1
        elif t in ")]":
            depth = max(0, depth - 1)
        elif t == "=" and depth == 0 and last not in ("=", "!", "<", ">") and text[pos : pos + 1] not in ("=", ">"):
            assigned = not parens or language in ("javascript",)
        elif t == ";" and depth == 0:
            return pos, False, named
        elif t == "{" and depth == 0:
            stop = _closing(text, pos)
            if assigned and language != "javascript":
                pos = stop
                continue
            return stop, True, named and parens
        last = t
    return end, False, named


def _closing(text: str, pos: int) -> int:
    """Behind the brace that closes the one before ``pos``; the text's end if none does."""
    depth, end = 1, len(text)
    while pos < end:
        m = _PIECE.match(text, pos)
        t = m.group()
        pos = m.end()
        if t == "{":
            depth += 1
        elif t == "}":
            depth -= 1
            if not depth:
                return pos
    return end


_PY_PIECE = re.compile(
    r"(?P<text>[rRbBuUfF]{0,2}(?:\"\"\"(?:[^\\]|\\.)*?\"\"\"|'''(?:[^\\]|\\.)*?'''|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'))|(?P<comment>#[^\n]*)|(?P<nl>\n)|(?P<space>[ \t\r\f]+|\\\r?\n)|(?P<word>\w+)|(?P<other>.)", re.S
)


def _python(text: str, name: str) -> Pair | None:
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    lines = text.split("\n")
    doc: list[str] = []
    start = None
    at = 0
    i = 0
    while i < len(lines):
        line = lines[i].strip()
        here = at
        at += len(lines[i]) + 1
        i += 1
        if not line:
            if start is None:
                doc = []
            continue
        if line.startswith("#"):
            doc.append(line)
            continue
        m = re.match(r"(?:async\s+)?def\s+(\w+)", line)
        if m and (m[1] == name or not name):
            start = here if start is None else start
            pair = _python_body(text, here, start, doc, m[1])
            return pair
        if line.startswith("class ") and line.endswith(":"):
            doc, start = [], None
            continue
        # another statement: to its end, over brackets and long texts
        stop, decorator = _python_statement(text, here), line.startswith("@")
        if decorator:
            start = here if start is None else start
        else:
            doc, start = [], None
        while i < len(lines) and at <= stop:
            at += len(lines[i]) + 1
            i += 1
    return None


def _python_statement(text: str, pos: int) -> int:
    depth, end = 0, len(text)
    while pos < end:
        m = _PY_PIECE.match(text, pos)
        t = m.group()
        if m["nl"] and depth <= 0:
            return pos
        if m["other"]:
            depth += (t in "([{") - (t in ")]}")
        pos = m.end()
    return end


def _python_body(text: str, pos: int, start: int, doc: list[str], name: str) -> Pair | None:
    depth, end = 0, len(text)
    while pos < end:  # to the colon that opens the body
        m = _PY_PIECE.match(text, pos)
        t = m.group()
        pos = m.end()
        if m["other"]:
            depth += (t in "([{") - (t in ")]}")
            if t == ":" and depth == 0:
                break
    else:
        return None
    string, statement = None, False
    while pos < end:
        m = _PY_PIECE.match(text, pos)
        pos = m.end()
        if m["nl"] or m["space"] or m["comment"]:
            continue
        statement = True
        if m["text"]:
            prefix = re.match(r"[a-zA-Z]*", m["text"])[0].lower()
            if "b" not in prefix and "f" not in prefix:
                after = re.compile(r"[ \t]*(?:#[^\n]*)?(?:\n|;|$)").match(text, pos)
                if after:
                    quoted = m["text"][len(prefix) :]
                    string = quoted[3:-3] if quoted[:3] in ('"""', "'''") else quoted[1:-1]
        break
    if not statement:
        return None
    before = "\n".join(strip_signs(c) for c in doc)
    inner = "\n".join(x.strip() for x in (string or "").split("\n"))
    words = own_words(inner, name) or own_words(before, name)
    raw = inner if string is not None else before
    return Pair(text[start:].strip(), words, raw, bool(_INHERIT.search(raw)))


def _assembler(text: str, name: str) -> Pair | None:
    doc: list[str] = []
    start = None
    lines = text.replace("\r\n", "\n").split("\n")
    at = 0
    inside: list[str] = []
    for raw_line in lines:
        line = raw_line.strip()
        here, at = at, at + len(raw_line) + 1
        if inside:
            pass
        elif not line:
            if start is None:
                doc = []
        elif re.match(r"(?:#|//|;|@\s|/\*|\*)", line):
            doc.append(line)
        elif re.match(r"\.(?:globa?l|type|align|p2align|balign|text|section|hidden|weak|func|ent|size|extern|thumb_func|code)\b", line):
            start = here if start is None else start
            if not re.match(r"\.(?:globa?l|type|hidden|weak|func|ent|thumb_func|align|p2align|balign)\b", line):
                doc, start = [], None
        elif line.startswith(name) and line[len(name) :].lstrip().startswith(":") if name else re.match(r"[A-Za-z_.$][\w.$]*:", line):
            start = here if start is None else start
            inside.append(line)
        else:
            doc, start = [], None
        if inside and line and re.match(r"[a-z][\w.]*(?:\s|$)", line) and not line.endswith(":"):
            words = "\n".join(strip_signs(c) for c in doc)
            return Pair(text.replace("\r\n", "\n")[start:].strip(), own_words(words, name), words, bool(_INHERIT.search(words)))
    return None


def extract(text: str | None, path: str | None, name: str | None) -> Pair | None:
    """The pair of a captured text; None if it is null, empty, in no known language, or has no definition with a body."""
    language = language_of(path, None)
    if not text or not text.strip() or language is None:
        return None
    text = text.removeprefix("﻿")
    if language == "python":
        return _python(text, name or "")
    if language == "asm":
        return _assembler(text, name or "")
    return _braces(text, language, name or "")
