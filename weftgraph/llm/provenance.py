"""Evidence in a text, a path and a record that a source file wasn't written by hand in its repository."""

from __future__ import annotations

import re
from typing import NamedTuple

LABELS = ("handwritten", "generated", "minified", "vendored", "blob")

#: Phrases of generators, in the languages in which tools write them. A text that speaks about such marks is none.
_TOOL = re.compile(
    r"@generated\b|<auto-?generated|auto-?generated (?:file|code|by|from)|generated (?:by|with|from|using)\b|automatically (?:generated|produced|created)|produced automatically|"
    r"\boutput of [\w.-]+ v?\d|do not (?:edit|modify|change)(?: (?:this|by hand|manually|it))?\s*(?:[.!:;*/-]|$)|(?:overwritten|lost) (?:by|on|in|at) the next|changes (?:made .{0,30})?(?:will be|are) (?:lost|overwritten)|"
    r"(?:emitted|created|made|written|built|compiled) by (?:the )?[\w.-]+ (?:backend|compiler|generator|v?\d[\d.]*)|derived from \S+ (?:with|by|using) \w+|regenerate with|please (?:change|edit) \S+ instead|"
    r"erzeugt (?:mit|von|durch)|nicht (?:bearbeiten|ändern|editieren)|généré (?:par|avec|automatiquement)|ne pas (?:modifier|éditer)|generado (?:por|con|automáticamente)|no (?:editar|modificar)|"
    r"自動生成|自动生成|编辑しない|編集しない|请勿(?:编辑|修改)|編集禁止|不要(?:编辑|修改)",
    re.I,
)
_ABOUT = re.compile(r"\b(?:marked|freely|by hand, unlike|written by hand|are skipped|checks? (?:that|whether)|detects?|recogni[sz]es?|how to|generates code|unlike the generated)\b", re.I)
#: Phrases of copies of code that is maintained elsewhere.
_COPY = re.compile(
    r"imported from|copied (?:verbatim|from|unchanged)|local changes\s*:|upstream (?:version|release|revision)|report bugs to the \S+ maintainers|\bvendored (?:from|copy)|synced (?:from|with)|mirror(?:ed)? (?:of|from)|"
    r"^\W*[\w.-]+ v?\d+\.\d+[\w.]* +(?:--|-|–|—) |see the \S+ distribution|taken from \S+ v?\d|bundled (?:copy|with)|übernommen aus|repris de|copiado de",
    re.I | re.M,
)
_PLATFORM = re.compile(r"platform C library|C standard library|\bglibc\b|\bnewlib\b|system header|libc headers?", re.I)
#: The project that a text names as its own.
_OWNER = re.compile(r"(?:copyright(?: \(c\))?(?: \d{4}(?:-\d{4})?)?,? the ([\w.-]+) (?:authors|project|developers|contributors)|part of (?:the )?([\w.-]+?)(?: project\b|[.,;]|$))", re.I | re.M)
_GUARD = re.compile(r"#\s*ifndef\s+(_[A-Z_]\w*)\s*\n\s*#\s*define\s+\1\b")
_MARKS = re.compile(r"^#line \d+ \"|\byy(?:r1|r2|parse|table|check|pact)\b|^\s*\.cfi_startproc|^\.LFB\d|^// Code generated", re.M)
_MAPPED = re.compile(r"[#@] sourceMappingURL=")

_NUMBERS = r"(?:[-+]?(?:0[xX][0-9a-fA-F]+|\d+(?:\.\d*)?(?:[eE][-+]?\d+)?)[uUlLfF]{0,3}\s*,\s*){6,}"
_DATA = re.compile(rf"{_NUMBERS}|['\"](?:[A-Za-z0-9+/=]{{40,}}|(?:\\x[0-9a-fA-F]{{2}}){{6,}}|(?:\\[0-7]{{3}}){{6,}})['\"]|\b[0-9a-fA-F]{{48,}}\b")
_NUMBERED = re.compile(r"(?<![A-Za-z_])[A-Za-z_]{3,}(\d{1,4})(?![0-9A-Za-z])")
_COMMENT = re.compile(r"(?:\s+|/\*.*?\*/|//[^\n]*|#(?!\s*(?:include|define|if|ifdef|ifndef|line|pragma|undef|endif|else|\[|!\[))[^\n]*|#!\[[^\n]*|;[^\n]*|--[^\n]*|(?:package|import|#\s*pragma|#\s*include)[^\n]*\n|#\s*line[^\n]*)*", re.S)
_IDENT = re.compile(r"[A-Za-z_$]\w*")


_BLOCK = re.compile(
    r"(?P<c>^[ \t]*(?:\"{3}.*?(?:\"{3}|\Z)|'{3}.*?(?:'{3}|\Z))|/\*.*?(?:\*/|\Z)|//[^\n]*(?:\n[ \t]*//[^\n]*)*|^[ \t]*#(?!\s*(?:include|define|if|ifdef|ifndef|line|pragma|undef|endif|else|elif|error|\[|!\[))[^\n]*(?:\n[ \t]*#[^\n]*)*|^[ \t]*(?:;|--)[^\n]*(?:\n[ \t]*(?:;|--)[^\n]*)*)"
    r"|\"{3}.*?(?:\"{3}|\Z)|'{3}.*?(?:'{3}|\Z)|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'",
    re.S | re.M,
)


def comments(text: str, start: int) -> list[str]:
    """Comments and docstrings from a place on, in any of the languages; neighbouring line comments are one."""
    return [m["c"] for m in _BLOCK.finditer(text, start) if m["c"]]


class Evidence(NamedTuple):
    tool: bool  # a generator's banner in a comment that doesn't speak about generated files
    about: bool  # the leading comments speak about generated files
    copy: bool
    platform: bool
    owner: str | None  # the project that the comments name first
    guard: bool  # include guard with a name reserved for the implementation
    marks: int  # structures that only tools write
    family: int  # length of a family of names numbered from 0, if most numbered names belong to it
    data: float  # share of literal data
    squeezed: float  # 0 to 1, how squeezed the script is
    chars: int


def evidence(text: str) -> Evidence:
    text = text.removeprefix("﻿")
    n = len(text)
    m = _COMMENT.match(text)
    head = text[: m.end()] if m else ""
    about = bool(_ABOUT.search(head))
    tool = bool(_TOOL.search(head)) and not about
    copy = bool(_COPY.search(head))
    owner = _OWNER.search(head)
    for c in comments(text, len(head)):
        if not _ABOUT.search(c):
            tool = tool or bool(_TOOL.search(c))
            copy = copy or bool(_COPY.search(c))
            owner = owner or _OWNER.search(c)
    owner = (owner[1] or owner[2]).lower() if owner else None
    platform = bool(_PLATFORM.search(text[: max(m.end() if m else 0, 1)])) or bool(_PLATFORM.search(text)) and bool(_GUARD.search(text))
    suffixes = {int(x) for x in _NUMBERED.findall(text)}
    run = 0
    if len(suffixes) > 4:
        start = 0 if 0 in suffixes else 1
        while start + run in suffixes:
            run += 1
        if run < 5 or run < 0.6 * len(suffixes):
            run = 0
    data = sum(len(x) for x in _DATA.findall(text)) / n if n else 0.0
    squeezed = 0.0
    if n > 400:
        lines = text.split("\n")
        longest = max(map(len, lines))
        if longest > 300:
            blank = sum(map(text.count, (" ", "\n", "\t", "\r"))) / n
            words = _IDENT.findall(text)
            short = sum(len(w) < 4 for w in words) / max(1, len(words))
            long_share = sum(len(x) for x in lines if len(x) > 300) / n
            squeezed = min(1.0, long_share) * (blank < 0.12) * (0.5 + 0.5 * (short > 0.5))
            if data > 0.5:
                squeezed = 0.0
    return Evidence(tool, about, copy, platform, owner, bool(_GUARD.search(text)), len(_MARKS.findall(text)) + bool(_MAPPED.search(text)), run, data, squeezed, n)
