"""Whether a text is valid in a language."""

from __future__ import annotations

import re
import sys
from bisect import bisect_right
from itertools import accumulate
from typing import NamedTuple

from weftgraph.llm.syntax import lexer
from weftgraph.llm.syntax.brace_languages import C, Go, Java, JavaScript, Rust
from weftgraph.llm.syntax.lexer import BAD
from weftgraph.llm.syntax.line_languages import Assembler, Python
from weftgraph.llm.syntax.parser import Fail

LANGUAGES = ("c", "cpp", "java", "javascript", "go", "rust", "python", "asm")

#: Spellings of a language, lower case.
SPELLINGS = {
    "c": "c", "cpp": "cpp", "c++": "cpp", "cxx": "cpp", "cc": "cpp", "hpp": "cpp", "java": "java", "javascript": "javascript", "js": "javascript", "ecmascript": "javascript",
    "go": "go", "golang": "go", "rust": "rust", "rs": "rust", "python": "python", "py": "python", "python3": "python", "asm": "asm", "assembly": "asm", "assembler": "asm", "s": "asm",
}
#: File name endings that tell the language by themselves.
ENDINGS = {
    "c": "c", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "hh": "cpp", "hxx": "cpp", "java": "java", "js": "javascript", "mjs": "javascript", "cjs": "javascript",
    "go": "go", "rs": "rust", "py": "python", "pyi": "python", "s": "asm", "asm": "asm",
}


def language_of(path: str | None, language: str | None) -> str | None:
    """The language that the path's ending gives, else the stated one; a header is C++ if stated so, else C."""
    ending = (path or "").rpartition(".")[2].lower() if "." in (path or "").rpartition("/")[2] else ""
    if ending in ENDINGS:
        return ENDINGS[ending]
    stated = SPELLINGS.get((language or "").strip().lower())
    return stated or ("c" if ending == "h" else None)


class Verdict(NamedTuple):
    errors: int
    line: int  # of the first error; 0 without one
    cause: str  # of the first error; empty without one
    lines: list  # of all stored errors
    causes: list


_IF, _ELSE, _ENDIF, _NEVER = "\x10", "\x11", "\x12", "\x13"
_DIRECTIVE = re.compile(r"#\s*(?:(if\s+0\s*(?:$|/))|(if|ifdef|ifndef)\b\s*\S|(elif|elifdef|elifndef|else)\b|(endif)\b|(?:include|include_next|import)\s*[<\"\w]|(?:define|undef)\s+[A-Za-z_]|(?:pragma|error|warning|line|ident|sccs|assert)\b|\d+\s|$)")
_BRANCH = re.compile(f"[{_IF}{_ELSE}{_ENDIF}{_NEVER}]")


def _directive(t: str) -> str:
    m = _DIRECTIVE.match(t.replace("\\\r\n", " ").replace("\\\n", " "))
    if not m:
        return BAD
    return _NEVER if m[1] else _IF if m[2] else _ELSE if m[3] else _ENDIF if m[4] else ""


def _c_lexer() -> lexer.Lexer:
    plain = lexer.C.kinds.classify
    return lexer.Lexer(
        r"#(?:[^\n\\/]|\\\r?\n|\\.|/(?![*/])|//[^\n]*|/\*.*?\*/)*|" + lexer.C.pattern.pattern,
        lambda t: _directive(t) if t[0] == "#" else plain(t),
    )


_C_RAW = re.compile(r'//[^\n]*|/\*.*?\*/|(?<!\w)(?:u8|[uUL])?R"([^ ()\\\n]{0,16})\(.*?\)\1"|"(?:[^"\\\n]|\\.)*"', re.S)


def _c_text(text: str) -> str:
    if 'R"' in text:
        text = _C_RAW.sub(lambda m: '""' + "\n" * m.group().count("\n") if m.group()[0] in "uULR" else m.group(), text)
    return text


class _Conditional(NamedTuple):
    branches: list  # each a list of pieces (begin, end) and conditionals


def _branches(kinds: str) -> tuple[list, list[tuple[int, str]]]:
    """A text's pieces and conditionals; conditionals without a beginning or an end. What ``#if 0`` excludes needn't be
    code and is left out."""
    top: list = []
    errors: list[tuple[int, str]] = []
    stack: list[tuple[list, _Conditional | None]] = [(top, None)]
    at = 0
    for m in [*_BRANCH.finditer(kinds), None]:
        end = m.start() if m else len(kinds)
        if end > at:
            stack[-1][0].append((at, end))
        if m is None:
            break
        at, c = m.end(), m.group()
        if c in (_IF, _NEVER):
            new = _Conditional([])
            stack[-1][0].append(new)
            stack.append(([], new))
            if c == _IF:
                new.branches.append(stack[-1][0])
        elif len(stack) == 1:
            errors.append((end, "conditional that was never opened"))
        elif c == _ELSE:
            stack[-1] = ([], stack[-1][1])
            stack[-1][1].branches.append(stack[-1][0])
        else:
            stack.pop()
    if len(stack) > 1:
        errors.append((len(kinds), "conditional never closed"))
    return top, errors


def _width(pieces: list) -> int:
    """Selections that it takes until each branch has been in one."""
    return max([1, *(sum(map(_width, p.branches)) for p in pieces if isinstance(p, _Conditional))])


def _select(pieces: list, number: int, out: list[tuple[int, int]]) -> None:
    """The pieces of one selection: of each conditional the branch that ``number`` falls to, the first one where it has
    fewer."""
    for p in pieces:
        if not isinstance(p, _Conditional):
            out.append(p)
            continue
        left = number
        for b in p.branches:
            w = _width(b)
            if left < w:
                _select(b, left, out)
                break
            left -= w
        else:
            if p.branches:
                _select(p.branches[0], 0, out)


_LEX = {"c": _c_lexer(), "java": lexer.JAVA, "javascript": lexer.JS, "go": lexer.GO, "rust": lexer.RUST, "python": lexer.PY, "asm": lexer.ASM}
_LEX["cpp"] = _LEX["c"]
_PARSE = {"c": C, "cpp": C, "java": Java, "javascript": JavaScript, "go": Go, "rust": Rust, "python": Python, "asm": Assembler}
#: Valid pieces by language, for as long as the process lives; they change no result.
_SEEN: dict[str, dict] = {name: {} for name in LANGUAGES}

#: Marks that version control leaves and no language allows at the start of a line outside texts.
_VALID = Verdict(0, 0, "", [], [])


def _errors(kinds: str, language: str) -> tuple[int, list[tuple[int, str]]]:
    """How many errors a sequence of kinds has, and where, counted in tokens."""
    parser_class = _PARSE[language]
    prepared = parser_class.prepare(kinds) if hasattr(parser_class, "prepare") else kinds
    parser = parser_class(prepared, _SEEN[language])
    try:
        parser.run()
    except Fail as e:
        parser.errors.append((e.at, e.why))
        parser.count += 1
    if language in ("javascript", "go"):
        return parser.count, [(len(prepared[:at].replace("\n", "")), why) for at, why in parser.errors]
    return parser.count, parser.errors


def check(text: str, language: str) -> Verdict:
    """All errors of a text, the first cause first. An empty text and one of comments only are valid.

    Of a C or C++ text every branch of its preprocessor conditionals is checked: the text is parsed with the first branch
    of each, then with the further ones in turn. Of a further selection only the errors count that lie in branches which
    the first one leaves out, or right behind them, since branches that belong together aren't told from others."""
    text = text.removeprefix("﻿")
    lex = _LEX[language]
    if language in ("c", "cpp"):
        text = _c_text(text)
    kinds = lex("\n" + text if language == "python" else text)
    # nesting takes as many of Python's frames as it is deep; those lie on the heap, so only the limit has to give way
    least = 12 * len(kinds) + 2000
    if sys.getrecursionlimit() < least:
        sys.setrecursionlimit(least)
    if language not in ("c", "cpp") or not _BRANCH.search(kinds):
        count, found = _errors(kinds, language)
    else:
        top, found = _branches(kinds)
        count, first, checked = len(found), [], set()
        for number in range(_width(top)):
            pieces: list[tuple[int, int]] = []
            _select(top, number, pieces)
            chosen = "".join(kinds[a:b] for a, b in pieces)
            if chosen in checked:
                continue
            checked.add(chosen)
            n, errors = _errors(chosen, language)
            if not number:
                first, count = pieces, count + n
            sizes = [0, *accumulate(b - a for a, b in pieces)]
            for at, why in errors:
                k = max(0, bisect_right(sizes, at) - 1)
                place = pieces[min(k, len(pieces) - 1)][0] + at - sizes[min(k, len(pieces) - 1)] if pieces else 0
                if number:
                    behind = k and at == sizes[k] and pieces[k - 1] not in first
                    if not (behind or k < len(pieces) and pieces[k] not in first) or (place, why) in found:
                        continue
                    count += 1
                found.append((place, why))
    if not count:
        return _VALID
    found = sorted(found)
    lines = lex.lines_of(text, [n for n, _ in found])
    causes = [w for _, w in found]
    return Verdict(count, lines[0], causes[0], lines, causes)
