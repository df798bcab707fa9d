"""What the parsers of languages with braces share: statements by recursive descent, expressions by precedence climbing,
and panic-mode recovery, which records an error, skips to the end of the statement and goes on."""

from __future__ import annotations

import re
from functools import lru_cache

import regex

from weftgraph.llm.syntax.lexer import BAD, KEPT

END = "\0"

# Type arguments, and round brackets, nested to any depth. Patterns with these names go through ``compiled``.
ARGS, PARENS = "(?&A)", "(?&P)"
_NESTED = r"(?(DEFINE)(?P<A><(?>[^;{}<>\0]++|(?&A))*+>)(?P<P>\((?>[^()\0]++|(?&P))*+\)))"


@lru_cache(maxsize=None)
def compiled(pattern: str):
    return regex.compile(_NESTED + pattern, regex.V0) if "(?&" in pattern else re.compile(pattern)


class Fail(Exception):
    def __init__(self, at: int, why: str):
        self.at, self.why = at, why


_CLOSE = {"(": ")", "[": "]", "{": "}"}
_BRACKET = re.compile(r"[()\[\]{}]")
_STOP = re.compile(r"[;{}()\[\]\n\0]")
_PARENS = re.compile(r"\((?:[^(){};\0]|\((?:[^(){};\0]|\((?:[^(){};\0]|\([^(){};\0]*\))*\))*\))*\)")


class Parser:
    #: Kinds of binary operators with their precedence; larger binds tighter.
    BINARY: dict[str, int] = {}
    PREFIX = frozenset()
    SIMPLE = re.compile(r"[^{};\0]*;")

    def __init__(self, kinds: str, seen: dict[str, bool]):
        """seen: whether a statement or condition of these kinds is valid, kept from text to text."""
        self.k = kinds + END * 4
        self.p = 0
        self.seen = seen
        self.errors: list[tuple[int, str]] = []
        self.count = 0
        self.depth = 0

    # errors and recovery

    def fail(self, why: str):
        raise Fail(self.p, "stray character" if self.k[self.p] == BAD else "unexpected end" if self.k[self.p] == END else why)

    def note(self, e: Fail) -> None:
        self.count += 1
        self.errors.append((e.at, e.why))

    def recover(self, e: Fail) -> None:
        """Panic mode: to behind the next semicolon outside brackets, or before the brace that closes the block."""
        self.note(e)
        k, p, depth = self.k, max(e.at, self.p), 0
        start = p
        while True:
            m = _STOP.search(k, p)
            c = m.group()
            if c == END:
                self.p = len(self.k) - 4
                return
            p = m.start() + 1
            if c in "({[":
                depth += 1
            elif c in ")]}":
                if depth == 0 and c == "}":
                    p -= 1
                    break
                depth = max(0, depth - 1)
                if depth == 0 and c == "}":
                    break
            elif depth == 0 and (c == ";" or p > start + 1):
                break
        self.p = p

    def run(self) -> None:
        k, last = self.k, len(self.k) - 4
        while self.p < last:
            at = self.p
            try:
                if k[at] in ")]}":
                    self.fail("bracket that closes nothing")
                self.item()
            except Fail as e:
                self.recover(e)
                if self.p < last and k[self.p] in ")]}":
                    self.p += 1
            if self.p == at:
                self.p += 1

    # small steps

    def need(self, c: str) -> None:
        if self.k[self.p] != c:
            self.fail(f"expected {c if c.isprintable() else 'a token'}")
        self.p += 1

    def take(self, c: str) -> bool:
        if self.k[self.p] == c:
            self.p += 1
            return True
        return False

    def match(self, pattern) -> bool:
        m = pattern.match(self.k, self.p)
        if m:
            self.p = m.end()
            return True
        return False

    def balanced(self) -> None:
        """Over a bracket and everything up to the one that closes it."""
        k, want = self.k, []
        p = self.p
        while True:
            c = k[p]
            if c in "([{":
                want.append(_CLOSE[c])
            elif c in ")]}":
                if not want or want.pop() != c:
                    self.p = p
                    self.fail("bracket that doesn't match")
                if not want:
                    self.p = p + 1
                    return
            elif c == END or c == BAD:
                self.p = p
                self.fail("bracket never closed")
            m = _BRACKET.search(k, p + 1)
            q = m.start() if m else len(k) - 4
            bad = k.find(BAD, p + 1, q)
            p = q if bad < 0 else bad

    def known(self, pattern, parse) -> None:
        """``parse`` over what ``pattern`` finds here, at most once for each sequence of kinds."""
        m = pattern.match(self.k, self.p)
        if not m:
            return parse()
        key = m.group()
        ok = self.seen.get(key)
        if ok:
            self.p = m.end()
            return None
        at = self.p
        parse()
        if ok is None and self.p == m.end() and at < self.p:
            if len(self.seen) > KEPT:
                self.seen.clear()
            self.seen[key] = True
        return None

    def deeper(self):
        self.depth += 1

    # expressions

    def expr(self, least: int = 0) -> None:
        self.deeper()
        self.unary()
        k, binary = self.k, self.BINARY
        while True:
            c = k[self.p]
            level = binary.get(c)
            if level is None or level < least:
                break
            self.p += 1
            if c == "?":
                self.expr(1)
                self.need(":")
                self.expr(1)
            elif c in "=a":
                self.initial()
            else:
                if c == ">" and k[self.p] == ">":  # a shift is two kinds, as type arguments may end in it
                    self.p += 1
                    self.take(">")
                self.after_operator()
                self.expr(level + 1)
        self.depth -= 1

    def after_operator(self) -> None:
        pass

    def initial(self) -> None:
        self.expr(1)

    def unary(self) -> None:
        while self.k[self.p] in self.PREFIX:
            self.p += 1
        self.primary()

    def primary(self) -> None:
        raise NotImplementedError

    def item(self) -> None:
        raise NotImplementedError

    def statement(self) -> None:
        raise NotImplementedError

    def paren_expr(self) -> None:
        self.need("(")
        self.expr()
        self.need(")")

    def condition(self) -> None:
        self.known(_PARENS, self.paren_expr)

    def arguments(self, close: str = ")") -> None:
        """After the open bracket: expressions between commas, up to and with the closing one."""
        if self.take(close):
            return
        while True:
            self.argument()
            if self.take(close):
                return
            self.need(",")
            if self.k[self.p] == close and self.TRAILING:
                self.p += 1
                return

    TRAILING = False

    def argument(self) -> None:
        self.expr()

    def block(self) -> None:
        """A block; errors within stay within."""
        self.need("{")
        self.deeper()
        k = self.k
        while True:
            c = k[self.p]
            if c == "}":
                self.p += 1
                self.depth -= 1
                return
            if c == END:
                self.fail("block never closed")
            depth, at = self.depth, self.p
            try:
                if c in ")]":
                    self.fail("bracket that closes nothing")
                self.statement()
            except Fail as e:
                if k[e.at] == END:
                    raise
                self.depth = depth
                self.recover(e)
                if self.p == at:
                    self.p += 1
