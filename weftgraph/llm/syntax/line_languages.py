"""Python and assembler, whose statements end with the line."""

from __future__ import annotations

import re

from weftgraph.llm.syntax.lexer import BAD, INDENT, KEPT
from weftgraph.llm.syntax.parser import END, Fail, Parser


class PythonLine(Parser):
    """One logical line. ``opens`` tells whether it must be followed by an indented block."""

    BINARY = {"o": 2, "k": 4, "s": 4, "b": 5, "-": 6, "*": 7}
    TRAILING = True

    def __init__(self, kinds, seen):
        # ** is a binary operator and a marker; & | ^ and shifts need no order of their own here
        super().__init__(kinds, seen)
        self.opens = False
        self.first = kinds[0] if kinds else ""

    def expr(self, least: int = 0):
        """A test: lambda, conditional, or operators."""
        k = self.k
        self.deeper()
        if self.take("L"):
            self.lambda_args()
            self.need(":")
            self.expr()
            self.depth -= 1
            return
        self.unary()
        while True:
            c = k[self.p]
            if c == "I" and least == 0:
                self.p += 1
                self.expr(1)
                self.need("E")
                self.expr()
                continue
            if c == "n" and k[self.p + 1] == "k":
                self.p += 1
                c = "k"
            level = self.BINARY.get(c)
            if level is None or level < least:
                break
            self.p += 1
            if c == "s":
                self.take("n")
            self.expr(level + 1)
        if least == 0 and self.take("v"):
            self.expr()
        self.depth -= 1

    def lambda_args(self):
        k = self.k
        while k[self.p] not in ":" + END:
            if not (k[self.p] in "i*,=b0t" or k[self.p] in "([{-dn."):
                self.fail("expected :")
            if k[self.p] == "=":
                self.p += 1
                self.expr()
            elif k[self.p] in "i*,b":
                self.p += 1
            else:
                self.fail("expected a parameter")

    def unary(self):
        k = self.k
        while k[self.p] in "-nw":
            self.p += 1
        c = k[self.p]
        if c in "0d":
            self.p += 1
        elif c == "i":
            self.p += 1
        elif c == "t":
            while k[self.p] == "t":
                self.p += 1
        elif c == "(":
            self.p += 1
            if self.take("Y"):
                self.take("N")
                if k[self.p] != ")":
                    self.tests()
                self.need(")")
            else:
                self.sequence(")")
        elif c == "[":
            self.p += 1
            self.sequence("]")
        elif c == "{":
            self.p += 1
            self.entries()
        else:
            self.fail("expected an expression")
        while True:
            c = k[self.p]
            if c == "(":
                self.p += 1
                self.call()
            elif c == "[":
                self.p += 1
                if k[self.p] in ",]":
                    self.fail("expected an expression")
                while not self.take("]"):
                    if self.take(":"):
                        continue
                    if not self.take(","):
                        self.take("*")
                        self.expr()
                        if k[self.p] not in ":,]":
                            self.fail("expected ]")
            elif c == ".":
                self.p += 1
                self.need("i")
            else:
                return

    def loops(self):
        """for ... in ... if ... of a comprehension."""
        while self.k[self.p] in "FIa":
            self.take("a")
            if self.take("F"):
                self.targets()
                self.need("k")
                self.expr(1)
            else:
                self.need("I")
                self.expr(1)

    def targets(self):
        while True:
            self.take("*")
            self.expr(5)
            if not self.take(","):
                return
            if self.k[self.p] == "k":
                return

    def sequence(self, close):
        if self.take(close):
            return
        while True:
            self.take("*")
            self.expr()
            if self.k[self.p] in "Fa":
                self.loops()
                self.need(close)
                return
            if self.take(close):
                return
            self.need(",")
            if self.take(close):
                return

    def entries(self):
        if self.take("}"):
            return
        while True:
            if self.take("*"):
                self.expr(1)
            elif self.take("b"):
                self.expr(1)
            else:
                self.expr()
                if self.take(":"):
                    self.expr()
            if self.k[self.p] in "Fa":
                self.loops()
                self.need("}")
                return
            if self.take("}"):
                return
            self.need(",")
            if self.take("}"):
                return

    def call(self):
        if self.take(")"):
            return
        while True:
            if self.k[self.p] == "i" and self.k[self.p + 1] == "=":
                self.p += 2
                self.expr()
            else:
                self.take("*") or self.take("b")
                self.expr()
                if self.k[self.p] in "Fa":
                    self.loops()
            if self.take(")"):
                return
            self.need(",")
            if self.take(")"):
                return

    def tests(self):
        while True:
            self.take("*")
            self.expr()
            if not self.take(","):
                return
            if self.k[self.p] in ")=:;" + END:
                return

    def parameters(self):
        k = self.k
        self.need("(")
        while not self.take(")"):
            if k[self.p] in "*b":
                self.p += 1
                if k[self.p] == "," and k[self.p - 1] == "*":
                    self.p += 1
                    continue
            elif k[self.p] == "b":
                self.p += 1
            self.need("i") if k[self.p] != "i" else self.take("i")
            if self.take(":"):
                self.take("*")
                self.expr()
            if self.take("="):
                self.expr()
            if not self.take(","):
                self.need(")")
                return
            if k[self.p] == "b" and k[self.p + 1] in ",)":  # /
                self.p += 1
                self.take(",")

    def line(self):
        k = self.k
        c = k[0]
        if c == "@":
            self.p = 1
            self.expr()
        elif c in "IeHFXEZfWKA" or c == "a" and k[1] in "KFW":
            self.compound()
            return
        elif c == "i" and k[1] in "it(0[-{" and self.soft():
            return
        else:
            self.small()
            while self.take(";"):
                if k[self.p] == END:
                    break
                self.small()
        if k[self.p] != END:
            self.fail("expected the end of the line")

    def soft(self) -> bool:
        """match x: and case y: and type X = ...; told from names by what follows."""
        k = self.k
        if k.rstrip(END)[-1] == ":" and k[1] not in "":
            depth = self.depth
            try:
                self.p = 1
                while k[self.p] not in ":" + END:
                    if k[self.p] in "([{":
                        self.balanced()
                    else:
                        self.p += 1
                self.need(":")
                if k[self.p] == END and (k[1] in "it0" or k[1] in "([{-"):
                    self.opens = True
                    return True
            except Fail:
                pass
            self.p, self.depth = 0, depth
        return False

    def compound(self):
        k = self.k
        self.take("a")
        c = k[self.p]
        self.p += 1
        if c in "IeH":
            self.expr()
        elif c == "F":
            self.targets()
            self.need("k")
            self.tests()
        elif c == "Z":
            self.take("*")
            if k[self.p] != ":":
                self.expr()
                while self.take(","):
                    self.expr()
                if self.take("x"):
                    self.need("i")
        elif c == "W":
            if k[self.p] == "(" and re.compile(r"\(.*\):").match(k, self.p) and "x" in k:
                self.balanced()
            else:
                while True:
                    self.expr()
                    if self.take("x"):
                        self.expr(5)
                    if not self.take(","):
                        break
        elif c == "K":
            self.need("i")
            if k[self.p] == "[":
                self.balanced()
            self.parameters()
            if self.take("z"):
                self.expr()
        elif c == "A":
            self.need("i")
            if k[self.p] == "[":
                self.balanced()
            if self.take("("):
                self.call()
        self.need(":")
        if k[self.p] == END:
            self.opens = True
            return
        while True:
            self.small()
            if not self.take(";") or k[self.p] == END:
                break
        if k[self.p] != END:
            self.fail("expected the end of the line")

    def small(self):
        k = self.k
        c = k[self.p]
        if c == "J":
            self.p += 1
        elif c == "R":
            self.p += 1
            if k[self.p] not in ";" + END:
                self.tests()
        elif c == "r":
            self.p += 1
            if k[self.p] not in ";" + END:
                self.expr()
                if self.take("N"):
                    self.expr()
        elif c == "M":
            self.p += 1
            if not self.match(re.compile(r"i(?:\.i)*(?:xi)?(?:,i(?:\.i)*(?:xi)?)*")):
                self.fail("expected a module")
        elif c == "N":
            self.p += 1
            if not self.match(re.compile(r"[.d]*(?:i(?:\.i)*)?M(?:\*|\((?:i(?:xi)?,?)+\)|i(?:xi)?(?:,i(?:xi)?)*)")):
                self.fail("expected an import")
        elif c == "G":
            self.p += 1
            if not self.match(re.compile(r"i(?:,i)*")):
                self.fail("expected a name")
        elif c == "D":
            self.p += 1
            self.tests()
        elif c == "S":
            self.p += 1
            self.expr()
            if self.take(","):
                self.expr()
        elif c == "Y":
            self.yielded()
        else:
            self.tests()
            if self.take(":"):
                self.expr()
                if self.take("="):
                    self.right()
            elif self.take("g"):
                self.right()
            else:
                while self.take("="):
                    self.right()

    def right(self):
        if self.k[self.p] == "Y":
            self.yielded()
        else:
            self.tests()

    def yielded(self):
        self.p += 1
        self.take("N")
        if self.k[self.p] not in ");=" + END:
            self.tests()


_BRACKETS = re.compile(r"[()\[\]{}]")
_PAIRS = {")": "(", "]": "[", "}": "{"}


def _net(line: str) -> tuple[str, str]:
    """Brackets that a line closes and opens, beyond its own pairs."""
    closes, opens = [], []
    for c in _BRACKETS.findall(line):
        if c in "([{":
            opens.append(c)
        elif opens and opens[-1] == _PAIRS[c]:
            opens.pop()
        else:
            closes.append(c)
            if opens:  # they don't match; the line is invalid as it stands
                return "!", ""
    return "".join(closes), "".join(opens)


class Python:
    """Logical lines from physical ones, each checked by its kinds, and the blocks that their indentation makes."""

    def __init__(self, kinds: str, seen: dict):
        self.kinds, self.seen = kinds, seen
        self.errors: list[tuple[int, str]] = []
        self.count = 0

    def note(self, at: int, why: str) -> None:
        self.count += 1
        self.errors.append((at, why))

    def run(self) -> None:
        seen = self.seen
        if len(seen) > KEPT:
            seen.clear()
        stack = [0]
        need_block = False
        first = True
        # of each open block the first kind of its last line, which else and its like may follow
        last_at: dict[int, str] = {0: ""}
        decorated = False
        at = 0
        open_brackets = ""
        joined, joined_at, indent = "", 0, 0
        lines = self.kinds.split("\n")
        for number, raw in enumerate(lines):
            if number == 0:  # nothing stands before the first line's indentation
                continue
            width, body = ord(raw[0]) - INDENT, raw[1:]
            here = at
            at += len(body)
            if not body and number < len(lines):
                continue
            if open_brackets:
                joined += body
            else:
                joined, joined_at, indent = body, here, width
            net = seen.get("\n" + body)
            if net is None:
                net = seen["\n" + body] = _net(body)
            closes, opens = net
            if closes:
                for c in closes:
                    if c == "!" or not open_brackets or open_brackets[-1] != _PAIRS[c]:
                        self.note(here, "bracket that doesn't match")
                        open_brackets, opens = "", ""
                        break
                    open_brackets = open_brackets[:-1]
            open_brackets += opens
            if open_brackets:
                continue
            if first and indent and joined:
                self.note(joined_at, "unexpected indent")
            first = False
            # indentation
            if need_block:
                if indent <= stack[-1]:
                    self.note(joined_at, "expected an indented block")
                else:
                    stack.append(indent)
                    last_at[len(stack)] = ""
                need_block = False
            elif indent > stack[-1]:
                self.note(joined_at, "unexpected indent")
                stack.append(indent)
                last_at[len(stack)] = ""
            if indent < stack[-1]:
                while indent < stack[-1]:
                    last_at.pop(len(stack), None)
                    stack.pop()
                if indent != stack[-1]:
                    self.note(joined_at, "indentation that matches no outer one")
                    stack.append(indent)
            # the line itself
            found = seen.get(joined)
            if found is None:
                parser = PythonLine(joined, seen)
                try:
                    parser.line()
                    found = (parser.opens, "", 0)
                except Fail as e:
                    found = (joined[-1:] == ":" and joined[0] in "IeHFXEZfWKAa", e.why, e.at)
                if len(joined) < 2000:
                    seen[joined] = found
            opens_block, why, where = found
            if why:
                self.note(joined_at + where, why)
            head = joined[1] if joined[0] == "a" and len(joined) > 1 else joined[0]
            before = last_at.get(len(stack), "")
            if head == "E" and before not in tuple("IeHFZX") or head == "e" and before not in tuple("Ie") or head == "Z" and before not in tuple("XZ") or head == "f" and before not in tuple("XZE"):
                self.note(joined_at, "clause without its statement")
            if before == "X" and head not in "Zf":
                self.note(joined_at, "try without except")
            if decorated and head not in "KA@":
                self.note(joined_at, "decorator without a definition")
            decorated = head == "@"
            last_at[len(stack)] = head
            need_block = opens_block
        if open_brackets:
            self.note(at, "bracket never closed")
        if need_block:
            self.note(at, "expected an indented block")
        if decorated:
            self.note(at, "decorator without a definition")
        if "X" in last_at.values():
            self.note(at, "try without except")


_ASM_OPERAND = r"(?:[#$=*:%!~+-]*(?:[infso]|\((?:[infso%$#*+\-,:/<>&|~!]*)\)|\[[infso#%$+\-*,:!=]*\]|\{[infso,\-]*\}))"
_ASM_LINE = re.compile(
    rf"(?:[ino]:)*(?:[io]=[^{BAD}]*|[io](?:{_ASM_OPERAND}(?:(?:[+\-*/&|^<>%:@!=]+){_ASM_OPERAND}|[(\[]|[infs#%])*?"
    rf"(?:!|\^)?(?:,{_ASM_OPERAND}(?:(?:[+\-*/&|^<>%:@!=]+){_ASM_OPERAND}|\[[infso#%$+\-*,:!=]*\]|\([infso%$,+\-]*\)|#?[infs])*!?)*)?)?$"
)


class Assembler:
    """Lines of labels, directives and instructions. A # or ; or @ begins a comment unless an operand follows it at once."""

    def __init__(self, kinds: str, seen: dict):
        self.kinds, self.seen = kinds, seen
        self.errors: list[tuple[int, str]] = []
        self.count = 0

    def run(self) -> None:
        seen, at = self.seen, 0
        if len(seen) > KEPT:
            seen.clear()
        for line in self.kinds.split("\n"):
            ok = seen.get(line)
            if ok is None:
                ok = self.valid(line)
                if len(line) < 400:
                    seen[line] = ok
            if not ok:
                self.count += 1
                self.errors.append((at, "no label, directive or instruction"))
            at += len(line)

    @staticmethod
    def valid(line: str) -> bool:
        if not line or line[0] in "#;@*":
            return True
        for part in line.split(";"):
            part = re.split(r"#(?![in\-+:(])|@(?!i)|(?<![,\[=#])#(?=i)", part)[0]
            if not part:
                break
            if not _ASM_LINE.match(part):
                return False
        return True
