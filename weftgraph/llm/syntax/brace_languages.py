"""Recursive-descent parsers for C and C++, Java, JavaScript, Go and Rust. They accept what the languages' grammars accept,
and somewhat more: names, types and the order of modifiers aren't checked."""

from __future__ import annotations

import re

from weftgraph.llm.syntax.parser import ARGS, END, PARENS, Fail, Parser, compiled

_LEVELS = {"=": 0, "a": 0, "?": 0, "1": 1, "2": 2, "3": 3, "|": 4, "^": 4, "&": 4, "5": 5, "6": 6, "<": 6, ">": 6, "7": 7, "+": 8, "-": 8, "*": 9, "9": 9}

_P3 = PARENS
_ATTR = rf"(?:@{_P3}|\[\[[^\0]*?\]\])"
_NAME = rf"(?:d?(?:!?i(?:{ARGS})?d)*(?:T?[!~]?i(?:{ARGS}(?=[(d{{*&ri>,;)=\[]))?|O(?:\(\)|\[\]|[BQi*&]+|[^\s(\0]{{1,2}}))|[*]?d)"
_HEAD = rf"(?:Q|{_ATTR}|e)*(?:B(?:{_P3})?(?:[QB]|{_ATTR})*|A(?:{_ATTR}|Q)*A?{_NAME}?|{_NAME})(?:[Q*&re]|{_ATTR})*"


class C(Parser):
    BINARY = _LEVELS | {"r": 3, ",": 0}
    PREFIX = frozenset("+-!~*&ur")
    TRAILING = False
    _head = compiled(rf"{_HEAD}(?:{_NAME}(?:[Q*&re]|{_ATTR})*){{0,2}}")
    _param = compiled(rf"(?:Y|{_HEAD}(?:{_NAME}(?:[Q*&re]|{_ATTR})*)?)(?=[,)=\[(:])")
    _declares = compiled(rf"(?:[QBAY]|{_ATTR}|{_NAME}[*&rQ]*{_NAME}[;=,\[({{:])")
    _type = compiled(rf"{_HEAD}(?:\[[^\]]*\])*(?=[),>;])")
    _cast = compiled(rf"\((?:(?:Q|A|B)[^()\0]*(?:\(\*\){_P3})?|{_NAME}(?:[Q*&r])*)\)")
    _args = compiled(ARGS)
    _designator = compiled(r"(?:\.i|\[[^\[\]\0]*\])+=")
    _operand = frozenset("insc(!~{BKUW[udO-+*&")

    def argument(self):
        at = self.p
        if self.k[at] in "BAQ" and self.match(self._type):
            return
        if self.k[at] == "{":
            return self.braces()
        self.expr(1)
        if self.k[self.p] == "e":  # a pack
            self.p += 1

    def initial(self):
        if self.k[self.p] == "{":
            self.braces()
        elif self.k[self.p] == "L" or self.k[self.p] == "U" and self.k[self.p + 1] == ";":  # = default, = delete
            self.p += 1
        else:
            self.expr(1)

    def braces(self):
        self.need("{")
        self.deeper()
        while not self.take("}"):
            if self.match(self._designator) or True:
                self.initial()
            self.take("e")
            if not self.take(","):
                self.need("}")
                break
        self.depth -= 1

    def unary(self):
        k = self.k
        while True:
            c = k[self.p]
            if c in "+-!~*&ur":
                self.p += 1
            elif c == "U":
                self.p += 1
                if k[self.p] == "[" and k[self.p + 1] == "]":
                    self.p += 2
                if k[self.p] == "e":
                    self.p += 1
                if k[self.p] in ";),":
                    return
                if k[self.p] == "(":
                    m = compiled(rf"\((?:{_HEAD}(?:\[[^\]]*\])*)\)").match(k, self.p)
                    if m and m.group()[1] in "BAQi":
                        self.p = m.end()
                        return self.postfix()
            elif c == "(" and (m := self._cast.match(k, self.p)):
                inner, after = m.group()[1:-1], k[m.end()]
                typed = inner[0] in "BAQ" or inner[-1] in "*&r"
                if typed and after in self._operand or not typed and after in "inscBKWUO!{(" and (after not in "({" or False):
                    self.p = m.end()
                    if after == "{":
                        self.braces()
                        return self.postfix()
                    continue
                break
            else:
                break
        self.primary()

    def primary(self):
        k = self.k
        c = k[self.p]
        if c in "id" or c == "O":
            m = _C_NAME.match(k, self.p)
            if not m:
                self.fail("expected an expression")
            self.p = m.end()
            if k[self.p] == "<" and (m := self._args.match(k, self.p)) and k[m.end()] in "({d":
                self.p = m.end()
            if k[self.p] == "s":  # a macro between pieces of a text
                self.p += 1
        elif c == "n" or c == "c":
            self.p += 1
        elif c == "s":
            while k[self.p] in "si" and (k[self.p] == "s" or k[self.p - 1] == "s"):
                self.p += 1
        elif c == "(":
            if k[self.p + 1] == "{":
                self.p += 1
                self.block()
                self.need(")")
            else:
                self.condition_in_parens()
        elif c == "{":
            self.braces()
        elif c == "[":
            self.balanced()
            self.match(self._args)
            if k[self.p] == "(":
                self.params()
            while k[self.p] in "Q@":
                self.p += 1
            if k[self.p] == ".":
                self.p += 1
                self.match(self._type_any)
            self.block()
        elif c == "K":
            self.p += 1
            if not self.match(self._args):
                self.fail("expected a type")
            self.paren_expr()
        elif c == "W":
            self.p += 1
            if k[self.p] == "(":
                self.balanced()
            if not self.match(self._type_any):
                self.fail("expected a type")
            while self.take("["):
                self.expr()
                self.need("]")
            if k[self.p] == "{":
                self.braces()
        elif c in "BA":
            if not self.match(self._type_any):
                self.fail("expected a type")
            if k[self.p] not in "({d)":
                self.fail("expected an expression")
            if k[self.p] == "{":
                self.braces()
            elif k[self.p] == "d":
                self.p += 1
                return self.primary()
        else:
            self.fail("expected an expression")
        self.postfix()

    _type_any = compiled(_HEAD)

    def condition_in_parens(self):
        self.need("(")
        if self.k[self.p] == "e":  # a fold
            self.p -= 1
            return self.balanced()
        self.expr()
        if self.k[self.p] == "e":
            self.p += 1
            self.take(",")
        self.need(")")

    def postfix(self):
        k = self.k
        while True:
            c = k[self.p]
            if c == "(":
                self.p += 1
                self.arguments()
            elif c == "[":
                self.p += 1
                self.expr()
                self.need("]")
            elif c == ".":
                self.p += 1
                self.take("T")
                m = _C_NAME.match(k, self.p)
                if not m:
                    self.fail("expected a member")
                self.p = m.end()
                if k[self.p] == "<" and (m := self._args.match(k, self.p)) and k[m.end()] in "(d":
                    self.p = m.end()
            elif c == "u":
                self.p += 1
            elif c == "{" and k[self.p - 1] in "i>" and self.in_braces_ok():
                self.braces()
            else:
                return

    def in_braces_ok(self) -> bool:
        """T{...}: a name before a brace, closed on its way without a statement."""
        m = _BRACES.match(self.k, self.p)
        return bool(m) and self.k[m.end()] in ";,)]}.+-*9?:56"

    def params(self):
        """( parameters )"""
        self.need("(")
        if self.take(")"):
            return
        while True:
            if self.match(self._param):
                while self.k[self.p] in "[(:":
                    if self.k[self.p] == ":":
                        self.p += 1
                        self.expr(1)
                    else:
                        self.balanced()
                if self.take("="):
                    self.initial()
            elif self.k[self.p] == "e":
                self.p += 1
            else:
                self.argument()
            if self.take(")"):
                return
            self.need(",")

    def declaration(self, member: bool):
        """Everything from specifiers to a semicolon or a body."""
        k = self.k
        if self.take("Y"):
            member = True
        at = self.p
        if not self.match(self._head):
            self.fail("expected a declaration")
        head = k[at : self.p]
        while True:
            c = k[self.p]
            if c == ";":
                self.p += 1
                return
            if c == "(":
                self.params()
                while k[self.p] in "Qr&@":
                    if k[self.p] == "@":
                        self.p += 1
                        self.balanced()
                    else:
                        self.p += 1
                        if k[self.p - 1] == "Q" and k[self.p] == "(":
                            self.balanced()
                if k[self.p] == "." and k[self.p + 1] in "BQAid":
                    self.p += 1
                    if not self.match(self._type_any):
                        self.fail("expected a type")
                if k[self.p] == ":" and member:
                    self.p += 1
                    while True:
                        if not self.match(_C_NAME):
                            self.fail("expected a member")
                        self.match(self._args)
                        if k[self.p] not in "({":
                            self.fail("expected an initial value")
                        self.balanced()
                        if not self.take(","):
                            break
                if k[self.p] in "{X":
                    self.take("X")
                    if not member:
                        self.fail("expected ;")
                    self.block()
                    while self.take("Z"):
                        self.params()
                        self.block()
                    return
            elif c == "[":
                if k[self.p + 1] == "]":
                    self.p += 2
                else:
                    self.p += 1
                    self.take("Q")
                    self.expr()
                    self.need("]")
            elif c == "=":
                self.p += 1
                self.initial()
            elif c == "{" or c == ":" and "A" in head:
                if "A" in head:
                    self.body(c, head)
                    head = ""
                    if not (k[self.p] == ";" or compiled(rf"[*&Q]*(?:{_ATTR})*[i(;]").match(k, self.p)):
                        self.fail("expected ;")
                    self.match(self._head)
                else:
                    self.braces()
            elif c == ":":
                self.p += 1
                self.expr(1)
            elif c == ",":
                self.p += 1
                if not (self.match(compiled(rf"(?:[Q*&r]|{_ATTR})*{_NAME}")) or k[self.p] in "(*"):
                    self.fail("expected a name")
                while k[self.p] in "*&Q":
                    self.p += 1
            elif c in "@M":
                self.p += 1
                self.balanced()
            else:
                self.fail("expected ;")

    def body(self, c: str, head: str):
        k = self.k
        if c == ":":
            while k[self.p] not in "{;" + END:
                if k[self.p] in ")]}":
                    self.fail("expected a base")
                self.p += 1
        if k[self.p] == ";":
            return
        at = self.p
        # an enumeration has names between commas; a structure has members
        if compiled(r"\{(?:i(?:=[^;{}\0]*)?,?)*\}").match(k, at):
            self.balanced()
            return
        self.need("{")
        while not self.take("}"):
            if k[self.p] == END:
                self.fail("body never closed")
            depth = self.depth
            try:
                self.item()
            except Fail as e:
                if k[e.at] == END:
                    raise
                self.depth = depth
                self.recover(e)

    def item(self):
        k = self.k
        c = k[self.p]
        if c == ";":
            self.p += 1
        elif c == "N" or c == "Q" and k[self.p + 1] == "N":
            self.p += 1 + (c == "Q")
            self.match(compiled(r"(?:\[\[[^\]]*\]\])*(?:i(?:d(?:Q)?i)*)?"))
            if self.take("="):
                self.expr(1)
                self.need(";")
                return
            self.items_in_braces()
        elif c == "Q" and k[self.p + 1] == "s":
            self.p += 2
            if k[self.p] == "{":
                self.items_in_braces()
            else:
                self.item()
        elif c == "T":
            self.p += 1
            self.match(self._args)
            self.item()
        elif c == "G":
            self.p += 1
            self.take("N")
            if self.match(compiled(rf"{_NAME}=")):
                if not self.match(self._type_any):
                    self.fail("expected a type")
                while k[self.p] in "([":
                    self.balanced()
            elif not self.match(self._type_any):
                self.fail("expected a name")
            self.need(";")
        elif c == "P":
            self.p += 1
            self.take("i")
            self.need(":")
        elif c == "M":
            self.p += 1
            self.match(compiled("Q*"))
            self.balanced()
            self.need(";")
        elif c == "[" and k[self.p + 1] == "[":
            self.balanced()
        else:
            self.known(self.SIMPLE, lambda: self.declaration(True))

    def items_in_braces(self):
        self.need("{")
        self.deeper()
        while not self.take("}"):
            if self.k[self.p] == END:
                self.fail("block never closed")
            depth, at = self.depth, self.p
            try:
                self.item()
            except Fail as e:
                if self.k[e.at] == END:
                    raise
                self.depth = depth
                self.recover(e)
                if self.p == at:
                    self.p += 1
        self.depth -= 1

    def statement(self):
        k = self.k
        c = k[self.p]
        if c == "{":
            self.block()
        elif c == "I":
            self.p += 1
            self.take("Q")
            self.head_condition()
            self.statement()
            if self.take("E"):
                self.statement()
        elif c == "F":
            self.p += 1
            self.for_head()
            self.statement()
        elif c in "HS":
            self.p += 1
            self.head_condition()
            self.statement()
        elif c == "D":
            self.p += 1
            self.statement()
            self.need("H")
            self.condition()
            self.need(";")
        elif c == "C":
            self.p += 1
            self.expr(1)
            if self.take("e"):
                self.expr(1)
            self.need(":")
            if k[self.p] not in "CL}" + END:
                self.statement()
        elif c == "L" and k[self.p + 1] == ":":
            self.p += 2
            if k[self.p] not in "CL}" + END:
                self.statement()
        elif c == "R":
            self.p += 1
            if k[self.p] == "{":
                self.braces()
                self.need(";")
            elif not self.take(";"):
                self.known(self.SIMPLE, self.expression_end)
        elif c == "J":
            self.p += 1
            self.need(";")
        elif c == "X":
            self.p += 1
            self.block()
            if k[self.p] != "Z":
                self.fail("expected catch")
            while self.take("Z"):
                self.params()
                self.block()
        elif c == "i" and k[self.p + 1] == ":":
            self.p += 2
            if k[self.p] not in "}":
                self.statement()
        elif c in "GNMTP":
            self.item()
        elif c == ";":
            self.p += 1
        elif c == "[" and k[self.p + 1] == "[":
            self.balanced()
            self.statement()
        elif c == "E":
            self.fail("else without if")
        else:
            self.known(self.SIMPLE, self.simple)

    def expression_end(self):
        self.expr()
        self.need(";")

    def simple(self):
        at = self.p
        if self._declares.match(self.k, at):
            try:
                return self.declaration(False)
            except Fail as e:
                if self.k[at] in "QAY" or self.k[e.at] == END:
                    raise
                self.p = at
                depth = self.depth
                try:
                    return self.expression_end()
                except Fail as other:
                    self.depth = depth
                    raise (e if e.at >= other.at else other) from None
        return self.expression_end()

    def head_condition(self):
        def parse():
            self.need("(")
            if self._declares.match(self.k, self.p):
                self.match(self._head)
                if self.k[self.p] in "={":
                    self.take("=")
                    self.initial()
                    if self.take(";"):
                        self.expr()
                else:
                    self.fail("expected a condition")
            else:
                self.expr()
                if self.take(";"):
                    self.expr()
            self.need(")")

        self.known(_COND, parse)

    def for_head(self):
        def parse():
            k = self.k
            self.need("(")
            if not self.take(";"):
                if self._declares.match(k, self.p):
                    self.match(self._head)
                    if k[self.p] == "[":
                        self.balanced()
                    if self.take(":"):
                        self.initial()
                        self.need(")")
                        return
                    while k[self.p] in "=,[({":
                        if k[self.p] == "=":
                            self.p += 1
                            self.initial()
                        elif k[self.p] == ",":
                            self.p += 1
                            self.match(compiled(r"[*&Q]*"))
                            self.need("i")
                        else:
                            self.balanced()
                else:
                    self.expr()
                self.need(";")
            if not self.take(";"):
                self.expr()
                self.need(";")
            if not self.take(")"):
                self.expr()
                self.need(")")

        self.known(_FOR, parse)


_C_NAME = compiled(rf"d?(?:i(?:{ARGS})?d)*(?:T?[!~]?i|O(?:\(\)|\[\]|[BQi*&]+|[^\s(\0]{{1,2}}))")
_BRACES = compiled(r"\{(?:[^{};\0]|\{[^{};\0]*\})*\}")
_COND = compiled(r"\((?:[^(){};\0]|\((?:[^(){};\0]|\((?:[^(){};\0]|\([^(){};\0]*\))*\))*\))*\)")
_FOR = compiled(r"\((?:[^(){}\0]|\((?:[^(){};\0]|\((?:[^(){};\0]|\([^(){};\0]*\))*\))*\))*\)")

_JT = rf"(?:(?:B|i(?:{ARGS})?(?:\.i(?:{ARGS})?)*)(?:@i)*(?:\[\])*)"
_ANN = rf"(?:@i(?:\.i)*(?:{_P3})?)"


class Java(Parser):
    BINARY = _LEVELS | {"V": 6}
    PREFIX = frozenset("+-!~u")
    _local = compiled(rf"(?:Q|{_ANN})*{_JT}i(?:\[\])*(?=[=;,:)\[])")
    _modifiers = compiled(rf"(?:Q|{_ANN})*")
    _generic = compiled(ARGS)
    _type = compiled(_JT)
    _cast = compiled(rf"\({_JT}(?:&{_JT})*\)")
    _lambda = compiled(rf"(?:i|\((?:[^()\0]|{_P3})*\))l")
    _types = compiled(rf"{_JT}(?:[,&]{_JT})*")

    def initial(self):
        if self.k[self.p] == "{":
            self.array()
        else:
            self.expr(0)

    def array(self):
        self.need("{")
        while not self.take("}"):
            self.initial()
            if not self.take(","):
                self.need("}")
                return

    def after_operator(self):
        if self.k[self.p - 1] == "V":  # instanceof: a type and maybe a name
            at = self.p
            self.match(self._modifiers)
            if not self.match(self._type):
                self.p = at
                self.fail("expected a type")
            if self.k[self.p] == "(":
                self.balanced()
            self.take("i")

    def expr(self, least: int = 0):
        k = self.k
        if k[self.p] in "i(" and self.match(self._lambda):
            if k[self.p] == "{":
                self.block()
            else:
                self.expr(0)
            return
        self.deeper()
        self.unary()
        while True:
            c = k[self.p]
            level = self.BINARY.get(c)
            if level is None or level < least:
                break
            self.p += 1
            if c == "?":
                self.expr(1)
                self.need(":")
                self.expr(1)
            elif c in "=a":
                self.initial()
            elif c == "V":
                self.after_operator()
            else:
                if c == ">" and k[self.p] == ">":
                    self.p += 1
                    self.take(">")
                self.expr(level + 1)
        self.depth -= 1

    def unary(self):
        k = self.k
        while True:
            if k[self.p] in self.PREFIX:
                self.p += 1
            elif k[self.p] == "(" and (m := self._cast.match(k, self.p)) and (k[m.end()] in "insc!~W(S" or k[m.start() + 1] == "B" and k[m.end()] in "+-") and (k[m.start() + 1] == "B" or k[m.end()] != "(" or True):
                after = k[m.end()]
                if after == "(" and k[m.start() + 1] == "i":
                    at = self.p
                    self.p = m.end()
                    if self._lambda.match(k, self.p):
                        return self.expr(1)
                    try:  # (name)(...) is a cast or a call in brackets; both need what follows to be in order
                        self.balanced()
                    finally:
                        self.p = at
                self.p = m.end()
                if self._lambda.match(k, self.p):
                    return self.expr(1)
            else:
                break
        self.primary()

    def primary(self):
        k = self.k
        c = k[self.p]
        if c in "nsc":
            self.p += 1
        elif c == "i":
            self.p += 1
            if k[self.p] == "<" and (m := self._generic.match(k, self.p)) and k[m.end()] in "d":
                self.p = m.end()
            elif k[self.p] == "[" and k[self.p + 1] == "]":
                while k[self.p : self.p + 2] == "[]":
                    self.p += 2
        elif c == "(":
            self.p += 1
            self.expr()
            self.need(")")
        elif c == "W":
            self.new()
        elif c == "B":
            self.match(self._type)
            if k[self.p] not in ".d":
                self.fail("expected an expression")
        elif c == "S":
            self.switch()
        elif c == "@":
            self.match(compiled(_ANN))
        else:
            self.fail("expected an expression")
        while True:
            c = k[self.p]
            if c == "(":
                self.p += 1
                self.arguments()
            elif c == "[":
                self.p += 1
                self.expr()
                self.need("]")
            elif c == ".":
                self.p += 1
                self.match(self._generic)
                if k[self.p] == "W":
                    self.new()
                elif k[self.p] in "iA":
                    self.p += 1
                else:
                    self.fail("expected a member")
            elif c == "d":
                self.p += 1
                if k[self.p] not in "iW":
                    self.fail("expected a method")
                self.p += 1
            elif c == "u":
                self.p += 1
            else:
                return

    def new(self):
        k = self.k
        self.need("W")
        if not self.match(compiled(rf"(?:{_ANN})*(?:B|i(?:{ARGS})?(?:\.i(?:{ARGS})?)*)")):
            self.fail("expected a type")
        if self.take("("):
            self.arguments()
            if k[self.p] == "{":
                self.members()
        elif k[self.p] == "[":
            while self.take("["):
                if not self.take("]"):
                    self.expr()
                    self.need("]")
            if k[self.p] == "{":
                self.array()
        else:
            self.fail("expected arguments")

    def switch(self):
        k = self.k
        self.need("S")
        self.condition()
        self.need("{")
        while not self.take("}"):
            c = k[self.p]
            if c == "C":
                self.p += 1
                while k[self.p] not in ":l;{}" + END:
                    if k[self.p] == "(":
                        self.balanced()
                    else:
                        self.p += 1
                arrow = k[self.p] == "l"
                if k[self.p] not in ":l":
                    self.fail("expected :")
                self.p += 1
            elif c == "Q" and k[self.p + 1] in ":l":
                arrow = k[self.p + 1] == "l"
                self.p += 2
            elif c == END:
                self.fail("switch never closed")
            else:
                self.statement()
                continue
            if arrow:
                if k[self.p] == "{":
                    self.block()
                else:
                    self.statement()

    def params(self):
        self.need("(")
        if self.take(")"):
            return
        while True:
            if not self.match(compiled(rf"(?:Q|{_ANN})*{_JT}(?:{_ANN})*e?(?:i\.)?i(?:\[\])*")):
                self.fail("expected a parameter")
            if self.take(")"):
                return
            self.need(",")

    def item(self):
        k = self.k
        if self.take(";"):
            return
        if k[self.p] == "N":
            self.p += 1
            self.take("Q")
            if not self.match(compiled(r"i(?:\.i)*(?:\.\*)?;")):
                self.fail("expected a name and ;")
            return
        at = self.p
        self.match(self._modifiers)
        if k[self.p] == "N":
            return self.item()
        if k[self.p] == "A" or k[self.p] == "@" and k[self.p + 1] == "A":
            return self.type_declaration()
        if k[self.p : self.p + 2] == "ii" and self.match(compiled(rf"ii(?:{ARGS})?(?=\()")):  # a record, or a method
            return self.method()
        self.p = at
        self.member()

    def type_declaration(self):
        k = self.k
        self.take("@")
        self.need("A")
        self.need("i")
        self.match(self._generic)
        while self.take("x"):
            if not self.match(self._types):
                self.fail("expected a type")
        self.members()

    def members(self):
        k = self.k
        self.need("{")
        self.deeper()
        # constants of an enumeration
        if compiled(rf"(?:{_ANN})*i(?:{_P3})?[,;}}{{]").match(k, self.p):
            while self.match(compiled(rf"(?:{_ANN})*i(?={_P3}|[,;}}{{])")):
                if k[self.p] == "(":
                    self.balanced()
                if k[self.p] == "{":
                    self.members()
                if not self.take(","):
                    break
            if k[self.p] not in ";}":
                self.fail("expected ;")
        while not self.take("}"):
            if k[self.p] == END:
                self.fail("class never closed")
            depth, at = self.depth, self.p
            try:
                self.member()
            except Fail as e:
                if k[e.at] == END:
                    raise
                self.depth = depth
                self.recover(e)
                if self.p == at:
                    self.p += 1
        self.depth -= 1

    def member(self):
        k = self.k
        if self.take(";"):
            return
        self.match(self._modifiers)
        if k[self.p] == "A" or k[self.p] == "@":
            return self.type_declaration()
        if k[self.p] == "{":
            return self.block()
        self.match(self._generic)
        if k[self.p] == "i" and k[self.p + 1] in "({":  # a constructor
            self.p += 1
            return self.method()
        if not self.match(self._type):
            self.fail("expected a member")
        self.need("i")
        if k[self.p] in "(<":
            self.match(self._generic)
            return self.method()
        while True:
            while k[self.p : self.p + 2] == "[]":
                self.p += 2
            if self.take("="):
                self.initial()
            if self.take(";"):
                return
            self.need(",")
            self.need("i")

    def method(self):
        k = self.k
        if k[self.p] == "(":
            self.params()
        while k[self.p : self.p + 2] == "[]":
            self.p += 2
        while k[self.p] in "tx":
            self.p += 1
            if not self.match(self._types):
                self.fail("expected a type")
        if self.take("Q"):  # the default of an annotation
            self.initial()
            self.need(";")
        elif not self.take(";"):
            self.block()

    def statement(self):
        k = self.k
        c = k[self.p]
        if c == "{":
            self.block()
        elif c == "I":
            self.p += 1
            self.condition()
            self.statement()
            if self.take("E"):
                self.statement()
        elif c == "H":
            self.p += 1
            self.condition()
            self.statement()
        elif c == "F":
            self.p += 1
            self.known(_FOR, self.for_head)
            self.statement()
        elif c == "D":
            self.p += 1
            self.statement()
            self.need("H")
            self.condition()
            self.need(";")
        elif c == "S":
            self.switch()
            self.take(";")
        elif c == "Q" and k[self.p + 1] == "(":
            self.p += 1
            self.condition()
            self.block()
        elif c == "R":
            self.p += 1
            if not self.take(";"):
                self.known(self.SIMPLE, self.expression_end)
        elif c == "J":
            self.p += 1
            self.take("i")
            self.need(";")
        elif c == "M":
            self.p += 1
            self.expr()
            if self.take(":"):
                self.expr()
            self.need(";")
        elif c == "X":
            self.p += 1
            resources = k[self.p] == "("
            if resources:
                self.balanced()
            self.block()
            if not resources and k[self.p] not in "Zf":
                self.fail("expected catch")
            while self.take("Z"):
                if not self.match(compiled(rf"\((?:Q|{_ANN})*{_JT}(?:\|{_JT})*i\)")):
                    self.fail("expected an exception")
                self.block()
            if self.take("f"):
                self.block()
        elif c == ";":
            self.p += 1
        elif c == "i" and k[self.p + 1] == ":":
            self.p += 2
            self.statement()
        elif c == "A" or c in "Q@" and compiled(rf"(?:Q|{_ANN})*A").match(k, self.p):
            self.item()
        elif c == "E":
            self.fail("else without if")
        else:
            self.known(self.SIMPLE, self.simple)

    def expression_end(self):
        self.expr()
        self.need(";")

    def simple(self):
        if self.match(self._local):
            return self.declarators()
        if self.k[self.p] == "i" and self.k[self.p + 1] in "ins(" and self.k[self.p + 1] != "(":  # yield
            self.p += 1
        self.expression_end()

    def declarators(self):
        while True:
            if self.take("="):
                self.initial()
            if self.take(";"):
                return
            self.need(",")
            self.need("i")
            while self.k[self.p : self.p + 2] == "[]":
                self.p += 2

    def for_head(self):
        self.need("(")
        if self.match(self._local):
            if self.take(":"):
                self.expr()
                return self.need(")")
            self.declarators()
        elif not self.take(";"):
            self.commas()
            self.need(";")
        if not self.take(";"):
            self.expr()
            self.need(";")
        if not self.take(")"):
            self.commas()
            self.need(")")

    def commas(self):
        self.expr()
        while self.take(","):
            self.expr()


_JS_NOT_END = "-=(,[{?:.+*9&|^!~1234567<>aelpkUVWNQxIHFDSCZM"
_JS_GOES_ON = r".,)\]=?:+\-*9&|^1234567<>alpk"


class JavaScript(Parser):
    """A line's end is a kind of its own; it ends a statement where the next token can't go on."""

    BINARY = _LEVELS | {"k": 6, "p": 10, ",": 0}
    PREFIX = frozenset("+-!~uU")
    TRAILING = True
    SIMPLE = compiled(r"[^{};\0\n]*;")
    _arrow = compiled(rf"(?:i|Q|\((?:[^()\0]|\((?:[^()\0]|{_P3})*\))*\))l")
    _key = compiled(r"(?:Q(?=[^(:,=}]))*\*?(?:[a-zA-Zns])(?=[(:,=};\n])")

    @staticmethod
    def prepare(kinds: str) -> str:
        kinds = re.sub(rf"\n+(?=[{_JS_GOES_ON}])", "", kinds)
        return re.sub(r"\n+", "\n", kinds)

    def lines(self):
        while self.k[self.p] == "\n":
            self.p += 1

    def end(self):
        c = self.k[self.p]
        if c in ";\n":
            self.p += 1
        elif c not in "}" + END or c == END and self.p < len(self.k) - 4:
            self.fail("expected ;")

    def after_operator(self):
        self.lines()

    def need(self, c):
        if c in "{(" and self.k[self.p] == "\n":
            self.lines()
        if c in "])}" and self.k[self.p] == "\n":
            self.lines()
        super().need(c)

    def argument(self):
        self.lines()
        self.take("e")
        self.expr(1) if self.k[self.p] not in "=" else self.fail("expected an expression")
        while self.k[self.p] in "=a":
            self.p += 1
            self.expr(0)

    def arguments(self, close=")"):
        while True:
            self.lines()
            if self.take(close):
                return
            if close == "]" and self.take(","):
                continue
            self.argument()
            self.lines()
            if self.take(close):
                return
            self.need(",")

    def initial(self):
        self.lines()
        self.expr(0) if False else self._assign()

    def _assign(self):
        self.expr(1)
        while self.k[self.p] in "=a":
            self.p += 1
            self.lines()
            self.expr(1)
        if self.k[self.p] == "?":
            self._ternary()

    def _ternary(self):
        self.need("?")
        self.lines()
        self._assign()
        self.lines()
        self.need(":")
        self.lines()
        self._assign()

    def expr(self, least: int = 0):
        k = self.k
        self.lines()
        self.deeper()
        if k[self.p] == "Q" and self._arrow.match(k, self.p + 1):
            self.p += 1
        if k[self.p] in "iQ(" and self.match(self._arrow):
            self.lines()
            if k[self.p] == "{":
                self.block()
            else:
                self._assign()
            self.depth -= 1
            return
        if k[self.p] == "Y":
            self.p += 1
            self.take("*")
            if k[self.p] not in ";)]},\n" + END:
                self._assign()
            self.depth -= 1
            return
        self.unary()
        while True:
            c = k[self.p]
            level = self.BINARY.get(c)
            if level is None or level < least:
                break
            if c == "?":
                self._ternary()
                continue
            self.p += 1
            if c in "=a":
                self.initial()
            else:
                if c == ">" and k[self.p] == ">":
                    self.p += 1
                    self.take(">")
                self.expr(level + 1 if level else 1)
        if least == 1 and k[self.p] == "?":
            self._ternary()
        self.depth -= 1

    def unary(self):
        while self.k[self.p] in self.PREFIX:
            self.p += 1
            self.lines()
        self.primary()

    def primary(self):
        k = self.k
        c = k[self.p]
        if c in "ins" or c == "Q" and k[self.p + 1] != "N" or c == "M" and k[self.p + 1] in "(.":
            self.p += 1
        elif c == "(":
            self.p += 1
            self.expr()
            self.lines()
            self.need(")")
        elif c == "[":
            self.p += 1
            self.arguments("]")
        elif c == "{":
            self.object()
        elif c in "NQ":
            self.function()
        elif c == "A":
            self.klass()
        elif c == "W":
            self.p += 1
            if self.take("."):
                self.need("i")
            else:
                self.primary_only()
        else:
            self.fail("expected an expression")
        self.postfix()

    def primary_only(self):
        k = self.k
        if k[self.p] == "W":
            self.p += 1
            return self.primary_only()
        if k[self.p] in "iQ":
            self.p += 1
            while self.take("."):
                self.p += 1
        elif k[self.p] == "(":
            self.balanced()
        elif k[self.p] in "NA":
            self.function() if k[self.p] == "N" else self.klass()
        else:
            self.fail("expected a constructor")

    def postfix(self):
        k = self.k
        while True:
            c = k[self.p]
            if c == "(":
                self.p += 1
                self.arguments()
            elif c == "[":
                self.p += 1
                self.expr()
                self.need("]")
            elif c == ".":
                self.p += 1
                self.lines()
                if k[self.p] in "([":
                    continue
                self.take("#")
                if not k[self.p].isalpha():
                    self.fail("expected a member")
                self.p += 1
            elif c in "us" and (c == "u" or k[self.p - 1] in "i)]"):
                self.p += 1
            else:
                return

    def object(self):
        k = self.k
        self.need("{")
        self.deeper()
        while True:
            self.lines()
            if self.take("}"):
                break
            if self.take("e"):
                self._assign()
            else:
                while k[self.p] in "Q*" and k[self.p + 1] not in "(:,}=\n":
                    self.p += 1
                if k[self.p] == "[":
                    self.balanced()
                elif k[self.p].isalpha():
                    self.p += 1
                else:
                    self.fail("expected a key")
                if self.take(":"):
                    self.lines()
                    self._assign()
                elif k[self.p] == "(":
                    self.balanced()
                    self.block()
                elif self.take("="):
                    self._assign()
            self.lines()
            if not self.take(","):
                self.need("}")
                break
        self.depth -= 1

    def function(self):
        k = self.k
        while self.take("Q"):
            pass
        self.need("N")
        self.take("*")
        if k[self.p] in "iQY":
            self.p += 1
        self.params()
        self.block()

    def params(self):
        self.lines()
        self.need("(")
        self.arguments()

    def klass(self):
        k = self.k
        self.need("A")
        if k[self.p] in "iQ":
            self.p += 1
        if self.take("x"):
            self.unary()
        self.lines()
        self.need("{")
        while True:
            while k[self.p] in ";\n":
                self.p += 1
            if self.take("}"):
                return
            while k[self.p] in "Q*" and k[self.p + 1] not in "(=;}\n":
                self.p += 1
            if k[self.p] == "{":
                self.block()
                continue
            self.take("#")
            if k[self.p] == "[":
                self.balanced()
            elif k[self.p].isalpha():
                self.p += 1
            else:
                self.fail("expected a member")
            if k[self.p] == "(":
                self.params()
                self.block()
            else:
                if self.take("="):
                    self._assign()
                self.end()

    def item(self):
        self.statement()

    def statement(self):
        k = self.k
        self.lines()
        c = k[self.p]
        if c == END or c == "}":
            if c == "}" and False:
                self.fail("bracket that closes nothing")
            return
        if c == "{":
            self.block()
        elif c == "N" or c == "Q" and k[self.p + 1] == "N":
            self.function()
        elif c == "A":
            self.klass()
        elif c == "I":
            self.p += 1
            self.condition()
            self.statement()
            at = self.p
            self.lines()
            if self.take("E"):
                self.statement()
            else:
                self.p = at
        elif c == "H":
            self.p += 1
            self.condition()
            self.statement()
        elif c == "F":
            self.p += 1
            if k[self.p] == "U":
                self.p += 1
            self.known(_FOR, self.for_head)
            self.statement()
        elif c == "D":
            self.p += 1
            self.statement()
            self.lines()
            self.need("H")
            self.condition()
            self.take(";")
        elif c == "S":
            self.p += 1
            self.condition()
            self.need("{")
            while True:
                self.lines()
                if self.take("}"):
                    break
                if self.take("C"):
                    self.expr()
                    self.need(":")
                elif k[self.p] == "L" and k[self.p + 1] == ":":
                    self.p += 2
                elif k[self.p] == END:
                    self.fail("switch never closed")
                else:
                    self.statement()
        elif c == "R":
            self.p += 1
            if k[self.p] not in ";\n}" + END:
                self.expr()
            self.end()
        elif c == "J":
            self.p += 1
            self.take("i")
            self.end()
        elif c == "X":
            self.p += 1
            self.block()
            self.lines()
            if k[self.p] not in "Zf":
                self.fail("expected catch")
            if self.take("Z"):
                if k[self.p] == "(":
                    self.balanced()
                self.block()
                at = self.p
                self.lines()
                if k[self.p] != "f":
                    self.p = at
            if self.take("f"):
                self.block()
        elif c == "V":
            self.p += 1
            self.known(self.SIMPLE, self.variables)
        elif c == "M" and k[self.p + 1] not in "(.":
            self.p += 1
            while k[self.p] not in ";\n" + END:
                if k[self.p] == "{":
                    self.balanced()
                else:
                    self.p += 1
            self.end()
        elif c == "P":
            self.p += 1
            if self.take("L"):
                if k[self.p] in "NA" or k[self.p : self.p + 2] == "QN":
                    return self.statement()
                self._assign()
                self.end()
            elif k[self.p] in "{*":
                while k[self.p] not in ";\n" + END:
                    if k[self.p] == "{":
                        self.balanced()
                    else:
                        self.p += 1
                self.end()
            else:
                self.statement()
        elif c == ";":
            self.p += 1
        elif c == "i" and k[self.p + 1] == ":":
            self.p += 2
            self.statement()
        elif c == "E":
            self.fail("else without if")
        else:
            self.known(self.SIMPLE, self.simple)

    def simple(self):
        self.expr()
        self.end()

    def target(self):
        if self.k[self.p] in "[{":
            self.balanced()
        elif self.k[self.p] in "iQ":
            self.p += 1
        else:
            self.fail("expected a name")

    def variables(self):
        while True:
            self.lines()
            self.target()
            if self.take("="):
                self._assign()
            if not self.take(","):
                break
        self.end()

    def for_head(self):
        k = self.k
        self.need("(")
        if not self.take(";"):
            if self.take("V"):
                self.target()
                if self.take("k"):
                    self.expr()
                    return self.need(")")
                self.p -= 1
                while k[self.p] not in "V(":
                    self.p -= 1
                self.p += 1
                while True:
                    self.target()
                    if self.take("="):
                        self._assign()
                    if not self.take(","):
                        break
            else:
                self.expr()
                if self.take(")"):
                    return
            self.need(";")
        if not self.take(";"):
            self.expr()
            self.need(";")
        if not self.take(")"):
            self.expr()
            self.need(")")


class Go(Parser):
    """A line's end counts as a semicolon behind a token that may end a statement; other line ends are taken out."""

    BINARY = {k: v for k, v in _LEVELS.items() if k not in "=a?"} | {"l": 1}
    PREFIX = frozenset("+-!~^*&l")
    TRAILING = True
    SIMPLE = compiled(r"[^{};\0\n]*[;\n]")

    @staticmethod
    def prepare(kinds: str) -> str:
        kinds = re.sub(r"\n+", "\n", kinds)
        return re.sub(r"(?<![insc)\]}uRJ\n])\n", "", kinds).lstrip("\n") + "\n"

    def __init__(self, kinds, seen):
        super().__init__(kinds, seen)
        self.plain = 0  # above 0 a name before { isn't a literal
        self.started = False

    def ends(self):
        c = self.k[self.p]
        if c in ";\n":
            self.p += 1
        elif c not in "})" or c == END:
            self.fail("expected the end of the statement")

    def run(self):
        k = self.k
        while k[self.p] in ";\n":
            self.p += 1
        if self.p < len(k) - 4 and k[self.p] != "N":
            self.note(Fail(self.p, "expected package"))
        super().run()

    def item(self):
        k = self.k
        c = k[self.p]
        self.plain = 0
        if c in ";\n":
            self.p += 1
        elif c == "N":
            if self.started:
                self.fail("package twice")
            self.started = True
            self.p += 1
            self.need("i")
            self.ends()
        elif c == "M":
            self.p += 1
            if self.take("("):
                while not self.take(")"):
                    if k[self.p] in ";\n":
                        self.p += 1
                        continue
                    self.one_import()
            else:
                self.one_import()
            self.ends()
        elif c == "K":
            self.p += 1
            if k[self.p] == "(":
                self.params()
            self.need("i")
            if k[self.p] == "[":
                self.balanced()
            self.signature()
            if k[self.p] == "{":
                self.block()
            self.ends()
        elif c in "YV":
            self.declare()
        else:
            self.fail("expected a declaration")

    def one_import(self):
        if self.k[self.p] in "i.":
            self.p += 1
        self.need("s")
        self.ends()

    def declare(self):
        k = self.k
        one = self.one_type if k[self.p] == "Y" else self.one_variable
        self.p += 1
        if self.take("("):
            while not self.take(")"):
                if k[self.p] in ";\n":
                    self.p += 1
                    continue
                one()
                self.ends()
        else:
            one()
        self.ends()

    def one_type(self):
        self.need("i")
        if self.k[self.p] == "[" and self.k[self.p + 1] == "i" and self.k[self.p + 2] not in "]":
            self.balanced()
        self.take("=")
        self.type()

    def one_variable(self):
        self.need("i")
        while self.take(","):
            self.need("i")
        if self.k[self.p] not in "=;\n)":
            self.type()
        if self.take("="):
            self.list()

    def type(self):
        k = self.k
        c = k[self.p]
        self.deeper()
        if c in "*le":
            self.p += 1
            self.type()
        elif c == "i":
            self.p += 1
            if self.take("."):
                self.need("i")
            if k[self.p] == "[" and k[self.p + 1] not in "]n":
                self.balanced()
        elif c == "[":
            self.p += 1
            if not self.take("]"):
                if not self.take("e"):
                    self.expr()
                self.need("]")
            self.type()
        elif c == "T":
            self.p += 1
            self.need("[")
            self.type()
            self.need("]")
            self.type()
        elif c == "O":
            self.p += 1
            self.take("l")
            self.type()
        elif c == "K":
            self.p += 1
            self.signature()
        elif c == "(":
            self.p += 1
            self.type()
            self.need(")")
        elif c == "A":
            self.p += 1
            self.need("{")
            while not self.take("}"):
                if k[self.p] in ";\n":
                    self.p += 1
                    continue
                if k[self.p] == "*" or k[self.p] == "i" and k[self.p + 1] in ".;\n}s":
                    self.type()
                else:
                    self.need("i")
                    while self.take(","):
                        self.need("i")
                    self.type()
                self.take("s")
                self.ends()
        elif c == "B":
            self.p += 1
            self.need("{")
            while not self.take("}"):
                if k[self.p] in ";\n":
                    self.p += 1
                    continue
                if k[self.p] == "i" and k[self.p + 1] == "(":
                    self.p += 1
                    self.signature()
                else:
                    self.take("~")
                    self.type()
                    while self.take("|"):
                        self.take("~")
                        self.type()
                self.ends()
        else:
            self.fail("expected a type")
        self.depth -= 1

    def params(self):
        k = self.k
        self.need("(")
        while not self.take(")"):
            if k[self.p] == "i" and k[self.p + 1] in "ie*[TOKABl(":
                self.p += 1
            self.type()
            self.take("\n")
            if not self.take(","):
                self.need(")")
                return

    def signature(self):
        self.params()
        if self.k[self.p] == "(":
            self.params()
        elif self.k[self.p] in "*iTOKAB[l":
            self.type()

    def primary(self):
        k = self.k
        c = k[self.p]
        literal = False
        if c == "i":
            self.p += 1
            literal = not self.plain
        elif c in "nsc":
            self.p += 1
        elif c == "(":
            self.p += 1
            held, self.plain = self.plain, 0
            if k[self.p] in "*" and compiled(r"\*+i(?:\.i)?\)").match(k, self.p):
                self.type()
            else:
                self.expr_or_type()
            self.plain = held
            self.need(")")
        elif c == "K":
            self.p += 1
            self.signature()
            if k[self.p] == "{":
                held, self.plain = self.plain, 0
                self.block()
                self.plain = held
        elif c in "[TAOB":
            self.type()
            literal = True
            if k[self.p] not in "({),":
                self.fail("expected a value")
        else:
            self.fail("expected an expression")
        while True:
            c = k[self.p]
            if c == "(":
                self.p += 1
                held, self.plain = self.plain, 0
                self.arguments()
                self.plain = held
                literal = False
            elif c == "[":
                self.p += 1
                held, self.plain = self.plain, 0
                while k[self.p] != "]":
                    if not self.take(":"):
                        self.expr_or_type()
                        self.take(",")
                self.plain = held
                self.need("]")
            elif c == ".":
                self.p += 1
                if self.take("("):
                    if not self.take("Y"):
                        self.type()
                    self.need(")")
                    literal = False
                else:
                    self.need("i")
            elif c == "{" and literal:
                self.literal()
                literal = False
            else:
                return

    def expr_or_type(self):
        if self.k[self.p] in "TOAB" or self.k[self.p : self.p + 2] == "[]":
            self.type()
            if self.k[self.p] in "{(":
                if self.take("("):
                    self.arguments()
                else:
                    self.literal()
        else:
            self.expr()

    def arguments(self, close=")"):
        while not self.take(close):
            self.expr_or_type()
            self.take("e")
            if not self.take(","):
                self.need(close)
                return

    def literal(self):
        self.need("{")
        self.deeper()
        held, self.plain = self.plain, 0
        while not self.take("}"):
            self.element()
            if self.take(":"):
                self.element()
            if not self.take(","):
                self.need("}")
                break
        self.plain = held
        self.depth -= 1

    def element(self):
        if self.k[self.p] == "{":
            self.literal()
        else:
            self.expr()

    def list(self):
        self.expr()
        while self.take(","):
            self.expr()

    def simple(self):
        """An expression, assignment, send or increment."""
        k = self.k
        self.list()
        c = k[self.p]
        if c in "=aw":
            self.p += 1
            if k[self.p] == "k":
                self.p += 1
                self.expr()
            else:
                self.list()
        elif c == "u":
            self.p += 1

    def head(self, loop: bool):
        k = self.k
        self.plain += 1
        if loop and self.take("k"):
            self.expr()
        else:
            parts = 0
            while k[self.p] != "{":
                if k[self.p] == END:
                    self.fail("expected a block")
                if self.take(";"):
                    parts += 1
                    if parts > 2:
                        self.fail("expected a block")
                    continue
                if k[self.p] == "V":
                    self.fail("expected a condition")
                self.simple()
                if k[self.p] not in ";{":
                    self.fail("expected a block")
        self.plain -= 1

    def statement(self):
        k = self.k
        c = k[self.p]
        if c in ";\n":
            self.p += 1
        elif c == "{":
            self.block()
            self.ends()
        elif c == "I":
            self.p += 1
            if k[self.p] == "{":
                self.fail("expected a condition")
            self.head(False)
            self.block()
            if self.take("E"):
                if k[self.p] == "I":
                    return self.statement()
                self.block()
            self.ends()
        elif c == "F":
            self.p += 1
            self.head(True)
            self.block()
            self.ends()
        elif c == "S":
            self.p += 1
            self.head(False)
            self.need("{")
            while not self.take("}"):
                if self.take("C"):
                    if k[self.p] in "*TOKAB" or k[self.p : self.p + 2] == "[]":
                        self.type()
                        while self.take(","):
                            self.type()
                    else:
                        self.simple()
                    self.need(":")
                elif self.take("L"):
                    self.need(":")
                elif k[self.p] == END:
                    self.fail("switch never closed")
                else:
                    self.statement()
            self.ends()
        elif c == "R":
            self.p += 1
            if k[self.p] not in ";\n}":
                self.known(self.SIMPLE, self.list_end)
            else:
                self.ends()
        elif c == "J":
            self.p += 1
            self.take("i")
            self.ends()
        elif c == "D":
            self.p += 1
            self.known(self.SIMPLE, self.list_end)
        elif c in "YV":
            self.declare()
        elif c == "i" and k[self.p + 1] == ":":
            self.p += 2
        else:
            self.known(self.SIMPLE, self.simple_end)

    def list_end(self):
        self.list()
        self.ends()

    def simple_end(self):
        self.simple()
        self.ends()


_RA = ARGS


class Rust(Parser):
    BINARY = {"=": 0, "a": 0, "y": 1, "o": 2, "r": 3, "5": 4, "6": 4, "<": 4, ">": 4, "|": 5, "^": 5, "&": 5, "7": 6, "+": 7, "-": 7, "*": 8, "9": 8}
    PREFIX = frozenset("-!~*")
    TRAILING = True
    _attr = compiled(r"#[!~]?(?=\[)")
    _generic = compiled(_RA)
    _item = compiled(r"(?:Q(?:\([^()\0]*\))?s?)*(?:[KABNGPTYM]|Q)")
    _vis = compiled(r"(?:Q(?:\((?:k?[iQd]+)+\))?s?)*")

    def __init__(self, kinds, seen):
        super().__init__(kinds, seen)
        self.plain = 0

    def attributes(self):
        while self.k[self.p] == "#":
            if not self.match(self._attr):
                self.fail("expected an attribute")
            self.balanced()

    def item(self):
        k = self.k
        self.plain = 0
        self.attributes()
        if self.p >= len(k) - 4:
            return
        if self.take(";"):
            return
        at = self.p
        self.match(self._vis)
        had = k[at : self.p]
        c = k[self.p]
        if c == "K":
            self.function()
        elif c == "A" and k[self.p + 1] == "i":
            self.p += 2
            self.match(self._generic)
            if k[self.p] == "w":
                self.where()
            if k[self.p] == "{":
                self.fields()
            else:
                if k[self.p] == "(":
                    self.balanced()
                if k[self.p] == "w":
                    self.where()
                self.need(";")
        elif c == "B":
            self.p += 1
            self.need("i")
            self.match(self._generic)
            if k[self.p] == "w":
                self.where()
            self.need("{")
            while not self.take("}"):
                self.attributes()
                self.need("i")
                if k[self.p] == "{":
                    self.fields()
                elif k[self.p] == "(":
                    self.balanced()
                if self.take("="):
                    self.expr()
                if not self.take(","):
                    self.need("}")
                    break
        elif c == "N":
            self.p += 1
            self.need("i")
            if not self.take(";"):
                self.items()
        elif c == "G":
            self.p += 1
            while k[self.p] not in ";" + END:
                if k[self.p] == "{":
                    self.balanced()
                elif k[self.p] in "idQ*k":
                    self.p += 1
                else:
                    self.fail("expected a path")
            self.need(";")
        elif c in "PT":
            self.p += 1
            if c == "T":
                self.need("i")
            self.match(self._generic)
            while k[self.p] not in "{;" + END:
                if k[self.p] in "([":
                    self.balanced()
                elif k[self.p] in "})]":
                    self.fail("expected a block")
                else:
                    self.p += 1
            self.items()
        elif c == "Y":
            self.p += 1
            self.need("i")
            self.match(self._generic)
            if self.take(":"):
                self.bounds()
            if self.take("="):
                self.type()
            self.need(";")
        elif c == "M":
            self.p += 1
            self.need("!") if k[self.p] == "!" else self.need("~")
            self.need("i")
            braces = k[self.p] == "{"
            self.balanced()
            if not braces:
                self.need(";")
        elif "Q" in had and c == "{":  # extern { ... }, unsafe { ... }
            self.items()
        elif "Q" in had and (c == "m" and k[self.p + 1] == "i" or c == "i") and k[self.p + 1 + (c == "m")] == ":":
            self.p += 1 + (c == "m")
            self.need(":")
            self.type()
            if self.take("="):
                self.expr()
            self.need(";")
        elif "Q" in had and c == "i" and k[self.p + 1] == ";":  # extern crate
            self.p += 2
        elif "Q" in had and c in "ik":
            while k[self.p] not in ";" + END and k[self.p] in "ikQ":
                self.p += 1
            self.need(";")
        elif compiled(r"i(?:di)*!").match(k, self.p):
            self.macro()
            self.take(";")
        else:
            self.fail("expected an item")

    def items(self):
        self.need("{")
        self.deeper()
        k = self.k
        while not self.take("}"):
            if k[self.p] == END:
                self.fail("block never closed")
            depth, at = self.depth, self.p
            try:
                self.attributes()
                if k[self.p] != "}":
                    self.item()
            except Fail as e:
                if k[e.at] == END:
                    raise
                self.depth = depth
                self.recover(e)
                if self.p == at:
                    self.p += 1
        self.depth -= 1

    def fields(self):
        self.need("{")
        while not self.take("}"):
            self.attributes()
            self.match(self._vis)
            self.need("i")
            self.need(":")
            self.type()
            if not self.take(","):
                self.need("}")
                return

    def where(self):
        self.need("w")
        while self.k[self.p] not in "{;" + END:
            if self.k[self.p] in "([":
                self.balanced()
            elif self.k[self.p] in ")]}":
                self.fail("expected a bound")
            else:
                self.p += 1

    def bounds(self):
        while True:
            self.take("?")
            if self.k[self.p] == "q":
                self.p += 1
            else:
                self.type()
            if not self.take("+"):
                return

    def type(self):
        k = self.k
        self.deeper()
        c = k[self.p]
        if c in "&r":
            self.p += 1
            self.take("q")
            self.take("m")
            self.type()
        elif c == "*":
            self.p += 1
            if k[self.p] not in "Qm":
                self.fail("expected const or mut")
            self.p += 1
            self.type()
        elif c == "(":
            self.p += 1
            while not self.take(")"):
                self.type()
                if not self.take(","):
                    self.need(")")
                    break
        elif c == "[":
            self.p += 1
            self.type()
            if self.take(";"):
                self.expr()
            self.need("]")
        elif c in "!~":
            self.p += 1
        elif c == "P" or c == "Q" and k[self.p + 1] in "idqP(F":
            self.p += 1
            self.bounds()
        elif c == "F":
            self.p += 1
            self.match(self._generic)
            self.type()
        elif c == "Q" and k[self.p + 1] in "KQs" or c == "K":
            self.match(self._vis)
            self.need("K")
            self.balanced()
            if self.take("z"):
                self.type()
        elif c == "<":
            if not self.match(self._generic):
                self.fail("expected a type")
            self.path()
        elif c in "idQ":
            self.path()
        else:
            self.fail("expected a type")
        self.depth -= 1

    def path(self):
        k = self.k
        self.take("d")
        while True:
            if k[self.p] not in "iQ":
                self.fail("expected a name")
            self.p += 1
            if k[self.p] == "<" and not self.match(self._generic):
                self.fail("type arguments never closed")
            elif k[self.p] == "(" and k[self.p - 1] == "i":
                self.balanced()
                if self.take("z"):
                    self.type()
            if not self.take("d"):
                return
            if k[self.p] == "<" and self.match(self._generic) and not self.take("d"):
                return

    def function(self):
        k = self.k
        self.need("K")
        self.need("i")
        if k[self.p] == "<" and not self.match(self._generic):
            self.fail("type parameters never closed")
        self.need("(")
        while not self.take(")"):
            self.attributes()
            if compiled(r"(?:[&r]q?)?m?i[,)]").match(k, self.p):  # self
                self.p = compiled(r"(?:[&r]q?)?m?i").match(k, self.p).end()
            elif k[self.p] == "y":
                self.p += 1
            else:
                self.pattern(":")
                self.need(":")
                self.type()
            if not self.take(","):
                self.need(")")
                break
        if self.take("z"):
            self.type()
        if k[self.p] == "w":
            self.where()
        if not self.take(";"):
            self.block()

    def pattern(self, stops: str):
        """Up to one of ``stops`` outside brackets; at least one token."""
        k = self.k
        at = self.p
        while k[self.p] not in stops:
            c = k[self.p]
            if c in "([{":
                self.balanced()
            elif c in ")]};" or c == END or c == "\x02":
                self.fail("expected a pattern")
            else:
                self.p += 1
        if self.p == at:
            self.fail("expected a pattern")

    def macro(self):
        k = self.k
        self.match(compiled(r"i(?:di)*"))
        self.p += 1
        self.take("i")
        if k[self.p] not in "([{":
            self.fail("expected a macro's arguments")
        self.balanced()

    def expr(self, least: int = 0):
        k = self.k
        self.deeper()
        c = k[self.p]
        if c == "y":  # ..end
            self.p += 1
            if k[self.p] not in ")]};,{" + END:
                self.expr(2)
            self.depth -= 1
            return
        self.unary()
        while True:
            c = k[self.p]
            if c == "k":
                self.p += 1
                self.type()
                continue
            level = self.BINARY.get(c)
            if level is None or level < least:
                break
            self.p += 1
            if c == "y":
                if k[self.p] not in ")]};,{l" + END:
                    self.expr(2)
            elif c in "=a":
                self.expr(0)
            else:
                if c == ">" and k[self.p] == ">":
                    self.p += 1
                    self.take(">")
                self.expr(level + 1)
        self.depth -= 1

    def unary(self):
        k = self.k
        while True:
            c = k[self.p]
            if c in "-!~*":
                self.p += 1
            elif c in "&r":
                self.p += 1
                if k[self.p] == "i" and k[self.p + 1] in "Qm":  # &raw
                    self.p += 1
                    self.take("Q")
                self.take("m")
            else:
                break
        self.primary()

    def primary(self):
        k = self.k
        c = k[self.p]
        if c in "nsc":
            self.p += 1
        elif c == "i" or c == "d" or c == "Q" and k[self.p + 1] == "d":
            at = self.p
            if not self.match(compiled(rf"d?[iQ](?:d(?:{_RA}|[iQ]))*")):
                self.fail("expected a name")
            if k[self.p] in "!~" and k[self.p + 1] in "([{":
                self.p += 1
                self.balanced()
            elif k[self.p] == "{" and not self.plain and k[at] in "iQ" and compiled(r"\{(?:\}|[in][:,}]|y|#)").match(k, self.p):
                self.struct()
        elif c == "<":
            if not self.match(compiled(rf"{_RA}(?:d(?:{_RA}|[iQ]))+")):
                self.fail("expected a path")
        elif c == "(":
            self.p += 1
            held, self.plain = self.plain, 0
            self.arguments()
            self.plain = held
        elif c == "[":
            self.p += 1
            held, self.plain = self.plain, 0
            if not self.take("]"):
                self.expr()
                if self.take(";"):
                    self.expr()
                    self.need("]")
                elif not self.take("]"):
                    self.need(",")
                    self.arguments("]")
            self.plain = held
        elif c == "{":
            self.block_in()
        elif c == "Q" and k[self.p + 1] in "{Q|oi":
            self.p += 1
            if k[self.p] == "m":
                self.p += 1
            if k[self.p] == "i" and k[self.p + 1] == "!":
                return self.primary()
            return self.primary()
        elif c == "I":
            self.branch()
        elif c == "S":
            self.p += 1
            self.plain += 1
            self.expr()
            self.plain -= 1
            self.arms()
        elif c in "HFD" or c == "q":
            self.loop()
        elif c in "|o":
            self.p += 1
            if c == "|":
                while not self.take("|"):
                    if k[self.p] in "([{":
                        self.balanced()
                    elif k[self.p] in ")]};" + END:
                        self.fail("closure never opened")
                    else:
                        self.p += 1
            if self.take("z"):
                self.type()
            self.expr(0)
            return
        elif c == "R" or c == "J":
            self.p += 1
            self.take("q")
            if c == "R" and k[self.p] not in ";,)}]" + END:
                self.expr(0)
            return
        else:
            self.fail("expected an expression")
        while True:
            c = k[self.p]
            if c == "(":
                self.p += 1
                held, self.plain = self.plain, 0
                self.arguments()
                self.plain = held
            elif c == "[":
                self.p += 1
                held, self.plain = self.plain, 0
                self.expr()
                self.plain = held
                self.need("]")
            elif c == ".":
                self.p += 1
                if k[self.p] not in "inQ":
                    self.fail("expected a member")
                self.p += 1
                if k[self.p] == "d":
                    self.p += 1
                    if not self.match(self._generic):
                        self.fail("expected type arguments")
            elif c == "?":
                self.p += 1
            else:
                return

    def block_in(self):
        held, self.plain = self.plain, 0
        self.block()
        self.plain = held

    def struct(self):
        k = self.k
        self.need("{")
        held, self.plain = self.plain, 0
        while not self.take("}"):
            self.attributes()
            if self.take("y"):
                if k[self.p] != "}":
                    self.expr()
                self.need("}")
                break
            if k[self.p] not in "in":
                self.fail("expected a field")
            self.p += 1
            if self.take(":"):
                self.expr()
            if not self.take(","):
                self.need("}")
                break
        self.plain = held

    def guard(self):
        self.plain += 1
        while True:
            if self.take("V"):
                self.pattern("=")
                self.need("=")
                self.expr(4)
            else:
                self.expr(4) if False else self.expr()
            if self.k[self.p] not in "r":
                break
            self.p += 1
        self.plain -= 1

    def branch(self):
        self.need("I")
        if self.k[self.p] == "{":
            self.fail("expected a condition")
        self.guard()
        self.block_in()
        if self.take("E"):
            if self.k[self.p] == "I":
                self.branch()
            else:
                self.block_in()

    def loop(self):
        k = self.k
        if self.take("q"):
            self.need(":")
        c = k[self.p]
        self.p += 1
        if c == "H":
            self.guard()
        elif c == "F":
            self.pattern("k")
            self.need("k")
            self.plain += 1
            self.expr()
            self.plain -= 1
        elif c != "D":
            self.p -= 1
            if c != "{":
                self.fail("expected a loop")
        self.block_in()

    def arms(self):
        k = self.k
        self.need("{")
        self.deeper()
        held, self.plain = self.plain, 0
        while not self.take("}"):
            self.attributes()
            self.pattern("lI")
            if self.take("I"):
                self.guard_plain()
            self.need("l")
            braced = k[self.p] == "{"
            self.expr()
            if not self.take(",") and k[self.p] != "}" and not (braced and k[self.p - 1] == "}"):
                self.fail("expected ,")
        self.plain = held
        self.depth -= 1

    def guard_plain(self):
        if self.take("V"):
            self.pattern("=")
            self.need("=")
        self.expr()

    def statement(self):
        k = self.k
        self.attributes()
        c = k[self.p]
        if c == "}":
            return
        if c == ";":
            self.p += 1
        elif c == "V":
            self.known(self.SIMPLE, self.let)
        elif c in "KABNGPTYM" and not (c == "A" and k[self.p + 1] != "i") or c == "Q" and self._is_item():
            self.item()
        elif c in "IHFDS{q" or c == "Q" and k[self.p + 1] == "{":
            self.block_like()
        else:
            self.known(self.SIMPLE, self.expression_end)

    def _is_item(self) -> bool:
        m = compiled(r"(?:Q(?:\([^()\0]*\))?s?)+").match(self.k, self.p)
        return self.k[m.end()] in "KABNGPTYM" or self.k[m.end()] in "im" and (self.k[m.end() + 1] == ":" or self.k[m.end()] == "m")

    def block_like(self):
        c = self.k[self.p]
        if c == "I":
            self.branch()
        elif c == "{":
            self.block_in()
        elif c == "Q":
            self.p += 1
            self.block_in()
        elif c == "S":
            self.p += 1
            self.plain += 1
            self.expr()
            self.plain -= 1
            self.arms()
        else:
            self.loop()
        if self.k[self.p] in ".?":  # the block's value goes on
            while self.k[self.p] in ".?":
                if self.take("?"):
                    continue
                self.p += 1
                self.need("i")
                if self.take("("):
                    self.arguments()
            if self.k[self.p] != "}":
                self.need(";")
        else:
            self.take(";")

    def let(self):
        self.need("V")
        self.pattern(":=;")
        if self.take(":"):
            self.type()
        if self.take("="):
            self.expr()
            if self.take("E"):
                self.block_in()
        self.need(";")

    def expression_end(self):
        self.expr()
        if self.k[self.p] == "}":
            return
        if self.k[self.p - 1] == "}" and self.k[self.p] != ";":  # a macro in braces
            return
        self.need(";")
