"""Conditions of paths: parsing, a three-valued evaluation over macros, and a check for contradictions.

The language is C's preprocessor's: ! && || == != < > <= >= defined(X), names and whole numbers.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import product

_TOKEN = re.compile(r"\s*(defined\b|&&|\|\||[!=<>]=|[!<>()]|-?\d+|[A-Za-z_][\w.>\-]*(?<![\-]))")


class ConditionError(ValueError):
    pass


def parse(text: str) -> tuple:
    """('or', a, b), ('and', a, b), ('not', a), ('cmp', op, x, y), ('defined', x), ('name', x) or ('num', n)."""
    tokens, pos = [], 0
    text = text.strip()
    while pos < len(text):
        m = _TOKEN.match(text, pos)
        if not m:
            raise ConditionError(text)
        tokens.append(m[1])
        pos = m.end()
    at = 0

    def peek():
        return tokens[at] if at < len(tokens) else None

    def take(*options):
        nonlocal at
        if peek() in options:
            at += 1
            return tokens[at - 1]
        return None

    def either():
        left = both()
        while take("||"):
            left = ("or", left, both())
        return left

    def both():
        left = compare()
        while take("&&"):
            left = ("and", left, compare())
        return left

    def compare():
        left = unary()
        op = take("==", "!=", "<", ">", "<=", ">=")
        return ("cmp", op, left, unary()) if op else left

    def unary():
        nonlocal at
        if take("!"):
            return ("not", unary())
        if take("("):
            e = either()
            if not take(")"):
                raise ConditionError(text)
            return e
        if take("defined"):
            bracket = take("(")
            name = peek()
            at += 1
            if name is None or bracket and not take(")"):
                raise ConditionError(text)
            return ("defined", name)
        t = peek()
        if t is None or t in ("&&", "||", ")", "==", "!="):
            raise ConditionError(text)
        at += 1
        return ("num", int(t)) if re.fullmatch(r"-?\d+", t) else ("name", t)

    out = either()
    if at < len(tokens):
        raise ConditionError(text)
    return out


def evaluate(e: tuple, macros: dict[str, object]) -> bool | None:
    """True, False, or None if it depends on names that aren't bound. A name bound to None is certainly undefined."""
    kind = e[0]
    if kind in ("or", "and"):
        a, b = evaluate(e[1], macros), evaluate(e[2], macros)
        stop = kind == "or"
        if a is stop or b is stop:
            return stop
        return None if a is None or b is None else not stop
    if kind == "not":
        a = evaluate(e[1], macros)
        return None if a is None else not a
    if kind == "defined":
        return macros[e[1]] is not None if e[1] in macros else None
    if kind == "cmp":
        a, b = _value(e[2], macros), _value(e[3], macros)
        if a is None or b is None:
            return None
        return {"==": a == b, "!=": a != b, "<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b}[e[1]]
    v = _value(e, macros)
    return None if v is None else v != 0


def _value(e: tuple, macros: dict[str, object]) -> int | None:
    if e[0] == "num":
        return e[1]
    if e[0] == "name":
        if e[1] not in macros:
            return None
        v = macros[e[1]]
        try:
            return int(v) if v is not None else 0
        except (TypeError, ValueError):
            return None
    r = evaluate(e, macros)
    return None if r is None else int(r)


def names(e: tuple) -> set[str]:
    if e[0] in ("name", "defined"):
        return {e[1]}
    return set().union(*(names(x) for x in e[1:] if isinstance(x, tuple))) if e[0] != "num" else set()


def truth_table(text: str) -> Iterator[tuple[dict[str, bool], bool | None]]:
    """The value for every setting of the macros, one after the other: twice as many for each macro."""
    e = parse(text)
    free = sorted(names(e))
    return ((dict(zip(free, bits)), evaluate(e, {k: 1 if b else None for k, b in zip(free, bits)})) for bits in product((False, True), repeat=len(free)))


def feasible(conditions: list[str]) -> tuple[bool, list[str]]:
    """Whether all conditions can hold at once, by ranges and known values, and the names that contradict if the first
    alternative of each is taken. A condition that can't be parsed limits nothing. Alternatives are searched depth first and
    left as soon as what they say about a name can't hold; none is left out."""
    goals: list[tuple[tuple, bool]] = []
    for c in conditions:
        try:
            goals.append((parse(c), True))
        except ConditionError:
            continue
    if _search(goals[::-1], []):
        return True, []
    first = [f for e, _ in goals for f in next(iter(_alternatives(e)), [])]
    return False, _contradictions(first)


def _search(goals: list[tuple[tuple, bool]], facts: list[tuple[str, str, int]]) -> bool:
    """Whether the goals, the last one first, can hold beside the facts."""
    goals, facts = list(goals), list(facts)
    while goals:
        e, positive = goals.pop()
        if e[0] == "not":
            goals.append((e[1], not positive))
        elif e[0] in ("or", "and"):
            if (e[0] == "or") == positive:
                return any(_search([*goals, (x, positive)], facts) for x in e[1:])
            goals += [(e[2], positive), (e[1], positive)]
        else:
            found = _alternatives(e, positive)
            if not found:
                return False
            for name, op, n in found[0]:
                facts.append((name, op, n))
                if _contradictions([f for f in facts if f[0] == name]):
                    return False
    return True


_FLIP = {"==": "!=", "!=": "==", "<": ">=", ">=": "<", ">": "<=", "<=": ">"}


def _alternatives(e: tuple, positive: bool = True) -> list[list[tuple[str, str, int]]]:
    """Disjunctive form: alternatives of facts (name, operator, number)."""
    if e[0] == "not":
        return _alternatives(e[1], not positive)
    if e[0] in ("or", "and"):
        a, b = _alternatives(e[1], positive), _alternatives(e[2], positive)
        if (e[0] == "or") == positive:
            return a + b
        return [x + y for x in a for y in b]
    if e[0] == "cmp" and e[2][0] == "name" and e[3][0] == "num":
        return [[(e[2][1], e[1] if positive else _FLIP[e[1]], e[3][1])]]
    if e[0] == "cmp" and e[2][0] == "num" and e[3][0] == "name":
        op = {"<": ">", ">": "<", "<=": ">=", ">=": "<="}.get(e[1], e[1])
        return [[(e[3][1], op if positive else _FLIP[op], e[2][1])]]
    if e[0] == "cmp" and e[2][0] == "name" and e[3] == ("name", "NULL"):
        return [[(e[2][1], e[1] if positive else _FLIP[e[1]], 0)]]
    if e[0] == "name":
        return [[(e[1], "!=" if positive else "==", 0)]]
    if e[0] == "defined":
        return [[(f"defined {e[1]}", "!=" if positive else "==", 0)]]
    if e[0] == "num":
        return [[]] if bool(e[1]) == positive else []
    return [[]]


def _contradictions(facts: list[tuple[str, str, int]]) -> list[str]:
    low: dict[str, float] = {}
    high: dict[str, float] = {}
    never: dict[str, set[int]] = {}
    for name, op, n in facts:
        lo, hi = low.get(name, -float("inf")), high.get(name, float("inf"))
        if op == "!=":
            never.setdefault(name, set()).add(n)
        elif op == "==":
            lo, hi = max(lo, n), min(hi, n)
        elif op in (">", ">="):
            lo = max(lo, n + (op == ">"))
        else:
            hi = min(hi, n - (op == "<"))
        low[name], high[name] = lo, hi
    return sorted(k for k in low if low[k] > high[k] or low[k] == high[k] and int(low[k]) in never.get(k, set()))


def hold_regions(events: list[tuple[str, str]]) -> dict:
    """Acquire and release events of a path, in order: (kind, lock). Releases close the innermost open acquire of the lock.
    Returns regions, what stays held, and releases that had nothing to release."""
    open_: list[tuple[int, str]] = []
    regions, stray = [], []
    for i, (kind, lock) in enumerate(events):
        if kind == "acquire":
            open_.append((i, lock))
        else:
            at = next((k for k in range(len(open_) - 1, -1, -1) if open_[k][1] == lock), None)
            if at is None:
                stray.append(lock)
            else:
                regions.append((lock, open_.pop(at)[0], i))
    return {"regions": sorted(regions), "held": [k for _, k in open_], "stray": stray, "balanced": not open_ and not stray}
