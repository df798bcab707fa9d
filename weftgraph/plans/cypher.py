"""A subset of Cypher, compiled to DataFrame plans.

    query := MATCH path (',' path)* [WHERE expr] RETURN items [GROUP BY attr, ...] [HAVING expr] [ORDER BY attr [ASC|DESC]] [LIMIT n]
    path  := node (rel node)*          node := '(' [var] [':' Label] ['{' key '=' literal, ... '}'] ')'
    rel   := '-[' [var] [':' TYPE] ['*' [n ['..' [m]]]] ']->' | '<-[' ... ']-'

A variable-length relation yields one row for each simple path; without an upper bound it ends at 5 hops. Relations
without a type match every type. ``<-`` has its usual meaning. A comparison with null matches nothing but ``= null``.
LIKE is case-sensitive and ``=~`` matches the whole text. SUM, AVG, MIN and MAX take numbers, texts that are numbers
count, and give 0 over nothing. Nulls come last ascending and first descending; ties are broken by the other columns.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.operators.traverse import OPEN_HOPS

_TOKEN = re.compile(r"\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<num>-?\d+(?:\.\d+)?(?!\w))|(?P<op><-|->|<=|>=|!=|<>|=~|\.\.|[-=<>(){}\[\],.:*|])|(?P<word>[A-Za-z_]\w*))")
AGGREGATES = ("COUNT", "SUM", "AVG", "MIN", "MAX")


class CypherError(ValueError):
    pass


@dataclass
class Node:
    var: str
    label: str | None = None
    props: dict = field(default_factory=dict)


@dataclass
class Rel:
    type: str | None = None
    reverse: bool = False
    least: int = 1
    most: int = 1
    varlen: bool = False


@dataclass
class Query:
    paths: list[list]
    where: tuple | None = None
    items: list[tuple] = field(default_factory=list)  # (expression, alias); expression: ('attr', a), ('agg', f, a) or ('*',)
    group: list[str] = field(default_factory=list)
    having: tuple | None = None
    order: tuple[str, bool] | None = None
    limit: int | None = None


def _lex(text: str) -> list[tuple[str, object]]:
    out, pos = [], 0
    text = text.strip()
    while pos < len(text):
        m = _TOKEN.match(text, pos)
        if not m:
            raise CypherError(f"unexpected character at {pos}: {text[pos:pos + 10]!r}")
        kind = m.lastgroup
        v: object = m[kind]
        if kind == "str":
            v = re.sub(r"\\(.)", r"\1", m[kind][1:-1])
        elif kind == "num":
            v = float(m[kind]) if "." in m[kind] else int(m[kind])
        out.append((kind, v))
        pos = m.end()
    return out


class _Parser:
    def __init__(self, text: str):
        self.toks = _lex(text)
        self.p = 0
        self.unnamed = 0

    def peek(self, *values: str) -> bool:
        if self.p >= len(self.toks):
            return False
        kind, v = self.toks[self.p]
        return kind in ("op", "word") and str(v).upper() in values

    def take(self, *values: str) -> bool:
        if self.peek(*values):
            self.p += 1
            return True
        return False

    def need(self, value: str) -> None:
        if not self.take(value):
            raise CypherError(f"expected {value} at token {self.p}")

    def word(self) -> str:
        if self.p < len(self.toks) and self.toks[self.p][0] == "word":
            self.p += 1
            return str(self.toks[self.p - 1][1])
        raise CypherError(f"expected a name at token {self.p}")

    def number(self) -> int:
        if self.p < len(self.toks) and self.toks[self.p][0] == "num":
            self.p += 1
            return int(self.toks[self.p - 1][1])
        raise CypherError(f"expected a number at token {self.p}")

    def literal(self):
        if self.p >= len(self.toks):
            raise CypherError("unexpected end")
        kind, v = self.toks[self.p]
        self.p += 1
        if kind in ("str", "num"):
            return v
        if kind == "word" and str(v).upper() in ("TRUE", "FALSE", "NULL"):
            return {"TRUE": True, "FALSE": False, "NULL": None}[str(v).upper()]
        raise CypherError(f"expected a literal, got {v!r}")

    def query(self) -> Query:
        self.need("MATCH")
        q = Query([self.path()])
        while self.take(","):
            q.paths.append(self.path())
        if self.take("WHERE"):
            q.where = self.either()
        self.need("RETURN")
        q.items.append(self.item())
        while self.take(","):
            q.items.append(self.item())
        if self.take("GROUP"):
            self.need("BY")
            q.group.append(self.attr())
            while self.take(","):
                q.group.append(self.attr())
        if self.take("HAVING"):
            q.having = self.either()
        if self.take("ORDER"):
            self.need("BY")
            key = self.attr()
            q.order = (key, not self.take("DESC"))
            self.take("ASC")
        if self.take("LIMIT"):
            q.limit = self.number()
        if self.p < len(self.toks):
            raise CypherError(f"unexpected {self.toks[self.p][1]!r}")
        return q

    def path(self) -> list:
        out: list = [self.node()]
        while self.peek("-", "<-"):
            out += [self.rel(), self.node()]
        return out

    def node(self) -> Node:
        self.need("(")
        self.unnamed += 1
        n = Node(f"_n{self.unnamed}")
        if self.p < len(self.toks) and self.toks[self.p][0] == "word":
            n.var = self.word()
        if self.take(":"):
            n.label = self.word()
        if self.take("{"):
            while True:
                key = self.word()
                self.take("=") or self.need(":")
                n.props[key] = self.literal()
                if not self.take(","):
                    break
            self.need("}")
        self.need(")")
        return n

    def rel(self) -> Rel:
        r = Rel(reverse=self.take("<-"))
        if not r.reverse:
            self.need("-")
        self.need("[")
        if self.p < len(self.toks) and self.toks[self.p][0] == "word":
            self.word()
        if self.take(":"):
            r.type = self.word()
        if self.take("*"):
            r.varlen = True
            if self.p < len(self.toks) and self.toks[self.p][0] == "num":
                r.least = r.most = self.number()
                if self.take(".."):
                    r.most = self.number() if self.p < len(self.toks) and self.toks[self.p][0] == "num" else OPEN_HOPS
            elif self.take(".."):
                r.most = self.number() if self.p < len(self.toks) and self.toks[self.p][0] == "num" else OPEN_HOPS
            if r.most < r.least or r.least < 1:
                raise CypherError("hops must be a range from at least 1")
        self.need("]")
        if r.reverse:
            self.take("-")
        else:
            self.need("->")
        return r

    def attr(self) -> str:
        parts = [self.word()]
        while self.take("."):
            parts.append(self.word())
        return ".".join(parts)

    def item(self) -> tuple:
        if self.take("*"):
            return ("*",), "*"
        if self.p + 1 < len(self.toks) and str(self.toks[self.p][1]).upper() in AGGREGATES and self.toks[self.p + 1][1] == "(":
            f = self.word().upper()
            self.need("(")
            arg = "*" if self.take("*") else self.attr()
            self.need(")")
            expr, name = ("agg", f, arg), f"{f}({arg})".lower()
        else:
            a = self.attr()
            expr, name = ("attr", a), a
        if self.take("AS"):
            name = self.word()
        return expr, name

    def either(self) -> tuple:
        left = self.both()
        while self.take("OR"):
            left = ("or", left, self.both())
        return left

    def both(self) -> tuple:
        left = self.one()
        while self.take("AND"):
            left = ("and", left, self.one())
        return left

    def one(self) -> tuple:
        if self.take("NOT"):
            return ("not", self.one())
        if self.peek("(") :
            self.need("(")
            e = self.either()
            self.need(")")
            return e
        if self.peek("CONFIG"):
            self.word()
            self.need("(")
            var = self.attr()
            self.need(",")
            pred = self.literal()
            self.need(")")
            return ("config", var, pred)
        left = self.operand()
        for op in ("=", "!=", "<>", "<", ">", "<=", ">=", "=~"):
            if self.take(op):
                return ("cmp", "!=" if op == "<>" else op, left, self.operand())
        if self.take("LIKE"):
            return ("like", left, self.literal())
        if self.take("IN"):
            if self.take("["):
                values = [self.literal()]
                while self.take(","):
                    values.append(self.literal())
                self.need("]")
                return ("in", left, values)
            return ("member", left, self.operand())
        return ("truth", left)

    def operand(self) -> tuple:
        if self.p < len(self.toks) and self.toks[self.p][0] == "word" and str(self.toks[self.p][1]).upper() not in ("TRUE", "FALSE", "NULL"):
            return ("attr", self.attr())
        return ("lit", self.literal())


def parse(text: str) -> Query:
    return _Parser(text).query()


class Cypher:
    """nodes: id and any attributes, labels among them; edges: src, dst, relation. ``config``: id, predicate (for CONFIG)."""

    def __init__(self, spark: SparkSession, nodes: DataFrame, edges: DataFrame, config: DataFrame | None = None):
        self.spark, self.nodes, self.edges, self.config = spark, nodes, edges, config

    def run(self, text: str) -> DataFrame:
        q = parse(text)
        rows = None
        names: dict[str, str] = {}
        for path in q.paths:
            part = self.match(path, q)
            if rows is None:
                rows = part
                names = {n.var: n.var for n in path[::2]}
            else:  # patterns meet in the variables that they share
                shared = [n.var for n in path[::2] if n.var in names]
                if not shared:
                    raise CypherError("patterns must share a variable")
                keys = [f"{v}.id" for v in shared]
                keep = [c for c in part.columns if c.split(".")[0] not in shared or c in keys]
                rows = rows.join(part.select([F.col(f"`{c}`") for c in keep]), keys)
                names.update({n.var: n.var for n in path[::2]})
        if q.where is not None:
            rows = rows.where(self.truth(q.where, rows))
        return self.project(rows, q)

    # matching

    def node_rows(self, n: Node) -> DataFrame:
        rows = self.nodes
        if n.label and n.label != "Function":
            rows = rows.where(F.array_contains("labels", n.label) if "labels" in rows.columns else F.lit(False))
        for k, v in n.props.items():
            rows = rows.where(F.col(k).eqNullSafe(F.lit(v)) if k in rows.columns else F.lit(v is None))
        return rows.select([F.col(c).alias(f"{n.var}.{c}") for c in rows.columns])

    def match(self, path: list, q: Query) -> DataFrame:
        first = path[0]
        rows = self.node_rows(first)
        seen = {first.var}
        at = first
        for rel, node in zip(path[1::2], path[2::2]):
            e = self.edges.where(F.coalesce("relation", F.lit("INVOKES")) == rel.type) if rel.type else self.edges
            e = e.select("src", "dst").where("src is not null and dst is not null").distinct()
            if rel.reverse:
                e = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
            here = F.col(f"`{at.var}.id`")
            if rel.varlen:
                from weftgraph.operators.traverse import simple_paths

                starts = rows.select(here.alias("id")).distinct()
                ends = self.node_rows(node).select(F.col(f"`{node.var}.id`").alias("id")).distinct() if node.label or node.props else None
                found = simple_paths(self.spark, e, starts, rel.most, rel.least, ends)
                e = found.select(F.col("start").alias("src"), F.col("id").alias("dst"))
            if node.var in seen:
                rows = rows.join(e, (here == e.src) & (F.col(f"`{node.var}.id`") == e.dst)).drop("src", "dst")
            else:
                target = self.node_rows(node)
                rows = rows.join(e, here == e.src).join(target, F.col("dst") == F.col(f"`{node.var}.id`")).drop("src", "dst")
                seen.add(node.var)
            at = node
        return rows

    # expressions

    def column(self, attr: str, rows: DataFrame) -> Column:
        if attr in rows.columns:
            return F.col(f"`{attr}`")
        if "." not in attr and f"{attr}.id" in rows.columns:
            return F.col(f"`{attr}.id`")
        return F.lit(None)  # an attribute that no node has

    def value(self, e: tuple, rows: DataFrame) -> Column:
        return F.lit(e[1]) if e[0] == "lit" else self.column(e[1], rows)

    def kind(self, e: tuple, rows: DataFrame) -> str:
        return rows.select(self.value(e, rows).alias("x")).dtypes[0][1]

    def truth(self, e: tuple, rows: DataFrame) -> Column:
        op = e[0]
        if op == "or":
            return self.truth(e[1], rows) | self.truth(e[2], rows)
        if op == "and":
            return self.truth(e[1], rows) & self.truth(e[2], rows)
        if op == "not":
            return ~F.coalesce(self.truth(e[1], rows), F.lit(False))
        if op == "cmp":
            a, b = self.value(e[2], rows), self.value(e[3], rows)
            return {
                "=": lambda: a.eqNullSafe(b), "!=": lambda: ~a.eqNullSafe(b), "<": lambda: a < b, ">": lambda: a > b, "<=": lambda: a <= b, ">=": lambda: a >= b,
                "=~": lambda: a.rlike(f"^(?:{e[3][1]})$"),
            }[e[1]]()
        if op == "like":
            return self.value(e[1], rows).like(str(e[2])) if self.kind(e[1], rows) == "string" else F.lit(False)
        if op == "in":
            given = [v for v in e[2] if v is not None]
            a = self.value(e[1], rows)
            hit = a.isin(*given) if given else F.lit(False)
            return F.coalesce(hit, F.lit(None in e[2]))
        if op == "member":
            return F.coalesce(F.array_contains(self.value(e[2], rows), self.value(e[1], rows)), F.lit(False))
        if op == "config":
            if self.config is None:
                return F.lit(False)
            # equal to the predicate, or part of it without NOT directly before
            p = re.escape(str(e[2]))
            hits = self.config.where(F.col("predicate").rlike(rf"(?<!NOT ){p}")).select("id").distinct()
            return self.column(e[1], rows).isin(hits)
        kind = self.kind(e[1], rows)
        v = self.value(e[1], rows)
        filled = v if kind == "boolean" else F.length(v) > 0 if kind == "string" else F.size(v) > 0 if kind.startswith("array") else v != 0 if kind != "void" else F.lit(False)
        return F.coalesce(filled, F.lit(False))

    # results

    def project(self, rows: DataFrame, q: Query) -> DataFrame:
        items = []
        for expr, name in q.items:
            if expr[0] == "*":
                items += [(("attr", c), c) for c in rows.columns if not c.startswith("_n")]
            else:
                items.append((expr, name))
        aggregated = q.group or any(e[0] == "agg" for e, _ in items)
        if aggregated:
            aggs = []
            for e, name in items:
                if e[0] == "agg":
                    aggs.append(self.aggregate(e[1], e[2], rows).alias(name))
                elif e[1] not in q.group:
                    aggs.append(F.min(self.column(e[1], rows)).alias(name))  # the reference takes any row's; the least is one of them
            keys = [self.column(g, rows).alias(f"_g{k}") for k, g in enumerate(q.group)]
            out = rows.groupBy(*keys).agg(*(aggs or [F.count("*").alias("_n")]))
            names = []
            for e, name in items:
                names.append(F.col(f"_g{q.group.index(e[1])}").alias(name) if e[0] == "attr" and e[1] in q.group else F.col(f"`{name}`"))
            out = out.select(*names)
            if q.having is not None and q.group:
                out = out.where(self.truth(q.having, out))
        else:
            extra = []
            if q.order and q.order[0] not in [n for _, n in items]:
                extra = [self.column(q.order[0], rows).alias("_order")]
            out = rows.select(*[self.column(e[1], rows).alias(name) for e, name in items], *extra)
        if q.order:
            key = F.col("_order") if "_order" in out.columns else F.col(f"`{q.order[0]}`")
            rest = [F.col(f"`{c}`") for c in out.columns if c not in ("_order", q.order[0]) and not dict(out.dtypes)[c].startswith("map")]
            out = out.orderBy(key.asc_nulls_last() if q.order[1] else key.desc_nulls_first(), *rest)
        elif q.limit is not None:
            out = out.orderBy(*[F.col(f"`{c}`") for c in out.columns])
        if q.limit is not None:
            out = out.limit(q.limit)
        return out.drop("_order")

    def aggregate(self, f: str, attr: str, rows: DataFrame) -> Column:
        if f == "COUNT":
            return F.count("*") if attr == "*" else F.count(self.column(attr, rows))
        x = self.column(attr, rows).cast("string").try_cast("double")
        return F.coalesce({"SUM": F.sum, "AVG": F.avg, "MIN": F.min, "MAX": F.max}[f](x), F.lit(0.0))
