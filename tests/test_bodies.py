"""Accesses, locks and races from bodies, against a plain computation; inferred edges and flows on small fixtures."""

import re
from collections import defaultdict
from itertools import combinations

import pytest

from tests.conftest import normal
from weftgraph.functions import conditions
from weftgraph.operators import bodies, inference, paths
from weftgraph.queries import bodies as queries

BODIES = [
    ("f", "reactor", "void f(struct s *p) {\n  a_lock(&p->guard);\n  p->n++; p->m = p->k + 1;\n  a_unlock(&p->guard);\n  p->n = 2;\n  if (p->n == 3) return;\n}"),
    ("g", "kthread", "void g(struct s *p) {\n  p->n += 1; a_lock(&p->guard); a_lock(&p->guard); x = p->m; a_unlock(&p->guard); p->k = p->n;\n}"),
    ("h", "", "void h(struct s *q) { b_lock(&q->other); q->n = 1; q->m--; mu.Lock(); q->k; mu.Unlock(); }"),
    ("i", "reactor", "void i(struct s *q) { q->n = 4; }"), ("j", "reactor", "void j() { q->n = 5; r->n; }"), ("j", "reactor", "void j() { q->n = 5; r->n; }"),
    ("k", None, None), (None, "reactor", "p->n = 1;"), ("l", "", ""), ("m", "", "unlock() ->x p-> a_lock() q->deep->n = 1"),
]


def plain_accesses(rows):
    out = []
    for fn, model, body in sorted(set(r for r in rows if r[0] is not None and r[2] is not None), key=str):
        held, seq = set(), 0
        for line in body.split("\n"):
            for t in re.findall(bodies.TOKEN, line):
                seq += 1
                if re.search(bodies.RELEASE, t) or re.search(bodies.ACQUIRE, t):
                    m = re.search(bodies.LOCK_ARGUMENT, t) or re.search(bodies.LOCK_OWNER, t)
                    name = m[1] if m else ""
                    (held.discard if re.search(bodies.RELEASE, t) else held.add)(name)
                else:
                    out.append((fn, model or "", re.search(bodies.FIELD, t)[1], bool(re.search(bodies.WRITE, t)), ",".join(sorted(held))))
    return out


@pytest.fixture(scope="module")
def accesses(spark):
    return bodies.covered_accesses(bodies.body_events(spark.createDataFrame(BODIES, "id string, model string, body string"))).cache()


def test_accesses_with_locks(accesses):
    got = [(r.fn, r.model, r.res, r.is_write, r.locks) for r in accesses.orderBy("fn", "seq").collect()]
    assert sorted(got) == sorted(plain_accesses(BODIES))
    assert ("f", "reactor", "n", True, "guard") in got and ("f", "reactor", "n", True, "") in got and ("f", "reactor", "n", False, "") in got


def test_races_stand_for_all_pairs(accesses):
    one = sorted({(a[2], (a[3], a[1], a[4]), a[0]) for a in plain_accesses(BODIES)})
    want, members = defaultdict(set), set()
    for (r, k, f), (s, m, g) in combinations(one, 2):
        (k, f), (m, g) = sorted([(k, f), (m, g)])
        if r == s and f != g and (k[0] or m[0]) and not (k[1] == m[1] != "") and not set(filter(None, k[2].split(","))) & set(filter(None, m[2].split(","))):
            want[r, k, m].add(frozenset((f, g)) if k == m else (f, g))
            members |= {(r, *k, f), (r, *m, g)}
    races = bodies.race_classes(accesses)
    got = {(r.res, (r.a_writes, r.a_model, r.a_locks), (r.b_writes, r.b_model, r.b_locks)): r.n_pairs for r in races.collect()}
    assert got == {k: len(v) for k, v in want.items()} and got
    listed = {(r.res, r.is_write, r.model, r.locks, r.fn) for r in bodies.race_members(accesses, races).collect()}
    assert listed >= members


@pytest.mark.parametrize("clashing", [False, True])
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_messy_functions_as_sql_says(spark, make_store, oracle, name, clashing):
    rows = [{"id": i, "name": i, "domain": "repo.a", "source_file": "repo/a.c", "body_text_compressed": b, "extra_json": None if m is None else '{"thread_model": "%s"}' % m, "signature": "void f(struct s *p, int n)", "labels": ["API_entry"] if i == "f" else None} for i, m, b in BODIES]
    rows += [{"id": "u", "name": "__low", "domain": "repo.b", "source_file": "repo/b.c"}, {"id": "v", "name": "Low", "domain": "repo.c", "source_file": ""}, {"id": "w__cond_1", "name": "w"}, {"id": "w__cond_1_else", "name": "w"}, {"id": "w", "name": None, "body_text_compressed": "f(1); w(2); Low(3)", "source_file": "repo/a.c"}]
    rows += [{"id": "x", "name": "x", "domain": "repo.a", "source_file": "repo/x.c", "body_text_compressed": "f(p, 3); y(0, p + 1); z(g(p));", "signature": "int x(char *p)", "labels": ["API_entry"]}, {"id": "y", "name": "y", "domain": "repo.b", "source_file": "repo/y.c", "signature": "int y(int a, int b)", "body_text_compressed": "y(b, a);"}]
    root = make_store(clashing, functions=rows)
    got = normal(queries.QUERIES[name](spark, root).collect())
    assert got == normal(oracle(root, queries.SQL[name])) and got


def test_the_best_resolution_wins(spark):
    nodes = spark.createDataFrame([("1", "f", "a.c", "d"), ("2", "f", "b.c", "d"), ("3", "g", "z.c", "e"), ("4", "h", "y.c", "d"), ("5", "i", "y.c", "e"), ("6", "i", "y.c", "q"), ("7", None, None, None)], "id string, name string, source_file string, domain string")
    calls = spark.createDataFrame([("s", "b.c", "d", c) for c in ("f", "g", "h", "i", "m.g", "none", None)], "src string, file string, domain string, callee string")
    imports = spark.createDataFrame([("b.c", "g", "9")], "file string, name string, id string")
    got = {r.callee: (r.dst, r.confidence) for r in inference.resolve_callees(calls, nodes, imports).collect()}
    assert got == {"f": ("2", 0.95), "g": ("9", 0.85), "h": ("4", 0.75), "i": ("5", 0.30), "m.g": ("3", 0.60)}


def test_models_are_handed_down_to_what_owns_none(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "c"), ("c", "d"), ("d", "e"), (None, "e")], "src string, dst string")
    entries = spark.createDataFrame([("a", "thread", 1), ("x", "irq", 2)], "id string, model string, priority int")
    got = {r.id: r.model for r in paths.propagate_models(spark, edges, entries, spark.createDataFrame([("a",), ("x",), ("d",)], "id string")).collect()}
    assert got == {"a": "thread", "x": "irq", "b": "thread", "c": "irq"}


def test_feasible_by_the_last_of_many_combinations():
    many = [f"a{k} == 1 || a{k} == 2" for k in range(12)] + [f"a{k} != 1" for k in range(12)]
    assert conditions.feasible(many) == (True, [])
    assert conditions.feasible([*many, "a3 < 2"])[0] is False
    assert sum(1 for _ in conditions.truth_table(" && ".join(f"M{k}" for k in range(13)))) == 2**13
