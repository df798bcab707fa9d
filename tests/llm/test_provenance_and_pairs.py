import pytest

from weftgraph.llm.docpairs import extract, own_words
from weftgraph.llm.provenance import evidence
from weftgraph.llm.queries import p5_found, p5_labels, p7_found, p7_pairs

CODE = "int add(int a, int b)\n{\n    if (a > b)\n        return a - b;\n    return a + b;\n}\n"


def found(spark, root):
    return sorted(r[0] for r in p5_found(spark, root).collect())


@pytest.mark.parametrize("clashing", [False, True])
def test_files_nobody_wrote(spark, make_store, clashing):
    texts = {
        1: ("r/src/a.c", CODE), 2: ("r/src/b.c", "// Code generated by gen 1.2. DO NOT EDIT.\n" + CODE), 3: ("r/src/c.c", "// Checks that files marked DO NOT EDIT are skipped.\n" + CODE),
        4: ("r/third_party/lib/d.c", CODE), 5: ("r/shop/vendor/vendor_e.c", CODE), 6: ("r/src/f.c", "const unsigned char f[] = {\n" + "  0x12, 0x34, 0x56, 0x78, 0x9a, 0xbc, 0xde, 0xf0,\n" * 60 + "};\n"),
        7: ("r/js/g.min.js", "var a=1;" + "function b(c,d){return c.e?d(1):c+d};" * 60), 8: ("r/src/h.c", CODE * 3 + "static const int t[] = { 1, 2, 3, 4, 5, 6, 7, 8, 9 };\n"), 9: ("r/src/i.c", "/* Imported from upstream zlib 1.2; local changes: none */\n" + CODE),
        10: ("r/sysroot/usr/include/j.h", "#ifndef _J_H\n#define _J_H 1\n" + CODE + "#endif\n"), 11: ("r/src/k.c", "// Copyright the r authors.\n" + CODE), 12: ("r/src/l.c", ""), 13: ("r/src/m.c", None),
        14: ("r/src/n.c", "\n".join(f"int get_field{i}(void) {{ return f({i}); }}" for i in range(12))),
    }
    files = [{"id": i, "path": p, "scan_run": 1, "delivery_id": i} for i, (p, _) in texts.items()] + [{"id": 1, "path": "r/src/a.c", "scan_run": 1, "delivery_id": 1}, {"id": 99, "path": None}, {"id": None, "path": "x"}]
    docs = [{"doc_id": i, "file_id": i, "text": t} for i, (_, t) in texts.items()] + [{"doc_id": 50, "text": "issue"}, {"doc_id": 51, "file_id": 77, "text": CODE}]
    assert found(spark, make_store(clashing, cgdb_files=files, documents=docs)) == [2, 4, 6, 7, 9, 10, 14]


def test_beliefs_match_enumeration(spark, make_store):
    """The two sweeps give the exact marginals of a small tree."""
    from itertools import product

    import numpy as np

    from weftgraph.llm import sources
    from weftgraph.llm.provenance import LABELS
    from weftgraph.sources.tables import table
    from weftgraph.workspace import Workspace

    paths = {1: "r/a/x.c", 2: "r/a/y_pb2.py", 3: "r/gen/z.c"}
    root = make_store(cgdb_files=[{"id": i, "path": p, "scan_run": 1, "delivery_id": i} for i, p in paths.items()], documents=[{"doc_id": i, "file_id": i, "text": CODE} for i in paths])
    ev = sources.text_evidence(table(spark, root, "documents"))
    got = {r.file_id: (r.label, r.confidence) for r in sources.infer_labels(spark, Workspace(spark, "x"), ev, table(spark, root, "cgdb_files")).collect()}
    known = sources.latest_files(table(spark, root, "cgdb_files")).join(ev, "file_id", "left")
    e = {r[0]: np.array(r[1:]) for r in known.select("file_id", *sources.file_potentials(known)).collect()}
    f = {r[0]: np.array(r[1:]) for r in spark.createDataFrame([("r", True), ("a", False), ("gen", False)], "name string, nested boolean").select("name", *sources.folder_potentials()).collect()}
    total = np.zeros((3, 5))
    for r, a, g in product(range(5), repeat=3):
        base = f["r"][r] + f["a"][a] + f["gen"][g] + sources._child(LABELS[r], LABELS[a]) + sources._child(LABELS[r], LABELS[g])
        for x in product(range(5), repeat=3):
            s = base + sum(e[i + 1][x[i]] + sources._file(LABELS[(a, a, g)[i]], LABELS[x[i]]) for i in range(3))
            for i in range(3):
                total[i, x[i]] += np.exp(s)
    for i in range(3):
        p = total[i] / total[i].sum()
        assert got[i + 1][0] == LABELS[p.argmax()] and abs(got[i + 1][1] - p.max()) < 1e-9


def test_evidence_of_odd_texts():
    for t in ("", " ", "x" * 100000, "\x00", "/* open", "{" * 10000):
        assert evidence(t).chars == len(t)
    assert evidence("// written by hand, unlike the generated by x 1.0 tables\n").about


@pytest.mark.parametrize(
    "path,name,text,want",
    [
        ("a.c", "f", "/** Copies the page while it is locked. */\nint f(int a) { return a; }", "Copies the page while it is locked."),
        ("a.c", "f", "/** Copies the page. */\nint f(int a);", None),
        ("a.c", "f", "// Copies the page in time.\n#define X 1\n\nint f(void) { return 1; }", ""),
        ("a.c", "f", "// Copies the page in time.\n\nint f(void) { return 1; }", ""),
        ("a.c", "f", "int f(void) {\n  // copies the page in time\n  return 1; }", ""),
        ("a.c", "f", "// TODO: document\nint f(void) { return 1; }", ""),
        ("a.c", "f", "// SPDX-License-Identifier: MIT\nint f(void) { return 1; }", ""),
        ("a.c", "f", "// NOLINTNEXTLINE(x)\nint f(void) { return 1; }", ""),
        ("a.c", "f", "// free_page(a, b);\nint f(void) { return 1; }", ""),
        ("a.c", "f", "/** @param a\n * @return */\nint f(int a) { return 1; }", ""),
        ("a.c", "f", "/** @param a the page to copy back */\nint f(int a) { return 1; }", "the page to copy back"),
        ("a.c", "split_page", "/** This function splits page. */\nint split_page(int a) { return 1; }", ""),
        ("a.c", "split_page", "/** split_page() - Never blocks, even then. */\nint split_page(int a) { return 1; }", "Never blocks, even then."),
        ("a.java", "f", "/** Waits for the lock. */\n@Timed(unit = \"ms\")\npublic int f() { return 1; }", "Waits for the lock."),
        ("a.rs", "f", '#[doc = "Waits for the lock."]\n#[inline]\npub fn f() -> u8 { 1 }', "Waits for the lock."),
        ("a.go", "F", "// Waits for the lock.\nfunc (s *T) F(a int) error {\n\treturn nil\n}", "Waits for the lock."),
        ("a.go", "F", "// Waits for the lock.\nconst x = 1\nfunc F() error {\n\treturn nil\n}", ""),
        ("a.js", "f", "/* Waits for the lock. */\nasync function f(a) { return 1; }", "Waits for the lock."),
        ("a.py", "f", 'def f(a):\n    r"""Waits for the lock."""\n    return a\n', "Waits for the lock."),
        ("a.py", "f", "# Waits for the lock.\n@cached\ndef f(a):\n    return a\n", "Waits for the lock."),
        ("a.py", "f", "# Waits for the lock.\nX = 1\n\ndef f(a):\n    return a\n", ""),
        ("a.py", "f", 'def f(a):\n    x = 1\n    """Waits for the lock."""\n', ""),
        ("a.py", "f", 'def f(a):\n    """"""\n', ""),
        ("a.py", "f", "def f(a):", None),
        ("a.py", "f", 'def f(a):\n    f"""Waits for {a} there."""\n', ""),
        ("a.s", "f", "# Waits for the lock.\n    .globl f\nf:\n    ret\n", "Waits for the lock."),
        ("a.s", "f", "# Waits for the lock.\n    .equ x, 1\n\n    .globl f\nf:\n    ret\n", ""),
        ("a.c", "f", "", None), ("a.c", "f", None, None), (None, "f", "int f() {}", None), ("a.c", None, "int f() { }", None),
    ],
)
def test_pair(path, name, text, want):
    p = extract(text, path, name)
    assert (p.description if p else None) == want


def test_documentation_in_other_languages():
    assert own_words("Gibt die Anzahl der freien Plätze zurück.", "f") and own_words("表をたどり、削除済みの項目を無視する。", "f")
    assert not own_words("---8<---\n* * *\n...\n(c)\nregion helpers\nn/a", "f")


def test_long_and_odd_texts():
    assert extract("/* open" + "x" * 200000, "a.c", "f") is None
    assert extract("{" * 50000, "a.c", "f") is None
    assert extract("'''" + "x" * 1000, "a.py", "f") is None


@pytest.mark.parametrize("clashing", [False, True])
def test_pairs_and_inherited_documentation(spark, make_store, clashing):
    fn = lambda i, doc, **k: {"id": i, "name": "f", "source_file": "a.java", "body_text_compressed": f"/** {doc} */\npublic int f() {{ return 1; }}", "first_seen_version": 1, **k}
    functions = [fn("base", "Waits for the lock."), fn("base", "Waits for the lock."), fn("mid", "{@inheritDoc}"), fn("leaf", "{@inheritDoc}"), fn("loop", "{@inheritDoc}"), fn("bare", "TODO"), fn(None, "Waits for it."), {"id": "null", "name": "f", "source_file": "a.c"}, {"id": "x", "body_text_compressed": ""}]
    edges = [{"id": k, "invoker_id": a, "invoked_id": b, "relation": "OVERRIDES"} for k, (a, b) in enumerate([("mid", "base"), ("leaf", "mid"), ("loop", "loop"), ("leaf", None)])]
    root = make_store(clashing, functions=functions, edges=edges)
    assert [r[0] for r in p7_found(spark, root).collect()] == ["base"]
    got = {r.id: (r.description, r.levels) for r in p7_pairs(spark, root).collect()}
    assert got == {"base": ("Waits for the lock.", 0), "mid": ("Waits for the lock.", 1), "leaf": ("Waits for the lock.", 2)}


@pytest.mark.parametrize("query", [p5_labels, p5_found, p7_found, p7_pairs])
def test_empty(spark, empty_store, query):
    assert query(spark, empty_store).collect() == []
