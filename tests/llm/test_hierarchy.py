"""Class headers by language, and documentation inherited through them."""

import pytest

from weftgraph.llm.hierarchy import classes, owner
from weftgraph.llm.queries import p7_found, p7_pairs

HEADERS = [
    ("java", "public class A<T extends X> extends b.B<T> implements C, D<Y> { /* class Z {} */ int f(int a) { if (a) { g(); } return 1; } abstract void h(); class In extends A { } }", [("A", ["B", "C", "D"], ["f", "h"]), ("In", ["A"], [])]),
    ("java", "interface I extends J, K { void f(); }\nrecord R(int a) implements I { }\nenum E implements I { A, B; public void f() { } }", [("I", ["J", "K"], ["f"]), ("R", ["I"], []), ("E", ["I"], ["f"])]),
    ("cpp", "namespace n { class A final : public B, private virtual ns::C<int> { public: int f() { return 1; } void g(); }; struct D { }; }", [("A", ["B", "C"], ["f", "g"]), ("D", [], [])]),
    ("rust", "impl<T> fmt::Display for Thing<T> where T: Copy { fn fmt(&self) -> R { x() } }\ntrait T: A + b::B { fn f(&self); }\nimpl Thing { fn new() {} }", [("Thing", ["Display"], ["fmt"]), ("T", ["A", "B"], ["f"]), ("Thing", [], ["new"])]),
    ("python", "class A(b.B, Generic[T], metaclass=M):\n    \"\"\"class Z(Y):\"\"\"\n    def f(self):\n        def inner(): pass\n    class In(A):\n        async def g(self): pass\ndef h(): pass\n", [("A", ["B", "Generic"], ["f", "inner"]), ("In", ["A"], ["g"])]),
    ("javascript", "class A extends b.B { f(x) { return 1 } }\nconst c = 1;", [("A", ["B"], ["f"])]),
    ("go", "type A struct {\n\t*B\n\tio.Reader\n\tn int\n}\ntype I interface {\n\tJ\n\tF(a int) error\n}\n", [("A", ["B", "Reader"], []), ("I", ["J"], ["F"])]),
    ("java", "class", []), ("java", "class A extends", []), ("java", "}}}{{{", []), ("asm", "class A {", []), ("python", "", []), ("java", None, []), ("c", "struct s { int a; };", [("s", [], [])]),
]


@pytest.mark.parametrize("language,text,want", HEADERS)
def test_headers(language, text, want):
    assert [tuple(c) for c in classes(text, language)] == want


def test_long_and_odd_texts():
    assert classes("{" * 100000 + "class A {", "java") == [("A", [], [])]
    assert classes("class A extends B {" * 3000, "java")[-1].bases == ["B"]
    assert classes("\0\ud800 class \"", "cpp") == []


@pytest.mark.parametrize("text,language,name,want", [("int A::f(int x) { }", "cpp", "f", "A"), ("int A<T>::f(int x) { }", "cpp", "f", "A"), ("func (a *A) F() {}", "go", "F", "A"), ("func (A[T]) F() {}", "go", "F", "A"), ("int f() {}", "cpp", "f", None), (None, "go", "F", None), ("def f(): pass", "python", "f", None)])
def test_owner(text, language, name, want):
    assert owner(text, language, name) == want


def store(levels):
    """A hierarchy of so many classes, each in its own file; only the root's method is documented."""
    files, docs, functions = [], [], []
    for k in range(levels):
        head = f"class C{k} extends C{k - 1}" if k else "class C0"
        path = f"repo/src/C{k}.java"
        files.append({"delivery_id": k, "scan_run": 1, "id": k, "path": path, "language": "java"})
        docs.append({"doc_id": k, "file_id": k, "text": head + " { int f() { return 1; } }"})
        doc = "{@inheritDoc}" if k else "Waits for the lock of the page."
        functions.append({"id": f"f{k}", "name": "f", "source_file": path, "body_text_compressed": f"/** {doc} */\nint f() {{ return 1; }}"})
    return {"cgdb_files": files, "documents": docs, "functions": functions}


def test_documentation_comes_down_a_hierarchy_of_any_depth(spark, make_store):
    tables = store(18)
    # a cycle, a class without a text, and one of the same name in another repository
    tables["documents"].append({"doc_id": 90, "file_id": 90, "text": "class X extends Y { int g() { return 1; } } class Y extends X { }"})
    tables["cgdb_files"].append({"delivery_id": 90, "scan_run": 1, "id": 90, "path": "repo/X.java", "language": "java"})
    tables["functions"].append({"id": "g", "name": "g", "source_file": "repo/X.java", "body_text_compressed": "/** {@inheritDoc} */\nint g() { return 1; }"})
    tables["functions"].append({"id": "o", "name": "f", "source_file": "other/C1.java", "body_text_compressed": "/** {@inheritDoc} */\nint f() { return 1; }"})
    root = make_store(True, **tables)
    got = {r.id: (r.description, r.levels) for r in p7_pairs(spark, root).collect()}
    assert got == {f"f{k}": ("Waits for the lock of the page.", k) for k in range(18)}
    assert [r[0] for r in p7_found(spark, root).collect()] == ["f0"]


def test_nearest_level_counts_and_ties_take_the_least(spark, make_store):
    fn = lambda i, path, doc: {"id": i, "name": "f", "source_file": path, "body_text_compressed": f"/** {doc} */\nint f() {{ return 1; }}"}
    files = [{"delivery_id": k, "scan_run": 1, "id": k, "path": p, "language": "java"} for k, p in enumerate(["r/A.java", "r/B.java", "r/D.java"])]
    docs = [{"doc_id": k, "file_id": k, "text": t} for k, t in enumerate(["class A { int f() { return 1; } }", "class B extends A { int f() { return 1; } }", "class D extends B { int f() { return 1; } }"])]
    root = make_store(cgdb_files=files, documents=docs, functions=[fn("a", "r/A.java", "Counts the open pages."), fn("b", "r/B.java", "Counts the closed pages."), fn("d", "r/D.java", "{@inheritDoc}")])
    got = {r.id: (r.description, r.levels) for r in p7_pairs(spark, root).collect()}
    assert got["d"] == ("Counts the closed pages.", 1)
