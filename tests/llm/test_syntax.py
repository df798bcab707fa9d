"""Parsers on valid and broken texts of each language, and Python's against the interpreter's own."""

import ast
import warnings

import pytest

from weftgraph.llm import sources
from weftgraph.llm.syntax import LANGUAGES, check, language_of

VALID = {
    "c": [
        "", "// only a comment", "int x;", "#include <a.h>\nint f(int a, char *b) { return a ? b[0] : -1; }", "static const int t[] = { 1, 2, [4] = 5, };", "struct s { int a : 3; struct { int b; } c; };\nenum e { A, B = 2 };",
        "typedef int (*fp)(void *, size_t);", "int f(void)\n{\n#ifdef A\n    if (a) {\n#else\n    if (b) {\n#endif\n        c();\n    }\n    return 0;\n}", '#if 0\nthis is { not code\n#endif\nint a;', 'char *s = "a" "b" /* c */ "d";',
        "void f() { do { x++; } while (x < 3); for (;;) break; switch (x) { case 1: case 2: y(); break; default: ; } goto out; out: return; }", "#define A(x) \\\n  do { x } while (0)\nint b;", "int f(struct a *p) { return ((struct b *)p)->c + sizeof(struct a) + (int)-1; }",
        "unsigned long long x = 0x1FUL, y = 1e-3;", "void g(void) { if (a) b(); else if (c) { d(); } else e(); }",
    ],
    "cpp": [
        "namespace a { namespace b { class C : public D<int>, E { public: C() : x_(1), y_{2} {} ~C() = default; virtual void f() const override; private: int x_; }; } }", "template <typename T, int N> T f(const std::vector<std::map<T, int>> &v) { return v.at(N); }",
        "auto l = [&](int a) -> int { return a >> 1; };", "int main() { for (const auto &x : xs) { std::cout << x << std::endl; } std::lock_guard<std::mutex> g(m); auto p = std::make_unique<T>(1); return 0; }", 'auto r = R"x(" ) )x";', "using A = std::pair<int, int>;\nint X::f(int a) { try { g(); } catch (const E &e) { throw; } }",
        "[[nodiscard]] int f();", "bool operator==(const A &a, const A &b) { return a.x == b.x; }",
    ],
    "java": [
        "package a.b; import java.util.*; public class A<T extends B> extends C implements D { @Override public int f(final int[] a, String... b) throws E { int x = 1, y[] = {1, 2}; for (int i = 0; i < 3; i++) x += a[i]; return (int) x; } }",
        "enum E { A(1), B { void f() {} }; E(int x) {} }", "class A { Runnable r = () -> { x(); }; F g = a -> a::b; { init(); } static { s(); } int f() { switch (x) { case 1 -> y(); default -> { z(); } } return x instanceof B b && b.c() ? 1 : 2; } }",
        "interface I { int f(); default void g() { synchronized (this) { h(); } } }", "class A { void f() { try (R r = new R()) { g(); } catch (A | B e) { throw e; } finally { h(); } Map<String, List<Integer>> m = new HashMap<>(); } }", "@Ann(x = 1) class A { }", 'class A { String s = """\n a " b\n """; }',
    ],
    "javascript": [
        "const a = require('x')\nlet {b, c: [d]} = e\nfunction f(x, ...y) { return x\n}\n", "var r = /[/\"]+/g.test(s), q = a / b / c;", "class A extends B { static x = 1; async *f() { yield 1; } get y() { return `a ${b + `c`}`; } }", "x = a => ({b: 1, ...c}); y = async (a, b) => { await a; };",
        "for (const k of m) { continue }\nfor (let i = 0, n = 3; i < n; i++) {}\ndo { a() } while (b)\nif (a) b\nelse c\n", "export default function () {}\nimport {a as b} from 'c'\n", "a?.b ?? c;\n(function () { 'use strict' })();", "!function(){var a=1;if(typeof b==='undefined'){c.d=void 0}}()", "switch (a) { case 1: b(); break; default: c() }\ntry { a() } catch { b() } finally { c() }",
    ],
    "go": [
        "package a\n\nimport (\n\t\"fmt\"\n\tb \"c/d\"\n)\n\ntype T struct {\n\tA, B int `json:\"a\"`\n\t*E\n}\n\nfunc (t *T) F(a int, b ...string) (int, error) {\n\tif x := f(); x != nil {\n\t\treturn 0, fmt.Errorf(\"%v\", x)\n\t}\n\tfor i, v := range b {\n\t\tt.A += i\n\t\t_ = v\n\t}\n\treturn 1, nil\n}\n",
        "package a\nvar m = map[string][]int{\"a\": {1, 2}, \"b\": nil}\nconst (\n\tX = iota\n\tY\n)\n", "package a\nfunc f() {\n\tgo func() {\n\t\tc <- 1\n\t}()\n\tselect {\n\tcase v := <-c:\n\t\tg(v)\n\tdefault:\n\t}\n\tswitch x := y.(type) {\n\tcase int:\n\t}\n\tdefer mu.Unlock()\n}\n", "package a\ntype I interface {\n\tF(a int) error\n}\nfunc g[T any](x T) T { return x }\n",
    ],
    "rust": [
        "use a::b::{c, d as e};\n#[derive(Debug)]\npub struct S<'a, T: X> { pub a: &'a T, b: Vec<Option<u8>> }\nimpl<'a, T: X> S<'a, T> { pub fn f(&mut self, x: usize) -> Result<(), E> { let mut y = self.a?; match x { 0 => y += 1, n if n > 2 => { g(n)?; } _ => {} } Ok(()) } }",
        'fn f() { let s = r#"a " { "#; let c = \'{\'; let l: &\'static str = "x"; /* a /* b } */ c { */ for i in 0..10 { println!("{}", i); } while let Some(x) = it.next() { break; } let z = if a { 1 } else { 2 }; let cl = |a, b| a + b; }', "mod m; pub(crate) const X: u32 = 1; enum E { A, B(u8), C { x: i32 } } trait T { fn f(&self); }", "macro_rules! m { ($x:expr) => { $x + 1 }; }", "fn f<T>(a: T) where T: Fn(u8) -> u8 { a.iter().map(|x| x * 2).collect::<Vec<_>>(); S { a: 1, ..d() }; }",
    ],
    "python": ["", "x = 1\n", "def f(a, *b, c=1, **d) -> int:\n    \"\"\"doc\"\"\"\n    return [x for x in a if x] or {**d}\n", "class A(B, metaclass=C):\n    @p\n    async def f(self):\n        async with a as b, c:\n            await d\n        yield\n", "try:\n    a()\nexcept (B, C) as e:\n    raise D from e\nelse:\n    pass\nfinally:\n    del x[1:2, ::3]\n", "lambda a, b=1: (a, *b)\nf'{a!r:>{w}} {{}}'\nx = '''\n<<<<<<< x\n'''\n", "if (a :=\n   b):\n\tc()\nelif d: e()\n", "match x:\n    case [1, *y] if y:\n        pass\n", "global a\nassert a, b\nfrom . import (a, b as c,)\nwith (open(a) as b, c as d):\n    pass\nx: int = 3\nprint(*a, sep='')\n"],
    "asm": ["", "    .text\n    .globl f\nf:\n    ldr x1, [x2, #40]\n    mov x0, #38\n    cbz x0, 1f\n1:\n    ret\n", "# a comment's quote\n// other\n    .byte 0x1, 2 // c\n    .equ a, 3\n", "    movl %eax, 4(%ebx,%ecx,2)\n    push {r0-r3, lr}\n    .ascii \"a\\\"b\"\n", "#include \"a.h\"\n#define X 1\nf: add x0, x1, x2, lsl #3\n"],
}
BROKEN = {
    "c": ["int f( { }", "int f() { if (a) { }", "int f() { return 1 }", "int f() { a = ; }", 'char *s = "open;\n', "/* open", "<<<<<<< HEAD\nint a;\n", "package a.b;\nimport c.*;", "int f() { a(b c); }", "}", "#if A\nint a;", "#endif", "int x = 08g;", "int f() { else b(); }", "not code at all, just words."],
    "cpp": ["namespace a { int f();", "class A { int x }", "int f() { std::vector<int> v(1 2); }"],
    "java": ["class A { int f() { return 1; }", "class A { int f( { } }", "package a\nclass B {}", "class A { int x = 1 int y; }", "int f() {}}"],
    "javascript": ["function f( { }", "var a = [1, 2;", "if (a { b() }", "let x = 'open\n", "a b c", "function f() { return 1; "],
    "go": ["func f() {}", "package a\nfunc f() {\n", "package a\nfunc f() { x := }\n", "package a\nvar x = [1, 2\n", "package a\nif x {}\n"],
    "rust": ["fn f() {", "fn f( -> u8 {}", "let x = 1;", "fn f() { let = 3; }", "fn f() { match x { 1 = 2 } }", "/* open /* */"],
    "python": ["def f(:\n    pass\n", "def f()\n    pass\n", "if a:\nb\n", "  x = 1\n", "x = (1,\n", "a b\n", "else:\n    pass\n", "def f():\n        a\n    b\n", "try:\n    a\nb\n", "x = 'open\n", "@d\nx = 1\n", "for x in:\n    pass\n"],
    "asm": ["    ldr x1, [x2\n", "int foo(struct x *y) {\n", "<<<<<<< HEAD\n", "@@ -1,2 +3 @@ x\n--- a/b\n", "  .ascii \"open\n", "/* open\n"],
}


@pytest.mark.parametrize("language,text", [(k, t) for k, ts in VALID.items() for t in ts])
def test_valid(language, text):
    assert check(text, language) == (0, 0, "", [], []), check(text, language)


@pytest.mark.parametrize("language,text", [(k, t) for k, ts in BROKEN.items() for t in ts])
def test_broken(language, text):
    v = check(text, language)
    assert v.errors > 0 and v.line > 0 and v.cause and v.cause == v.causes[0] and v.lines == sorted(v.lines)


@pytest.mark.parametrize("language", LANGUAGES)
def test_carriage_returns_and_marks_make_no_difference(language):
    for t in VALID[language]:
        assert check("﻿" + t.replace("\n", "\r\n"), language).errors == 0


def test_python_as_the_interpreter_says():
    warnings.simplefilter("ignore")
    for t in VALID["python"] + BROKEN["python"]:
        try:
            ast.parse(t)
            good = True
        except SyntaxError:
            good = False
        assert (check(t, "python").errors == 0) == good


def test_recovery_finds_later_errors():
    v = check("int f() { a = ; b = 1; }\nint g() { c( ; }\nint h;\n", "c")
    assert v.errors >= 2 and set(v.lines) >= {1, 2}


def test_deep_and_long_texts():
    assert check("int x = " + "(" * 5000 + "1" + ")" * 5000 + ";", "c").errors == 0
    assert check("int x = " + "(" * 5000 + "1" + ")" * 4999 + ";", "c").errors > 0
    assert check("int f() {" + "a = b + 1;\n" * 50000 + "}", "c").errors == 0
    assert check("{" * 100000, "javascript").errors > 0


@pytest.mark.parametrize("path,stated,want", [("a/b.py", "c", "python"), ("a.h", "C++", "cpp"), ("a.h", None, "c"), ("a.S", "assembly", "asm"), ("Makefile", " GoLang ", "go"), ("x.txt", "prose", None), (None, None, None)])
def test_language(path, stated, want):
    assert language_of(path, stated) == want


@pytest.mark.parametrize("clashing", [False, True])
def test_files_with_nulls_and_repetitions(spark, make_store, clashing):
    from weftgraph.llm.queries import p4_found, p4_rates

    f = lambda i, p, k=1, lang="c": {"id": i, "path": p, "language": lang, "scan_run": k, "delivery_id": k}
    files = [f(1, "r/a.c"), f(1, "r/a.c"), f(2, "r/b.py"), f(3, None, lang=None), f(4, "q/d.c"), f(5, "q/e.c"), f(6, "q/f.c"), f(None, "x.c")]
    doc = lambda d, i, t: {"doc_id": d, "file_id": i, "text": t}
    docs = [doc(1, 1, "int a"), doc(2, 2, "def f("), doc(3, 3, "("), doc(4, 4, None), doc(5, 5, ""), doc(6, 6, "int b;"), doc(7, None, "("), doc(8, 9, "("), doc(1, 1, "int a"), doc(None, 6, " ")]
    root = make_store(clashing, documents=docs, cgdb_files=files)
    assert sorted(r[0] for r in p4_found(spark, root).collect()) == [1, 2]
    rates = {(r.repo, r.language): (r.n_files, r.n_invalid) for r in p4_rates(spark, root).collect()}
    assert rates[("q", "c")] == (3, 0) and rates[("r", "c")] == (2, 2)


def test_stated_errors_are_stored(spark, make_store):
    docs = spark.createDataFrame([(1, 1, "a = (\n")], "doc_id bigint, file_id bigint, text string")
    files = spark.createDataFrame([(1, 1, 1, "x/y.py", "py", False)], "id bigint, scan_run int, delivery_id bigint, path string, language string, is_system boolean")
    r = sources.check_syntax(docs, files).first()
    assert r.errors == len(r.lines) == len(r.causes) == 1 and r.cause == "bracket never closed"


@pytest.mark.parametrize("language,text", [("c", "int x = %s;"), ("java", "class A { int x = %s; }"), ("javascript", "let x = %s;"), ("go", "package a\n\nvar x = %s\n"), ("rust", "fn f() { let x = %s; }"), ("python", "x = %s\n"), ("cpp", "int x = %s;")])
@pytest.mark.parametrize("n", [190, 500, 3000])
def test_brackets_of_any_depth(language, text, n):
    assert check(text % ("(" * n + "1" + ")" * n), language).errors == 0
    assert check(text % ("(" * n + "1" + ")" * (n - 1)), language).errors > 0


@pytest.mark.parametrize("language,text,open_", [("java", "class A { %s x; void f(%s a) { %s y = null; } }", "List<"), ("cpp", "%s x; void f(%s a) { %s y; }", "std::vector<"), ("rust", "struct S { x: %s } fn f(a: %s) { let y: %s = g(); }", "Option<")])
@pytest.mark.parametrize("n", [1, 5, 8, 200])
def test_type_arguments_of_any_depth(language, text, open_, n):
    inner = {"java": "String", "cpp": "int", "rust": "u8"}[language]
    assert check(text.replace("%s", open_ * n + inner + ">" * n), language).errors == 0
    assert check(text.replace("%s", open_ * n + inner + ">" * (n - 1)), language).errors > 0


@pytest.mark.parametrize("language,bad,good", [("c", "int a%d = ;\n", "int b%d;\n"), ("java", "int a%d = ;\n", "int b%d;\n"), ("python", "a%d = = 1\n", "b%d = 1\n"), ("asm", "mov%d, , ]\n", "mov x0, x%d\n"), ("go", "var a%d = =\n", "var b%d int\n")])
def test_all_errors_are_stored(language, bad, good):
    body = "".join(bad % k + good % k for k in range(40))
    text = {"java": "class A {\n" + body + "}\n", "go": "package p\n" + body}.get(language, body)
    v = check(text, language)
    assert v.errors == len(v.lines) == len(v.causes) == 40
    assert v.lines[0] == v.line and [b - a for a, b in zip(v.lines, v.lines[1:])] == [2] * 39


BRANCHES = [
    ("#ifdef A\nint a;\n#else\nint b = ;\n#endif\n", 1), ("#ifdef A\nint a;\n#else\nint b = ;;)\n#endif\nint c;\n", None), ("#if A\nint a;\n#elif B\nint b;\n#elif C\nint c = = 2;\n#endif\n", 1), ("#if A\nint a;\n#elif B\nchar *s = \"open;\n#endif\n", None),
    ("#if 0\nthis isn't code ;;) at all\n#endif\nint a;\n", 0), ("#if 0\nno code (\n#else\nint a = ;\n#endif\n", 1), ("#ifdef A\nint f(int a) {\n#else\nint f(long a) {\n#endif\nreturn 1; }\n", 0),
    ("#ifdef A\nvoid f(void) {\n#endif\nint x;\n#ifdef A\n}\n#endif\n", 0), ("#ifndef H\n#define H\n#ifdef A\nint a;\n#else\nint b = = 1;\n#endif\n#endif\n", 1), ("#if A\n#if B\nint a;\n#else\nint b = ;\n#endif\n#else\nint c;\n#endif\n", 1),
    ("#ifdef A\nvoid f(void) {\n#else\n#endif\nint x;\n#ifdef A\n}\n#endif\n", 0), ("void f(void) {\n#ifdef A\nif (a) {\n#else\nif (b) {\n#endif\ng(); } }\n", 0),
]


@pytest.mark.parametrize("text,errors", BRANCHES)
def test_every_branch_of_conditionals(text, errors):
    v = check(text, "c")
    assert (v.errors > 0) if errors is None else v.errors == errors, v
    if errors == 1:
        assert "= ;" in text.split("\n")[v.line - 1] or "= =" in text.split("\n")[v.line - 1]


def test_many_conditionals_are_parsed_in_few_selections():
    import importlib

    module = importlib.import_module("weftgraph.llm.syntax.check")

    text = "#if A\nint a;\n#else\nint b;\n#endif\n" * 500
    assert module._width(module._branches(module._LEX["c"](text))[0]) == 2
    assert check(text + "#if A\nint a;\n#else\nint b = ;\n#endif\n", "c").errors == 1
