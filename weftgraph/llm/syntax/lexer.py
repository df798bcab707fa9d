"""Texts to kind strings: one character for each token, none for spaces and comments.

A lexer is one regular expression and a dictionary from token to kind that fills itself. Kinds:

    i identifier   n number   s string   c character   = and compound assignments: = and a
    1-9 a binary operator of that precedence   ( ) [ ] { } ; , . : ? and other single operators: themselves
    capital letters: classes of keywords, by language   \\n a line's end where the language needs it
    \\x02 a token that can't occur
"""

from __future__ import annotations

import re

BAD = "\x02"
#: Entries kept of what was seen; beyond it a table starts anew.
KEPT = 200_000


class Kinds(dict):
    """token -> kind, asking ``classify`` once for each token."""

    def __init__(self, classify):
        super().__init__()
        self.classify = classify

    def __missing__(self, token: str) -> str:
        if len(self) > KEPT:
            self.clear()
        kind = self.classify(token)
        if len(token) < 64:
            self[token] = kind
        return kind


class Lexer:
    def __init__(self, pattern: str, classify):
        self.pattern = re.compile(pattern, re.S)
        self.kinds = Kinds(classify)

    def __call__(self, text: str) -> str:
        return "".join(map(self.kinds.__getitem__, self.pattern.findall(text)))

    def lines_of(self, text: str, ordinals: list[int]) -> list[int]:
        """The lines of the tokens with these numbers in ascending order, not counting line ends; in one pass."""
        out: list[int] = []
        n, last, line, counted = 0, 0, 1, 0
        for m in self.pattern.finditer(text):
            if len(out) == len(ordinals):
                break
            kind = self.kinds[m.group()]
            if not kind or kind[0] == "\n":
                continue
            last = m.start()
            while len(out) < len(ordinals) and n >= ordinals[len(out)]:
                line, counted = line + text.count("\n", counted, last), last
                out.append(line)
            n += 1
        rest = text.count("\n") + 1
        return out + [rest] * (len(ordinals) - len(out))


WORD = r"[^\W\d]\w*"
DEC = r"(?:0[xX][0-9a-fA-F_']+|0[bB][01_']+|0[oO][0-7_]+|(?:\d[\d_']*)?\.?\d[\d_']*(?:\.(?![.A-Za-z_])|\.(?=[fFlL]\b|[eE][+-]?\d))?(?:[eEpP][+-]?\d+)?)\w*"
BLOCK = r"/\*.*?\*/"
LINE = r"//[^\n]*"


def operators(table: dict[str, str]) -> dict[str, str]:
    """'kind': 'op op op' as op -> kind."""
    return {op: kind for kind, ops in table.items() for op in ops.split()}


def classifier(words: dict[str, str], ops: dict[str, str], comment: tuple[str, ...], quotes: dict[str, str], lines: bool = False):
    """The usual classification by the first character."""

    def classify(t: str) -> str:
        a = t[0]
        if a.isalpha() or a == "_":
            if t in words:
                return words[t]
            if t[-1] in quotes and len(t) > 1:  # a prefixed string
                return quotes[t[-1]]
            return "i" if t.replace("$", "a").isidentifier() else BAD
        if a.isspace():
            return "\n" if lines and "\n" in t else ""
        if t.startswith(comment) and len(t) > 1:
            if t[:2] == "/*" and (len(t) < 4 or t[-2:] != "*/"):
                return BAD
            return "\n" if lines and "\n" in t else ""
        if a.isdigit() or (a == "." and len(t) > 1 and t[1].isdigit()):
            return "n" if number_ok(t) else BAD
        if a in quotes:
            return quotes[a] if len(t) > 1 and t[-1] in quotes else BAD
        return ops.get(t, BAD if len(t) > 1 or not t.isascii() or not t.isprintable() else t)

    return classify


_NUMBER = re.compile(r"(?:0[xX][0-9a-fA-F_']+(?:\.[0-9a-fA-F]*)?(?:[pP][+-]?\d+)?|0[bB][01_']+|0[oO][0-7_]+|\d[\d_']*\.?(?:\d[\d_']*)?(?:[eE][+-]?\d+)?|\.\d[\d_]*(?:[eE][+-]?\d+)?)(?:_?[uif](?:8|16|32|64|128|size)|[uUlLfFdDnjJi]{0,3})$")


def number_ok(t: str) -> bool:
    return _NUMBER.match(t) is not None


_ASSIGN = {"a": "+= -= *= /= %= &= |= ^= <<= >>= >>>= **= &&= ||= ??= &^= //= @="}
_BINARY = {"5": "== != === !==", "6": "<= >= <=>", "7": "<<", "9": "/ %"}
_OP = r"<=>|->\*|>>>=|<<=|>>=|\*\*=|&&=|\|\|=|\?\?=|&\^=|===|!==|\.\.\.|\.\.=|\.\.|\*\*|\?\?|\?\.|=>|->|<-|:=|&\^|\+\+|--|&&|\|\||[=!<>+\-*/%&|^]=|<<|::|."
_CHAR = r"'(?:[^'\\\n]|\\.)+'"
_TEXT = r'"(?:[^"\\\n]|\\.)*"'
_SPACE = r"\s+|\\\r?\n"

# C and C++: B types, Q qualifiers, A struct or class, U unary words, otherwise a letter for one statement
C_WORDS = operators({
    "B": "void char short int long float double signed unsigned bool auto wchar_t char8_t char16_t char32_t _Bool decltype",
    "Q": "const volatile static extern register inline constexpr consteval constinit thread_local mutable virtual explicit friend restrict _Noreturn noexcept override final __restrict __inline __inline__ __extension__ typename",
    "A": "struct union enum class", "N": "namespace", "Y": "typedef", "G": "using", "T": "template", "O": "operator",
    "P": "public private protected", "U": "sizeof alignof _Alignof co_await throw delete co_yield", "W": "new",
    "K": "static_cast dynamic_cast const_cast reinterpret_cast", "I": "if", "E": "else", "F": "for", "H": "while", "D": "do", "S": "switch",
    "C": "case", "L": "default", "R": "return goto co_return", "J": "break continue", "X": "try", "Z": "catch", "M": "asm __asm__ __asm", "@": "__attribute__ alignas __declspec",
})
C_OPS = operators(_ASSIGN | _BINARY | {"2": "||", ".": ". -> .* ->*", "u": "++ --", "d": "::", "e": "...", "r": "&&"})
C = Lexer(rf"{_SPACE}|{LINE}|{BLOCK}|{DEC}|(?:u8|[uUL])?{_TEXT}|(?:u8|[uUL])?{_CHAR}|{WORD}|{_OP}", classifier(C_WORDS, C_OPS, ("//", "/*"), {'"': "s", "'": "c"}))

JAVA_WORDS = operators({
    "B": "void char short int long float double boolean byte", "Q": "public private protected static final abstract native synchronized transient volatile strictfp default sealed",
    "A": "class interface enum", "N": "package import", "W": "new", "V": "instanceof", "I": "if", "E": "else", "F": "for", "H": "while", "D": "do", "S": "switch", "C": "case",
    "R": "return throw", "M": "assert", "J": "break continue", "X": "try", "Z": "catch", "f": "finally", "t": "throws", "x": "extends implements permits",
})
JAVA_OPS = operators(_ASSIGN | _BINARY | {"2": "||", "3": "&&", "u": "++ --", "d": "::", "e": "...", "l": "->"})
JAVA = Lexer(rf'{_SPACE}|{LINE}|{BLOCK}|{DEC}|"""(?:[^\\]|\\.)*?"""|{_TEXT}|{_CHAR}|{WORD}|{_OP}', classifier(JAVA_WORDS, JAVA_OPS, ("//", "/*"), {'"': "s", "'": "c"}))

JS_WORDS = operators({
    "V": "var let const", "U": "typeof void delete await throw", "k": "in instanceof of", "W": "new", "N": "function", "A": "class", "x": "extends", "Q": "async static get set",
    "I": "if", "E": "else", "F": "for", "H": "while", "D": "do", "S": "switch", "C": "case", "L": "default", "R": "return", "J": "break continue debugger", "X": "try", "Z": "catch", "f": "finally",
    "M": "import", "P": "export", "Y": "yield",
})
JS_OPS = operators(_ASSIGN | _BINARY | {"1": "??", "2": "||", "3": "&&", "u": "++ --", "e": "...", "l": "=>", ".": ". ?.", "~": "!", "p": "**"})
_REGEX = r"/(?![*/])(?:[^/\\\n\[]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/[a-z]*"
_TEMPLATE = r"`(?:[^`\\$]|\\.|\$(?!\{)|\$\{(?:[^{}`]|`[^`]*`|\{[^{}]*\})*\})*`"
_JS_QUOTES = {'"': "s", "'": "s", "`": "s"}
_js = classifier(JS_WORDS, JS_OPS, ("//", "/*", "#!"), _JS_QUOTES, lines=True)


def _js_classify(t: str) -> str:
    """An operator or return with a regular expression behind it is one token of two kinds."""
    head = "return" if t.startswith("return") else t[0]
    if len(t) > 2 and (head == "return" or head in "=(,:[!&|?;{") and t[len(head) :].lstrip()[:1] == "/" and t[len(head) :].lstrip()[1:2] not in ("", "/", "*"):
        return _js(head) + "s"
    return _js(t)


JS = Lexer(rf"{_SPACE}|{LINE}|{BLOCK}|\A#![^\n]*|{DEC}|{_TEMPLATE}|{_TEXT}|'(?:[^'\\\n]|\\.)*'|[=(,:\[!&|?;{{]\s*{_REGEX}|return\s+{_REGEX}|[$\w][$\w]*|{_OP}", _js_classify)

GO_WORDS = operators({
    "N": "package", "M": "import", "K": "func", "Y": "type", "V": "var const", "A": "struct", "B": "interface", "T": "map", "O": "chan", "I": "if", "E": "else", "F": "for", "k": "range",
    "S": "switch select", "C": "case", "L": "default", "R": "return", "J": "break continue goto fallthrough", "D": "go defer",
})
GO_OPS = operators(_ASSIGN | _BINARY | {"2": "||", "3": "&&", "9": "/ % &^", "u": "++ --", "w": ":=", "l": "<-", "e": "...", "~": "!"})
GO = Lexer(rf"{_SPACE}|{LINE}|{BLOCK}|{DEC}|`[^`]*`|{_TEXT}|{_CHAR}|{WORD}|{_OP}", classifier(GO_WORDS, GO_OPS, ("//", "/*"), {'"': "s", "'": "c", "`": "s"}, lines=True))

RUST_WORDS = operators({
    "K": "fn", "V": "let", "m": "mut ref", "Q": "pub unsafe async extern const static default move dyn crate", "A": "struct union", "B": "enum", "N": "mod", "G": "use", "P": "impl", "T": "trait",
    "Y": "type", "w": "where", "k": "as in", "I": "if", "E": "else", "F": "for", "H": "while", "D": "loop", "S": "match", "R": "return break", "J": "continue", "M": "macro_rules",
})
RUST_OPS = operators(_ASSIGN | _BINARY | {"r": "&&", "o": "||", "y": ".. ..= ...", "d": "::", "l": "=>", "z": "->", "~": "!"})
_NEST = r"/\*(?:[^*/]|\*(?!/)|/(?!\*))*\*/"
for _ in range(4):
    _NEST = rf"/\*(?:[^*/]|\*(?!/)|/(?!\*)|{_NEST})*\*/"
_RAW = r'b?r"[^"]*"|' + "|".join(rf'b?r{h}".*?"{h}' for h in ("#", "##", "###"))


def _rust_classify(t: str) -> str:
    if t[0] == "'" and (len(t) < 3 or t[-1] != "'"):
        return "q" if len(t) > 1 else BAD  # a lifetime
    if len(t) > 2 and t[-1] in '"#' and t[0] in "rb":
        return "s"
    if t.startswith("r#"):
        return "i"
    return _rust(t)


_rust = classifier(RUST_WORDS, RUST_OPS, ("//", "/*"), {'"': "s", "'": "c"})
RUST = Lexer(rf"{_SPACE}|{LINE}|{_NEST}|{DEC}|{_RAW}|b?\"(?:[^\"\\]|\\.)*\"|b?'(?:[^'\\\n]|\\u\{{[^}}]*\}}|\\x..|\\.)'|'{WORD}|r#{WORD}|{WORD}|{_OP}", _rust_classify)

#: Values in Python are i, 0 (number) and t (text), apart from the letters of words.
PY_WORDS = operators({
    "K": "def", "A": "class", "I": "if", "e": "elif", "E": "else", "F": "for", "H": "while", "X": "try", "Z": "except", "f": "finally", "W": "with", "R": "return", "J": "pass break continue",
    "r": "raise", "M": "import", "N": "from", "G": "global nonlocal", "D": "del", "S": "assert", "a": "async", "w": "await", "Y": "yield", "L": "lambda", "k": "in", "s": "is", "n": "not", "o": "or and", "x": "as",
})
PY_OPS = operators({"=": "=", "b": "== != <= >= << >> // ** % / ^ | & < >", "g": "+= -= *= /= //= %= **= >>= <<= &= ^= |= @=", "z": "->", "v": ":=", ".": ".", "-": "+ - ~", "d": "..."})
_PRE = r"(?:[rRbBuU]|[rR][bB]|[bB][rR])?"
_FPRE = r"(?:[fF][rR]?|[rR][fF])"
_HOLE = r"\{(?:[^{}\n]|\{[^{}\n]*\})*\}"
_FS = "|".join(rf"{_FPRE}{q}(?:[^{q}\\\n{{}}]|\\.|\{{\{{|\}}\}}|{_HOLE})*{q}" for q in ('"', "'"))
_LONG = "|".join(rf"(?:{_PRE}|{_FPRE}){q}(?:[^\\]|\\.)*?{q}" for q in ('"' * 3, "'" * 3))
_SHORT = "|".join(rf"{_PRE}{q}(?:[^{q}\\\n]|\\.)*{q}" for q in ('"', "'"))
#: The indentation of a line as one character, from here on.
INDENT = 0xE000
_py = classifier(PY_WORDS, PY_OPS, ("#",), {'"': "t", "'": "t"})


def _py_classify(t: str) -> str:
    if t[0] in "\r\n" and "\n" in t:
        width = 0
        for ch in t[t.index("\n") + 1 :]:
            width = (width // 8 + 1) * 8 if ch == "\t" else width + 1
        return "\n" + chr(INDENT + min(width, 4000))
    if t[0] == "\\" and len(t) > 1 or t[0] == "#":
        return ""
    kind = _py(t)
    return "0" if kind == "n" and t != "not" else kind


PY = Lexer(
    rf"\r?\n[ \t\f]*|[ \t\f\r]+|\\\r?\n[ \t]*|#[^\n]*|{_LONG}|{_FS}|{_SHORT}|{DEC}|{WORD}|\*\*=|//=|>>=|<<=|\.\.\.|:=|->|\*\*|//|<<|>>|[=!<>+\-*/%&|^@]=|.",
    _py_classify,
)


def _asm_classify(t: str) -> str:
    a = t[0]
    if a == "\n":
        return "\n"
    if a.isspace() or t[:2] == "//":
        return ""
    if t[:2] == "/*":
        return "" if len(t) > 3 and t[-2:] == "*/" else BAD
    if a == '"':
        return "s" if len(t) > 1 and t[-1] == '"' else BAD
    if a == "'" and len(t) > 1:
        return "n"
    if a.isdigit():
        return "n" if re.match(r"(0[xX][0-9a-fA-F]+|0[bB][01]+|\d+(\.\d+)?([eE]\d+)?)[uUlL]*$", t) else "f" if re.match(r"\d+[bf]$", t) else BAD
    if a == "." and len(t) > 1:
        return "o"
    if a.isalpha() or a in "_$.":
        return "i" if t.isascii() else BAD
    return t if t.isascii() and t.isprintable() else BAD


ASM = Lexer(r"[ \t\r\f]+|\n|//[^\n]*|/\*.*?\*/|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)'?|\d[\w.]*|[^\W\d][\w.$@]*|[.$_][\w.$@]*|.", _asm_classify)
