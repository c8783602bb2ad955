"""Early errors, nesting and places of the grammars."""

from __future__ import annotations

import sys

import pytest

from larkspur.llm import parsing

sys.setrecursionlimit(parsing.DEPTH)


@pytest.mark.parametrize(
    ("language", "text", "valid"),
    [
        ("python", "f(**k, *a)\n", False), ("python", "f(*a, b, c=1, *d, **e, g=2)\n", True), ("python", "def f(*): pass\n", False), ("python", "def f(a, /, b=1, *, c, d=2, **k,): pass\n", True),
        ("python", "def f(a=1, b): pass\n", False), ("python", "x = lambda *, a: 1\ny = lambda a, /, b=2, *c, d, **e: 0\nz = lambda: 0\n", True), ("javascript", "1 = 2;\n", False), ("javascript", "x?.y = 1;\n", False),
        ("javascript", "a ?? b || c;\n", False), ("javascript", "a ?? (b || c); (a && b) ?? c\n", True), ("javascript", "-1 ** 2;\n", False), ("javascript", "(-1) ** 2; 2 ** -1; await x ** 2; ++x ** 2\n", True),
        ("javascript", "a.b[c].d = e = [f] = {g} = h; (a).b += 1; (a) = 2; [a, b] = [b, a]; ({a, b: c.d} = e); this.x = 1; f().y = 3; a[0] ??= 4; new A().b = 2\n", True),
        ("typescript", "-1 ** 2;\n", False), ("java", "class A { void f() { 1 + 2; } }\n", False), ("java", "class A { void f() { (a); } }\n", False),
        ("java", "class A { void f() { x++; --y; a.b(); new B(); new C() { }; a[1] = 2; x >>= 2; x >>>= 2; x.<T>g(); this.z(); super.q(); a = b -> c; ((A) b).c(); } }\n", True),
        ("java", "class A { int f(Object o) { return switch (o) { case String s -> 1; default -> 2; }; } }\n", False),
        ("java", "class A { int f(int o) { switch (o) { case 1, 2: x(); break; case B: default: } return switch (o) { case 1 -> 1; default -> 2; }; } }\n", True),
        ("go", "package a\nfunc f() { 1 + 2 := 3 }\n", False),
        ("go", "package a\nfunc f() { a, b := 1, 2; for i, v := range x { }; for i = range y { }; if v, ok := m[k]; ok { }; a[0], b = 1, 2; switch x := y.(type) { case int: }; select { case v, ok := <-c: ; case w = <-d: } }\n", True),
    ],
)
def test_early_errors(language, text, valid):
    assert parsing.is_valid(text, language) is valid


@pytest.mark.parametrize(("language", "text"), [("javascript", "x = {0}{1};\n"), ("java", "class A {{ int x = {0}1{1}; }}\n"), ("go", "package a\nvar x = {0}1{1}\n"), ("python", "x = {0}{1}\n")])
def test_twenty_thousand_brackets_in_each_other(language, text):
    a, b = ("[", "]") if language in ("javascript", "python") else ("(", ")")
    assert parsing.is_valid(text.format(a * 20_000, b * 20_000), language) is True
    assert parsing.is_valid(text.format(a * 20_000, b * 19_999), language) is False


@pytest.mark.parametrize(
    ("language", "text", "line"),
    [
        ("python", "x = 1\n\n\ny = (1,\n     2 3)\n", 5), ("python", "def f():\n    x = 1\n      y = 2\n", 3), ("python", "x = f'{a!r:>{w}} {f\"{b}\"}'\n\ny = = 2\n", 3), ("java", "class A {\n  int x;\n\n  int y = ;\n}\n", 4), ("go", "package a\n\nfunc f() {\n\tx := := 1\n}\n", 4),
        ("javascript", "const a = 1\nconst b = `x${a\n}`\nlet c = = 2\n", 4), ("javascript", "#!/usr/bin/env node\n\nlet c = = 2\n", 3), ("tsx", "const a = <A>\n  {b}\n</A>;\nlet c = = 2;\n", 4), ("typescript", "let a = 1;\n/* x\ny */\nlet b: = 2;\n", 4),
    ],
)
def test_place_of_the_failure(language, text, line):
    assert parsing.explain(text, language)[0] == line
