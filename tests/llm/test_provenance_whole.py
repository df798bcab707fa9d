"""Banners count in every comment and docstring, not only at the head of a text."""

import pytest

from weftgraph.llm.provenance import comments, evidence

CODE = "int add(int a, int b)\n{\n    return a + b;\n}\n"


@pytest.mark.parametrize("text", [
    CODE + "// This file was produced automatically from x.schema; changes will be lost.\n",
    "#ifndef X_H\n#define X_H\n/*\n * @generated by tablecast\n */\n" + CODE + "#endif\n",
    "'use strict';\n// @generated by tablecast 1.2\nfunction f() {}\n",
    '"""Parser tables.\n\nGenerated by grammarloom 4.1. DO NOT EDIT.\n"""\n\nX = 1\n',
    "X = 1\n\n# This file was automatically generated.\n",
])
def test_banner_anywhere(text):
    assert evidence(text).tool


def test_copies_and_owners_anywhere():
    e = evidence(CODE + "/* Imported from upstream zlib 1.2 */\n/* Copyright 2020 the zlib authors */\n")
    assert e.copy and e.owner == "zlib"


@pytest.mark.parametrize("text", [
    CODE + "// Checks that files marked DO NOT EDIT are skipped.\n",
    CODE + 'const char *s = "// Code generated by x. DO NOT EDIT.";\n',
    "def f():\n    return '''\n# Generated by x. DO NOT EDIT.\n'''\n",
    CODE,
])
def test_no_banner(text):
    e = evidence(text)
    assert not e.tool and not e.copy and e.owner is None


@pytest.mark.parametrize("text", ["/*" * 50000, '"""' + "x" * 100000, "'" * 100000, "//\n" * 50000, "x '\\" * 30000])
def test_comments_of_long_and_broken_texts(text):
    assert len("".join(comments(text, 0))) <= len(text)
