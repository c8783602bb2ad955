"""What the Merkle tree finds alone, and headers that no table has."""

from __future__ import annotations

import string

import pytest

from larkspur.llm import provenance
from tests.llm.test_edges import SCHEMAS


def _file(i, repo, path, content):
    return (i, repo, path, "python", "full", 1, 1, [], content, None)


def _code(word, n=12):
    return "\n\n".join(f"def {word}_{c}(value):\n    total = value.{word} + other_{c}\n    return total if total else fallback_{word}_{c}" for c in string.ascii_lowercase[:n])


def test_tree_alone_finds_copies_in_plain_places(spark):
    """No header and no directory name says so: whole copies, a changed copy, a shared directory with its small file, and what lies in a directory of copies."""
    rows = [
        _file(1, "r1", "app/net.py", _code("net")), _file(2, "r2", "core/io/net2.py", _code("net")), _file(3, "r3", "x/y.py", _code("net").replace("total if total", "total or None if total", 1)),
        _file(10, "r1", "kit/a.py", _code("kit")), _file(11, "r1", "kit/__init__.py", "from . import a\n"), _file(12, "r2", "lib/kit/a.py", _code("kit")), _file(13, "r2", "lib/kit/__init__.py", "from . import a\n"),
        *[_file(20 + i, "r1", f"tools/t{i}.py", _code("abcd"[i], 20)) for i in range(4)], *[_file(30 + i, "r2", f"bin/t{i}.py", _code("abcd"[i], 20)) for i in range(4)], _file(40, "r1", "tools/own_fix.py", _code("fix", 4)),
        _file(50, "r1", "app/own.py", _code("own")), _file(51, "r2", "app/own.py", _code("mine")), _file(52, "r1", "app/__init__.py", "from . import own\n"), _file(53, "r3", "app/__init__.py", "from . import own\n"),
    ]
    got = {r["file_id"]: r for r in provenance.evidence(spark.createDataFrame(rows, SCHEMAS["source_files"])).collect()}
    assert {k for k, r in got.items() if r["tree"]} == {1, 2, 3, 10, 11, 12, 13, *range(20, 24), *range(30, 34), 40}
    assert not any(r["vendored_by_name"] or r["generated"] or r["packed"] or r["bulk_data"] for r in got.values())


@pytest.mark.parametrize(
    ("head", "kind"),
    [
        ("# This module was automatically created from api.yaml by the schema compiler.", "generated"), ("// Generated with codemaker 3.1 on 2024-01-02", "generated"), ("/* Do not modify this file by hand */", "generated"), ("# Manual changes will be discarded on the next build.", "generated"),
        ("// Machine generated, never edit", "generated"), ("# Forked from the zorbly project at v2", "vendored_by_name"), ("// Copyright 2019 The Zorbly Authors. All rights reserved.", "vendored_by_name"), ("/*! zorbly v1.2.3 | MIT */", "vendored_by_name"), ("// Upstream: zorbly, release 4", "vendored_by_name"),
        ("# Written by hand; see the generator's notes", None), ("// Copyright (c) Own House. All rights reserved.", None), ("# Reads what the code generator wrote", None), ("# Lost updates are handled in the store", None), ("# Edit distance of two words", None), ("// The vendor's price list is imported here", None),
    ],
)
def test_heads_that_no_table_has(spark, head, kind):
    row = provenance.evidence(spark.createDataFrame([_file(1, "r", "src/a.py", head + "\n\n" + _code("own"))], SCHEMAS["source_files"])).first()
    assert [k for k in ("vendored_by_name", "generated", "packed", "bulk_data", "tree") if row[k]] == ([kind] if kind else [])
