"""Sources and the event log as a stream."""

from __future__ import annotations

import json
import zipfile

import pytest

from larkspur.sources import files
from larkspur.streaming import log


def test_directory_scan_gives_reasons(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "node_modules" / "x").mkdir(parents=True)
    (tmp_path / "src" / "a.py").write_text("x = 1\n")
    (tmp_path / "src" / "b.bin").write_bytes(b"a\x00b")
    (tmp_path / "src" / "c.min.js").write_text("x")
    (tmp_path / "node_modules" / "x" / "i.js").write_text("y")
    got = {r["path"]: (r["reason"], r["content"]) for r in files.scan_directory(spark, str(tmp_path), exclude=("src/z*",)).collect()}
    assert got["src/a.py"] == (None, "x = 1\n")
    assert {k: v[0] for k, v in got.items() if v[0]} == {"src/b.bin": "binary", "src/c.min.js": "generated", "node_modules/x/i.js": "excluded_directory"}


def test_limits(spark):
    df = spark.createDataFrame([(5,), (6,)], "size int")
    files.check_limits(df, 2, 11)
    with pytest.raises(ValueError, match="more than"):
        files.check_limits(df, 1, 11)


def test_archive_members(spark, tmp_path):
    path = tmp_path / "a.zip"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("ok.py", "x")
        z.writestr("../evil.py", "x")
        z.writestr("OK.py", "y")
        z.writestr("bin", b"\x00")
    got = {r["path"]: (r["reason"], r["content"]) for r in files.read_archives(spark, str(path)).collect()}
    assert got["ok.py"] == (None, bytearray(b"x"))
    assert (got["../evil.py"][0], got["OK.py"][0], got["bin"][0]) == ("path_traversal", "duplicate", "binary")


def test_zip_bomb_is_rejected(spark, tmp_path):
    path = tmp_path / "b.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a", b"0" * 3_000_000)
    with pytest.raises(Exception, match="expands"):
        files.read_archives(spark, str(path)).collect()


def test_labels_and_anchors(spark, tmp_path):
    p = tmp_path / "labels.json"
    p.write_text(json.dumps({"dataset": "d", "version": 1, "labels": [{"id": "a", "file": "f", "anchor": "needle", "lines": 2, "category": "bug"}, {"id": "b", "file": "f", "anchor": "twice", "category": "bug"}]}))
    lines = spark.createDataFrame([("f", 1, "x"), ("f", 2, "needle here"), ("f", 3, "twice"), ("f", 4, "twice")], "file_path string, line_no int, text string")
    got = {r["id"]: (r["n_hits"], r["start_line"], r["end_line"]) for r in files.locate_labels(files.read_labels(spark, str(p)), lines).collect()}
    assert got == {"a": (1, 2, 3), "b": (2, None, None)}


def test_last_record_wins_and_resume(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text('{"file": "a", "complete": false}\n\nbroken\n{"file": "a", "complete": true}\n{"file": "b", "complete": false}\n')
    records = files.latest_records(spark, str(tmp_path / "r.jsonl"))
    assert records.count() == 2
    wanted = spark.createDataFrame([("a",), ("b",), ("c",)], "file string")
    assert sorted(r["file"] for r in files.pending(wanted, records).collect()) == ["b", "c"]


@pytest.mark.parametrize(
    ("text", "want"),
    [("", (79, 11)), ("[tool.ruff]\n", (88, 11)), ("[tool.ruff]\nline-length = 200\ntarget-version = 'py39'\n", (120, 9)), ("[project]\nrequires-python = '>=3.8,>3.9'\n", (79, 8)), ("broken [", (79, 11))],
)
def test_settings(text, want):
    assert files.settings(text) == want


def test_provider_config_checks_routes(spark):
    good = json.dumps({"providers": {"a": {"limits": "l"}}, "routing": {"review": ["a"]}})
    providers, routes = files.provider_config(spark, good)
    assert providers.count() == 1 and routes.first()["pos"] == 0
    with pytest.raises(ValueError, match="unknown"):
        files.provider_config(spark, json.dumps({"providers": {}, "routing": {"review": ["a"]}}))


def _write(folder, rows):
    folder.mkdir()
    (folder / "e.jsonl").write_text("\n".join(json.dumps(r) if isinstance(r, dict) else r for r in rows) + "\n")


def test_stream_follows_and_upserts_like_the_batch(spark, tmp_path):
    rows = [{"scan_id": 1, "id": i, "ts": f"2024-01-01T00:00:{i:02}", "kind": "tool", "key": i % 2, "value": float(i)} for i in range(1, 7)]
    _write(tmp_path / "in", [*rows, "broken", rows[0]])
    spark.conf.set("spark.sql.streaming.stateStore.stateSchemaCheck", "false")
    stream = log.upserts(log.once(log.follow(spark, str(tmp_path / "in"), after=1)))
    q = stream.writeStream.format("memory").queryName("up").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r["key"]): (r["first_id"], r["last_id"], r["value"]) for r in spark.table("up").collect()}
    assert got == {0: (2, 6, 6.0), 1: (3, 5, 5.0)}


def test_sink_writes_each_event_once(spark, tmp_path):
    _write(tmp_path / "in", [{"scan_id": 1, "id": 1, "ts": "2024-01-01T00:00:01", "kind": "tool", "key": 1, "value": 1.0}])
    for _ in range(2):
        log.write(log.follow(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert spark.read.json(str(tmp_path / "out")).count() == 1


def test_windowed_counts(spark, tmp_path):
    _write(tmp_path / "in", [{"scan_id": 1, "id": i, "ts": f"2024-01-0{i}T01:00:00", "kind": "tool", "key": 1, "value": 1.0} for i in (1, 2, 3)])
    df = log.windowed(log.follow(spark, str(tmp_path / "in")))
    q = df.writeStream.format("memory").queryName("win").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("win").count() == 3
