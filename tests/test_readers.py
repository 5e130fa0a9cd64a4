"""Readers whose driver holds no path of the files they read."""

from __future__ import annotations

import json

import pytest

from runforge.sources import compaction, readers


def _put(root, files):
    for path, body in files.items():
        p = root / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(body if isinstance(body, bytes) else body.encode())


def _listed_by_driver(df):
    """Run files among the files that the plan lists."""
    return [f for f in df.inputFiles() if f.endswith(".json")]


def test_round_inputs_are_listed_by_tasks(spark, tmp_path):
    _put(tmp_path, {f"ds/c{i}/agentic_eval_round_inputs_{j}.json": json.dumps([{"round_index": j}]) for i in range(5) for j in range(3)})
    good, bad = readers.read_round_inputs(spark, str(tmp_path))
    assert _listed_by_driver(good) == _listed_by_driver(bad) == []
    assert {(r.context_id, r.repeat_index, r.entries[0].round_index) for r in good.collect()} == {(f"c{i}", j, j) for i in range(5) for j in range(3)}
    assert bad.count() == 0


def test_names_and_bytes_of_files(spark, tmp_path):
    root = tmp_path / "a b%20+ü"
    _put(root, {"x y/%41+/ü#?.json": b"\xff\x00{", "empty.json": "", ".hidden/n.json": "1", "_tmp/n.json": "1", "_d=1/n.json": "1", "p.json._COPYING_": "1", "other.txt": "1"})
    for path in (str(root), f"file://{root}"):
        got = {tuple(r.parts): (r.name, bytes(r.raw)) for r in readers.whole_files(spark, path, "*.json").selectExpr("parts", "name", "cast(raw as binary) as raw").collect()}
        assert got == {("x y", "%41+", "ü#?.json"): ("ü#?.json", b"\xff\x00{"), ("empty.json",): ("empty.json", b""), ("_d=1", "n.json"): ("n.json", b"1")}
    assert [(r.parts, r.length) for r in readers.listed_files(spark, str(root / "other.txt")).collect()] == [(["other.txt"], 1)]
    assert [r.raw for r in readers.whole_files(spark, str(root / "other.txt"), "*").collect()] == ["1"]
    (tmp_path / "nothing").mkdir()
    assert readers.whole_files(spark, str(tmp_path / "nothing"), "*").count() == 0
    with pytest.raises(FileNotFoundError, match="no such path"):
        readers.listed_files(spark, str(tmp_path / "none"))


def test_histories_are_listed_by_tasks(spark, tmp_path, monkeypatch):
    _put(tmp_path, {f"ds/x/c{i}/agentic_round_history.json": json.dumps([{"run_id": "h"}]) for i in range(3)} | {f"ds/x/c{i}/r{j}/tb.sv": "t" for i in range(3) for j in range(1 + i % 2)})
    walks, real = [], readers.listed_files
    monkeypatch.setattr(readers, "listed_files", lambda *a: walks.append(a) or real(*a))
    good, bad = readers.read_round_histories(spark, str(tmp_path))
    assert len(walks) == 1  # the files and what lies beside them
    assert _listed_by_driver(good) == _listed_by_driver(bad) == []
    assert {(r.dataset, r.context_id, r.run_id) for r in good.collect()} == {("ds/x", "c0", "r0"), ("ds/x", "c1", None), ("ds/x", "c2", "r0")}


def test_compaction_lists_by_tasks(spark, tmp_path, monkeypatch):
    root, table, walks, seen = tmp_path / "runs", str(tmp_path / "table"), [], []
    _put(root, {f"ds/c{i}/r/x_result.json": json.dumps({"status": "success"}) for i in range(4)} | {"ds/c9/r/x_result.json": ""})
    real, cut = readers.listed_files, compaction.cut
    monkeypatch.setattr(readers, "listed_files", lambda *a: walks.append(a) or real(*a))
    monkeypatch.setattr(compaction, "cut", lambda df: seen.extend(_listed_by_driver(df)) or cut(df))
    assert compaction.compact(spark, str(root), table, "results") == 5
    assert len(walks) == 1 and seen == []
    rows, bad = compaction.compacted(spark, table, "results")
    assert {r.context_id for r in rows.collect()} == {f"c{i}" for i in range(4)}
    assert [(r.path, r.reason) for r in bad.collect()] == [("ds/c9/r/x_result.json", "no JSON object")]
