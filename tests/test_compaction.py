"""Run files in a growing table."""

from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from runforge.operators import coverage
from runforge.sources import compaction, readers


def _put(root, files, at=None):
    for path, body in files.items():
        p = root / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(body)
        if at is not None:
            os.utime(p, (at, at))


def _result(overall, status="success"):
    return json.dumps({"status": status, "cov_info": {"summary": [{"name": "top", "level": 0, "Overall Average": overall}], "detail": "x" * 5000}})


def _of(spark, table, kind="results"):
    rows, rejects = compaction.compacted(spark, table, kind)
    return [] if rows is None else rows.collect(), {r.path: r.reason for r in rejects.collect()}


def test_only_new_files_are_opened(spark, tmp_path, monkeypatch):
    root, table, now = tmp_path / "runs", str(tmp_path / "table"), 1_700_000_000
    _put(root, {"a/b/c1/r1/x_result.json": _result(0.5), "2024/c2/r1/x_result.json": _result(0.25), "a/b/c3/r1/x_result.json": "[1]", "x_result.json": "{}"}, now)
    assert compaction.compact(spark, str(root), table, "results", bundle_bytes=2000) == 4
    opened = []
    real = readers.whole_files
    monkeypatch.setattr(readers, "whole_files", lambda *a: opened.append(a) or real(*a))
    assert compaction.compact(spark, str(root), table, "results") == 0
    assert opened == []
    rows, rejects = _of(spark, table)
    assert {(r.dataset, r.context_id, r.run_id, r.result.cov_info.summary[0]["Overall Average"]) for r in rows} == {("a/b", "c1", "r1", 0.5), ("2024", "c2", "r1", 0.25)}
    assert rejects == {"a/b/c3/r1/x_result.json": "no JSON object", "x_result.json": "path too short"}
    # One new file, one mended and one changed; the others stay closed.
    _put(root, {"a/b/c9/r1/x_result.json": _result(0.75), "a/b/c3/r1/x_result.json": _result(0.1), "a/b/c1/r1/x_result.json": _result(0.9)}, now + 60)
    assert compaction.compact(spark, str(root), table, "results") == 3
    assert opened[0][3] == "2023-11-14T22:14:19"
    rows, rejects = _of(spark, table)
    assert {(r.context_id, r.result.cov_info.summary[0]["Overall Average"]) for r in rows} == {("c1", 0.9), ("c2", 0.25), ("c3", 0.1), ("c9", 0.75)}
    assert rejects == {"x_result.json": "path too short"}
    # A file that is older than what was taken, but new.
    _put(root, {"a/b/c5/r1/x_result.json": _result(0.3)}, now - 500)
    assert compaction.compact(spark, str(root), table, "results") == 1
    assert len(_of(spark, table)[0]) == 5


def test_an_unfinished_batch_is_not_there(spark, tmp_path, monkeypatch):
    root, table = tmp_path / "runs", str(tmp_path / "table")
    _put(root, {"d/c1/r1/x_result.json": _result(0.5)})
    real = compaction.discard
    monkeypatch.setattr(compaction, "F", type("Broken", (), {"__getattr__": lambda self, name: _fail() if name == "lit" else getattr(F, name)})())
    with pytest.raises(OSError, match="lost"):
        compaction.compact(spark, str(root), table, "results")
    monkeypatch.setattr(compaction, "F", F)
    monkeypatch.setattr(compaction, "discard", real)
    spark.createDataFrame([("d/c1/r1/x_result.json", "d", "no such run", "left over", "{}")], "path string, dataset string, context_id string, batch string, result_json string").write.mode("append").partitionBy("batch", "dataset").parquet(f"{table}/data")
    assert compaction.compact(spark, str(root), table, "results") == 1
    assert [r.context_id for r in _of(spark, table)[0]] == ["c1"]


def _fail():
    raise OSError("lost")


def test_scores_from_the_table(spark, tmp_path):
    root, table = tmp_path / "runs", str(tmp_path / "table")
    _put(root, {f"d/c{i}/r{j}/x_result.json": _result(i / 10, "success" if j else "xrun_failed") for i in range(4) for j in range(2)})
    compaction.compact(spark, str(root), table, "results")
    rows, _ = compaction.compacted(spark, table, "results")
    assert "detail" not in rows.schema.simpleString()
    blank = F.array().cast("array<struct<inst_name: string, metric: string, target_percentage: double>>")
    scored = lambda df: {(r.context_id, r.run_id, r.is_pass_targets, r.overall_coverage) for r in coverage.score_coverage(df.withColumns({"dut_top_module_name": F.lit("top"), "dut_top_instance_name": F.lit("u"), "targets": blank})).collect()}
    assert scored(rows) == scored(readers.read_run_results(spark, str(root))[0])


def test_other_kinds(spark, tmp_path):
    root = tmp_path / "runs"
    _put(root, {
        "ds/c1/r1/round_1/agentic_round_history.json": json.dumps([{"run_id": "no"}, {"run_id": "yes"}]), "ds/c2/r1/agentic_round_history.json": "{}", "ds/c3/r1/agentic_round_history.json": "[]", "c/agentic_round_history.json": "[{}]",
        "ds/c5/r1/agentic_round_history.json": "[null]", "ds/c6/r1/agentic_round_history.json": "[{", "ds/c1/agentic_eval_round_inputs_2.json": json.dumps([{"round_index": 0}]), "ds/c1/agentic_eval_round_inputs_x.json": "[]",
        "ds/c1/agentic_eval_round_inputs_4.json": "nothing", "agentic_eval_round_inputs_4.json": "[]",
    })
    for kind, keys in (("histories", [("ds", "c1", "yes")]), ("round_inputs", [("ds", "c1", 2)])):
        table = str(tmp_path / kind)
        compaction.compact(spark, str(root), table, kind)
        assert compaction.compact(spark, str(root), table, kind) == 0
        rows, rejects = _of(spark, table, kind)
        assert [(r.dataset, r.context_id, r.entry.run_id if kind == "histories" else r.repeat_index) for r in rows] == keys
        direct = (readers.read_round_histories if kind == "histories" else readers.read_round_inputs)(spark, str(root))
        assert direct[0].count() == 1 and {r.path: r.reason for r in direct[1].collect()} == rejects
        assert set(rejects.values()) == ({"no JSON list", "empty list", "path too short", "no entry"} if kind == "histories" else {"no repeat index in the name", "no JSON list", "path too short"})
    with pytest.raises(ValueError, match="unknown kind"):
        compaction.compact(spark, str(root), "x", "other")
    assert compaction.compacted(spark, str(tmp_path / "none"), "results")[0] is None
