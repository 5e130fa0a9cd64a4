"""Padding by division against padding by rows."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from runforge.operators import coverage, scoring
from runforge.plans import jobs, staging

SAMPLE = "dataset string, context_id string, repeat_index int, is_pass_xrun boolean, has_coverage boolean, is_pass_targets boolean, overall_coverage double"
FLAGS = ("is_pass_xrun", "has_coverage", "is_pass_targets")


def _made(spark, seed, n):
    rng = random.Random(seed)
    flag = lambda: rng.choice([True, False, None])
    rows = [("d", f"a{c}" if c % 2 else f"b{c}", i, flag(), flag(), flag(), rng.choice([None, 0.0, 0.25, 1.0])) for c in range(9) for i in range(n + 2) if rng.random() < 0.6]
    contexts = [("d", f"a{c}" if c % 2 else f"b{c}") for c in range(11)] * 2
    return rows, contexts, spark.createDataFrame(rows, SAMPLE), spark.createDataFrame(contexts, "dataset string, context_id string")


def _by_rows(rows, contexts, n):
    """What the reports say of every context × n samples, one by one."""
    have = {(r[1], r[2]): r for r in rows}
    every = {c: [have.get((c, i)) for i in range(n)] for _, c in contexts}
    tasks = {}
    for c, samples in every.items():
        for k, m in enumerate((*FLAGS, "overall_coverage")):
            values = [float(s[3 + k] or 0) if s else 0.0 for s in samples]
            tasks[c, m] = (round(sum(values) / n, 9), max(values)) if n else (0.0, 0.0)
    at = [sum((s[i][6] or 0) if s[i] and s[i][3] else 0 for s in every.values()) / len(every) for i in range(n)]
    return tasks, (sum(at) / n, max(at)) if n else (0.0, 0.0)


@pytest.mark.parametrize("n", [0, 1, 5])
def test_padding_makes_no_rows(spark, n):
    rows, contexts, samples, every = _made(spark, n, n)
    tasks, mean = _by_rows(rows, contexts, n)
    got = scoring.per_task(samples, scoring.KEY, every, n)
    assert {(r.context_id, r.metric): (round(r.at_1, 9), r.at_k) for r in got.collect()} == tasks
    assert "sequence" not in got._jdf.queryExecution().toString()
    r = scoring.mean_sim_pass_cov(samples, every, n).first()
    assert (r.at_1, r.at_k) == pytest.approx(mean)
    padded = scoring.pad_missing(samples, every, n)
    assert padded.count() == 11 * n
    again = scoring.per_task(padded)
    assert {(r.context_id, r.metric): (round(r.at_1, 9), r.at_k) for r in again.collect()} == (tasks if n else {})
    cohorts = {r.cohort: (r.n_tasks, round(r.at_1, 9)) for r in scoring.cohort_pass_rates(got, {"a": "a", "none": "x"}).collect()}
    mine = [v for (c, m), v in tasks.items() if c[0] == "a" and m == "is_pass_targets"]
    assert cohorts == {"a": (len(mine), pytest.approx(sum(v[0] for v in mine) / len(mine))), "none": (0, 0.0)}


def test_one_context_with_most_samples(spark):
    """Reports read as many rows as there are samples, whatever the largest context has."""
    rows = spark.range(2000).select(F.lit("d").alias("dataset"), F.when(F.col("id") < 1000, "big").otherwise(F.col("id").cast("string")).alias("context_id"), "id").withColumns({
        "repeat_index": F.when(F.col("id") < 1000, F.col("id")).otherwise(0).cast("int"), **{f: F.lit(True) for f in FLAGS}, "overall_coverage": F.lit(0.5),
    })
    out = jobs.evaluate_samples(rows, rows, staging.most_samples(rows), {"big": "big"})
    assert {(r.metric, round(r.at_1, 6)) for r in out["metrics"].collect()} >= {("is_pass_xrun", round((1 + 1000 / 1000) / 1001, 6))}
    assert out["cohorts"].first().at_1 == 1.0
    assert "tokens" not in out


def test_reports_without_samples(spark):
    none = spark.createDataFrame([], SAMPLE)
    assert staging.most_samples(none) == 0
    out = jobs.evaluate_samples(none, none, 0, {"a": "a"})
    assert {k: [tuple(r) for r in v.collect()] for k, v in out.items()} == {"metrics": [], "per_task": [], "mean_cov": [(0.0, 0.0)], "mean_cov_padded": [(0.0, 0.0)], "cohorts": [("a", 0, 0.0, 0.0)]}
    assert scoring.pad_missing(none, none, 3).count() == 0


def test_categories_parse_once(spark):
    """A result is parsed once for all metrics; null, other tops and null metrics stay as they are."""
    rows = [(1, '{"cov_info":{"summary":[{"name":"top","level":1,"Toggle":0.9},{"name":"top","level":0,"Toggle":0.5,"Block":null},{"name":"top","level":0,"Toggle":0.7}]}}'), (2, '{"cov_info":{"summary":[{"name":"sub","level":0,"Toggle":0.5}]}}')]
    rows += [(3, '{"cov_info":{}}'), (4, "[1"), (5, None), (6, '{"cov_info":{"summary":[null,{"name":"top","level":0}]}}')]
    df = spark.createDataFrame(rows, "id int, result_json string").repartition(1)
    got = df.select("id", coverage.coverage_categories(coverage.parse_result(), F.lit("top")).alias("c"))
    assert {r.id: r.c for r in got.collect()} == {1: {"Toggle": 0.5}, 2: None, 3: None, 4: None, 5: None, 6: {}}
    assert got._jdf.queryExecution().optimizedPlan().toString().count("from_json(") == 1
