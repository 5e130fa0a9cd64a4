"""Edge rows of the operators, by hand."""

from __future__ import annotations

import collections
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from runforge.functions import chat, patches, text, tokens
from runforge.operators import attach, blend, coverage, designs, rounds, scoring, selection, sft, similarity
from runforge.sources import readers, writers

TARGETS = "array<struct<inst_name: string, metric: string, target_percentage: double>>"


def _result(status="success", overall=0.9, **more):
    top = {"name": "top", "level": 0, "Overall Average": overall, "Toggle": None}
    return json.dumps({"status": status, "cov_info": {"summary": [{"name": "top", "level": 1, "Overall Average": 0.1}, top, {"name": "sub", "level": 1, "Overall Average": 0.5}]}} | more)


@pytest.mark.parametrize(
    ("raw", "targets", "want"),
    [
        (_result(), [], (True, True, True, 0.9, None)),
        (_result(), [("u", "Overall Average", 90.0)], (True, True, True, 0.9, None)),
        (_result(), [("u", "Overall Average", 91.0), ("ghost", "Toggle", 1.0)], (True, True, False, 0.9, None)),
        (_result(), [("ghost", "Toggle", 1.0), ("u", "Overall Average", 91.0)], (None, None, None, None, "missing instance")),
        (_result(), [("u", "Toggle", 99.0), ("sub", "Block", 99.0)], (True, True, True, 0.9, None)),
        (_result(overall=1), [], (True, True, True, 1.0, None)),
        (_result(overall=None), [], (None, None, None, None, "missing overall")),
        (_result("xrun_failed"), [], (False, False, False, 0.0, None)),
        (_result("exception"), [], (True, False, False, 0.0, None)),
        ("{}", [], (False, False, False, 0.0, None)),
        ("not json", [], (False, False, False, 0.0, None)),
        ('{"status": "success"}', [], (None, None, None, None, "missing summary")),
        ('{"status": "success", "cov_info": {"summary": []}}', [], (None, None, None, None, "missing top")),
    ],
)
def test_score_coverage(spark, raw, targets, want):
    rows = spark.createDataFrame([(raw, "top", "u", targets)], f"result_json string, dut_top_module_name string, dut_top_instance_name string, targets {TARGETS}")
    r = coverage.score_coverage(rows).first()
    assert (r.is_pass_xrun, r.has_coverage, r.is_pass_targets, r.overall_coverage, r.eval_error) == want


def _runs(spark, rows):
    return spark.createDataFrame(rows, "dataset string, context_id string, run_id string, is_pass_xrun boolean, has_coverage boolean, is_pass_targets boolean, overall_coverage double, n int")


def test_ties(spark):
    same = [("d", "c", r, True, True, True, 0.5, i) for i, r in enumerate(("b", "a", "c"))]
    runs = _runs(spark, same)
    assert scoring.best_of_n(runs, "n").first().run_id == "b"
    assert selection.select_median(runs).first().run_id == "a"
    assert selection.select_worst(runs).first().run_id == "a"
    assert selection.select_rounds(runs, 1).first().run_id == "c"
    assert selection.gap_rule(selection.select_median(runs), selection.select_worst(runs)).count() == 1
    with pytest.raises(ValueError, match="fewer than 4"):
        selection.select_rounds(runs, 4)


def test_empty_summary(spark):
    r = scoring.eval_summary(_runs(spark, []), {"x": "x_"}).first()
    assert r.total_items == 0
    assert r.mean_overall_cov is None


def test_rounds_budget_against_a_loop(spark):
    rng = random.Random(3)
    rows = [("d", f"c{c}", f"r{i:03}", True, True, rng.random() < 0.5, rng.choice([0.2, 0.5, 1.0]), i) for c in range(7) for i in range(rng.randint(0, 6))]
    runs = _runs(spark, rows)
    open_rows = {}
    for r in rows:
        if r[6] < 1:
            open_rows.setdefault(r[1], []).append(r)
    total = sum(map(len, open_rows.values()))
    for n in (1, 5, total):
        got = selection.select_rounds(runs, n).groupBy("round_id").count().collect()
        left, sizes, want = n, [len(v) for v in open_rows.values()], {}
        for i in range(10):
            take = min(left, sum(s > i for s in sizes))
            if take:
                want[i] = take
            left -= take
        assert {r.round_id: r["count"] for r in got} == want


def test_sampling_ignores_partitions(spark):
    rows = spark.range(1000)
    a, b = (sorted(r.id for r in blend.sample_exact(rows.repartition(p), 37, 5, "id").collect()) for p in (1, 7))
    assert a == b
    assert len(set(a)) == 37
    assert a != sorted(r.id for r in blend.sample_exact(rows, 37, 6, "id").collect())


@pytest.mark.parametrize(("sizes", "n"), [((1, 1000), 500), ((3, 3, 3), 10), ((5,), 12), ((4, 6), -1), ((2, 2), 4)])
def test_blend(spark, sizes, n):
    sources = [spark.range(s).withColumnRenamed("id", "row_id") for s in sizes]
    out = blend.blend(blend.concat_sources(*sources), n, 1, "row_id").groupBy("source_ord", "row_id").count().collect()
    total = sum(r["count"] for r in out)
    assert total == (sum(sizes) if n == -1 else n)
    for i, s in enumerate(sizes):
        counts = [r["count"] for r in out if r.source_ord == i] + [0] * (s - sum(r.source_ord == i for r in out))
        assert max(counts) - min(counts) <= 1
    with pytest.raises(ValueError, match="positive"):
        blend.blend(blend.concat_sources(*sources), 0, 1, "row_id")


def test_patches():
    assert patches.parse_patch(" NO_CHANGES\n") == []
    assert patches.apply_hunks("b\n", patches.parse_patch("@@\n+a\n")) == ("a\nb\n", [])
    assert patches.apply_hunks("x\n", patches.parse_patch("@@\n-y\n+z\n@@\n-x\n+w\n")) == ("w\n", [0])
    assert patches.parse_patch("@@\n a\n b\n") == []
    with pytest.raises(ValueError, match="not a line"):
        patches.parse_patch("@@\n*a\n")


def _table_lcs(a, b):
    last = [0] * (len(b) + 1)
    for x in a:
        now = [0]
        for j, y in enumerate(b):
            now.append(last[j] + 1 if x == y else max(last[j + 1], now[j]))
        last = now
    return last[-1]


def test_lcs_against_a_table(spark):
    rng = random.Random(1)
    some = lambda n, m, letters: ([rng.choice(letters) for _ in range(n)], [rng.choice(letters + "e") for _ in range(m)])
    rows = [some(rng.randint(0, n), rng.randint(0, 70), "abcd") for n in (5, 40, 62) for _ in range(15)]
    rows += [some(rng.choice([61, 62, 63, 123, 124, 125, 186, rng.randint(63, 500)]), rng.randint(0, 500), rng.choice(["ab", "abcd", "abcdefghijklmnopqrst"])) for _ in range(30)]
    rows += [(x, x) for x in (["a"] * 62, ["a"] * 63, ["a"] * 500, list("ab") * 200)] + [(["a"] * 300, []), (["a"] * 300, ["b"] * 100)]
    df = spark.createDataFrame(rows, "a array<string>, b array<string>")
    got = df.select("a", "b", tokens.lcs_length(F.col("a"), F.col("b")).alias("n"))
    for r in got.collect():
        assert r.n == _table_lcs(r.a, r.b)
    assert "Python" not in got._jdf.queryExecution().toString()


@pytest.mark.parametrize("files_in_list", [256, 2])
def test_similar_files_against_all_pairs(spark, monkeypatch, files_in_list):
    monkeypatch.setattr(similarity, "LIST_FILES", files_in_list)
    rng = random.Random(2)
    files = [(i, [rng.choice("aabcdefgh") for _ in range(rng.randint(0, 12))]) for i in range(40)] + [(40 + i, [rng.choice("abcdefghijklmnopqrstuvw") for _ in range(rng.randint(60, 90))]) for i in range(6)]
    files += [(50, files[41][1][:70] + ["x"]), (51, None)]
    rng.shuffle(files)
    a, b = (spark.createDataFrame([*x, x[3]], "f bigint, tokens array<string>") for x in (files[:25], files[25:]))
    for t in (0.3, 0.6, 1.0):
        got = similarity.similar_files(a, b, t)
        want = {(i, j) for i, x in files[:25] for j, y in files[25:] if x and y and 2.0 * _table_lcs(x, y) / (len(x) + len(y)) >= t}
        assert sorted((r.f_left, r.f_right) for r in got.collect()) == sorted(want)
        assert "Python" not in got._jdf.queryExecution().toString()


def test_where_files_meet_bounds_what_they_share(spark):
    rng = random.Random(12)
    files = [(i, [rng.choice("aaabbcdefghijk") for _ in range(rng.randint(1, 15))]) for i in range(60)]
    a, b = (spark.createDataFrame(x, "f bigint, tokens array<string>") for x in (files[:30], files[30:]))
    bags = {f: collections.Counter(x) for f, x in files}
    for t in (0.4, 0.8):
        rows = similarity.candidate_files(a, b, t).collect()
        assert rows and all(r.met <= (bags[r.f_left] & bags[r.f_right]).total() <= r.bound for r in rows)
        found = {(r.f_left, r.f_right) for r in rows if 2.0 * r.bound >= t * (r.a + r.b) - 1e-9}
        need = {(i, j) for i, x in files[:30] for j, y in files[30:] if 2.0 * (bags[i] & bags[j]).total() >= t * (len(x) + len(y)) - 1e-9}
        assert need <= found and len(found) < len(rows)


def test_chat_forms(spark):
    m = lambda *t: [(r, c) for r, c in t]
    rows = [
        (0, m(("system", "s"), ("user", "a"), ("user", "b"), ("assistant", "c"), ("user", "d"), ("user", "e"))),
        (1, m(("user", "a"))),
        (2, m(("system", "s"), ("assistant", "x"))),
        (3, m(("system", "s"), ("user", "a"), ("assistant", "b"))),
        (4, []),
    ]
    df = spark.createDataFrame(rows, "k int, m array<struct<role: string, content: string>>")
    got = {r.k: (r.s, r.h, r.i) for r in df.select("k", chat.system_of(F.col("m")).alias("s"), chat.history_of(F.col("m")).alias("h"), chat.instruction_of(F.col("m")).alias("i")).collect()}
    assert got[0] == ("s", [["a\nb", "c"]], "d\ne")
    assert got[1] == (None, [], None)
    assert got[2] == ("s", None, None)
    assert got[3] == ("s", [["a", "b"]], None)
    assert got[4] == (None, [], None)


@pytest.mark.parametrize(
    ("raw", "code", "name"),
    [("```verilog\nx\n```", "x", None), ("``````", "", None), ("```python\ny\n```", "python\ny", None), ("module a; endmodule", "module a; endmodule", None), ("nothing", None, None), ("file name: a/b.sv", None, "b.sv"), ('output file is "t.v"', None, "t.v")],
)
def test_extract(spark, raw, code, name):
    r = spark.createDataFrame([(raw,)], "t string").select(text.extract_code(F.col("t")).alias("c"), text.extract_filename(F.col("t")).alias("n")).first()
    assert (r.c, r.n) == (code, name)


def test_whitespace_tokens_are_unicode(spark):
    s = "a\x1cb\x85c\xa0d e　f g"
    assert spark.createDataFrame([(s,)], "t string").select(text.whitespace_tokens(F.col("t"))).first()[0] == s.split()


def test_top_modules(spark):
    src = "module a(input x); b #(.W(1)) u0 (.x(x)); endmodule\nmodule b(input x); /* c u (x); */ endmodule\nmodule self; self u(); endmodule"
    df = spark.createDataFrame([(src,), ("module one; one u(); endmodule",)], "t string")
    assert [r[0] for r in df.select(designs.top_modules(designs.module_defs(F.col("t")), designs.module_insts(F.col("t")))).collect()] == [["a"], ["one"]]


def test_improvement(spark):
    cov = "struct<is_pass_xrun: boolean, has_coverage: boolean, is_pass_targets: boolean, overall_coverage: double, misc: map<string, double>>"
    ok = lambda c, **m: (True, True, True, c, m)
    rows = [(ok(0.5), (True, False, False, 0.0, None), True), (ok(0.51), ok(0.5), False), (ok(0.6, a=1.0), ok(0.5, a=1.0), True), (ok(0.6), ok(0.5, a=1.0), False), (ok(0.6, a=0.5), ok(0.5, a=1.0), False), ((True, False, False, 0.0, None), ok(0.1), False)]
    df = spark.createDataFrame(rows, f"c {cov}, p {cov}, want boolean")
    assert all(r[0] == r[1] for r in df.select("want", sft.has_absolute_improvement(F.col("c"), F.col("p"))).collect())


def test_pick_testbench(spark):
    files = spark.createDataFrame([("d", "c", "r", n, n) for n in ("z.sv", "tb_b.sv", "rtl.sv", "n.txt")], "dataset string, context_id string, run_id string, name string, content string")
    own = spark.createDataFrame([("d", "c", "rtl.sv", "rtl")], "dataset string, context_id string, name string, kind string")
    assert attach.pick_testbench(files, own).first().name == "tb_b.sv"
    assert attach.pick_testbench(files, own, "strict").first().pick_error == "3 testbench files"
    assert attach.pick_testbench(files, own, "resume").first().name == "tb_b.sv"


def test_readers(spark, tmp_path):
    for path, body in {
        "ds/sub/c1/r1/x_result.json": _result(), "ds/c2/r1/x_result.json": "[1]", "x_result.json": "{}", "ds/c1/r1/tb.sv": "module t; endmodule",
        "ds/c1/r1/round_1/agentic_round_history.json": json.dumps([{"run_id": "no"}, {"run_id": "yes"}]), "ds/c3/r9/agentic_round_history.json": json.dumps([{"run_id": "q"}]),
        "ds/c4/agentic_eval_round_inputs_3.json": json.dumps([{"round_index": 0, "messages": [], "best_cov_result": {"overall_coverage": 0.5}}, {"final_best_cov_result": {"overall_coverage": 0.7}}]),
    }.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(body)
    good, bad = readers.read_run_results(spark, str(tmp_path))
    assert [(r.dataset, r.context_id, r.run_id) for r in good.collect()] == [("ds/sub", "c1", "r1")]
    assert {r.reason for r in bad.collect()} == {"no JSON object", "path too short"}
    h = {r.context_id: (r.dataset, r.run_id, r.entry.run_id) for r in readers.read_round_histories(spark, str(tmp_path))[0].collect()}
    assert h["c1"] == ("ds", "r1", "yes")
    i, _ = readers.read_round_inputs(spark, str(tmp_path))
    assert i.first().repeat_index == 3
    assert i.select(rounds.post_round_best(F.col("entries"), F.lit(0))["overall_coverage"]).first()[0] == 0.7
    stats = tmp_path / "eval_stats.json"
    stats.write_text(json.dumps({"best_rids": {"ds/c1": "r1", f"{tmp_path}/ds/c2": "r2", "/else/where": "x", "one": "y"}}))
    assert {(r.dataset, r.context_id, r.run_id) for r in readers.read_best_entries(spark, str(stats), str(tmp_path)).collect()} == {("ds", "c1", "r1"), ("ds", "c2", "r2")}
    with pytest.raises(ValueError, match="unknown dataset"):
        readers.load_dataset(spark, "none", {})


def test_writers(spark, tmp_path):
    rows = spark.createDataFrame([("é", None)], "a string, b string")
    writers.write_jsonl(rows, str(tmp_path / "j"))
    assert '{"a":"é","b":null}' in "".join(p.read_text() for p in (tmp_path / "j").glob("part-*"))
    writers.publish_split(rows, str(tmp_path / "p"), "train")
    assert spark.read.parquet(str(tmp_path / "p")).first().split == "train"
    writers.write_id_pairs(spark.createDataFrame([("1", "2")], "train_id string, eval_id string"), str(tmp_path / "t"))
    assert "".join(p.read_text() for p in (tmp_path / "t").glob("part-*")) == "1\t2\n"


def test_patches_against_a_state_machine():
    """Random hunks against a line-by-line reading of the format."""
    rng = random.Random(31)

    def by_lines(body):
        parts, part = {"pre": [], "old": [], "new": [], "post": []}, "pre"
        for kind, text in body:
            if kind == "-":
                parts["old"].append(text)
            elif kind == "+":
                parts["new"].append(text)
            else:
                parts[part].append(text)
            part = part if kind == " " else "post"
        return parts

    for _ in range(300):
        hunks = [[(rng.choice(" -+"), f"l{rng.randint(0, 9)}\n") for _ in range(rng.randint(0, 7))] for _ in range(3)]
        text = "".join("@@\n" + "".join(k + x + "\n" * rng.randint(0, 1) for k, x in h) for h in hunks)
        assert patches.parse_patch(text) == [by_lines(h) for h in hunks if any(k != " " for k, _ in h)]


def test_positions_and_samples_in_buckets(spark, monkeypatch):
    rows = spark.range(3000).selectExpr("id % 7 as a", "id as b").repartition(5)
    got = {(r.a, r.b): r.position for r in blend.positions(rows, "a", "b").collect()}
    assert got == {x: i for i, x in enumerate(sorted((i % 7, i) for i in range(3000)))}
    want = sorted(r.b for r in blend.sample_exact(rows, 777, 3, "b").collect())
    monkeypatch.setattr(blend, "BUCKET_ROWS", 20)
    assert sorted(r.b for r in blend.sample_exact(rows, 777, 3, "b").collect()) == want
    assert [blend.sample_exact(rows, n, 3, "b").count() for n in (0, 1, 2999, 3000, 9999)] == [0, 1, 2999, 3000, 3000]
    with pytest.raises(ValueError, match="slice or a limit"):
        blend.slice_rows(rows, 1, None, "b", limit=3)
    with pytest.raises(ValueError, match="without c"):
        blend.slice_rows(rows.selectExpr("b", "nullif(b, 5) as c"), 1, 4, "b", needs="c")


def test_token_counts_within_the_row(spark):
    files = "array<struct<name: string, content: string>>"
    rows = spark.createDataFrame([("d", "1", [("a", "x = 1;"), ("b", None)]), ("d", "1", [("a", "y")]), (None, None, None)], f"dataset string, context_id string, rtl_files {files}")
    assert sorted(r.rtl_tokens for r in designs.count_rtl_tokens(rows).collect()) == [0, 1, 4]
    assert sorted(r.rtl_tokens for r in designs.count_rtl_tokens(rows, encoder=lambda texts: [len(t) for t in texts]).collect()) == [0, 1, 6]


def test_shared_folder_on_a_cluster(spark):
    from runforge import lineage

    class Session:
        def __init__(self, **conf):
            self.conf = conf

    assert lineage.shared_path(Session(**{"spark.checkpoint.dir": "s3://x"})).startswith("s3://x/")
    for master in ("yarn", "local-cluster[3,2,1000]"):
        with pytest.raises(ValueError, match="checkpoint"):
            lineage.shared_path(Session(**{"spark.master": master}))
    assert lineage.shared_path(Session(**{"spark.master": "local[4]"}))
    t = lineage.cut(spark.range(3))
    lineage.discard(t)
    assert not os.path.exists(t.cut_path.removeprefix("file://"))


def test_refinement_rejects_chats_without_form(spark):
    say = "struct<role: string, content: string>"
    cov = "struct<is_pass_xrun: boolean, has_coverage: boolean, is_pass_targets: boolean, overall_coverage: double, misc: map<string, double>>"
    none, full = (True, False, False, 0.0, None), (True, True, True, 1.0, None)
    rows = spark.createDataFrame([
        ("d", "1", 1, [("system", "s"), ("user", "u")], ("assistant", "a"), full, none), ("d", "2", 2, [("user", "u")], ("assistant", "a"), full, none), ("e", "3", 3, [("user", "u")], ("assistant", "a"), None, none),
    ], f"dataset string, context_id string, ord int, input array<{say}>, output {say}, cov_result {cov}, prev_cov_result {cov}").withColumn("run_type", F.lit("x"))
    good, bad = sft.refine_sft(rows, None, "ord")
    assert [(r.context_id) for r in good.collect()] == ["1"]
    assert [(r.context_id, r.chat_error) for r in bad.collect()] == [("2", "system")]
    with pytest.raises(ValueError, match="more than one dataset"):
        sft.refine_sft(rows.unionByName(rows.where("ord = 1").withColumn("dataset", F.lit("z"))), None, "ord")
