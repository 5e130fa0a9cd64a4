"""Outputs under one commit, quantiles by sketches, message logs."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from runforge.functions import tokens
from runforge.operators import designs, quantiles, rounds, sft
from runforge.sources import readers, versions, writers

RUN = "dataset string, context_id string, run_id string, is_pass_xrun boolean, has_coverage boolean, is_pass_targets boolean, overall_coverage double"


def _selected(spark, *ids):
    return spark.createDataFrame([("d", c, "r", True, True, True, 0.5) for c in ids], RUN)


def test_manifest_and_statistics_never_part(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "out")
    both = lambda: (lambda m, s: (sorted(r.context_id for r in m.collect()), s.first().total_items))(*readers.read_selection(spark, path))
    with pytest.raises(ValueError, match="no selection"):
        readers.read_selection(spark, path)
    writers.write_selection(_selected(spark, "a", "b"), path, {})
    assert both() == (["a", "b"], 2)
    with pytest.raises(FileExistsError):
        writers.write_selection(_selected(spark, "c"), path, {})
    real = writers.write_jsonl

    def fails(*args):
        raise OSError("lost between manifest and statistics")

    monkeypatch.setattr(writers, "write_jsonl", fails)
    with pytest.raises(OSError, match="lost"):
        writers.write_selection(_selected(spark, "c"), path, {}, overwrite=True)
    assert both() == (["a", "b"], 2)  # the manifest of the failed write is there, but no one reads it
    monkeypatch.setattr(writers, "write_jsonl", real)
    writers.write_selection(_selected(spark, "c"), path, {}, overwrite=True)
    assert both() == (["c"], 1)
    assert versions.current(spark, str(tmp_path / "none")) is None


def test_a_second_publication_replaces_its_split(spark, tmp_path):
    path = str(tmp_path / "data")
    shown = lambda: sorted((r.split, r.x) for r in spark.read.parquet(path).collect())
    rows = lambda *xs: spark.createDataFrame([(x,) for x in xs], "x int")
    writers.publish_splits({"train": rows(1, 2), "eval": rows(3)}, path)
    for _ in range(2):
        writers.publish_split(rows(4, 5, 6), path, "train")
        assert shown() == [("eval", 3), ("train", 4), ("train", 5), ("train", 6)]
    with pytest.raises(ValueError, match="no rows"):
        writers.publish_splits({"train": rows(9), "eval": rows().limit(0)}, path)
    broken = rows(7, 8).withColumn("x", F.when(F.col("x") == 8, F.raise_error(F.lit("lost"))).otherwise(F.col("x")).cast("int"))
    with pytest.raises(Exception, match="lost"):
        writers.publish_split(broken.coalesce(1), path, "train")
    assert shown() == [("eval", 3), ("train", 4), ("train", 5), ("train", 6)]
    with pytest.raises(ValueError, match="no splits"):
        writers.publish_splits({}, path)


@pytest.mark.parametrize("shape", ["uniform", "skewed", "few"])
def test_sketched_quantiles_keep_their_error(spark, shape):
    n, e = 60_000, quantiles.rank_error()
    v = {"uniform": F.rand(3) * 1_000_000, "skewed": F.pow(F.rand(4) * 10, F.lit(6)), "few": F.floor(F.rand(5) * 4)}[shape].cast("bigint")
    rows = spark.range(n).select(F.when(F.col("id") % 1000 == 0, F.lit(None)).otherwise(v).cast("bigint").alias("v"), (F.col("id") % 9).alias("part")).cache()
    parts = quantiles.sketches(rows, "v", "part")
    whole = quantiles.merged(parts)
    assert whole.first().n == n - n // 1000
    values = sorted(r.v for r in rows.collect() if r.v is not None)
    for one in (whole, quantiles.sketches(rows, "v")):
        for q in (0.01, 0.25, 0.5, 0.75, 0.99):
            x = one.select(quantiles.quantile("sketch", q)).first()[0]
            below, upto = sum(y < x for y in values) / len(values), sum(y <= x for y in values) / len(values)
            assert below <= q + e and upto >= q - e
    rows.unpersist()
    assert e == pytest.approx(0.0103, abs=0.001)


def test_profiles_with_and_without_sketch(spark):
    d = spark.range(3000).select(F.array(F.lit("t")).alias("potential_top"), F.array().cast("array<string>").alias("spec_files"), (F.col("id") * 7 % 3001).cast("int").alias("rtl_tokens"))
    exact, close = ({r.stage: r for r in designs.length_profile(d, 1000, k).collect()} for k in (None, 400))
    assert set(exact) == set(close) == {"all", "single_top", "short", "long"}
    for s in exact:
        assert all(abs(exact[s][q] - close[s][q]) <= quantiles.rank_error() * 3001 + 1 for q in ("q1", "q2", "q3")) and exact[s].max == close[s].max
    assert designs.length_profile(d.limit(0), 1000, 400).count() == 0
    chats = spark.range(4000).select(F.lit("s").alias("system"), F.array().cast("array<array<string>>").alias("history"), F.lit("i").alias("instruction"), F.repeat(F.lit("w "), F.col("id").cast("int") % 977).alias("output"))
    assert sft.longest_tail_check(chats, sketch=400).first() == sft.longest_tail_check(chats).first()
    assert tuple(sft.longest_tail_check(chats.limit(0), sketch=400).first()) == (None, None)


SAY = "array<struct<role: string, content: string>>"


def _rounds(spark, rows):
    return spark.createDataFrame(rows, f"dataset string, context_id string, repeat_index int, round_index int, messages {SAY}, answer {SAY}, feedback {SAY}")


def _by_window(df):
    """Every round with what was said before, carried along by a window."""
    w = Window.partitionBy(*rounds.SAMPLE).orderBy("round_index")
    said = F.collect_list(F.concat("answer", "feedback")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("prompt", F.concat(F.first("messages").over(w), F.flatten(said)))


def test_full_history_from_one_log(spark):
    rng = random.Random(4)
    m = lambda text: [("user", text)]
    rows = [("d", f"c{c}", i, r, m(f"{c}{i}{r}"), None if rng.random() < 0.2 else m(f"a{r}"), m(f"f{r}") if rng.random() < 0.9 else []) for c in range(4) for i in range(3) for r in rng.sample(range(9), rng.randint(1, 6))]
    df = _rounds(spark, rows)
    key = lambda d: sorted((r.context_id, r.repeat_index, r.round_index, [x.content for x in r.prompt]) for r in d.collect())
    assert key(rounds.full_history(df)) == key(_by_window(df))
    assert rounds.full_history(df.limit(0)).count() == 0
    log = rounds.message_log(df)
    assert log.count() == len({x[:3] for x in rows})


def test_histories_shuffle_each_message_once_or_twice(spark):
    store = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()
    moved = {}
    for n in (20, 80):
        rng = random.Random(n)
        text = lambda: [("user", rng.randbytes(2000).hex())]  # noqa: E731, B023
        df = _rounds(spark, [("d", "c", 0, r, text(), text(), text()) for r in range(n)]).repartition(4).cache()
        df.count()
        before = store()
        rounds.full_history(df).select(F.size("prompt").alias("n")).agg(F.sum("n")).collect()
        moved[n] = store() - before
        df.unpersist()
    assert moved[80] < 5 * moved[20]  # four times the messages; their prompts are sixteen times as long


def test_blake2b_fractions(spark):
    ids = ["", "a", "é", "12", None]
    got = [r.x for r in spark.createDataFrame([(i,) for i in ids], "id string").select(tokens.hash_fraction(F.col("id")).alias("x")).collect()]
    assert got == [None if i is None else int(hashlib.blake2b(i.encode(), digest_size=8).hexdigest(), 16) / 2**64 for i in ids]
