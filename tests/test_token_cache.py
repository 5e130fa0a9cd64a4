"""Token counts: written once, dealt by length."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from runforge.functions import tokens
from runforge.operators import designs, token_cache

ROW = "dataset string, context_id string, rtl_files array<struct<name: string, content: string>>"


def _noting(path):
    def encoder(texts):
        with open(path, "a") as f:
            f.writelines(f"{t}\n" for t in texts)
        return [len(t.split()) for t in texts]

    return encoder


def _noted(path):
    return sorted(path.read_text().split("\n")[:-1]) if path.exists() else []


def _n(df):
    return sorted((r.context_id or "", r.rtl_tokens) for r in df.collect())


def test_second_call_counts_nothing(spark, tmp_path):
    cache, note = str(tmp_path / "cache"), tmp_path / "note"
    rows = [("d", "1", [("a", "x y z"), ("b", None)]), ("d", "1", [("a", "u v")]), ("e", "2", [("other", "u v")]), (None, None, None), (None, None, []), ("d", "3", [("a", "x y z"), ("b", None)])]
    first = spark.createDataFrame(rows, ROW)
    want = [("", 0), ("", 0), ("1", 2), ("1", 3), ("2", 2), ("3", 3)]
    assert _n(token_cache.count_with_cache(first, cache, "split", _noting(str(note)))) == want
    assert _noted(note) == ["", "u v", "x y z"]  # each text once, whatever ids have it
    assert _n(token_cache.count_with_cache(first.withColumn("rtl_tokens", F.lit(99)), cache, "split", _noting(str(note)))) == want
    assert _noted(note) == ["", "u v", "x y z"]
    # Changed texts under the same ids, and the old ones.
    changed = spark.createDataFrame([("d", "1", [("a", "now four words here")]), ("e", "2", [("z", "u v")])], ROW)
    assert _n(token_cache.count_with_cache(changed, cache, "split", _noting(str(note)))) == [("1", 4), ("2", 2)]
    assert _noted(note) == ["", "now four words here", "u v", "x y z"]
    assert _n(token_cache.count_with_cache(first, cache, "split", _noting(str(note)))) == want
    # Another tokenizer has counts of its own.
    assert _n(token_cache.count_with_cache(first, cache)) == _n(designs.count_rtl_tokens(first))
    assert len(_noted(note)) == 4
    assert token_cache.count_with_cache(first.limit(0), cache).count() == 0


def test_upsert_touches_its_buckets_only(spark, tmp_path):
    path = str(tmp_path / "cache")
    rows = lambda *r: spark.createDataFrame(r, "key string, rtl_tokens int")
    token_cache.upsert(rows(("aa1", 1), ("aa2", 2), ("bb1", 3)), path, "t")
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "cache/tokenizer=t/bucket=bb").glob("*.parquet")}
    for _ in range(2):  # repeating changes nothing
        token_cache.upsert(rows(("aa3", 4), ("aa1", 5)), path, "t")
        assert {(r.key, r.rtl_tokens, r.bucket) for r in token_cache.read_cache(spark, path, "t").collect()} == {("aa1", 5, "aa"), ("aa2", 2, "aa"), ("aa3", 4, "aa"), ("bb1", 3, "bb")}
    assert {p: p.stat().st_mtime_ns for p in (tmp_path / "cache/tokenizer=t/bucket=bb").glob("*.parquet")} == before
    assert token_cache.read_cache(spark, path, "other").count() == 0


def test_texts_are_dealt_by_length(spark):
    rng = random.Random(8)
    rows = [(i, "x" * int(2 ** rng.uniform(0, 10))) for i in range(3000)] + [(3000 + i, "y" * 20_000) for i in range(12)] + [(4000, None), (4001, "")]
    df = spark.createDataFrame(rows, "k int, t string").repartition(1)
    dealt = tokens.deal_by_length(df, F.coalesce(F.length("t"), F.lit(0)), "k", parts=16)
    loads = [r.s for r in dealt.groupBy(F.spark_partition_id()).agg(F.sum(F.coalesce(F.length("t"), F.lit(0))).alias("s")).collect()]
    total = sum(len(t or "") for _, t in rows)
    assert dealt.count() == len(rows) and sum(loads) == total
    assert dealt.rdd.getNumPartitions() <= 16 + 15
    assert max(loads) <= 2.6 * total / 16  # plain hashing puts a large part of the large texts together at times
    large = [r.n for r in dealt.where("t like 'y%'").groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert len(large) >= 4 and sum(large) == 12
    assert tokens.deal_by_length(df.limit(0), F.lit(1), "k").count() == 0
