"""Benchmark decontamination: size-partitioned MinHash containment search, then exact check.

Items are short, documents may be very long, so a Jaccard estimate says nothing; what
matters is the share of the item's shingles that a document holds. Items are partitioned by
size, and the MinHash sketch of an item is as long as the largest size n of its class asks
for, the n - ceil(t n) + 1 smallest hashes: a document that holds a share of t or more of an
item misses too few shingles to miss all of the sketch. A document is searched in the classes
that it is large enough for. Candidates, and nothing else, are verified by counting the
shingles they share. No qualifying pair is lost, at any length of the document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runforge.llm.common import SPACE, cut, load, row_key

SHINGLE_WORDS = 5
MIN_CONTAINMENT = 0.8


def words(text: str = "text") -> Column:
    """Lower-cased words between white space; an empty array if there are none."""
    clean = F.trim(F.lower(F.coalesce(text, F.lit(""))), F.lit(SPACE))
    return F.when(clean == "", F.array().cast("array<string>")).otherwise(F.split(clean, r"[\x20\x09-\x0D]+", -1))


def shingle_hashes(df: DataFrame, keep: list[str], n_words: int = SHINGLE_WORDS) -> DataFrame:
    """A row (keep, h1, h2) for each shingle, repeats included; a text of fewer words is one shingle.

    Two 64-bit hashes over the words stand for a shingle. Texts without words have none.
    """
    at = [F.get("words", F.col("i") + j) for j in range(n_words)]
    return (
        df.where(F.size("words") > 0)
        .select(*keep, "words", F.explode(F.sequence(F.lit(0), F.greatest(F.size("words") - n_words, F.lit(0)))).alias("i"))
        .select(*keep, F.xxhash64(*at).alias("h1"), F.xxhash64(F.lit(1), *at).alias("h2"))
    )


def item_shingles(items: DataFrame, t: float) -> DataFrame:
    """(item_id, item_key, n_item, size_class, h1, h2, in_sketch) for each distinct shingle of each item; class c has items of 2^c to 2^(c+1) - 1 shingles."""
    each = shingle_hashes(items.select("item_id", row_key("item_id", "text").alias("item_key"), words().alias("words")), ["item_id", "item_key"]).distinct()
    item = Window.partitionBy("item_id", "item_key")
    sized = each.withColumns({"n_item": F.count("*").over(item), "rank": F.row_number().over(item.orderBy("h1", "h2"))}).withColumn("size_class", F.floor(F.log2("n_item")).cast("int"))
    largest = F.pow(F.lit(2.0), F.col("size_class") + 1) - 1
    return sized.withColumn("in_sketch", F.col("rank") <= largest - F.ceil(largest * F.lit(t) - 1e-9) + 1).drop("rank")


def candidate_pairs(docs: DataFrame, shingles: DataFrame, t: float) -> DataFrame:
    """(doc_id, row_key, item_id, item_key, size_class): documents (doc_id, row_key, words) that hold part of an item's sketch and are large enough for its class."""
    sketch = shingles.where("in_sketch").select("h1", "h2", "item_id", "item_key", "size_class")
    n_doc = F.greatest(F.size("words") - SHINGLE_WORDS + 1, F.lit(1))
    probes = shingle_hashes(docs.withColumn("n_doc", n_doc), ["doc_id", "row_key", "n_doc"]).join(sketch, ["h1", "h2"])
    return probes.where(F.col("n_doc") >= F.pow(F.lit(2.0), "size_class") * F.lit(t) - 1e-9).select("doc_id", "row_key", "item_id", "item_key", "size_class").distinct()


def contained_items(docs: DataFrame, items: DataFrame, threshold: float = MIN_CONTAINMENT) -> DataFrame:
    """(doc_id, row_key, item_id, size_class, n_item, n_shared, containment) for every pair at or above the threshold.

    docs has doc_id and text, items item_id and text; other columns are ignored. Words are
    lower-cased and split at white space, shingles are of five words (a shorter text is one
    shingle) and count once for each text. Null and empty texts contain nothing and are
    contained nowhere, empty tables give no rows. Rows with one id and different texts are
    judged apart, repeated rows are one.
    """
    if not 0 < threshold <= 1:
        raise ValueError(f"threshold must be in (0, 1]: {threshold}")
    shingles = item_shingles(items, threshold)
    src = docs.select("doc_id", row_key("doc_id", "text").alias("row_key"), words().alias("words"))
    # The only pass over the shingles of all texts.
    found = cut(candidate_pairs(src, shingles, threshold))
    ids = found.select(F.col("doc_id").alias("c_id"), F.col("row_key").alias("c_key")).distinct()
    of_docs = src.join(ids, (src["row_key"] == ids["c_key"]) & src["doc_id"].eqNullSafe(ids["c_id"]), "left_semi")
    held = shingle_hashes(of_docs, ["doc_id", "row_key"]).distinct().toDF("d_id", "d_key", "h1", "h2")
    item = shingles.select(F.col("item_id").alias("i_id"), F.col("item_key").alias("i_key"), F.col("size_class").alias("i_class"), "n_item", "h1", "h2")
    asked = found.join(item, (found["item_key"] == item["i_key"]) & (found["size_class"] == item["i_class"]) & found["item_id"].eqNullSafe(item["i_id"]))
    shared = asked.join(held, (F.col("row_key") == F.col("d_key")) & (asked["h1"] == held["h1"]) & (asked["h2"] == held["h2"]) & F.col("doc_id").eqNullSafe(F.col("d_id")))
    counted = shared.groupBy("doc_id", "row_key", "item_id", "item_key", "size_class", "n_item").agg(F.count("*").alias("n_shared"))
    return counted.where(F.col("n_shared") >= F.col("n_item") * F.lit(threshold) - 1e-9).select(
        "doc_id", "row_key", "item_id", "size_class", "n_item", "n_shared", (F.col("n_shared") / F.col("n_item")).alias("containment")
    )


def op8_decontaminate(spark, sf_dir: str) -> DataFrame:
    found = contained_items(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_item", "n_shared", F.round("containment", 6).alias("containment"))


ORACLE = """
with d as (select doc_id, string_split_regex(trim(lower(coalesce(text, '')), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '[\\x20\\x09-\\x0D]+') as w from documents),
i as (select item_id, string_split_regex(trim(lower(coalesce(text, '')), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '[\\x20\\x09-\\x0D]+') as w from benchmark),
ds as (select distinct doc_id, array_to_string(w[k : k + 4], ' ') as s from (select doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) as k from d where w <> [''])),
i_s as (select distinct item_id, array_to_string(w[k : k + 4], ' ') as s from (select item_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) as k from i where w <> [''])),
n as (select item_id, count(*) as n_item from i_s group by 1),
j as (select doc_id, item_id, count(*) as n_shared from ds join i_s using (s) group by 1, 2)
select doc_id, item_id, n_item, n_shared, round(n_shared::double / n_item, 6) as containment
from j join n using (item_id) where n_shared >= 0.8 * n_item - 1e-9
"""
