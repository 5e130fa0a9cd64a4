"""Token counts of designs that are written down and never counted twice.

A count is kept under the hash of the texts that it is of, so a changed design is counted anew
whatever its id, and designs with the same files share one count. The cache is a Parquet
table of a folder for each tokenizer and hash bucket. New counts replace the buckets that
they fall into, old rows and new ones together; other buckets are not touched. A job that
fails leaves whole buckets, and repeating it adds what is missing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from runforge.functions.tokens import deal_by_length
from runforge.lineage import cut, discard
from runforge.operators.designs import count_rtl_tokens
from runforge.schemas import FILE

#: Hex digits of a hash that name its bucket.
BUCKET_DIGITS = 2
CACHE = "key string, rtl_tokens int, tokenizer string, bucket string"


def texts_key(files: str = "rtl_files") -> Column:
    """SHA-256 over the lengths and texts of a design's files in order; names don't count, a null text is none."""
    texts = F.transform(F.coalesce(files, F.array().cast(f"array<{FILE}>")), lambda f: F.coalesce(F.concat(F.length(f["content"]).cast("string"), F.lit(":"), f["content"]), F.lit("-")))
    return F.sha2(F.array_join(texts, ","), 256)


def read_cache(spark: SparkSession, path: str, tokenizer: str) -> DataFrame:
    """(key, rtl_tokens, bucket) of a tokenizer; empty if there is no cache."""
    try:
        rows = spark.read.schema(CACHE).parquet(path)
    except AnalysisException:
        rows = spark.createDataFrame([], CACHE)
    return rows.where(F.col("tokenizer") == tokenizer).select("key", "rtl_tokens", "bucket")


def upsert(counts: DataFrame, path: str, tokenizer: str) -> None:
    """Adds (key, rtl_tokens) to the cache; a key that is there already takes the new count."""
    new = cut(counts.groupBy("key").agg(F.max("rtl_tokens").cast("int").alias("rtl_tokens")).withColumn("bucket", F.substring("key", 1, BUCKET_DIGITS)))
    if not new.isEmpty():
        old = read_cache(counts.sparkSession, path, tokenizer).join(new.select("bucket").distinct(), "bucket", "left_semi").join(new.select("key"), "key", "left_anti")
        # Cut, as the buckets that are read here are those that are written.
        both = cut(old.select(*new.columns).unionByName(new).withColumn("tokenizer", F.lit(tokenizer)))
        both.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("tokenizer", "bucket").parquet(path)
        discard(both)
    discard(new)


def count_with_cache(contexts: DataFrame, path: str, tokenizer: str = "words", encoder: Callable | None = None, parts: int | None = None) -> DataFrame:
    """contexts with rtl_tokens as count_rtl_tokens() gives them, from the cache at path, to which what it lacks is added first.

    tokenizer names the encoder in the cache. What is to be counted by an encoder is dealt out
    by length. Rows with null ids or files stay, as do repeated rows.
    """
    keyed = contexts.withColumn("_key", texts_key())
    asked = keyed.select("_key").distinct()
    lacks = asked.join(read_cache(contexts.sparkSession, path, tokenizer).select(F.col("key").alias("_key")), "_key", "left_anti")
    todo = keyed.select("_key", "rtl_files").join(lacks, "_key", "left_semi").groupBy("_key").agg(F.first("rtl_files").alias("rtl_files"))
    if encoder is not None:
        size = F.aggregate(F.transform("rtl_files", lambda f: F.coalesce(F.length(f["content"]), F.lit(0))), F.lit(0), lambda a, x: a + x)
        todo = deal_by_length(todo, F.coalesce(size, F.lit(0)), "_key", parts=parts)
    counted = count_rtl_tokens(todo, encoder=encoder).select(F.col("_key").alias("key"), "rtl_tokens")
    upsert(counted, path, tokenizer)
    known = read_cache(contexts.sparkSession, path, tokenizer).select(F.col("key").alias("_key"), "rtl_tokens")
    return keyed.drop("rtl_tokens").join(known, "_key").drop("_key")
