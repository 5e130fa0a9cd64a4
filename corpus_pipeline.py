"""From raw documents to token ids: five stages, each on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runforge.llm import bpe, decontaminate, line_dedup, quality, simhash
from runforge.llm.common import cut, load, row_key


def accept_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality.keep_accepted(docs, load(spark, sf_dir, "labels"))


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in many documents go from every text; all documents stay, with texts and n_chars as they are then."""
    done = line_dedup.apply_keep_bitmaps(docs, line_dedup.line_keep_bitmaps(docs))
    changed = done.withColumns({"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast(docs.schema["n_chars"].dataType)})
    return changed.select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, by SimHash over the index of fingerprint bytes and by similar shingles, the document with the smallest doc_id stays."""
    return simhash.keep_one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    found = decontaminate.contained_items(docs, load(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("f_id"), F.col("row_key").alias("f_key")).distinct()
    marked = docs.withColumn("f_row", row_key("doc_id", "text"))
    return marked.join(found, marked["doc_id"].eqNullSafe(found["f_id"]) & (marked["f_row"] == found["f_key"]), "left_anti").drop("f_row")


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and the hash of what they decode to."""
    path = bpe.tokenizer_path()
    ids = cut(bpe.bpe_encode(docs.select("doc_id", "lang", "source", "text"), path).drop("text"))
    return bpe.bpe_decode(ids, path).select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality", accept_quality),
    ("line_dedup", drop_common_lines),
    ("near_dedup", drop_near_copies),
    ("decontaminate", drop_contaminated),
    ("bpe", tokenize),
]

#: SQL can't express the classifier, the SimHash search and the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each keeps is written before the next begins."""
    docs = load(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs)
    return docs
