"""MinHash near-dedup by bottom-k sketches from one hash function.

A sketch is the k smallest hashes of a document's shingles. The k smallest of the union of two
similar sets hold least_shared() hashes of both, but for a probability of 1e-12, and these
are retained in both sketches; where both sets are whole in their sketches the bound is
exact. So by falling frequency the commonest retained hashes of a document needn't be
posted: two similar documents meet in the inverted list of one of the others. What shares
lists is compared in set_links: overlaps, union-sketch estimate, exact Jaccard.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runforge.llm.common import cut, discard, load, row_key
from runforge.llm.set_links import SKETCH, least_overlap, node_of, similar_components, texts_by_node
from runforge.llm.simhash import shingle_set


def sketches(docs: DataFrame, n_words: int, k: int = SKETCH) -> DataFrame:
    """(doc_id, row_key, n, node, sketch) for every row of docs (doc_id, text): size and name of its set, and its k smallest hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in range(0, b.num_rows, 500):
                c = b.slice(part, 500)
                n, node, kept = [], [], []
                for t in c.column(2):
                    h = shingle_set(t.as_py(), n_words)
                    n.append(len(h))
                    node.append(node_of(h))
                    kept.append(h[:k].view(np.int64))
                yield pa.RecordBatch.from_arrays([c.column(0), c.column(1), pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(kept, pa.list_(pa.int64()))], names=["doc_id", "row_key", "n", "node", "sketch"])

    src = docs.select("doc_id", row_key("doc_id", "text").alias("row_key"), "text")
    return src.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, row_key bigint, n bigint, node bigint, sketch array<bigint>")


def posted_hashes(sets: DataFrame, similarity: float, k: int = SKETCH) -> DataFrame:
    """(key, node, n) from distinct sets (node, n, sketch): of each set's retained hashes the rarest that it must post, without those that no other set has."""
    each = sets.select("node", "n", F.explode("sketch").alias("key"))
    shared = each.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    retained = F.least(F.col("n"), F.lit(k)).cast("int")
    mine = each.join(shared, "key").groupBy("node").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("c", "key"))).alias("s"))
    # Hashes of this set alone are rarest and take the first places.
    room = retained - least_overlap(F.col("n"), k, similarity) + 1 - (retained - F.size("s"))
    return mine.withColumn("room", room).where("room > 0").select("node", "n", F.explode(F.slice("s", F.lit(1), F.col("room"))).alias("x")).select(F.col("x.key").alias("key"), "node", "n")


def near_copies(docs: DataFrame, n_words: int = 4, similarity: float = 0.8) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs (doc_id, text).

    A set is the distinct shingles of n_words lower-cased words between white space, the whole
    sequence if there are fewer, none without words; sets without shingles are linked with
    nothing. Sets are linked at a Jaccard similarity of similarity or more; equal sets are one
    before the search. component_id is the smallest doc_id reached, kept says that it is the
    row's own. Rows with a null doc_id link but give no id and aren't kept; a component of
    such rows only has a null component_id. Repeated rows get equal results; an empty table
    gives no rows; other columns are ignored. Shingles and sets are told apart by 64-bit hashes.
    """
    if not 0 < similarity <= 1:
        raise ValueError(f"similarity must be in (0, 1]: {similarity}")
    rows = cut(sketches(docs, n_words))
    with_words = rows.where("n > 0")
    sets = cut(with_words.groupBy("node").agg(F.max("n").alias("n"), F.first("sketch").alias("sketch")))
    posted = cut(posted_hashes(sets, similarity))
    labels = similar_components(posted, sets, texts_by_node(docs, with_words.select("row_key", "node")), lambda t: shingle_set(t, n_words), similarity)
    discard(posted, sets)
    each = with_words.groupBy("node").agg(F.min("doc_id").alias("least_id")).join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = each.groupBy("label").agg(F.min("least_id").alias("component_id"))
    found = each.join(least, "label").select("node", "component_id", F.lit(1).alias("n_any"))
    out = rows.drop("sketch", "row_key").join(found, "node", "left")
    own = F.when(F.col("n_any").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def op11_minhash(spark, sf_dir: str) -> DataFrame:
    return near_copies(load(spark, sf_dir, "documents"))
