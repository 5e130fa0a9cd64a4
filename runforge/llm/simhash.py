"""SimHash near-dedup over an inverted index of fingerprint bytes with count filtering.

Two fingerprints of eight bytes that differ in two bits at most share six of their
positional bytes. The lists of single bytes would hold a 256th of all rows each, so a
posting list is keyed by two pairs of neighbouring bytes: of the four pairs two at least
are whole, so every qualifying pair of fingerprints meets in one of six lists. Pairs are
tallied by shared positional bytes, kept from six on, and verified by their bits.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runforge.llm.common import cut, discard, load, row_key
from runforge.llm.components import connected_components
from runforge.llm.set_links import FIRST, node_of, similar_components, texts_by_node

SEED = 42
MAX_BITS = 2
MIN_BYTES = 8 - MAX_BITS
#: Longer posting lists are joined by one-bit neighbours instead of pair by pair.
LONG_LIST = 256
#: Hash buckets in which near_duplicates() counts shingles, and how far above the mean a frequent one is.
BUCKETS, FAR = 1 << 20, 4


def shingle_hashes(text: str | None, n_words: int) -> np.ndarray:
    """XXH64 of each shingle, in text order, repeats included; empty if there are no words."""
    found = (text or "").encode().lower().split()
    if not found:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    if len(found) <= n_words:
        return np.array([digest(b" ".join(found), SEED)], np.uint64)
    joined, ends, at = b" ".join(found), [], -1
    for w in found:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *(e + 1 for e in ends)]
    return np.array([digest(joined[s:e], SEED) for s, e in zip(starts, ends[n_words - 1 :], strict=False)], np.uint64)


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    x = (h ^ np.uint64(k * 0x9E3779B97F4A7C15 & 2**64 - 1)) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def fingerprint(h: np.ndarray) -> int:
    """As a signed 64-bit number: a bit is 1 if set in over half of the hashes; zero if there are none."""
    ones = np.zeros(64, np.int64)
    for part in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[part : part + (1 << 16)].astype(">u8").view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int32)
    return int(np.packbits(ones * 2 > len(h)).view(">i8")[0])


def fingerprints(docs: DataFrame, n_words: int = 3) -> DataFrame:
    """(doc_id, row_key, fp) for every row of docs (doc_id, text).

    A-Z is lower-cased, words lie between white space, shingles count as often as they
    occur; a text of fewer words is one shingle, null is empty, no words give zero.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in range(0, b.num_rows, 300):
                c = b.slice(part, 300)
                prints = [fingerprint(shingle_hashes(t, n_words)) for t in c.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([c.column(0), c.column(1), pa.array(prints, pa.int64())], names=["doc_id", "row_key", "fp"])

    src = docs.select("doc_id", row_key("doc_id", "text").alias("row_key"), "text")
    return src.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, row_key bigint, fp bigint")


def _shared_bytes(x: Column) -> Column:
    """How many of the eight bytes of x are zero."""
    return sum((F.when(x.bitwiseAND(F.lit(_signed(0xFF << 8 * i))) == 0, 1).otherwise(0) for i in range(8)), F.lit(0))


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def linked_fingerprints(prints: DataFrame) -> DataFrame:
    """(a, b): edges that join all fingerprints within MAX_BITS bits of each other.

    prints has distinct fingerprints fp. In lists of up to LONG_LIST all pairs are tallied
    and verified. Members of longer lists are linked through one-bit neighbours: two
    fingerprints within two bits have a number within one bit of both, and at most 65
    fingerprints lie that close to any number, so these groups stay small whatever the list.
    """
    masks = [_signed(sum(0xFFFF << 16 * p for p in pair)) for pair in itertools.combinations(range(4), 2)]
    lists = F.explode(F.array(*(F.struct(F.lit(i).alias("list"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks)))).alias("p")
    posted = prints.select("fp", lists).select("fp", "p.*")
    sizes = posted.groupBy("list", "key").agg(F.count("*").alias("n")).where("n > 1")
    live = cut(posted.join(sizes, ["list", "key"]))
    short = live.where(F.col("n") <= LONG_LIST)
    a, b = short.select("list", "key", F.col("fp").alias("a")), short.select("list", "key", F.col("fp").alias("b"))
    differ = F.col("a").bitwiseXOR(F.col("b"))
    pairs = a.join(b, ["list", "key"]).where("a < b").where(_shared_bytes(differ) >= MIN_BYTES).where(F.bit_count(differ) <= MAX_BITS).select("a", "b").distinct()
    flips = F.array(F.lit(0).cast("bigint"), *(F.lit(_signed(1 << i)).cast("bigint") for i in range(64)))
    near = live.where(F.col("n") > LONG_LIST).select("fp").distinct().select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("z"))
    centres = near.groupBy("z").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1")
    meet = near.join(centres, "z").where("a <> fp").select("a", F.col("fp").alias("b")).distinct()
    return pairs.union(meet)


def labelled_fingerprints(docs: DataFrame, n_words: int = 3) -> tuple[DataFrame, DataFrame]:
    """(rows, labels): doc_id, row_key, fp for every row of docs; fp, least_id, label for every fingerprint, where label tells components of links of at most MAX_BITS bits apart."""
    rows = cut(fingerprints(docs, n_words))
    each = rows.groupBy("fp").agg(F.min("doc_id").alias("least_id"))
    labels = connected_components(linked_fingerprints(each.select("fp")))
    return rows, each.join(labels, each["fp"] == labels["node"], "left").select("fp", "least_id", F.coalesce("label", "fp").alias("label"))


def simhash_components(docs: DataFrame, n_words: int = 3) -> DataFrame:
    """(doc_id, row_key, fingerprint, component_id) for every row of docs (doc_id, text).

    component_id is the smallest doc_id reached over links of at most MAX_BITS bits.
    Fingerprints are compared once, however many rows share them; wordless rows have
    fingerprint zero and link like any other. Rows with a null doc_id link too but give no
    id; a component of such rows only has a null component_id. Other columns are ignored.
    """
    rows, labelled = labelled_fingerprints(docs, n_words)
    ids = labelled.groupBy("label").agg(F.min("least_id").alias("component_id"))
    found = labelled.join(ids, "label").select("fp", "component_id")
    return rows.join(found, "fp").select("doc_id", "row_key", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def shingle_set(text: str | None, n_words: int) -> np.ndarray:
    """The distinct shingles as sorted 64-bit hashes mixed from the hashes of their words; a text of fewer words is one, none has none."""
    found = (text or "").encode().lower().split()
    if not found:
        return np.empty(0, np.uint64)
    of_word = np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found))
    n = min(n_words, len(found))
    h = np.zeros(len(found) - n + 1, np.uint64)
    for k in range(n):
        h = _mixed((h << np.uint64(5) | h >> np.uint64(59)) + of_word[k : k + len(h)], k + 1)
    return np.unique(h)


def frequent_buckets(texts: DataFrame, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, counts) of hash buckets that hold far more shingles than others: BUCKETS at most, whatever the corpus.

    Each task counts its shingles by bucket and gives those FAR times above its mean. The
    counts put frequent shingles last in the order of rarity; that order needs to be the same
    for all texts and no more, so it loses nothing that they are approximate.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, held = np.zeros(BUCKETS, np.int64), [np.empty(0, np.int64)]

        def add() -> None:
            counts[:] += np.bincount(np.concatenate(held), minlength=BUCKETS)
            held.clear()

        size = 0
        for b in batches:
            for t in b.column(0):
                held.append((shingle_set(t.as_py(), n_words) % np.uint64(BUCKETS)).astype(np.int64))
                size += len(held[-1])
                if size > 2 * BUCKETS:
                    add()
                    size = 0
        held.append(np.empty(0, np.int64))
        add()
        far = np.flatnonzero(counts > max(2, FAR * counts.mean()))
        yield pa.RecordBatch.from_arrays([pa.array(far), pa.array(counts[far])], names=["bucket", "n"])

    got = texts.select("text").mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    return got.column("bucket").to_numpy(), got.column("n").to_numpy()


def rare_shingles(docs: DataFrame, n_words: int, similarity: float) -> DataFrame:
    """(doc_id, row_key, n, node, keys, sketch) for every row of docs (doc_id, text): size and name of its set of shingles, the n - ceil(t n) + 1 rarest, and its smallest hashes."""
    buckets, counts = frequent_buckets(docs, n_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = np.zeros(BUCKETS, np.int64)
        weight[buckets] = counts
        for b in batches:
            for part in range(0, b.num_rows, 500):
                c = b.slice(part, 500)
                n, node, keys, first = [], [], [], []
                for t in c.column(2):
                    h = shingle_set(t.as_py(), n_words)
                    k = len(h) - math.ceil(similarity * len(h) - 1e-9) + 1 if len(h) else 0
                    n.append(len(h))
                    node.append(node_of(h))
                    first.append(h[:FIRST].view(np.int64))
                    keys.append(h[np.lexsort((h, weight[(h % np.uint64(BUCKETS)).astype(np.int64)]))[:k]].view(np.int64))
                yield pa.RecordBatch.from_arrays([c.column(0), c.column(1), pa.array(n, pa.int64()), pa.array(node, pa.int64()), *(pa.array(x, pa.list_(pa.int64())) for x in (keys, first))], names=["doc_id", "row_key", "n", "node", "keys", "sketch"])

    src = docs.select("doc_id", row_key("doc_id", "text").alias("row_key"), "text")
    return src.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, row_key bigint, n bigint, node bigint, keys array<bigint>, sketch array<bigint>")


def near_duplicates(docs: DataFrame, n_words: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, row_key, label, component_id) for every row of docs: near copies by Jaccard similarity of shingles.

    At a similarity of 0.8 the 64-bit fingerprints of two texts differ in ten bits and need not
    share a byte: the guaranteed minimum of shared positional bytes is none, so the byte index
    can't be used here without losing pairs. Instead the shingles themselves are the
    positions of an inverted index with a guaranteed minimum: two sets of sizes up to n with
    similarity t or more share one of the n - ceil(t n) + 1 rarest shingles of each, so only
    these are posted, and of them only those that another set posts too. Frequent shingles
    come last in the order of rarity, so that a passage of many documents posts where they
    have nothing else. Lists are put together and compared in tiles of bounded size by
    set_links, exact Jaccard decides. Documents with the same shingles are one before the
    search; those without words are copies of each other. label tells components apart,
    component_id is the smallest doc_id in one. Null doc_id: as in simhash_components(). Other
    columns are ignored, an empty table gives no rows.
    """
    if not 0 < similarity <= 1:
        raise ValueError(f"similarity must be in (0, 1]: {similarity}")
    docs = docs.select("doc_id", "text")
    found = cut(rare_shingles(docs, n_words, similarity))
    rows = cut(found.drop("keys", "sketch"))
    sets = cut(found.groupBy("node").agg(F.max("n").alias("n"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch")))
    discard(found)
    each = sets.select("node", "n", F.explode("keys").alias("key"))
    shared = each.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
    posted = cut(each.join(shared, "key", "left_semi").select("key", "node", "n"))
    firsts = cut(sets.select("node", "sketch"))
    discard(sets)
    labels = similar_components(posted, firsts, texts_by_node(docs, rows.select("row_key", "node")), lambda t: shingle_set(t, n_words), similarity)
    discard(posted, firsts)
    named = rows.groupBy("node").agg(F.min("doc_id").alias("least_id")).join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    ids = named.groupBy("label").agg(F.min("least_id").alias("component_id"))
    return rows.join(named.join(ids, "label").select("node", "label", "component_id"), "node").select("doc_id", "row_key", "label", "component_id")


def with_fingerprint_links(docs: DataFrame, found: DataFrame, print_words: int = 3) -> DataFrame:
    """found (row_key and label of rows of docs) with one label for what the byte index links by fingerprints."""
    rows, labelled = labelled_fingerprints(docs, print_words)
    prints = rows.select("row_key", "fp").distinct().join(labelled.select("fp", F.col("label").alias("by_print")), "fp").select("row_key", "by_print")
    meet = cut(found.select("row_key", "label").distinct().join(prints, "row_key").select("by_print", "label").distinct())
    # Labels that a component of fingerprints has are linked with the smallest of them.
    least = meet.groupBy("by_print").agg(F.min("label").alias("a"), F.count("*").alias("n")).where("n > 1")
    labels = connected_components(meet.join(least, "by_print").where("a <> label").select("a", F.col("label").alias("b")))
    joined = labels.select(F.col("node").alias("label"), F.col("label").alias("joined"))
    return found.join(joined, "label", "left").withColumn("label", F.coalesce("joined", "label")).drop("joined")


def keep_one_of_each(docs: DataFrame, n_words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of docs but for near copies: of each component the row with the smallest doc_id stays.

    Components are of links of two kinds: fingerprints within MAX_BITS bits, which the byte
    index finds as in simhash_components(), and sets of shingles of that similarity, which may
    differ in more bits and which near_duplicates() finds. Of rows that share this doc_id one
    stays. Columns are those of docs. A component without any doc_id keeps one row.
    """
    found = with_fingerprint_links(docs, cut(near_duplicates(docs, n_words, similarity).select("doc_id", "row_key", "label")))
    best = found.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_key")).alias("keep"))
    keep = best.select(F.col("keep.doc_id").alias("keep_id"), F.col("keep.row_key").alias("keep_key")).distinct()
    marked = docs.withColumn("keep_row", row_key("doc_id", "text")).dropDuplicates(["doc_id", "keep_row"])
    return marked.join(keep, marked["doc_id"].eqNullSafe(keep["keep_id"]) & (marked["keep_row"] == keep["keep_key"]), "left_semi").drop("keep_row")


def op2_simhash(spark, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return simhash_components(docs).select("doc_id", "fingerprint", "component_id")
