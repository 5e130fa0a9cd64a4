"""LM scoring by context-tree weighting over binary-decomposed byte contexts.

A byte is eight binary choices, each at a node of a binary tree over byte values; every node
has a context tree over the bytes before, nearest first. All depths from none to DEPTH are
mixed: a node's weighted probability is half its Krichevsky-Trofimov estimate and half the
product of its children's. After training the tree stands still, and the probability of a
byte after a context is a mixture along the context's path.

Texts are dealt out in blocks. Each block tells which grams (a byte and the DEPTH bytes
before) and words it has and how often the training documents have them; Spark adds these up
over the corpus, grams are given their probabilities, and each block is handed just those
that it has. Nothing that grows with the corpus is broadcast or collected.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runforge.llm.common import cut, load, row_key, shuffle_partitions

DEPTH = 5
BLOCK_BYTES = 24_000_000
#: Blocks for each task that can run at once, if the corpus is large enough for blocks of LEAST_BYTES.
BLOCKS_FOR_EACH, LEAST_BYTES = 3, 1_000_000
#: Subtrees of so many nearest bytes are built whole; with a depth of 5 those of the given texts have some thousands of grams.
TREE = 3
#: Positions of text looked at at once, and grams whose trees are built at once.
WINDOW, SLICE = 2_000_000, 200_000
#: No byte of UTF-8: what stands before a text, and the symbol that ends it.
BEFORE, END = 0xFE, 0xFF


class Grams:
    """The grams of texts, WINDOW positions at a time: from the nearest byte of context down to the symbol itself."""

    def __init__(self, texts: Iterable[bytes], depth: int = DEPTH):
        before, end, joined, sizes = bytes([BEFORE]) * depth, bytes([END]), bytearray(), []
        for t in texts:
            joined += before + t + end
            sizes.append(len(t) + 1 + depth)
        self.depth, self.bytes = depth, np.frombuffer(joined, np.uint8)
        #: Where each text begins among the positions that have a gram or stand before a text.
        self.first = np.cumsum([0, *sizes], dtype=np.int64)[:-1]

    def windows(self, size: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(grams, the text of each)."""
        n, size = max(0, len(self.bytes) - self.depth), size or WINDOW
        for lo in range(0, n, size):
            hi = min(n, lo + size)
            gram = np.zeros(hi - lo, np.uint64)
            for d in range(1, self.depth + 1):
                gram = (gram << np.uint64(8)) | self.bytes[lo + self.depth - d : hi + self.depth - d]
            symbol = self.bytes[lo + self.depth : hi + self.depth]
            keep = symbol != BEFORE
            gram = ((gram << np.uint64(8)) | symbol)[keep]
            yield gram, np.searchsorted(self.first, np.flatnonzero(keep) + lo, side="right") - 1

    def counts(self, teaches: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(distinct grams, how often they occur in the texts that teach)."""
        every, counts = np.empty(0, np.uint64), np.empty(0, np.int64)
        for gram, text in self.windows():
            k, n = np.unique(gram, return_counts=True)
            other, less = np.unique(gram[~teaches[text]], return_counts=True)
            n[np.searchsorted(k, other)] -= less
            both = np.union1d(every, k)
            added = np.zeros(len(both), np.int64)
            added[np.searchsorted(both, every)] = counts
            added[np.searchsorted(both, k)] += n
            every, counts = both, added
        return every, counts

    def sums(self, gram: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
        """For each of n texts the sum of its grams' values; gram has all of them once, in any order.

        Text gives grams in no order, in which a hash table finds them three times as fast as
        a binary search; windows are half as long to make room for it.
        """
        out, places = np.zeros(n), pd.Index(gram)
        for g, text in self.windows(max(1, WINDOW // 2)):
            out += np.bincount(text, value[places.get_indexer(g)], n)
        return out


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Natural log of the Krichevsky-Trofimov block probability of n0 zeros and n1 ones."""

    def lgamma(x: np.ndarray) -> np.ndarray:
        y = x + 8
        return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) - sum(np.log(x + k) for k in range(8))

    return lgamma(n0 + 0.5) + lgamma(n1 + 0.5) - lgamma(n0 + n1 + 1.0) - math.log(math.pi)


def _up(keys: np.ndarray, n0: np.ndarray, n1: np.ndarray, below: np.ndarray | None) -> tuple[np.ndarray, ...]:
    """(keys, n0, n1, log KT, log weighted, log weight of the own estimate) of the nodes with distinct keys."""
    k, inv = np.unique(keys, return_inverse=True)
    a, b = (np.bincount(inv, n, len(k)) for n in (n0, n1))
    kt = log_kt(a, b)
    if below is None:
        return k, a, b, kt, kt, np.zeros(len(k))
    weighted = np.logaddexp(kt, np.bincount(inv, below, len(k))) - math.log(2)
    return k, a, b, kt, weighted, kt - math.log(2) - weighted


def _levels(gram: np.ndarray, n: np.ndarray, top: int, depth: int) -> dict[int, tuple[np.ndarray, ...]]:
    """The nodes of depths depth to top over grams with counts; a key is the context's bytes, then the node."""
    sym, context = (gram & np.uint64(255)).astype(np.int64), gram >> np.uint64(8)
    keys, n0, n1 = [], [], []
    for bit in range(8):
        keys.append((context << np.uint64(8)) | ((1 << bit) | (sym >> (8 - bit))).astype(np.uint64))
        one = (sym >> (7 - bit)) & 1
        n0.append(np.where(one == 1, 0, n))
        n1.append(np.where(one == 1, n, 0))
    levels = {depth: _up(np.concatenate(keys), np.concatenate(n0), np.concatenate(n1), None)}
    for d in range(depth - 1, top - 1, -1):
        k, a, b, _, weighted, _ = levels[d + 1]
        levels[d] = _up(((k >> np.uint64(16)) << np.uint64(8)) | (k & np.uint64(255)), a, b, weighted)
    return levels


def _along(levels, gram: np.ndarray, depth: int, start: tuple[np.ndarray, np.ndarray] | None, top: int) -> np.ndarray:
    """Natural log probability of each gram; start: what depths above top have mixed so far, and the weight left, by nearest byte and node."""
    sym, context = (gram & np.uint64(255)).astype(np.int64), gram >> np.uint64(8)
    out = np.zeros(len(gram))
    for bit in range(8):
        node = (1 << bit) | (sym >> (8 - bit))
        if start is None:
            p, left = np.zeros(len(gram)), np.ones(len(gram))
        else:
            nearest = (context >> np.uint64(8 * (depth - 1))).astype(np.int64)
            p, left = start[0][nearest, node], start[1][nearest, node]
        for d in range(top, depth + 1):
            k, a, b, _, _, weight = levels[d]
            if len(k):
                q = ((context >> np.uint64(8 * (depth - d))) << np.uint64(8)) | node.astype(np.uint64)
                j = np.minimum(np.searchsorted(k, q), len(k) - 1)
                own = np.exp(weight[j]) * (k[j] == q)
                p = p + left * own * (b[j] + 0.5) / (a[j] + b[j] + 1)
                left = left * (1 - own)
        p = p + left / 2  # contexts never seen
        out += np.log(np.where((sym >> (7 - bit)) & 1 == 1, p, 1 - p))
    return out


def _slices(batches: Iterator[pa.RecordBatch], depth: int) -> Iterator[tuple[pa.Table, bool]]:
    """Rows sorted by gram in tables of SLICE rows or a few more that part no subtree of TREE nearest bytes; the gram is column 0."""
    held: list[pa.RecordBatch] = []
    rows, shift = 0, np.uint64(8 * (depth + 1 - min(TREE, depth)))
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        rows += b.num_rows
        if rows >= SLICE:
            t = pa.Table.from_batches(held)
            tree = t[0].to_numpy().view(np.uint64) >> shift
            other = np.flatnonzero(tree != tree[-1])
            if len(other):
                at = int(other[-1]) + 1
                yield t.slice(0, at)
                held = t.slice(at).combine_chunks().to_batches()
                rows = t.num_rows - at
    if held:
        yield pa.Table.from_batches(held)


def gram_probabilities(grams: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(gram, value): log10 probability of every gram of grams (gram, n), n counted in training and 0 for others.

    Subtrees of the two nearest bytes are independent below depth 2, so each task takes whole
    ones, sorted, and builds them from subtrees of TREE nearest bytes, SLICE grams at a
    time: a heavy context is never in memory as a whole. The nodes of depth 2 become a table
    whose rows come before the grams below them on the way down. What stands above has 255
    nodes for each nearest byte at most.
    """
    if depth < 2:
        raise ValueError("depth must be 2 or more")
    low = min(TREE, depth)
    parts = shuffle_partitions(grams.sparkSession)
    near = F.shiftrightunsigned("gram", 8 * (depth - 1))
    dealt = cut(grams).withColumn("near", near)
    cols2 = ["key", "n0", "n1", "weighted", "weight"]

    def bottom_up(batches):
        parts_of: list[np.ndarray] = []  # nodes of depth 3 of the context of two bytes that isn't finished

        def finish(nodes: np.ndarray) -> pa.RecordBatch:
            key = nodes[0].view(np.uint64)
            two = _up(((key >> np.uint64(16)) << np.uint64(8)) | (key & np.uint64(255)), nodes[1], nodes[2], nodes[3])
            return pa.RecordBatch.from_arrays([pa.array(two[0].view(np.int64)), *(pa.array(two[i]) for i in (1, 2, 4, 5))], names=cols2)

        for t in _slices(batches, depth):
            k, a, b, _, weighted, weight = _levels(t[0].to_numpy().view(np.uint64), t[1].to_numpy(), low, depth)[low]
            if low == 2:
                yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), *map(pa.array, (a, b, weighted, weight))], names=cols2)
                continue
            nodes = np.concatenate([*parts_of, np.array([k.view(np.float64), a, b, weighted])], axis=1)
            # Rows are in order of signed grams: the context that the slice ends in goes on.
            open_ = nodes[0].view(np.uint64) >> np.uint64(16) == t[0].to_numpy().view(np.uint64)[-1] >> np.uint64(8 * (depth - 1))
            if not open_.all():
                yield finish(np.ascontiguousarray(nodes[:, ~open_]))
            parts_of = [np.ascontiguousarray(nodes[:, open_])]
        if parts_of:
            yield finish(parts_of[0])

    counted = dealt.where("n > 0").select("gram", "n", "near").repartition(parts, "near").sortWithinPartitions("gram").select("gram", "n")
    two = cut(counted.mapInArrow(bottom_up, "key bigint, n0 double, n1 double, weighted double, weight double"))
    top = two.groupBy(F.shiftrightunsigned("key", 16).alias("nearest"), F.col("key").bitwiseAND(F.lit(255)).alias("node")).agg(F.sum("n0"), F.sum("n1"), F.sum("weighted"))
    got = np.array([tuple(r) for r in top.collect()], np.float64).reshape(-1, 5)  # 256 x 255 rows at most
    one = _up((got[:, 0].astype(np.uint64) << np.uint64(8)) | got[:, 1].astype(np.uint64), got[:, 2], got[:, 3], got[:, 4])
    root = _up(one[0] & np.uint64(255), one[1], one[2], one[4])
    mixed, left = np.zeros((256, 256)), np.ones((256, 256))
    for k, a, b, _, _, weight in (root, one):
        for key, n0, n1, w in zip(k, a, b, np.exp(weight), strict=True):
            at = (slice(None) if k is root[0] else int(key) >> 8, int(key) & 255)
            mixed[at] += left[at] * w * (n1 + 0.5) / (n0 + n1 + 1)
            left[at] *= 1 - w

    def top_down(batches):
        above = np.empty((4, 0))  # nodes of depth 2: key, counts, weight
        for t in _slices(batches, depth):
            key = t[2].to_numpy(zero_copy_only=False)
            node = ~np.isnan(t[3].to_numpy(zero_copy_only=False))
            gram, n = t[0].to_numpy().view(np.uint64), t[1].to_numpy()
            above = np.concatenate([above, np.array([key[node].astype(np.int64).view(np.float64), *(t[i].to_numpy(zero_copy_only=False)[node] for i in (3, 4, 5))])], axis=1)
            g, n = gram[~node], n[~node]
            levels = _levels(g[n > 0], n[n > 0], low, depth)
            order = np.argsort(above[0].view(np.uint64))
            k, a, b, weight = above[:, order]
            k = np.ascontiguousarray(k).view(np.uint64)
            levels[2] = (k, a, b, None, None, weight)
            yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(_along(levels, g, depth, (mixed, left), 2) / math.log(10))], names=["gram", "value"])
            last = gram[-1] >> np.uint64(8 * (depth - 1))
            above = np.ascontiguousarray(above[:, np.ascontiguousarray(above[0]).view(np.uint64) >> np.uint64(8) == last])

    # A node's row lies before all grams of its context: it takes the smallest of them.
    none = [F.lit(None).cast(t).alias(c) for c, t in (("key", "bigint"), ("n0", "double"), ("n1", "double"), ("weight", "double"))]
    nodes = two.select(F.shiftleft(F.shiftrightunsigned("key", 8), 8 * (depth - 1)).alias("gram"), F.lit(0).cast("bigint").alias("n"), "key", "n0", "n1", "weight", F.shiftrightunsigned("key", 8).alias("near"))
    rows = nodes.unionByName(dealt.select("gram", "n", *none, "near"))
    ordered = rows.repartition(parts, "near").sortWithinPartitions("gram", F.col("key").isNull()).drop("near")
    return ordered.mapInArrow(top_down, "gram bigint, value double")


def _lowered(t: pa.Table) -> Iterator[bytes]:
    """The texts of a table as bytes, some at a time."""
    for part in range(0, t.num_rows, 500):
        for x in t["text"].slice(part, 500).to_pylist():
            yield x.encode().lower()


def in_training(doc_id: str = "doc_id"):
    """Whether crc32 of the id as text leaves another remainder than 2 when divided by 7; a null id teaches."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 7 != 2, F.lit(True))


def score_texts(docs: DataFrame, depth: int = DEPTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, row_key, held_out, n_bytes, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) for every row of docs.

    A-Z is lower-cased for all of it; null is an empty text. score is the model's log10
    probability of the text's bytes and its end, bits_per_byte that code length over bytes
    and end. Tokens are words and one end of text; base_score is their unigram log10
    probability with one added to each count and one unseen token. Rows whose crc32(doc_id)
    mod 7 is 2 are held out, all others teach; every row, repeated or not, counts once and is
    scored. An empty training set scores every bit as one half. Other columns are ignored.
    Texts are whole: one that is longer than block_bytes is a block by itself, read a window
    at a time, of which the distinct grams and words are held.
    """
    spark = docs.sparkSession
    src = docs.select("doc_id", row_key("doc_id", "text").alias("row_key"), F.coalesce("text", F.lit("")).alias("text"))
    total = src.agg(F.coalesce(F.sum(F.octet_length("text") + 1), F.lit(1))).first()[0]
    n_blocks = max(-(-total // block_bytes), min(-(-total // LEAST_BYTES), BLOCKS_FOR_EACH * spark.sparkContext.defaultParallelism))
    src = src.withColumns({"teaches": in_training(), "block": F.pmod(F.xxhash64("doc_id", "row_key"), F.lit(n_blocks)).cast("int")})
    blocks = src.repartition(min(2 * n_blocks, 1_000_000), "block")

    def contents(t: pa.Table) -> pa.Table:
        teaches = np.array(t["teaches"].to_pylist(), bool)
        taught, words = Counter({b"": int(teaches.sum())}), {b""}  # b"" is the end of a text

        def texts() -> Iterator[bytes]:
            for i, x in enumerate(_lowered(t)):
                found = x.split()
                words.update(found)
                if teaches[i]:
                    taught.update(found)
                yield x

        every, counts = Grams(texts(), depth).counts(teaches)
        words = list(words)
        n, m = len(words), len(every)
        block = t["block"][0].as_py()
        return pa.table({
            "block": pa.array(np.full(n + m, block, np.int32)),
            "word": pa.concat_arrays([pa.array(words, pa.binary()), pa.nulls(m, pa.binary())]),
            "gram": pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(every.view(np.int64))]),
            "n": pa.array(np.concatenate([np.array([taught[w] for w in words], np.int64), counts.astype(np.int64)])),
        })

    has = cut(blocks.groupBy("block").applyInArrow(contents, "block int, word binary, gram bigint, n bigint"))
    counted = cut(has.where("word is not null").groupBy("word").agg(F.sum("n").cast("double").alias("value")))
    n_train, n_distinct = counted.agg(F.coalesce(F.sum("value"), F.lit(0.0)), F.count(F.when(F.col("value") > 0, 1))).first()
    probs = gram_probabilities(has.where("gram is not null").groupBy("gram").agg(F.sum("n").alias("n")), depth)
    for_words = has.where("word is not null").select("block", "word").join(counted, "word").select("block", "word", F.lit(None).cast("bigint").alias("gram"), "value")
    for_grams = has.where("gram is not null").select("block", "gram").join(probs, "gram").select("block", F.lit(None).cast("binary").alias("word"), "gram", "value")
    bottom = math.log10(n_train + n_distinct + 1)

    def score(t: pa.Table, known: pa.Table) -> pa.Table:
        is_word = known["word"].is_valid().to_numpy()
        value = known["value"].to_numpy()
        count = dict(zip(known.filter(pa.array(is_word))["word"].to_pylist(), value[is_word].tolist(), strict=True))
        gram, value = known.filter(pa.array(~is_word))["gram"].to_numpy().view(np.uint64), value[~is_word]
        rows = []

        def texts() -> Iterator[bytes]:
            for x in _lowered(t):
                c = np.array([*map(count.__getitem__, x.split()), count[b""]])
                rows.append((len(x), len(c), int((c > 0).sum()), float(np.log10(c + 1).sum() - len(c) * bottom)))
                yield x

        sums = Grams(texts(), depth).sums(gram, value, t.num_rows)
        n_bytes, n_tokens, n_known, base = (np.array(c) for c in zip(*rows, strict=True))
        return pa.table({
            "doc_id": t["doc_id"], "row_key": t["row_key"], "teaches": t["teaches"], "n_bytes": n_bytes, "n_tokens": n_tokens, "n_known": n_known,
            "base_score": base, "score": sums, "bits_per_byte": -sums * math.log2(10) / (n_bytes + 1),
        })

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = blocks.groupBy("block").cogroup(for_words.unionByName(for_grams).groupBy("block")).applyInArrow(
        score, f"doc_id {kind}, row_key bigint, teaches boolean, n_bytes bigint, n_tokens bigint, n_known bigint, base_score double, score double, bits_per_byte double"
    )
    return scored.select(
        "doc_id", "row_key", (~F.col("teaches")).alias("held_out"), "n_bytes", "n_tokens", "n_known",
        F.lit(int(n_train)).cast("bigint").alias("train_tokens"), "base_score", "score", "bits_per_byte",
    )


def op7_context_tree(spark, sf_dir: str) -> DataFrame:
    scored = score_texts(load(spark, sf_dir, "documents").select("doc_id", "text"))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")
