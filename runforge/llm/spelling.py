"""Spelling variants by Bloom-guided neighbourhoods.

Every word's one-edit neighbours are generated in numbers, never as strings: the hash of an
edited word follows from hashes of the word's prefixes and suffixes. The hashes are probed in
a broadcast Bloom filter of the vocabulary, sharded by word length and blocked, so that a
probe reads one 64-bit block. Only positives become strings and are shuffled to the
vocabulary, where an exact join removes the false ones. A pair of near words is found from
one of its sides only: from the longer word by a deletion, or, of words of one length, from
the side where the differing code point is smaller.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runforge.llm.common import cut, discard, load, shuffle_partitions

RUN = re.compile("[A-Za-zÀ-ÿ]+")
#: Where a run is damaged, and what is a word.
DAMAGED, MIN_LENGTH, MIN_COUNT = 97, 5, 3
#: A block is a number of 64 bits; this many blocks at most are broadcast, 8 bytes each, however large the vocabulary. With more words false positives rise, and nothing else.
MAX_BLOCKS = 1 << 22
WORDS_A_BLOCK, BITS_A_WORD = 4, 5
#: Words of this length and more share a shard.
LAST_SHARD = 40
#: Distinct words that a task holds before it passes their counts on; hashes that it makes at once.
HELD_WORDS, PROBES = 300_000, 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)


def runs_of(text: str | None, doc_id) -> Counter:
    """How often each word-like run occurs in a document, A-Z lower-cased, after the damage; a null id is empty text in the checksum."""
    lowered = (text or "").encode().lower().decode()
    prefix = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    out: Counter = Counter()
    for run, n in Counter(map(itemgetter(0), RUN.finditer(lowered))).items():
        h = zlib.crc32(run.encode(), prefix)
        if h % DAMAGED == 0:
            run = run[: h % len(run)] + run[h % len(run) + 1 :]
        if len(run) >= MIN_LENGTH:
            out[run] += n
    return out


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n): words of MIN_LENGTH code points or more that occur MIN_COUNT times or more in the rows of docs (doc_id, text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def given() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])
            held.clear()
            return out

        for b in batches:
            for doc_id, text in zip(b.column(0), b.column(1), strict=True):
                held.update(runs_of(text.as_py(), doc_id.as_py()))
                if len(held) > HELD_WORDS:
                    yield given()
        yield given()

    return docs.select("doc_id", "text").mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_COUNT)


def _points(words: list[str], length: int) -> np.ndarray:
    """A row of code points for each word, all of this length."""
    return np.array(words, dtype=f"<U{length}").view(np.uint32).reshape(len(words), length).astype(np.uint64)


def _powers(n: int) -> np.ndarray:
    out = np.ones(n + 1, np.uint64)
    out[1:] = BASE
    return np.multiply.accumulate(out)


def _ends(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each word's first i and last L - i code points, i from 0 to L."""
    n, length = points.shape
    before, after, power = np.zeros((n, length + 1), np.uint64), np.zeros((n, length + 1), np.uint64), _powers(length)
    for i in range(length):
        before[:, i + 1] = before[:, i] * BASE + points[:, i]
    for i in range(length - 1, -1, -1):
        after[:, i] = points[:, i] * power[length - 1 - i] + after[:, i + 1]
    return before, after


def hashes(points: np.ndarray) -> np.ndarray:
    return _ends(points)[0][:, -1]


def _place(h: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """The block of each hash and its bits there."""
    x = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    bits = np.zeros_like(x)
    for i in range(BITS_A_WORD):
        bits |= np.uint64(1) << (x >> np.uint64(6 * i) & np.uint64(63))
    return (x >> np.uint64(34) & np.uint64(blocks - 1)).astype(np.int64), bits


def shard_of(length: int) -> int:
    return min(length, LAST_SHARD)


def shard_blocks(counts: dict[int, int]) -> dict[int, int]:
    """Blocks of each shard, a power of two, by its words; MAX_BLOCKS in all at most."""
    shrink = max(1.0, 2 * sum(counts.values()) / WORDS_A_BLOCK / MAX_BLOCKS)
    return {s: 1 << max(0, int(np.ceil(np.log2(max(1.0, n / WORDS_A_BLOCK / shrink))))) for s, n in counts.items()}


def _by_length(words: list[str]) -> dict[int, list[int]]:
    out: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        out.setdefault(len(w), []).append(i)
    return out


def bloom_filters(words: DataFrame) -> dict[int, np.ndarray]:
    """The filter of each shard; blocks are put together by Spark, and no more than MAX_BLOCKS numbers come to the driver."""
    shard = F.least(F.length("word"), F.lit(LAST_SHARD)).alias("shard")
    blocks = shard_blocks({r["shard"]: r["n"] for r in words.groupBy(shard).agg(F.count("*").alias("n")).collect()})

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            every = b.column(0).to_pylist()
            for length, rows in _by_length(every).items():
                s = shard_of(length)
                at, bits = _place(hashes(_points([every[i] for i in rows], length)), blocks[s])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), s, np.int32)), pa.array(at), pa.array(bits.view(np.int64))], names=["shard", "at", "bits"])

    found = words.select("word").mapInArrow(place, "shard int, at bigint, bits bigint").groupBy("shard", "at").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = {s: np.zeros(n, np.uint64) for s, n in blocks.items()}
    shards, at, bits = (found.column(c).to_numpy() for c in ("shard", "at", "bits"))
    for s in out:
        out[s][at[shards == s]] = bits[shards == s].view(np.uint64)
    return out


def probes(words: list[str], length: int, alphabet: np.ndarray, filters: dict[int, np.ndarray]) -> Iterator[tuple[np.ndarray, list[str]]]:
    """(positions in words, edited words) that the filters let pass: deletions, and replacements by a larger code point of the alphabet."""

    def passed(h: np.ndarray, shard: int) -> np.ndarray:
        if shard not in filters:
            return np.zeros(h.shape, bool)
        at, bits = _place(h, len(filters[shard]))
        return filters[shard][at] & bits == bits

    power = _powers(length)
    for lo in range(0, len(words), max(1, PROBES // length)):
        some = words[lo : lo + max(1, PROBES // length)]
        points = _points(some, length)
        before, after = _ends(points)
        if length > MIN_LENGTH:
            h = before[:, :-1] * power[:length][::-1] + after[:, 1:]
            again = np.zeros(points.shape, bool)
            again[:, 1:] = points[:, 1:] == points[:, :-1]  # the same word as by deleting the one before
            w, i = np.nonzero(passed(h, shard_of(length - 1)) & ~again)
            yield lo + w, [some[x][:k] + some[x][k + 1 :] for x, k in zip(w.tolist(), i.tolist(), strict=True)]
        for x in alphabet:
            h = before[:, -1:] + (x - points) * power[:length][::-1]
            w, i = np.nonzero(passed(h, shard_of(length)) & (points < x))
            yield lo + w, [some[j][:k] + chr(int(x)) + some[j][k + 1 :] for j, k in zip(w.tolist(), i.tolist(), strict=True)]


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, other, n_other): every pair of words (word, n) that differ by one inserted, deleted or replaced code point, both ways round."""
    spark = words.sparkSession
    filters = spark.sparkContext.broadcast(bloom_filters(words))
    letters = words.select(F.explode(F.array_distinct(F.split("word", ""))).alias("x")).where("x <> ''").distinct().collect()  # 90 code points make words
    alphabet = np.array(sorted(ord(r["x"]) for r in letters), np.uint64)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            every, counts = b.column(0).to_pylist(), b.column(1).to_numpy()
            for length, rows in _by_length(every).items():
                mine, at = [every[i] for i in rows], np.array(rows)
                for which, edited in probes(mine, length, alphabet, filters.value):
                    if edited:
                        src = at[which]
                        yield pa.RecordBatch.from_arrays([pa.array(edited, pa.string()), b.column(0).take(pa.array(src)), pa.array(counts[src])], names=["edited", "word", "n"])

    dealt = words.select("word", "n").repartition(shuffle_partitions(spark), "word")
    met = dealt.mapInArrow(probe, "edited string, word string, n bigint").join(words.toDF("edited", "n_edited"), "edited")
    side = lambda *c: F.struct(*(F.col(x).alias(y) for x, y in zip(c, ("word", "n", "other", "n_other"), strict=True)))
    return met.select(F.explode(F.array(side("word", "n", "edited", "n_edited"), side("edited", "n_edited", "word", "n"))).alias("p")).select("p.*")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for each word of forms (word, form): the end of its chain of forms. Each round doubles the steps; counts at least double along a chain, so there are few."""
    now = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        then = cut(now.join(on, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")))
        discard(now)
        if then.where("moved").isEmpty():
            return then.drop("moved")
        now = cut(then.drop("moved"))
        discard(then)


def spelling_variants(docs: DataFrame, times: int = 2, words_of: Callable[[DataFrame], DataFrame] = vocabulary) -> DataFrame:
    """(word, n, n_near, form, form_n, root) for each word of docs (doc_id, text).

    n_near counts the words that differ by one code point. form is the most frequent of
    these (of equal ones the smallest in code-point order) if it occurs times as often as the
    word, else null; root is the last form of the chain, or the word. Every row counts, also
    repeated ones and those without an id; null and empty texts have no words, an empty
    table gives no rows. Words of any length are whole. Other columns are ignored.
    """
    if times < 2:
        raise ValueError(f"times must be 2 or more, or forms may go in circles: {times}")
    words = cut(words_of(docs))
    best = F.min(F.struct((-F.col("n_other")).alias("less"), F.col("other")))
    near = cut(near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best")))
    joined = words.join(near, "word", "left")
    formed = cut(joined.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        *(F.when(-F.col("best.less") >= times * F.col("n"), c).alias(name) for name, c in (("form", F.col("best.other")), ("form_n", -F.col("best.less")))),
    ))
    discard(near)
    last = roots(formed.where("form is not null"))
    return formed.join(last, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def op12_spelling(spark, sf_dir: str) -> DataFrame:
    return spelling_variants(load(spark, sf_dir, "documents")).select("word", "form", "root", "n", "n_near", "form_n")
