"""Components of texts whose shingle sets are similar, from inverted lists of shared keys.

The lists that have the same smallest member (their hub) are one group: whoever shares a list
shares a group, and a text is in few groups however many lists it is in. A group is dealt out
in tiles: sets meet tile by tile in tasks of bounded size, however large the group is, and
each task gives a star for each component that it finds, not its pairs. In a tile the
numbers of shared retained hashes (the smallest k of each set) are counted for all pairs at
once; pairs below the guaranteed minimum fall, the union-sketch estimate drops more, and
exact Jaccard decides unless the two are joined already.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runforge.llm.common import cut, discard, row_key, shuffle_partitions
from runforge.llm.components import connected_components

#: Hashes of a sketch, and of these those that are looked at first; how unlikely a similar pair may be to fall below least_shared().
SKETCH, FIRST, MISS = 128, 32, 1e-12
#: Members and shingles of a tile; a tile task holds two.
TILE_SETS, TILE_SHINGLES = 800, 1 << 20
#: Hashes that more members of a tile share are counted by matrix products, of this many columns at once.
COMMON, COLUMNS = 12, 1024
MANY_PAIRS = 8


def node_of(h: np.ndarray) -> int:
    """A set's name: 64 bits of its hashes."""
    return int(np.frombuffer(xxhash.xxh64_digest(h.tobytes(), 11), ">i8")[0])


def least_shared(k: int, similarity: float) -> int:
    """The most t for which fewer than t of the k smallest hashes of a union are shared with a probability of MISS at most."""
    total = 0.0
    for t in range(k + 1):
        total += math.exp(math.lgamma(k + 1) - math.lgamma(t + 1) - math.lgamma(k - t + 1) + t * math.log(similarity) + (k - t) * math.log1p(-similarity)) if similarity < 1 else float(t == k)
        if total > MISS:
            return max(t, 1)
    return k


def least_overlap(n: Column, k: int, similarity: float) -> Column:
    """How many retained hashes a set of n shares with any similar one: exact where both must be whole."""
    return F.when(n <= math.floor(similarity * k + 1e-9), F.ceil(n * similarity - 1e-9)).otherwise(least_shared(k, similarity)).cast("int")


def _least_overlap(n: np.ndarray, k: int, similarity: float) -> np.ndarray:
    return np.where(n <= math.floor(similarity * k + 1e-9), np.ceil(n * similarity - 1e-9), least_shared(k, similarity)).astype(np.int64)


def overlaps(values: np.ndarray, owner: np.ndarray, m: int) -> np.ndarray:
    """How many values each two of m owners share; (value, owner) pairs are distinct."""
    order = np.lexsort((owner, values))
    values, owner = values[order], owner[order]
    starts = np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(values) else np.empty(0, np.int64)
    sizes = np.diff(np.r_[starts, len(values)])
    pairs = []
    for size in range(2, min(COMMON, m) + 1):
        first = starts[sizes == size]
        if len(first):
            at = owner[first[:, None] + np.arange(size)]
            i, j = np.triu_indices(size, 1)
            pairs.append((at[:, i] * m + at[:, j]).ravel())
    few = np.bincount(np.concatenate(pairs), minlength=m * m).reshape(m, m) if pairs else np.zeros((m, m), np.int64)
    out = (few + few.T).astype(np.float32)
    many = np.flatnonzero(sizes > COMMON)
    for lo in range(0, len(many), COLUMNS):
        some = many[lo : lo + COLUMNS]
        held = np.zeros((m, len(some)), np.float32)
        for c, (s, n) in enumerate(zip(starts[some], sizes[some], strict=True)):
            held[owner[s : s + n], c] = 1
        out += held @ held.T
    return out.astype(np.int64)


def union_estimate(a: np.ndarray, b: np.ndarray, k: int) -> tuple[int, int]:
    """(shared, size) of the k smallest of the union of two sketches."""
    both = np.sort(np.concatenate([a, b]))
    twice = both[1:] == both[:-1]
    first = np.r_[True, ~twice]
    rank = np.cumsum(first)
    return int((twice & (rank[:-1] <= k)).sum()), min(k, int(rank[-1]))


def stars(sets: list[np.ndarray], similarity: float, k: int = SKETCH, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """(member, smallest member of its component) for the sets, sorted arrays of hashes, that are similar to others.

    With side, pairs of one side are left out; its own tile task has them. Where more than
    MANY_PAIRS pairs a set are left by their sketches, as in a host's pages that share most
    of their text, all shared shingles are counted at once instead of pair by pair.
    """
    m = len(sets)
    n = np.array([len(s) for s in sets], np.int64)
    sketches = [s[:k] for s in sets]
    shared = overlaps(np.concatenate(sketches), np.repeat(np.arange(m), [len(s) for s in sketches]), m)
    need = _least_overlap(n, k, similarity)
    fits = np.triu(shared >= np.maximum(need[:, None], need[None, :]), 1) & (np.minimum(n[:, None], n[None, :]) >= similarity * np.maximum(n[:, None], n[None, :]) - 1e-9)
    if side is not None:
        fits &= side[:, None] != side[None, :]
    x, y = np.nonzero(fits)
    up = np.arange(m)

    def top(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(i: int, j: int) -> None:
        i, j = top(i), top(j)
        up[max(i, j)] = min(i, j)

    def settle() -> None:
        while (up[up] != up).any():
            up[:] = up[up]

    both = np.minimum(n[x], k) + np.minimum(n[y], k) - shared[x, y]
    whole = (n[x] <= k) & (n[y] <= k)  # the sketches are the sets
    alike = whole & (shared[x, y] >= similarity * both - 1e-9)
    for i, j in zip(x[alike].tolist(), y[alike].tolist(), strict=True):
        if up[i] != up[j]:
            join(i, j)
    settle()
    x, y = x[~whole], y[~whole]
    if len(x) > MANY_PAIRS * m:
        inter = overlaps(np.concatenate(sets), np.repeat(np.arange(m), n), m)[x, y]
        alike = inter >= similarity * (n[x] + n[y] - inter) - 1e-9
        for i, j in zip(x[alike].tolist(), y[alike].tolist(), strict=True):
            if up[i] != up[j]:
                join(i, j)
        x, y = x[:0], y[:0]
    order = np.argsort(-shared[x, y], kind="stable")
    x, y, lo, step = x[order], y[order], 0, m
    least = least_shared(k, similarity)
    while lo < len(x):
        for i, j in zip(x[lo : lo + step].tolist(), y[lo : lo + step].tolist(), strict=True):
            if top(i) == top(j):
                continue
            meet, of = union_estimate(sketches[i], sketches[j], k)
            if meet < (least if of == k else similarity * of - 1e-9):
                continue
            inter = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if inter >= similarity * (n[i] + n[j] - inter) - 1e-9:
                join(i, j)
        lo += step
        settle()
        # What has come together meanwhile needs no more looking at.
        open_ = up[x[lo:]] != up[y[lo:]]
        x, y, lo = x[lo:][open_], y[lo:][open_], 0
    settle()
    return [(i, int(up[i])) for i in range(m) if up[i] != i]


def groups_of(posted: DataFrame, similarity: float) -> DataFrame:
    """(hub, node, n, m, weight) from distinct (key, node, n): members of the lists with this hub, itself included; m and weight are the group's sets and shingles."""
    ends = posted.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("last")).where("hub <> last").select("key", "hub")
    member = cut(posted.join(ends, "key").select("hub", "node", "n").distinct())
    size = member.groupBy("hub").agg(F.count("*").alias("m"), F.sum("n").alias("weight"), F.min("n").alias("lo"), F.max("n").alias("hi"))
    return member.join(size.where(f"m > 2 or lo >= {similarity} * hi - 1e-9").select("hub", "m", "weight"), "hub")


def tiles_of(groups: DataFrame) -> DataFrame:
    """(hub, i, j, side, node, n): every two tiles of a group, and a tile with itself, once."""
    parts = F.greatest(F.ceil(F.col("m") / TILE_SETS), F.ceil(F.col("weight") / TILE_SHINGLES)).cast("int")
    mine = groups.withColumn("parts", parts).withColumn("t", F.pmod(F.xxhash64("node", F.lit(1)), F.col("parts")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("o")
    return mine.select("hub", "node", "n", "t", other).select("hub", F.least("t", "o").alias("i"), F.greatest("t", "o").alias("j"), F.col("t").alias("side"), "node", "n")


def _tile_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int, int], list[tuple]]]:
    """((hub, i, j), rows) of each tile from rows in this order; the rows without hub, i and j, and Arrow's value last."""
    held: list[tuple] = []
    now = None
    for b in batches:
        cols = [b.column(c).to_pylist() for c in range(b.num_columns - 1)]
        for r, (hub, i, j, *rest) in enumerate(zip(*cols, strict=True)):
            if held and (hub, i, j) != now:
                yield now, held
                held = []
            now = (hub, i, j)
            held.append((*rest, b.column(b.num_columns - 1)[r]))
    if held:
        yield now, held


def _in_tiles(rows: DataFrame) -> DataFrame:
    return rows.repartition(shuffle_partitions(rows.sparkSession), "hub", "i", "j").sortWithinPartitions("hub", "i", "j")


def may_match(sketches: list[np.ndarray], n: np.ndarray, similarity: float, side: np.ndarray | None) -> np.ndarray:
    """Which sets have one in the tile that their sizes and FIRST smallest hashes don't rule out."""
    owner = np.repeat(np.arange(len(sketches)), [len(s) for s in sketches])
    need = _least_overlap(n, FIRST, similarity)
    fits = overlaps(np.concatenate(sketches), owner, len(sketches)) >= np.maximum(need[:, None], need[None, :])
    fits &= np.minimum(n[:, None], n[None, :]) >= similarity * np.maximum(n[:, None], n[None, :]) - 1e-9
    np.fill_diagonal(fits, False)
    if side is not None:
        fits &= side[:, None] != side[None, :]
    return fits.any(0)


def similar_components(posted: DataFrame, sketches: DataFrame, texts_of: Callable[[DataFrame], DataFrame], sets_of: Callable[[str], np.ndarray], similarity: float) -> DataFrame:
    """(node, label) of the nodes in posted (key, node, n) that are similar to others; label is the smallest node of the component.

    sketches has (node, sketch), the FIRST smallest hashes or more. texts_of gives (node, text)
    for nodes that it is given as (node), each once; sets_of gives a text's shingles as
    sorted hashes. Every two similar nodes must share a key. Tiles are looked at twice: by
    the first hashes, and by texts for those that these leave.
    """
    groups = cut(groups_of(posted, similarity))
    tiles = tiles_of(groups).join(sketches.select("node", F.slice("sketch", 1, FIRST).alias("sketch")), "node").select("hub", "i", "j", "side", "node", "n", "sketch")

    def left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (hub, i, j), rows in _tile_rows(batches):
            side, node = (np.array([r[c] for r in rows]) for c in (0, 1))
            keep = may_match([r[3].values.to_numpy() for r in rows], np.array([r[2] for r in rows]), similarity, side if i != j else None)
            k = int(keep.sum())
            cols = [np.full(k, hub), np.full(k, i, np.int32), np.full(k, j, np.int32), side[keep].astype(np.int32), node[keep]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["hub", "i", "j", "side", "node"])

    some = cut(_in_tiles(tiles).mapInArrow(left, "hub bigint, i int, j int, side int, node bigint"))
    discard(groups)
    dealt = some.join(texts_of(some.select("node").distinct()), "node").select("hub", "i", "j", "side", "node", "text")

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, i, j), rows in _tile_rows(batches):
            star = stars([sets_of(r[2].as_py()) for r in rows], similarity, side=np.array([r[0] for r in rows]) if i != j else None)
            yield pa.RecordBatch.from_arrays([pa.array([rows[p[c]][1] for p in star], pa.int64()) for c in (0, 1)], names=["a", "b"])

    links = cut(_in_tiles(dealt).mapInArrow(met, "a bigint, b bigint"))
    discard(some)
    return connected_components(links)


def texts_by_node(docs: DataFrame, rows: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """texts_of for similar_components(): from docs (doc_id, text) and rows (doc_id, row_key, node), a text for each node that is asked for."""

    def of(asked: DataFrame) -> DataFrame:
        known = rows.join(asked, "node", "left_semi").groupBy("node").agg(F.min("row_key").alias("r_key"))
        # Rows that are repeated become one in the tasks that read them.
        each = docs.select(row_key("doc_id", "text").alias("r_key"), "text").groupBy("r_key").agg(F.first("text").alias("text"))
        return each.join(known, "r_key").select("node", "text")

    return of
