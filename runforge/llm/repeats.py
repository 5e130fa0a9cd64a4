"""Suffix dedup of long repeats by column-wise multi-document construction.

Inserting one symbol of every document in each round takes as many rounds as the longest
document has bytes and rewrites the whole collection in each. What is asked for are strings
of LENGTH bytes only, so the collection is first cut down to short texts of one width that
can be aligned: a window's anchor is its smallest hash of GRAM bytes, and equal windows have
equal anchors at equal places. Around an anchor that occurs once nothing repeats. Occurrences
with the same bytes all around repeat as a whole. What is left, one text for each different
surrounding of a repeated anchor, goes through the column-wise construction: from the last
column to the first one symbol of every text is inserted, which updates the order of the
suffixes (their symbols are the collection's Burrows-Wheeler transform) and the common
prefixes of neighbours; runs of neighbours that share LENGTH bytes are the repeats.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runforge.llm.common import cut, load, shuffle_partitions

LENGTH = 100
GRAM = 32
#: Texts in one construction, at least, if there are so many; anchors are never torn apart.
TEXTS = 50_000
#: Anchors with more different surroundings than this are matched window by window instead.
HOT = 200_000
#: Bytes of documents hashed at a time.
CHUNK = 4_000_000
#: No byte of UTF-8; stands for what lies outside of a document.
OUTSIDE = 0xFF

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_OF_BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))


def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    p[:1] = 1
    return np.multiply.accumulate(p)


class Hashes:
    """Hashes of any substring of a joined text, from prefix sums."""

    def __init__(self, a: np.ndarray):
        self.sums = np.zeros(len(a) + 1, np.uint64)
        np.cumsum(_OF_BYTE[a] * _powers(_BASE, len(a)), out=self.sums[1:])
        self.back = _powers(_INVERSE, len(a) + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64))


def window_anchors(sizes: np.ndarray, a: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(document, place in it, hash of the gram, hash of all around) of the anchors of all windows of joined documents."""
    ends = np.cumsum(sizes)
    starts = ends - sizes
    if len(a) < length:
        return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.uint64, np.uint64))
    hashes = Hashes(a)
    at = np.arange(len(a) - gram + 1)
    value = hashes.of(at, at + gram)
    # The leftmost smallest value of each window, by doubling.
    width, w = length - gram + 1, 1
    low, place = value, at
    while w < width:
        step = min(w, width - w)
        right = low[step:] < low[:-step]
        low, place = np.where(right, low[step:], low[:-step]), np.where(right, place[step:], place[:-step])
        w += step
    inside = np.zeros(len(a) + 1, np.int64)
    long = sizes >= length
    np.add.at(inside, starts[long], 1)
    np.add.at(inside, ends[long] - length + 1, -1)
    anchors = np.unique(place[np.cumsum(inside)[: len(place)] > 0])
    doc = np.searchsorted(ends, anchors, side="right")
    left, right = np.maximum(anchors - (length - gram), starts[doc]), np.minimum(anchors + length, ends[doc])
    around = _mix(hashes.of(left, right) + (anchors - left).astype(np.uint64) * np.uint64(1009))
    return doc, anchors - starts[doc], value[anchors], around


def column_wise_repeats(texts: np.ndarray, length: int, first_columns: int) -> np.ndarray:
    """For texts, a row each and earlier ones first: whether the string at (text, column) is also at that column of an earlier text.

    texts has one byte for each column; columns from first_columns on begin no string.
    """
    n, columns = texts.shape
    order, common = np.arange(n), np.zeros(n, np.uint8)
    found = np.zeros((n, first_columns), bool)
    if n < 2:
        return found
    for j in range(columns - 1, -1, -1):
        symbols = texts[order, j]
        into = np.argsort(symbols, kind="stable")
        before = into[:-1]
        same = np.flatnonzero(symbols[into[1:]] == symbols[before])
        lo, hi = before[same] + 1, into[same + 1] + 1
        # Smallest common prefix in each range [lo, hi), from minima over powers of two.
        least = np.empty(len(same), np.uint8)
        level, minima = 0, common
        span = np.frexp((hi - lo).astype(np.float64))[1] - 1
        while len(same):
            here = span == level
            least[here] = np.minimum(minima[lo[here]], minima[hi[here] - (1 << level)])
            level += 1
            if level > span.max():
                break
            minima = np.minimum(minima[: -(1 << level - 1)], minima[1 << level - 1 :])
        order = order[into]
        common = np.zeros(n, np.uint8)
        common[same + 1] = np.minimum(least, 253) + 1
        if j < first_columns:
            heads = np.flatnonzero(common < length)
            earliest = np.minimum.reduceat(order, heads)
            found[order, j] = order != np.repeat(earliest, np.diff(np.append(heads, n)))
    return found


def _runs(found: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first, last) of the runs of true columns."""
    edge = np.diff(np.pad(found, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, first = np.nonzero(edge == 1)
    return row, first, np.nonzero(edge == -1)[1] - 1


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """(doc_id, text_hash, spans array<struct<first, end>>): bytes of each document that some repeated string covers; spans may overlap.

    docs has doc_id (an integer), text_hash (64 bits) and text, which may not be null. Rows of
    one (doc_id, text_hash) are one document: wherever places meet, the same place of the same
    document counts once, which spares a shuffle of whole texts. A string of length bytes is
    repeated if it also starts earlier: in a smaller (doc_id, text_hash), or before in the same
    document. Anchors are compared by two 64-bit hashes, what decides in the construction by bytes.
    """
    side = length - gram

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, marks = b.column(0), b.column(1).to_numpy()
            ranks, nulls = ids.fill_null(-(2**63)).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False)
            sizes = np.array([len(x.as_buffer()) for x in b.column(2)])
            for lo, hi in _chunks(sizes):
                joined = b"".join(x.as_py().encode() for x in b.column(2).slice(lo, hi - lo))
                doc, place, value, around = window_anchors(sizes[lo:hi], np.frombuffer(joined, np.uint8), length, gram)
                row = lo + doc
                # Of occurrences alike all around only the first goes on; the others are known
                # to repeat and are given anchors of their own, so that none gathers in one task.
                # Places met again in a row alike are left out.
                order = np.lexsort((place, marks[row], ranks[row], ~nulls[row], around, value))
                keys = [x[order] for x in (value, around, nulls[row], ranks[row], marks[row], place)]
                same = [x[1:] == x[:-1] for x in keys]
                again, alike = np.zeros(len(doc), bool), np.zeros(len(doc), bool)
                again[order[1:]] = same[0] & same[1]
                alike[order[1:]] = np.logical_and.reduce(same)
                own = _mix(marks[row].view(np.uint64) + place.astype(np.uint64) * np.uint64(_INVERSE) + np.arange(len(doc), dtype=np.uint64) * np.uint64(_BASE))
                value = np.where(again, _mix(value ^ own), value)
                row, place, value, around, again = (x[~alike] for x in (row, place, value, around, again))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(value.view(np.int64)), pa.array(around.view(np.int64)), ids.take(pa.array(row)), pa.array(marks[row]), pa.array(place), pa.array(again)],
                    names=["anchor", "around", "doc_id", "text_hash", "place", "again"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    all_anchors = docs.select("doc_id", "text_hash", "text").mapInArrow(anchors, f"anchor bigint, around bigint, doc_id {kind}, text_hash bigint, place bigint, again boolean")
    of_anchor = Window.partitionBy("anchor")
    in_order = of_anchor.orderBy("around", "doc_id", "text_hash", "place")
    me = F.struct("around", "doc_id", "text_hash", "place")
    marked = cut(
        all_anchors.withColumns({"first": F.coalesce(F.lag("around").over(in_order) != F.col("around"), F.lit(True)), "alike": F.lag(me).over(in_order).eqNullSafe(me)})
        .withColumn("kinds", F.sum(F.col("first").cast("int")).over(of_anchor))
        .where("not alike and (again or not first or kinds > 1)")
        .select("anchor", "doc_id", "text_hash", "place", (F.col("again") | ~F.col("first")).alias("whole"), (F.col("kinds") > hot).alias("hot"))
    )
    whole = marked.where("whole").select("doc_id", "text_hash", (F.col("place") - side).alias("first"), (F.col("place") + length).alias("end"))

    asked = marked.where("not whole").groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("anchor", "place", "hot")).alias("asked"))
    a = asked.select(F.col("doc_id").alias("a_id"), F.col("text_hash").alias("a_hash"), "asked")
    text_of = docs.select("doc_id", "text_hash", "text")
    around_of = text_of.join(a, text_of["doc_id"].eqNullSafe(a["a_id"]) & (text_of["text_hash"] == a["a_hash"])).select("doc_id", "text_hash", "text", "asked")

    def texts_around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for b in batches:
            for part in range(0, b.num_rows, 200):
                rows = []
                for r in b.slice(part, 200).to_pylist():
                    # Most rows alike follow each other here; construct() passes over the others.
                    if last == (last := (r["doc_id"], r["text_hash"])):
                        continue
                    raw = r["text"].encode()
                    for x in r["asked"]:
                        p = x["place"]
                        left, right = raw[max(0, p - side) : p], raw[p : p + length]
                        rows.append((x["anchor"], r["doc_id"], r["text_hash"], p, x["hot"], left.rjust(side, b"\xff") + right.ljust(length, b"\xff")))
                cols = zip(*rows, strict=True) if rows else [[]] * 6
                kinds = [pa.int64(), b.schema.field("doc_id").type, pa.int64(), pa.int64(), pa.bool_(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds, strict=True)], names=["anchor", "doc_id", "text_hash", "place", "hot", "around"])

    around_of = around_of.mapInArrow(texts_around, f"anchor bigint, doc_id {kind}, text_hash bigint, place bigint, hot boolean, around binary")

    def construct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_anchors(batches):
            ids = t["doc_id"].combine_chunks()
            keys = (t["anchor"].to_numpy(), t["place"].to_numpy(), t["text_hash"].to_numpy(), ids.fill_null(-(2**63)).to_numpy(), ids.is_valid().to_numpy(zero_copy_only=False))
            order = np.lexsort(keys)
            new = np.append(True, np.logical_or.reduce([np.diff(k[order]) != 0 for k in keys]))
            t = t.take(pa.array(order[new]))
            texts = np.frombuffer(b"".join(t["around"].to_pylist()), np.uint8).reshape(t.num_rows, side + length)
            found = column_wise_repeats(texts, length, side + 1)
            # Strings that reach outside of their document are none.
            inside = texts != OUTSIDE
            from_left = np.argmax(inside, axis=1)
            to_right = side + length - np.argmax(inside[:, ::-1], axis=1)
            j = np.arange(side + 1)
            row, first, last = _runs(found & (j >= from_left[:, None]) & (j + length <= to_right[:, None]))
            place = t["place"].to_numpy()[row]
            yield pa.RecordBatch.from_arrays(
                [t["doc_id"].combine_chunks().take(pa.array(row)), pa.array(t["text_hash"].to_numpy()[row]), pa.array(place - side + first), pa.array(place - side + last + length)],
                names=["doc_id", "text_hash", "first", "end"],
            )

    spans = f"doc_id {kind}, text_hash bigint, first bigint, end bigint"
    n = shuffle_partitions(docs.sparkSession)
    edges = around_of.where("not hot").select("anchor", "doc_id", "text_hash", "place", "around").repartition(n, "anchor").sortWithinPartitions("anchor").mapInArrow(construct, spans)
    every = whole.unionByName(edges)
    if marked.where("hot").head(1):
        every = every.unionByName(_hot_spans(around_of.where("hot"), length, side))
    return every.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("first", "end")).alias("spans"))


def _hot_spans(around_of: DataFrame, length: int, side: int) -> DataFrame:
    """Spans of anchors with very many surroundings: their windows are compared one by one, grouped by content."""
    window = F.substring(F.col("around"), F.col("j") + 1, F.lit(length))
    each = (
        around_of.select("anchor", "doc_id", "text_hash", "place", "around", F.explode(F.sequence(F.lit(0), F.lit(side))).alias("j"))
        .withColumn("w", window)
        .where(~F.hex("w").rlike("^(..)*FF"))  # strings that reach outside of their document
        .select("anchor", "j", F.xxhash64("w").alias("w1"), F.xxhash64(F.lit(1), "w").alias("w2"), F.struct("doc_id", "text_hash", "place").alias("me"))
    )
    firsts = each.groupBy("anchor", "j", "w1", "w2").agg(F.min("me").alias("least"))
    again = each.join(firsts, ["anchor", "j", "w1", "w2"]).where(~F.col("me").eqNullSafe(F.col("least")))
    place = F.col("me.place") - side + F.col("j")
    return again.select("me.doc_id", "me.text_hash", place.alias("first"), (place + length).alias("end"))


def _chunks(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    lo, held = 0, 0
    for i, n in enumerate(sizes):
        held += n
        if held >= CHUNK:
            yield lo, i + 1
            lo, held = i + 1, 0
    if lo < len(sizes):
        yield lo, len(sizes)


def _whole_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of TEXTS rows or more, of rows sorted by anchor, that part no anchor."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        rows += b.num_rows
        if rows >= TEXTS:
            t = pa.Table.from_batches(held)
            anchor = t["anchor"].to_numpy()
            cut_at = int(np.searchsorted(anchor, anchor[-1])) if (np.diff(anchor) >= 0).all() else 0
            if cut_at:
                yield t.slice(0, cut_at)
                held = t.slice(cut_at).combine_chunks().to_batches()
                rows = t.num_rows - cut_at
    if held:
        yield pa.Table.from_batches(held)


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """(doc_id, n_bytes, n_removed, removed array<struct<first, end>>, kept binary) for every document.

    Texts are UTF-8 bytes, null is empty. Removed is each byte that a string of length bytes
    covers which also starts earlier: in a document with a smaller doc_id, or before in the
    same one. removed has the maximal runs in order, kept all other bytes. Rows alike in
    doc_id and text are one document, and each of them has what it keeps; rows of one doc_id
    with different texts are told apart and ordered by a 64-bit hash of the text, a null
    doc_id comes first. Texts under length bytes stay whole.
    doc_id is an integer; other columns are ignored.
    """
    if not 0 < gram <= length <= 250:
        raise ValueError("gram and length must satisfy 0 < gram <= length <= 250")
    src = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    spans = repeated_spans(src, length, gram, hot)
    s = spans.select(F.col("doc_id").alias("s_id"), F.col("text_hash").alias("s_hash"), "spans")
    joined = src.join(s, src["doc_id"].eqNullSafe(s["s_id"]) & (src["text_hash"] == s["s_hash"]), "left").select("doc_id", "text", "spans")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in range(0, b.num_rows, 500):
                c = b.slice(part, 500)
                n_bytes, removed, kept = [], [], []
                for t, found in zip(c.column(1).to_pylist(), c.column(2), strict=True):
                    raw = t.encode()
                    runs = _merged(found.values, len(raw)) if found.is_valid else []
                    at, out = 0, []
                    for first, end in runs:
                        out.append(raw[at:first])
                        at = end
                    n_bytes.append(len(raw))
                    removed.append([{"first": f, "end": e} for f, e in runs])
                    kept.append(b"".join([*out, raw[at:]]))
                n_removed = [n - len(k) for n, k in zip(n_bytes, kept, strict=True)]
                runs_type = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
                yield pa.RecordBatch.from_arrays([c.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(removed, runs_type), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "removed", "kept"])

    return joined.mapInArrow(apply, "doc_id bigint, n_bytes bigint, n_removed bigint, removed array<struct<first: bigint, end: bigint>>, kept binary")


def _merged(spans: pa.StructArray, n: int) -> list[tuple[int, int]]:
    """Maximal runs of the bytes that spans cover in a text of n bytes."""
    first = np.maximum(spans.field("first").to_numpy(), 0)
    end = np.minimum(spans.field("end").to_numpy(), n)
    order = np.argsort(first, kind="stable")
    first, end = first[order], np.maximum.accumulate(end[order])
    new = np.flatnonzero(np.append(True, first[1:] > end[:-1]))
    return list(zip(first[new].tolist(), end[np.append(new[1:] - 1, len(end) - 1)].tolist(), strict=True))


def op9_repeats(spark, sf_dir: str) -> DataFrame:
    done = remove_repeats(load(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
