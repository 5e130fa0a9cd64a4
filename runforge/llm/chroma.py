"""Media columns: chroma fingerprints of audio, and recordings aligned by them.

Frames of a signal are folded into twelve pitch classes; 32 differences of rectangle sums over
an integral image of these give the bits of one integer for each position. Integers are posted
under three of their four bytes, where these change and at intervals while they are held, so
that thinning goes by content and excerpts post what their recordings post. Postings that meet
vote for an offset of two recordings, once a position, and at each offset with enough votes
the bits that differ are counted position by position. Recordings with the same integers are
one class and are compared once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runforge.llm.common import cut, load

RATE, FRAME, HOP, SPAN = 4000, 1024, 256, 16
#: Frames transformed at once, so that a recording of hours needs no more memory than its samples.
FRAMES_AT_ONCE = 4096
#: Three bytes that are held post again after so many positions.
HOLD = SPAN // 2
#: Positions that must agree on an offset; share of wrong bits that the best stretch may have, and its least number of positions.
MIN_VOTES, MAX_BIT_ERROR, MIN_STRETCH = 2, 0.2, 24


def _to_classes() -> np.ndarray:
    """From spectrum bins of 100 to 1800 Hz to pitch classes; A is 0."""
    hz = np.fft.rfftfreq(FRAME, 1 / RATE)
    m = np.zeros((len(hz), 12))
    for i, f in enumerate(hz):
        if 100 <= f <= 1800:
            m[i, round(12 * np.log2(f / 440)) % 12] = 1
    return m


_CLASSES = _to_classes()


def chroma_frames(signal: np.ndarray) -> np.ndarray:
    """The shares of the pitch classes in each frame, a row each; zeros where nothing sounds."""
    n = max(0, (len(signal) - FRAME) // HOP + 1)
    out = np.zeros((n, 12))
    for part in range(0, n, FRAMES_AT_ONCE):
        some = signal[part * HOP : (min(n, part + FRAMES_AT_ONCE) - 1) * HOP + FRAME].astype(float)
        frames = np.lib.stride_tricks.sliding_window_view(some, FRAME)[::HOP] * np.hanning(FRAME)
        chroma = np.abs(np.fft.rfft(frames, axis=1)) @ _CLASSES
        norm = np.linalg.norm(chroma, axis=1, keepdims=True)
        out[part : part + len(frames)] = np.where(norm > 1e-6, chroma / np.maximum(norm, 1e-6), 0)
    return out


def fingerprint(signal: np.ndarray) -> np.ndarray:
    """One unsigned 32-bit integer for each position; none for signals shorter than SPAN frames, 0 where nothing sounds."""
    chroma = chroma_frames(signal)
    n = len(chroma)
    if n < SPAN:
        return np.empty(0, np.uint32)
    image = np.zeros((n + 1, 13))
    image[1:, 1:] = chroma.cumsum(0).cumsum(1)
    at = np.arange(n - SPAN + 1)

    def box(t0: int, t1: int, c0: int, c1: int) -> np.ndarray:
        return image[at + t1, c1] - image[at + t0, c1] - image[at + t1, c0] + image[at + t0, c0]

    out = np.zeros(len(at), np.uint32)
    for i in range(32):
        c, w = i % 12, 1 + i // 12
        end = min(c + w, 12)
        if i < 12:  # a class against the mean of all
            a = 12 * box(0, SPAN, c, end) - box(0, SPAN, 0, 12)
        else:  # a band of classes, the first half against the second
            a = box(0, SPAN // 2, c, end) - box(SPAN // 2, SPAN, c, end)
        out |= (a > 1e-9).astype(np.uint32) << np.uint32(i)
    return out


def audio_fingerprints(media: DataFrame) -> DataFrame:
    """(media_id, prints array<bigint>) for every row of media (media_id, pcm binary: 16-bit little-endian mono at RATE).

    Null, empty and short audio has no prints; an odd last byte is passed over. Long
    recordings are transformed FRAMES_AT_ONCE frames at a time. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in range(0, b.num_rows, 200):
                c = b.slice(part, 200)
                prints = [fingerprint(np.frombuffer(x[: len(x) // 2 * 2], "<i2")).astype(np.int64) for x in (y or b"" for y in c.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([c.column(0), pa.array(prints, pa.list_(pa.int64()))], names=["media_id", "prints"])

    return media.select("media_id", "pcm").mapInArrow(run, "media_id bigint, prints array<bigint>")


def print_classes(prints: DataFrame) -> DataFrame:
    """(class_key, class_id, prints): each different list of integers once, with the smallest media_id that has it; recordings without any have no class."""
    some = prints.where("size(prints) > 0").select("media_id", "prints", F.xxhash64("prints").alias("class_key"))
    return some.groupBy("class_key").agg(F.min("media_id").alias("class_id"), F.any_value("prints").alias("prints"))


def posted_at(prints: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each of four lists, of which each leaves out one byte, the places in prints that post in it: where the other bytes change, and each HOLD-th after that. Silence posts nothing; first marks where a recording begins."""
    at = np.arange(len(prints))
    for i in range(4):
        x = prints & (0xFFFFFFFF ^ 0xFF << 8 * i)
        changed = first.copy()
        changed[1:] |= x[1:] != x[:-1]
        since = at - np.maximum.accumulate(np.where(changed, at, 0))
        yield i, np.flatnonzero((prints != 0) & (since % HOLD == 0))


def _posted(classes: DataFrame, side: str) -> DataFrame:
    """(posting, list, key, at, integer) of classes, the last four named by side."""
    names = ["posting", f"{side}_list", f"{side}_key", f"{side}_at", f"{side}_v"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in range(0, b.num_rows, 1000):
                c = b.slice(part, 1000)
                sizes = np.array([len(p) for p in c.column(1)], np.int64)
                v = c.column(1).flatten().to_numpy()
                starts = np.cumsum(sizes) - sizes
                key, place = np.repeat(c.column(0).to_numpy(), sizes), np.arange(len(v)) - np.repeat(starts, sizes)
                for i, at in posted_at(v, place == 0):
                    x = v[at]
                    cols = [x & (0xFFFFFFFF ^ 0xFF << 8 * i) | i << 32, np.full(len(at), i, np.int32), key[at], place[at].astype(np.int32), x]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=names)

    kinds = ("bigint", "int", "bigint", "int", "bigint")
    return classes.select("class_key", "prints").mapInArrow(run, ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True)))


def best_stretch(q: np.ndarray, m: np.ndarray, offset: int) -> tuple[float, int, float]:
    """(score, positions, bit error) of the stretch in which q laid at offset of m agrees best.

    A position scores the wrong bits that the bound allows less those it has; the stretch
    with the largest sum, then the longest, then the first, is taken, so that its error is within the bound.
    """
    lo, hi = max(0, -offset), min(len(q), len(m) - offset)
    if hi <= lo:
        return 0.0, 0, 1.0
    wrong = np.bitwise_count(q[lo:hi] ^ m[lo + offset : hi + offset]).astype(np.int64)
    sums = np.concatenate([[0], np.cumsum(round(3200 * MAX_BIT_ERROR) - 100 * wrong)])
    low = np.minimum.accumulate(sums)
    gain = sums - low
    end = len(gain) - 1 - int(np.argmax(gain[::-1]))
    start = int(np.argmax(sums[: end + 1] == low[end]))
    n = end - start
    return float(gain[end]) / 100, n, float(wrong[start:end].sum()) / (32 * n) if n else 1.0


def align(queries: DataFrame, prints: DataFrame) -> DataFrame:
    """(query_key, query_class, media_key, media_class, offset, votes, n_positions, bit_error): different classes of recordings of which a stretch agrees.

    queries and prints have media_id and prints, of which classes are made by
    print_classes(); a class is named by its key and by its smallest media_id. Postings are
    joined by list, so that work follows those that meet, and votes are added up before they
    are shuffled. Every offset with MIN_VOTES votes is tested, however little overlaps: its
    best stretch must have MIN_STRETCH positions and at most MAX_BIT_ERROR of its bits wrong,
    so that an excerpt or a jingle inside recordings that differ otherwise is found. Of the
    offsets that pass, that of the best stretch is given, then the smallest. Rows without
    prints find nothing, repeated rows are in one class, rows with null ids take part.
    Stretches that share three bytes at less than two posted positions are missed: the search
    is probabilistic, see README for its recall by length and noise.
    """
    q, m = print_classes(queries), print_classes(prints)
    # Integers that are the same meet in all four lists and vote in the first only.
    once = "query.posting = media.posting and query_key <> media_key and (query_list = 0 or query_v <> media_v)"
    met = _posted(q, "query").alias("query").join(_posted(m, "media").alias("media"), F.expr(once))
    votes = met.groupBy("query_key", "media_key", (F.col("media_at") - F.col("query_at")).cast("bigint").alias("offset")).agg(F.count("*").alias("votes")).where(F.col("votes") >= MIN_VOTES)
    asked = cut(votes.groupBy("query_key", "media_key").agg(F.collect_list(F.struct("offset", "votes")).alias("offsets")))
    both = (
        asked.join(q.toDF("query_key", "query_class", "q_prints"), "query_key")
        .join(m.toDF("media_key", "media_class", "m_prints"), "media_key")
        .select("query_key", "query_class", "media_key", "media_class", "offsets", "q_prints", "m_prints")
    )

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["offset", "votes", "n_positions", "bit_error"]
        for b in batches:
            for part in range(0, b.num_rows, 1000):
                c = b.slice(part, 1000)
                rows, found = [], []
                offsets, q_prints, m_prints = (c.column(i) for i in (4, 5, 6))
                for i in range(c.num_rows):
                    x, y = (np.asarray(p[i].values) for p in (q_prints, m_prints))
                    tried = []
                    for o in offsets[i].as_py():
                        score, n, error = best_stretch(x, y, o["offset"])
                        if n >= MIN_STRETCH:
                            tried.append((-score, o["offset"], o["votes"], n, error))
                    if tried:
                        rows.append(i)
                        found.append(min(tried)[1:])
                kept = c.take(pa.array(rows, pa.int64()))
                cols = zip(*found, strict=True) if found else [[]] * 4
                yield pa.RecordBatch.from_arrays([*kept.columns[:4], *(pa.array(list(v), t) for v, t in zip(cols, [*[pa.int64()] * 3, pa.float64()], strict=True))], names=[*c.schema.names[:4], *names])

    return both.mapInArrow(test, "query_key bigint, query_class bigint, media_key bigint, media_class bigint, offset bigint, votes bigint, n_positions bigint, bit_error double")


def search(queries: DataFrame, prints: DataFrame) -> DataFrame:
    """A row for every row of prints: (media_id, class_id, n_prints, n_links, query_ids, best_query, offset, votes, n_positions, bit_error).

    class_id is the smallest media_id with the same integers, null without any. query_ids
    are the classes of queries that align with the row's class (each by its smallest id, its own
    left out), n_links their number; best_query and what follows are of the one with the
    lowest bit error, then the most positions, then the smallest id, null if there is none.
    """
    pairs = align(queries, prints)
    best = F.struct("bit_error", (-F.col("n_positions")).alias("fewer"), F.col("query_class").alias("best_query"), "offset", "votes", "n_positions")
    links = pairs.groupBy(F.col("media_key").alias("class_key")).agg(F.sort_array(F.collect_list("query_class")).alias("query_ids"), F.min(best).alias("best"))
    classes = print_classes(prints).drop("prints").join(links, "class_key", "left")
    rows = prints.select("media_id", F.coalesce(F.size("prints"), F.lit(0)).alias("n_prints"), F.when(F.size("prints") > 0, F.xxhash64("prints")).alias("class_key"))
    return rows.join(classes, "class_key", "left").select(
        "media_id", "class_id", F.col("n_prints").cast("bigint").alias("n_prints"), F.coalesce(F.size("query_ids"), F.lit(0)).cast("bigint").alias("n_links"),
        F.coalesce("query_ids", F.array().cast("array<bigint>")).alias("query_ids"), *(F.col(f"best.{c}").alias(c) for c in ("best_query", "offset", "votes", "n_positions", "bit_error")),
    )


#: Samples of one chord, and the pitch of its first note.
CHORD, LOWEST = 8 * HOP, 880.0


def tones(embeddings: DataFrame) -> DataFrame:
    """Vectors as audio: twelve values at a time sound together for half a second, each at its own pitch and as loud as it is large.

    Loudness follows a value without steps, so that vectors that hardly differ sound alike.
    The last chord is filled up from the first values. Null values are silent.
    """
    t = np.arange(CHORD) / RATE
    notes = np.sin(2 * np.pi * LOWEST * 2 ** (np.arange(12)[:, None] / 12) * t + np.arange(12)[:, None])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in range(0, b.num_rows, 200):
                c = b.slice(part, 200)
                pcm = []
                for v in c.column(1).to_pylist():
                    x = np.array([np.nan if a is None else a for a in v or []], float)
                    level = np.where(np.isnan(x), 0, np.clip(1 + 3 * np.nan_to_num(x), 0, 2.2))
                    chords = np.resize(level, (-(-len(x) // 12), 12)) if len(x) else np.empty((0, 12))
                    pcm.append((1200 * chords @ notes).ravel().astype("<i2").tobytes())
                yield pa.RecordBatch.from_arrays([c.column(0), pa.array(pcm, pa.binary())], names=["media_id", "pcm"])

    return embeddings.select(F.col("vec_id").alias("media_id"), "embedding").mapInArrow(run, "media_id bigint, pcm binary")


def op5_chroma(spark, sf_dir: str) -> DataFrame:
    """All vectors, by the audio derived from them; queries are those whose id is divisible by 100."""
    prints = cut(audio_fingerprints(tones(load(spark, sf_dir, "embeddings"))))
    return search(prints.where("media_id % 100 = 0"), prints)
