"""Audio fingerprints and their alignment, against brute force over all pairs and offsets."""

from __future__ import annotations

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from runforge.llm import chroma


def song(rng, n, samples=800):
    t = np.arange(samples) / chroma.RATE
    return np.concatenate([8000 * np.sin(2 * np.pi * 220 * 2 ** (rng.integers(0, 24) / 12) * t) for _ in range(n)])


def media_of(spark, rows):
    return spark.createDataFrame([(i, None if x is None else x.astype("<i2").tobytes()) for i, x in rows], "media_id bigint, pcm binary")


def test_recordings_align(spark):
    rng = np.random.default_rng(1)
    a, b = song(rng, 60), song(rng, 60)
    shifted = np.concatenate([rng.normal(0, 50, 10 * chroma.HOP), a + rng.normal(0, 50, len(a))])
    prints = chroma.audio_fingerprints(media_of(spark, [(1, a), (2, shifted), (3, b), (4, np.zeros(100)), (5, np.zeros(0)), (6, None), (7, np.zeros(40000))]))
    assert {r.media_id: len(r.prints) > 0 for r in prints.collect()} == {1: True, 2: True, 3: True, 4: False, 5: False, 6: False, 7: True}
    found = {(r.query_class, r.media_class): (r.offset, r.bit_error) for r in chroma.align(prints.where("media_id = 1"), prints).collect()}
    assert set(found) == {(1, 2)}
    assert found[1, 2][0] == 10
    assert found[1, 2][1] < 0.1


def test_excerpt_inside_other_recordings(spark):
    """The last third of one recording is the first third of the other, and a jingle lies in the midst of two that differ otherwise."""
    rng = np.random.default_rng(3)
    shared, jingle = song(rng, 64), song(rng, 40)
    rows = [(1, np.concatenate([song(rng, 128), shared])), (2, np.concatenate([shared, song(rng, 128)])), (3, np.concatenate([song(rng, 90), jingle, song(rng, 30)])), (4, np.concatenate([song(rng, 20), jingle, song(rng, 100)]))]
    prints = chroma.audio_fingerprints(media_of(spark, rows))
    found = {(r.query_class, r.media_class): r.offset for r in chroma.align(prints.where("media_id in (1, 3)"), prints).collect()}
    assert found.keys() == {(1, 2), (3, 4)}
    assert abs(found[1, 2] + 128 * 800 / chroma.HOP) <= 1
    assert abs(found[3, 4] + 70 * 800 / chroma.HOP) <= 1


def test_long_recordings_are_transformed_in_parts(monkeypatch):
    signal = song(np.random.default_rng(5), 40)
    whole = chroma.fingerprint(signal)
    monkeypatch.setattr(chroma, "FRAMES_AT_ONCE", 7)
    assert (chroma.fingerprint(signal) == whole).all()


def test_search_equals_brute_force(spark):
    """Repeated rows, null ids, recordings without prints, clashing names and an empty table."""
    rng = np.random.default_rng(6)
    make = lambda n: rng.integers(1, 2**32, n)
    noisy = lambda x, share: x ^ ((rng.random((len(x), 32)) < share) @ (1 << np.arange(32)))
    base = [make(60) for _ in range(6)]
    rows = [(i, b) for i, b in enumerate(base)]
    for i in range(60):
        b = base[rng.integers(6)]
        at, n = rng.integers(0, 30), rng.integers(10, 50)
        rows.append((10 + i, np.concatenate([make(rng.integers(0, 20)), noisy(b[at : at + n], rng.choice([0, 0.03, 0.1, 0.2, 0.3])), make(rng.integers(0, 5))])))
    rows += [(3, base[3]), (200, base[3]), (201, base[0]), (None, noisy(base[1], 0.05)), (None, make(40)), (202, make(0)), (203, None), (204, np.zeros(40, np.int64))]
    df = spark.createDataFrame([(i, None if p is None else [int(x) for x in p]) for i, p in rows], "media_id bigint, prints array<bigint>").withColumns({c: F.lit(7) for c in ("class_key", "class_id", "posting", "offset", "votes")}).repartition(3)

    def lists(p):
        """Where each three bytes begin, and every eighth position while they last."""
        out = []
        for k in range(4):
            since = 0
            for i, v in enumerate(p):
                since = since + 1 if i and (p[i - 1] ^ v) & ~(0xFF << 8 * k) == 0 else 0
                if v and since % 8 == 0:
                    out.append((i, k, v & ~(0xFF << 8 * k)))
        return out

    classes = {}
    for i, p in rows:
        if p is not None and len(p):
            ids = classes.setdefault(tuple(int(x) for x in p), [])
            ids += [i] if i is not None else []
    name = {p: min(ids, default=None) for p, ids in classes.items()}
    asked = {tuple(int(x) for x in p) for i, p in rows if i is not None and i < 6}
    links = collections.defaultdict(list)
    for q in asked:
        # A query's class is named by the queries alone.
        q_name = min(i for i, p in rows if i is not None and i < 6 and p is not None and tuple(int(x) for x in p) == q)
        for m in classes:
            if m == q:
                continue
            met = collections.Counter(j - i for i, j in {(i, j) for i, k, v in lists(q) for j, k2, v2 in lists(m) if (k, v) == (k2, v2)})
            tried = []
            for o, votes in met.items():
                if votes >= chroma.MIN_VOTES:
                    wrong = {i: (q[i] ^ m[i + o]).bit_count() for i in range(len(q)) if 0 <= i + o < len(m)}
                    spans = [(round(sum(6.4 - wrong[k] for k in range(s, e)), 6), e - s, -s) for s in wrong for e in range(s + 1, max(wrong) + 2)]
                    score, n, s = max(spans)
                    if score >= 0 and n >= chroma.MIN_STRETCH:
                        tried.append((-score, o, votes, n, sum(wrong[k] for k in range(-s, -s + n)) / (32 * n)))
            if tried:
                links[m].append((q_name, *min(tried)[1:]))
    assert sum(map(len, links.values())) > 20
    got = chroma.search(df.where("media_id < 6"), df).collect()
    assert len(got) == len(rows)
    want = collections.Counter()
    for i, p in rows:
        p = tuple(int(x) for x in p) if p is not None else ()
        found = sorted(links[p])
        best = min(((round(e, 9), -n, q, o, v) for q, o, v, n, e in found), default=None)
        want[i, name.get(p), len(p), len(found), tuple(q for q, *_ in found), best] += 1
    have = collections.Counter((r.media_id, r.class_id, r.n_prints, r.n_links, tuple(r.query_ids), None if r.bit_error is None else (round(r.bit_error, 9), -r.n_positions, r.best_query, r.offset, r.votes)) for r in got)
    assert have == want
    assert chroma.search(df.limit(0), df.limit(0)).count() == 0
    assert chroma.search(df.limit(0), df).where("n_links > 0").count() == 0
    assert chroma.audio_fingerprints(media_of(spark, [(1, np.zeros(0))]).limit(0)).count() == 0


def true_pairs(queries, media):
    """(query, recording) of which some stretch agrees, by every offset of every two of them."""
    out = set()
    for i, q in queries.items():
        for j, m in media.items():
            if i != j and any(chroma.best_stretch(q, m, o)[1] >= chroma.MIN_STRETCH for o in range(-len(q) + 1, len(m))):
                out.add((i, j))
    return out


@pytest.mark.parametrize("error, least", [(0.0, 1.0), (0.05, 0.97), (0.1, 0.9)])
def test_noisy_excerpts_are_found(spark, error, least):
    """Excerpts of 24 to 60 positions at any offset, bits of which are wrong at random, against the alignment of all pairs at all offsets."""
    rng = np.random.default_rng(11)

    def walk(n):
        """Integers as of sound: from one position to the next a few bits change, and some are held."""
        flips = (rng.random((n, 32)) < 0.06) & (rng.random((n, 1)) < 0.8)
        return np.bitwise_xor.accumulate((flips @ (1 << np.arange(32))) ^ np.r_[rng.integers(1, 2**32), np.zeros(n - 1, np.int64)]) | 1

    queries, media = {}, {}
    for i in range(40):
        whole = walk(150)
        n = int(rng.integers(24, 61))
        at = int(rng.integers(0, 150 - n))
        wrong = (rng.random((n, 32)) < error) @ (1 << np.arange(32))
        queries[i], media[100 + i] = whole, np.concatenate([walk(int(rng.integers(1, 80))), whole[at : at + n] ^ wrong, walk(int(rng.integers(1, 80)))])
    frame = lambda d: spark.createDataFrame([(i, [int(x) for x in p]) for i, p in d.items()], "media_id bigint, prints array<bigint>")
    want = true_pairs(queries, media)
    got = {(r.query_class, r.media_class) for r in chroma.align(frame(queries), frame(media)).collect()}
    assert got <= want and len(want) >= 38
    assert len(got) >= least * len(want)


def test_a_held_tone_is_found(spark):
    frame = spark.createDataFrame([(1, [5] * 40), (2, [7] * 30 + [5] * 33 + [9] * 4), (3, [6 << 8] * 40)], "media_id bigint, prints array<bigint>")
    assert {(r.query_class, r.media_class) for r in chroma.align(frame.where("media_id = 1"), frame).collect()} >= {(1, 2)}


def test_tones_of_vectors(spark):
    df = spark.createDataFrame([(1, [0.1] * 64), (1, [0.1] * 64), (2, None), (3, []), (4, [None, 0.5]), (None, [0.2] * 13)], "vec_id bigint, embedding array<float>")
    got = sorted((r.media_id or 0, len(r.pcm) // 2 // chroma.CHORD) for r in chroma.tones(df).collect())
    assert got == [(0, 2), (1, 6), (1, 6), (2, 0), (3, 0), (4, 1)]
