"""Near copies by bottom-k sketches against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from runforge.llm import minhash, set_links
from runforge.llm.simhash import shingle_set

DOC = "doc_id bigint, text string"


def docs_of(spark, rows, parts=3):
    return spark.createDataFrame(rows, DOC).repartition(parts)


def shingles(text, n):
    w = [x for x in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ") if x]
    return {" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute(rows, n=4, percent=80):
    sets = [shingles(t, n) for _, t in rows]
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                up[max(top(i), top(j))] = min(top(i), top(j))
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top(i)] = min(d, least.get(top(i), d))
    return sorted(((d, len(sets[i]), least.get(top(i)) if sets[i] else d, d is not None and (not sets[i] or least.get(top(i)) == d)) for i, (d, _) in enumerate(rows)), key=str)


def copies(rng, n, words=90, groups=6):
    vocabulary = [f"w{i}" for i in range(400)]
    passage = rng.choices(vocabulary, k=40)
    out = []
    for i in range(n):
        g = random.Random(i % groups)
        size = g.choice([3, 20, 60, words, 3 * words, 6 * words])
        text = g.choices(vocabulary, k=size)
        for _ in range(int(size * rng.choice([0, 0.01, 0.02, 0.04, 0.05, 0.06, 0.2]))):
            text[rng.randrange(size)] = rng.choice(vocabulary)
        if rng.random() < 0.4:
            text += passage
        out.append((i, " ".join(text)))
    return out


EDGES = [(1000, None), (1001, ""), (1002, " \n\t"), (1003, "One two"), (1004, "one  TWO "), (None, "one two"), (None, None), (None, "only here"), (5, "again and again and again"), (5, "again and again and again"), (5, "another text"), (1005, "x " * 5000), (1006, "É é ﬁ İ 日本 x")]


def found(df):
    return sorted((tuple(r[c] for c in ("doc_id", "n_shingles", "component_id", "kept")) for r in df.collect()), key=str)


@pytest.mark.parametrize("sets, hashes, common", [(800, 1 << 20, 12), (7, 900, 3)])
def test_near_copies_equal_brute_force(spark, monkeypatch, sets, hashes, common):
    monkeypatch.setattr(set_links, "TILE_SETS", sets)
    monkeypatch.setattr(set_links, "TILE_SHINGLES", hashes)
    monkeypatch.setattr(set_links, "COMMON", common)
    monkeypatch.setattr(set_links, "COLUMNS", 50)
    rows = copies(random.Random(2), 240) + EDGES
    docs = docs_of(spark, rows).withColumns({c: F.lit("clash") for c in ("node", "n", "key", "label", "row_key", "sketch")})
    got = found(minhash.near_copies(docs))
    assert got == brute(rows)
    assert len({r[2] for r in got}) < len(rows) - 60


def test_small_tables(spark):
    assert minhash.near_copies(docs_of(spark, [])).count() == 0
    for rows in ([(1, None)], [(2, "a b c d e"), (1, "a b c d e")], [(None, "a"), (None, "a")]):
        assert found(minhash.near_copies(docs_of(spark, rows))) == brute(rows)
    with pytest.raises(ValueError):
        minhash.near_copies(docs_of(spark, []), similarity=0)


@pytest.mark.parametrize("similarity, many", [(0.5, 8), (0.8, 8), (0.8, 0), (0.8, 1000)])
def test_stars_equal_all_pairs(monkeypatch, similarity, many):
    monkeypatch.setattr(set_links, "MANY_PAIRS", many)
    rng = random.Random(4)
    texts = [t for _, t in copies(rng, 150)]
    sets = [s for s in (shingle_set(t, 4) for t in texts)]
    side = np.array([rng.randrange(2) for _ in sets])
    for sides in (None, side):
        label = list(range(len(sets)))
        for i in range(len(sets)):
            for j in range(i):
                n = len(np.intersect1d(sets[i], sets[j]))
                if n >= similarity * (len(sets[i]) + len(sets[j]) - n) - 1e-9 and (sides is None or sides[i] != sides[j]):
                    a, b = sorted((label[i], label[j]))
                    label = [a if x == b else x for x in label]
        assert dict(set_links.stars(sets, similarity, side=sides)) == {i: x for i, x in enumerate(label) if x != i}


def test_overlaps_equal_sets():
    rng = random.Random(6)
    sets = [set(rng.sample(range(60), rng.randrange(1, 40))) for _ in range(40)]
    values, owner = (np.array(x) for x in zip(*[(v, i) for i, s in enumerate(sets) for v in s], strict=True))
    got = set_links.overlaps(values, owner, 40)
    assert all(got[i, j] == len(sets[i] & sets[j]) for i in range(40) for j in range(40) if i != j)


def test_guaranteed_overlap():
    """Similar sets share the guaranteed number of retained hashes, and one that both post."""
    assert set_links.least_shared(128, 0.8) == 67 and set_links.least_shared(5, 1.0) == 5
    rng = np.random.default_rng(0)
    for n in (100, 103, 127, 129, 200, 3000):
        for _ in range(200):
            same = int(np.ceil(0.8 * n * 1.0))
            only = n - same
            h = rng.integers(0, 2**63, n, np.int64).astype(np.uint64)
            a, b = np.sort(h), np.sort(h[:same] if only else h)
            assert len(np.intersect1d(a[:128], b[:128])) >= set_links._least_overlap(np.array([len(a), len(b)]), 128, 0.8).max()
