"""Spelling variants and token alignment against brute force."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from runforge.llm import spelling, token_align

DOC = "doc_id bigint, text string"


def docs_of(spark, rows, parts=3):
    return spark.createDataFrame(rows, DOC).repartition(parts)


# 12


def brute_variants(rows):
    n = collections.Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    words = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        short, long = sorted((a, b), key=len)
        return len(long) - len(short) == 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))

    out, form = {}, {}
    for w, c in words.items():
        others = sorted((-m, u) for u, m in words.items() if near(w, u))
        form[w] = others[0] if others and -others[0][0] >= 2 * c else None
        out[w] = [c, len(others), form[w] and form[w][1], form[w] and -form[w][0]]
    for w in words:
        end = w
        while form[end]:
            end = form[end][1]
        out[w].append(end)
    return {w: tuple(x) for w, x in out.items()}


def spelled(rng, n_docs):
    stems = ["receive", "separate", "Straße", "naïve", "aaaaab", "aaaab", "élève", "definitely", "bbbbb", "bbbbbb"]
    out = []
    for i in range(n_docs):
        words = []
        for _ in range(40):
            w = rng.choice(stems)
            while rng.random() < 0.4:
                k = rng.randrange(len(w) + 1)
                w = rng.choice([w[:k] + rng.choice("abeéÿÀ×") + w[k:], w[:k] + w[k + 1 :], w[:k] + rng.choice("abeéÿ") + w[k + 1 :]])
            words.append(w.upper() if rng.random() < 0.1 else w)
        out.append((i, rng.choice([" ", "\n", "-", "9"]).join(words)))
    return out


def found_variants(df):
    return {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in df.collect()}


@pytest.mark.parametrize("max_blocks", [1 << 22, 8])
def test_spelling_variants_equal_brute_force(spark, monkeypatch, max_blocks):
    monkeypatch.setattr(spelling, "MAX_BLOCKS", max_blocks)  # a full filter lets all pass, and nothing changes
    rows = spelled(random.Random(5), 60)
    rows += [(None, "separate separate"), (None, None), (7, None), (8, ""), (9, "  \n 12 日本"), (3, rows[3][1]), (10, "long" * 500 + " " + "long" * 499 + "lons " + "long" * 500 + " " + "long" * 500 + " " + ("long" * 499 + "lons ") * 2), (11, "word " * 3000)]
    rows += [(20 + i, "chain ef chaief" + " chaieg" * 2 + " chaihg" * 4) for i in range(4)]  # a chain of forms
    found = spelling.spelling_variants(docs_of(spark, rows).withColumns({"word": F.lit("clash"), "n": F.lit(1)}))
    want = brute_variants(rows)
    assert found_variants(found) == want
    assert sum(x[2] is not None for x in want.values()) > 20 and any(x[2] not in (None, x[4]) for x in want.values())


def test_every_edit_passes_its_filter():
    words, rng = sorted({"".join(rng.choice("abé") for _ in range(n)) for rng in [random.Random(1)] for n in (5, 6, 7) for _ in range(120)}), None
    filters = {}
    for length, rows in spelling._by_length(words).items():
        at, bits = spelling._place(spelling.hashes(spelling._points([words[i] for i in rows], length)), 64)
        filters[length] = np.zeros(64, np.uint64)
        np.bitwise_or.at(filters[length], at, bits)
    alphabet, found = np.array(sorted(map(ord, "abé")), np.uint64), set()
    for length, rows in spelling._by_length(words).items():
        mine = [words[i] for i in rows]
        for which, edited in spelling.probes(mine, length, alphabet, filters):
            found |= {frozenset((mine[w], e)) for w, e in zip(which.tolist(), edited, strict=True) if e in set(words)}
    assert found == {frozenset((a, b)) for a in words for b in words if len(a) == len(b) and sum(x != y for x, y in zip(a, b, strict=True)) == 1 or len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))}


def test_no_words(spark):
    for rows in ([], [(1, None), (2, "a b c"), (3, "lonely")]):
        assert spelling.spelling_variants(docs_of(spark, rows)).count() == 0
    assert found_variants(spelling.spelling_variants(docs_of(spark, [(1, "alone alone alone")]))) == {"alone": (3, 0, None, None, "alone")}
    with pytest.raises(ValueError):
        spelling.spelling_variants(docs_of(spark, []), times=1)


def test_chains_of_forms(spark):
    rows = [(f"w{i}", f"w{i + 1}") for i in range(37)]
    got = spelling.roots(spark.createDataFrame(rows, "word string, form string"))
    assert {r["word"]: r["root"] for r in got.collect()} == {w: "w37" for w, _ in rows}


# 13


def brute_alignment(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    a_path, b_path = token_align.tokenizer_paths()
    ta, tb = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
    ta.encode_special_tokens = True
    letters, k = {}, 0
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b:
            letters[chr(b)] = b
        else:
            letters[chr(256 + k)] = b
            k += 1
    docs, count = [], collections.Counter()
    for doc_id, text in rows:
        whole, groups = (" " + (text or "")).encode(), []
        a = ta.encode(" " + text, add_special_tokens=False).ids if text else []
        b = tb.encode(text) if text else []
        xa = [bytes(letters[c] for c in ta.id_to_token(i)) for i in a]
        xb = [bytes([int(tb.id_to_piece(i)[3:5], 16)]) if tb.is_byte(i) else tb.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if text and b"".join(xa) == b"".join(xb) == whole:
            ea, eb = np.cumsum([len(x) for x in xa]), np.cumsum([len(x) for x in xb])
            i = j = 0
            for e in sorted(set(ea.tolist()) & set(eb.tolist())):
                i2, j2 = int(np.searchsorted(ea, e)) + 1, int(np.searchsorted(eb, e)) + 1
                groups.append((a[i:i2], b[j:j2]))
                i, j = i2, j2
        links = collections.Counter((x, y) for g in groups for x in g[0] for y in g[1])
        count.update(links.keys())
        docs.append((doc_id, groups, links))
    best = collections.defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    out = []
    for doc_id, groups, links in docs:
        text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        out.append((
            doc_id, sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), sum(links.values()),
            sum(n for (x, y), n in links.items() if count[x, y] == best[x]), sum(n * count[p] for p, n in links.items()), hashlib.sha256(text.encode()).hexdigest() if groups else "",
        ))
    return collections.Counter(out)


ODD = [
    (1, None), (2, ""), (3, " "), (4, "  \n\t "), (5, "a  b\n c "), (6, "tail \n"), (7, "tail\n \n x"), (8, "▁x y"), (9, "ﬁ Å"), (10, "<|endoftext|> <s> <unk> <0x41> </s>"), (11, "a\x00b \x1c c\x1c d"), (12, "don't we'll 'tis it's"),
    (13, "日本語 　 مرحبا \U0001f600\U0001f468‍\U0001f469"), (14, "x" * 3000), (15, "word " * 800), (None, "no id"), (None, None), (5, "a  b\n c "), (16, "\xa0nbsp\xa0 x  y\x85 z"), (17, "café café naïve  "), (18, "1234567 89,0.1 --- !!!? \r\n\r\n  z"),
]


def aligned(df):
    return collections.Counter(tuple(r[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")) for r in df.collect())


@pytest.mark.parametrize("links, pieces, large", [(400_000, 300_000, 4096), (30, 5, 2)])
def test_alignment_equals_brute_force(spark, monkeypatch, links, pieces, large):
    rng = random.Random(3)
    rows = [(100 + i, "".join(rng.choice(["the ", "token", "iz", "ation", " ", "\n", "Un", "believ", "able", "é", "日", ". ", "<s>", "\t", "'s", "42", "ß", "\x1f", " "]) for _ in range(rng.randrange(60)))) for i in range(150)]
    rows += ODD
    monkeypatch.setattr(token_align, "BLOCK_LINKS", links)
    monkeypatch.setattr(token_align, "KNOWN_PIECES", pieces)
    monkeypatch.setattr(token_align, "LARGE_GROUP", large)
    got = aligned(token_align.align_tokens(docs_of(spark, rows).withColumns({"a": F.lit("clash"), "block": F.lit(1), "n_a": F.lit(2)})))
    assert got == brute_alignment(rows)


def test_pieces_join_nothing():
    """What is tokenized piece by piece equals the whole."""
    both = token_align.Aligner(*token_align.tokenizer_paths())
    assert not [i for i in range(both.b_size) if "▁" in both.b.id_to_piece(i).lstrip("▁")]
    rng = random.Random(9)
    for _ in range(300):
        text = "".join(rng.choice(["a", "the", " ", "  ", "\n", "\t", "　", "\x1c", "ing", ".", "日", "9", "'s", "\x85", "\U0001f600"]) for _ in range(rng.randrange(1, 40)))
        pieces = token_align.PIECE.findall(" " + text)
        assert "".join(pieces) == " " + text and all(x[-1:].strip() and y[0] == " " for x, y in zip(pieces, pieces[1:], strict=False))


def test_alignment_of_empty_tables(spark):
    assert token_align.align_tokens(docs_of(spark, [])).count() == 0
    assert aligned(token_align.align_tokens(docs_of(spark, [(1, None)]))) == {(1, 0, 0, 0, 0, 0, 0, ""): 1}


@pytest.mark.parametrize("pair_rows", [1000, 7])
def test_rows_of_blocks_are_bounded(spark, monkeypatch, pair_rows):
    """A block's documents and pairs don't lie in one row, which Spark would hold a whole file of at once."""
    monkeypatch.setattr(token_align, "PAIR_ROWS", pair_rows, raising=False)
    rng = random.Random(4)
    rows = [(i, " ".join("".join(rng.choice(["un", "believ", "é", "tok", "en", "日"]) for _ in range(3)) for _ in range(30))) for i in range(200)] + ODD
    docs = docs_of(spark, rows, 1)
    blocks = token_align.alignment_blocks(docs, token_align.tokenizer_paths()).persist()
    most = blocks.select(*(F.max(F.size(c)).alias(c) for c in ("pair", "links", "a", "b", "docs"))).first()
    both = token_align.aligner(*token_align.tokenizer_paths())
    of_one = max(len(codes) for _, codes, _ in both.documents([t for _, t in rows]))
    assert most["pair"] == most["links"] == of_one
    assert blocks.select("block").distinct().count() == 1 and blocks.where("a is null").count() == len(rows)
    n_pairs = blocks.agg(F.sum(F.when(F.col("a").isNotNull(), F.size("a")))).first()[0]
    assert n_pairs > of_one and most["a"] == most["b"] == most["docs"] == min(pair_rows, n_pairs)
    blocks.unpersist()
    assert aligned(token_align.align_tokens(docs)) == brute_alignment(rows)
