"""Alignment of two tokenizers' tokens, counted over a corpus.

Token boundaries that both tokenizers have cut a text into groups. Most groups hold one token
of each side with the same bytes, so a table from A ids to the B id of the same bytes is made
beforehand, and these pairs are counted in a vector as long as the vocabulary. Other pairs
are counted by a shuffle, once for each block of documents: a block is a row for each of its
documents, which says which of the block's distinct pairs it has how often, and rows of at
most PAIR_ROWS of these pairs, so that no row, and no batch of rows, is larger than a few
documents. The counts come back to the blocks and are added up there.

Neither tokenizer joins anything across a space that follows a printing character, so a text
is cut there and each distinct piece is tokenized and aligned once.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runforge.llm.common import cut, discard, load

#: A piece begins at a space after a character that is no white space.
PIECE = re.compile(r"\s*\S+(?:[^\S ]\s*\S+)*(?:[^\S ]\s*\Z)?|\s+")
#: Links that a block holds, unless its only document has more; pieces that a task remembers, and letters of pieces that are tokenized as one text.
BLOCK_LINKS, KNOWN_PIECES, ROW_LETTERS = 400_000, 300_000, 500_000
#: Distinct pairs of a block in one row. Spark reads 4096 rows at once.
PAIR_ROWS = 1000
#: Groups of more links are counted by distinct ids.
LARGE_GROUP = 4096


def tokenizer_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def _byte_letters() -> dict[str, int]:
    """The byte for each character of a byte-level vocabulary: printing ones stand for themselves, the others follow 255 in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Growing:
    """An array that is added to at its end."""

    def __init__(self, first: np.ndarray):
        self.values, self.n = first, len(first)

    def add(self, more: np.ndarray) -> None:
        if self.n + len(more) > len(self.values):
            self.values = np.concatenate([self.values[: self.n], np.empty(self.n + 2 * len(more), self.values.dtype)])
        self.values[self.n : self.n + len(more)] = more
        self.n += len(more)


def _pairs(a: np.ndarray, b: np.ndarray, of_a: np.ndarray, of_b: np.ndarray, b_size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, code, times) of the tokens a and b in the groups of_a and of_b, which rise; a code may come several times, but for large groups."""
    in_a, in_b = np.bincount(of_a), np.bincount(of_b)
    large = np.flatnonzero(in_a * in_b > LARGE_GROUP)
    small = np.ones(len(in_a), bool)
    small[large] = False
    mine = np.flatnonzero(small[of_a])
    times = in_b[of_a[mine]]
    start_b = np.cumsum(in_b) - in_b
    within = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    group = np.repeat(of_a[mine], times)
    out = [(group, np.repeat(a[mine], times) * b_size + b[start_b[group] + within], np.ones(len(group), np.int64))]
    for g in large.tolist():
        (x, n), (y, m) = (np.unique(t[np.searchsorted(of, g) : np.searchsorted(of, g, "right")], return_counts=True) for t, of in ((a, of_a), (b, of_b)))
        out.append((np.full(len(x) * len(y), g), (x[:, None] * b_size + y[None, :]).ravel(), (n[:, None] * m[None, :]).ravel()))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


class Aligner:
    """Both tokenizers, the bytes of their tokens, the B id with the same bytes for each A id (-1 if there is none), and the pieces that were aligned before."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True
        self.a.no_padding()
        self.a.no_truncation()
        letters = _byte_letters()
        entries = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b"\xff"] * (max(entries.values(), default=0) + 1)
        for t, i in entries.items():
            if all(c in letters for c in t):
                self.a_bytes[i] = bytes(letters[c] for c in t)
        self.b_size = self.b.get_piece_size()
        self.b_bytes = [self._piece_bytes(i) for i in range(self.b_size)]
        self.a_lengths, self.b_lengths = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        plain = [i for i in range(self.b_size) if not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i))]
        same = {self.b_bytes[i]: i for i in [*(i for i in range(self.b_size) if self.b.is_byte(i)), *plain]}
        self.same = np.array([same.get(x, -1) for x in self.a_bytes], np.int64)
        self.space = self.b.piece_to_id("▁")
        # An A token with what follows it in a group, and a B token with what follows it.
        self.texts = [f"{i}{x}" for i in range(len(self.a_bytes)) for x in ",|"] + [f"{i}{x}" for i in range(self.b_size) for x in ",;\n"]
        self.forget()

    def _piece_bytes(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def forget(self) -> None:
        """Of each known piece: its place, groups as text (None if a side's bytes differ), n_a, n_b, n_groups, n_links, and where its pairs lie."""
        self.place: dict[str, int] = {}
        self.groups: list[str | None] = []
        self.n = [Growing(np.zeros(1024, np.int64)) for _ in range(4)]
        self.ends, self.codes, self.times = (Growing(np.zeros(1024, np.int64)) for _ in range(3))
        for g in (*self.n, self.ends, self.codes, self.times):
            g.n = 0

    def learn(self, pieces: set[str]) -> None:
        """Tokenizes and aligns the pieces that aren't known, one after the other as one text."""
        if len(self.place) > KNOWN_PIECES:
            self.forget()
        new = [p for p in pieces if p not in self.place]
        row, size = [], 0
        for p in new:
            if p[-1].isspace():  # the end of its text: nothing can follow
                self._add([p])
                continue
            row.append(p)
            size += len(p)
            if size > ROW_LETTERS:
                self._add(row)
                row, size = [], 0
        if row:
            self._add(row)

    def _add(self, pieces: list[str]) -> None:
        text = "".join(pieces)
        whole = text.encode()
        # B puts a space before what it is given, so the text's own goes; of nothing it would make nothing.
        a, b = self.a.encode(text, add_special_tokens=False).ids, self.b.encode(text[1:]) if len(text) > 1 else [self.space]
        if b"".join(map(self.a_bytes.__getitem__, a)) != whole or b"".join(map(self.b_bytes.__getitem__, b)) != whole:
            if len(pieces) > 1:
                self._add(pieces[: len(pieces) // 2])
                self._add(pieces[len(pieces) // 2 :])
            else:
                self._place(pieces, [None], *[np.zeros(1, np.int64)] * 5, np.empty(0, np.int64), np.empty(0, np.int64))
            return
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        ends_a, ends_b = np.cumsum(self.a_lengths[a]), np.cumsum(self.b_lengths[b])
        last_a, last_b = ends_b[np.searchsorted(ends_b, ends_a)] == ends_a, ends_a[np.searchsorted(ends_a, ends_b)] == ends_b
        of_a, of_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        ends, at = ends_a[last_a], np.cumsum([len(p.encode()) for p in pieces])
        if not np.isin(at, ends).all():
            raise ValueError("a tokenizer joins text across a space")
        piece, m = np.searchsorted(at, ends), len(pieces)
        in_a, in_b = np.bincount(of_a), np.bincount(of_b)
        links = np.zeros(m, np.int64)
        np.add.at(links, piece, in_a * in_b)
        closing = np.isin(ends, at)
        shown = np.concatenate([2 * a + last_a, 2 * len(self.a_bytes) + 3 * b + last_b + (last_b & closing[of_b])])
        order = np.argsort(np.concatenate([2 * of_a, 2 * of_b + 1]), kind="stable")
        groups = "".join(map(self.texts.__getitem__, shown[order].tolist())).split("\n")[:-1]
        group, codes, times = _pairs(a, b, of_a, of_b, self.b_size)
        of = piece[group]
        order = np.lexsort((codes, of))
        of, codes, times = of[order], codes[order], times[order]
        first = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (codes[1:] != codes[:-1])])
        self._place(pieces, groups, np.bincount(piece[of_a], minlength=m), np.bincount(piece[of_b], minlength=m), np.bincount(piece, minlength=m), links, np.bincount(of[first], minlength=m), codes[first], np.add.reduceat(times, first))

    def _place(self, pieces: list[str], groups: list, n_a: np.ndarray, n_b: np.ndarray, n_groups: np.ndarray, links: np.ndarray, sizes: np.ndarray, codes: np.ndarray, times: np.ndarray) -> None:
        self.place.update(zip(pieces, range(len(self.place), len(self.place) + len(pieces)), strict=True))
        self.groups += groups
        for g, x in zip((*self.n, self.ends, self.codes, self.times), (n_a, n_b, n_groups, links, self.codes.n + np.cumsum(sizes), codes, times), strict=True):
            g.add(x)

    def documents(self, texts: list[str | None]) -> Iterator[tuple[tuple[int, int, int, int, str], np.ndarray, np.ndarray]]:
        """((n_a, n_b, n_groups, n_links, groups_sha256), pair codes in order, how often each is linked) of each whole text."""
        cut_up = [PIECE.findall(" " + t) if t else [] for t in texts]
        self.learn(set().union(*cut_up))
        nothing = np.empty(0, np.int64)
        for pieces in cut_up:
            at = list(map(self.place.__getitem__, pieces))
            said = list(map(self.groups.__getitem__, at))
            if not said or None in said:
                yield (0, 0, 0, 0, ""), nothing, nothing
                continue
            where = np.array(at)
            digest = hashlib.sha256()
            for lo in range(0, len(said), 10_000):
                digest.update((";" * (lo > 0) + ";".join(said[lo : lo + 10_000])).encode())
            some, often = np.unique(where, return_counts=True)
            ends = self.ends.values[some]
            starts = np.where(some > 0, self.ends.values[some - 1], 0)
            sizes = ends - starts
            flat = np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
            codes, links = self.codes.values[flat], self.times.values[flat] * np.repeat(often, sizes)
            order = np.argsort(codes, kind="stable")
            codes = codes[order]
            first = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
            yield (*(int(g.values[where].sum()) for g in self.n), digest.hexdigest()), codes[first], np.add.reduceat(links[order], first)


@functools.cache
def aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def alignment_blocks(docs: DataFrame, paths: tuple[str, str]) -> DataFrame:
    """Rows of two kinds for each block of documents: its documents (doc_id to links: digests, and how often it has which of the block's pairs, which are numbered by code), and its distinct pairs with the number of its documents that have each (a, b, docs). The columns of the other kind are null."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    fields = f"block bigint, doc_id {kind}, " + ", ".join(f"{c} bigint" for c in COUNTS)
    fields += ", groups_sha256 string, pair array<int>, links array<int>, a array<int>, b array<int>, docs array<int>"
    names = [f.strip().split(" ")[0] for f in fields.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, part, held, size, n = aligner(*paths), TaskContext.get().partitionId(), [], 0, 0
        ids: list[pa.Scalar] = []
        lists = lambda ends, values: pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), pa.array(np.asarray(values, np.int32)))
        ints = pa.list_(pa.int32())

        def given() -> Iterator[pa.RecordBatch]:
            nonlocal n, size
            codes, pair = np.unique(np.concatenate([c for _, c, _ in held]), return_inverse=True)
            block, counts = part << 32 | n, [np.array([d[k] for d, _, _ in held], np.int64) for k in range(4)]
            ends, to = np.cumsum([len(c) for _, c, _ in held]), np.r_[np.arange(PAIR_ROWS, len(codes), PAIR_ROWS), len(codes)]
            doc_id = pa.array([i.as_py() for i in ids], b.column(0).type)
            mine = [doc_id, *map(pa.array, counts), pa.array([d[4] for d, _, _ in held], pa.string()), lists(ends, pair), lists(ends, np.concatenate([x for _, _, x in held]))]
            pairs = [lists(to, x) for x in (codes // both.b_size, codes % both.b_size, np.bincount(pair, minlength=len(codes)))]
            held.clear()
            ids.clear()
            n, size = n + 1, 0
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(doc_id), block)), *mine, *(pa.nulls(len(doc_id), ints) for _ in pairs)], names=names)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(to), block)), *(pa.nulls(len(to), x.type) for x in mine), *pairs], names=names)

        for b in batches:
            for lo in range(0, b.num_rows, 100):
                c = b.slice(lo, 100)
                for i, found in zip(c.column(0), both.documents(c.column(1).to_pylist()), strict=True):
                    held.append(found)
                    ids.append(i)
                    size += len(found[1]) + 10
                    if size > BLOCK_LINKS:
                        yield from given()
        if held:
            yield from given()

    return docs.select("doc_id", "text").mapInArrow(run, fields)


def _same_pairs(pairs: DataFrame, paths: tuple[str, str]) -> np.ndarray:
    """How many documents have each A id linked with the B id of the same bytes: vectors as long as the vocabulary, one a task, added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        same = aligner(*paths).same
        total = np.zeros(len(same), np.int64)
        for batch in batches:
            a, b, docs = (batch.column(c).flatten().to_numpy() for c in ("a", "b", "docs"))
            mine = same[a] == b
            np.add.at(total, a[mine], docs[mine])
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], names=["a", "n"])

    got = pairs.select("a", "b", "docs").mapInArrow(run, "a bigint, n bigint").groupBy("a").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(aligner(*paths).same), np.int64)
    out[got.column("a").to_numpy()] = got.column("n").to_numpy()
    return out


def _other_pairs(pairs: DataFrame, paths: tuple[str, str]) -> DataFrame:
    """(block, code, docs): the pairs of each block that have different bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(*paths)
        for batch in batches:
            block = np.repeat(batch.column("block").to_numpy(), batch.column("a").value_lengths().to_numpy())
            a, b, docs = (batch.column(c).flatten().to_numpy().astype(np.int64) for c in ("a", "b", "docs"))
            other = both.same[a] != b
            yield pa.RecordBatch.from_arrays([pa.array(x[other]) for x in (block, a * both.b_size + b, docs)], names=["block", "code", "docs"])

    return pairs.select("block", "a", "b", "docs").mapInArrow(run, "block bigint, code bigint, docs bigint")


def align_tokens(docs: DataFrame, paths: tuple[str, str] | None = None) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for every row of docs (doc_id, text).

    The space before the text is a part of it for both tokenizers. Texts that are null or
    empty, or that a tokenizer doesn't give back byte by byte, have zeros and an empty hash.
    Each row is a document, also repeated ones and those without an id. A text is one
    document whatever its length; an empty table gives no rows; other columns are ignored.
    """
    paths = paths or tokenizer_paths()
    blocks = cut(alignment_blocks(docs, paths))
    pairs = blocks.where(F.col("a").isNotNull())
    same_n = _same_pairs(pairs, paths)
    other = cut(_other_pairs(pairs, paths))
    counts = cut(other.groupBy("code").agg(F.sum("docs").alias("n")))
    b_size = aligner(*paths).b_size
    # As many rows at most as A has ids.
    top = counts.groupBy(F.floor(F.col("code") / b_size).alias("a")).agg(F.max("n").alias("n")).toArrow()
    best = same_n.copy()
    np.maximum.at(best, top.column("a").to_numpy().astype(np.int64), top.column("n").to_numpy())
    known = docs.sparkSession.sparkContext.broadcast((same_n, best))
    back = other.join(counts, "code").select("block", "code", "n")
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", *COUNTS, "n_best", "count_sum", "groups_sha256"]

    def add_up(block: pa.Table, counted: pa.Table) -> pa.Table:
        both, (same_n, best) = aligner(*paths), known.value
        is_pairs = pc.is_valid(block["a"])
        mine = block.filter(pc.invert(is_pairs))
        a, b, pair, links = (pc.list_flatten(t[c]).to_numpy().astype(np.int64) for t, c in ((block.filter(is_pairs), "a"), (block.filter(is_pairs), "b"), (mine, "pair"), (mine, "links")))
        codes = np.sort(a * both.b_size + b)
        a, b = codes // both.b_size, codes % both.b_size
        n = np.where(both.same[a] == b, same_n[a], 0)
        n[np.searchsorted(codes, counted["code"].to_numpy())] = counted["n"].to_numpy()
        ends = np.r_[0, np.cumsum(pc.list_value_length(mine["pair"]).to_numpy())]
        sums = [np.r_[0, np.cumsum(x)][ends] for x in (links * (n[pair] == best[a[pair]]), links * n[pair])]
        return pa.table([mine["doc_id"], *(mine[c] for c in COUNTS), *(pa.array(np.diff(s)) for s in sums), mine["groups_sha256"]], names=names)

    together = blocks.groupBy("block").cogroup(back.groupBy("block"))
    out = cut(together.applyInArrow(add_up, f"doc_id {kind}, " + ", ".join(f"{c} bigint" for c in names[1:-1]) + ", groups_sha256 string"))
    discard(blocks, other, counts)
    return out


def op13_token_align(spark, sf_dir: str) -> DataFrame:
    found = align_tokens(load(spark, sf_dir, "documents"))
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), *COUNTS, "n_best", "count_sum", "groups_sha256")
