"""BPE encoding by prefix-sharing trie traversal, and decoding.

The encoding of a word ends, for each of its prefixes, in one token that the prefixes
before it determine: the token t that ends the prefix such that the last token of what is
left of t and t itself stay apart when merged together. Distinct words are walked in
sorted order, which is the depth-first order of their trie; the last-token states of the
path to the current node are kept on a stack, so a prefix shared by many words is encoded
once.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runforge.llm.common import cut, load

#: Pieces, and pairs of tokens, that a worker remembers in each of two generations; bounds memory only.
CACHE_ENTRIES = 250_000
END = "</w>"


class TrieEncoder:
    """The model of one tokenizer file: byte-level BPE with word ends."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.vocab: dict[str, int] = spec["model"]["vocab"]
        merges = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        self.rank = {(a, b): i for i, (a, b) in enumerate(merges)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t for t, i in (self.vocab | self.special).items()}
        # The ends of tokens, with the token's id where the end is a token itself.
        self.tails = dict.fromkeys((t[k:] for t in self.vocab for k in range(1, len(t))), -1) | self.vocab
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.words = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
        # str.split() also splits at these four, which are no white space to the tokenizer.
        self.controls = re.compile("[\x1c-\x1f]")
        self.pieces_between = regex.compile(r"[^\t-\r \x85\xa0  -     　]+")
        # Printable ASCII stands for itself in the byte-level alphabet.
        self.plain = re.compile(r"[!-~]+\Z")
        self.apart: set[int] = set()
        self.merging: set[int] = set()
        self.piece_ids: dict[str, tuple[int, ...]] = {}
        self.older_ids: dict[str, tuple[int, ...]] = {}

    def merged(self, symbols: list[str]) -> list[str]:
        """Plain BPE of a few symbols: the lowest rank first, leftmost among equals."""
        while len(symbols) > 1:
            r, i = min((self.rank.get(p, 1 << 30), i) for i, p in enumerate(zip(symbols, symbols[1:], strict=False)))
            if r == 1 << 30:
                break
            symbols = [*symbols[:i], symbols[i] + symbols[i + 1], *symbols[i + 2 :]]
        return symbols

    def stays_apart(self, pair: int) -> bool:
        """Whether two tokens, the ids in the halves of a number, are still two after a merge of all their symbols."""
        left, right = self.names[pair >> 32], self.names[pair & 0xFFFFFFFF]
        body, end = (right[: -len(END)], END) if right.endswith(END) else (right, "")
        stays = self.merged([*left, *body[:-1], body[-1] + end]) == [left, right]
        known = self.apart if stays else self.merging
        if len(known) > CACHE_ENTRIES:
            known.clear()
        known.add(pair)
        return stays

    def last_token(self, w: str, n: int, end: str, ids: list[int]) -> tuple[int, int]:
        """Id and start of the last token of the first n characters of w and end; ids has the last tokens of shorter prefixes."""
        tail_id, ends = self.tails.get, []
        for k in range(n - 1, -1, -1):
            t = tail_id(w[k:n] + end)
            if t is None:
                break
            if t >= 0:
                ends.append((k, t))
        for k, t in reversed(ends):
            if k == 0:
                return t, k
            pair = ids[k] << 32 | t
            if pair in self.apart or (pair not in self.merging and self.stays_apart(pair)):
                return t, k
        raise ValueError(f"no token ends {w[:n]!r}")

    def encode_words(self, words: set[str]) -> dict[str, list[int]]:
        """The ids of each of the words, which are given in the byte-level alphabet."""
        out = {}
        # Id and start of the last token of the first i characters of the current path.
        ids, starts = [0], [0]
        before = ""
        for w in sorted(words):
            shared, n = 0, len(w)
            for a, b in zip(before, w, strict=False):
                if a != b:
                    break
                shared += 1
            keep = min(shared, n - 1) + 1
            del ids[keep:], starts[keep:]
            for i in range(len(ids), n):
                t, k = self.last_token(w, i, "", ids)
                ids.append(t)
                starts.append(k)
            before = w[: n - 1]
            t, at = self.last_token(w, n, END, ids)
            found = [t]
            while at:
                found.append(ids[at])
                at = starts[at]
            out[w] = found[::-1]
        return out

    def words_of(self, piece: str) -> list[str]:
        """The words of a piece without white space, in the byte-level alphabet."""
        if self.plain.match(piece):
            return self.words.findall(piece.lower())
        return [w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(piece))]

    def forget(self) -> None:
        """Frees what was remembered of texts: a worker lives on, also for other work."""
        self.piece_ids, self.older_ids = {}, {}

    def pieces(self, text: str) -> list[str]:
        return self.pieces_between.findall(text) if self.controls.search(text) else text.split()

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        """The ids of each text; null is empty."""
        cut_up, new = [], set()
        if len(self.piece_ids) > CACHE_ENTRIES:
            self.older_ids, self.piece_ids = self.piece_ids, {}
        for t in texts:
            parts = self.split_special.split(t) if t and self.split_special else [t or ""]
            found = []
            for part in parts:
                if part in self.special:
                    found.append(part)
                    self.piece_ids.setdefault(part, (self.special[part],))
                else:
                    found += self.pieces(part)
            new.update(found)
            cut_up.append(found)
        new.difference_update(self.piece_ids)
        self.piece_ids.update((p, self.older_ids[p]) for p in new if p in self.older_ids)
        new = {p: self.words_of(p) for p in new if p not in self.piece_ids}
        word_ids = self.encode_words({w for found in new.values() for w in found})
        for p, found in new.items():
            self.piece_ids[p] = tuple(i for w in found for i in word_ids[w])
        get = self.piece_ids.__getitem__
        return [[i for ids in map(get, found) for i in ids] for found in cut_up]


_ENCODERS: dict[str, TrieEncoder] = {}


def encoder(path: str) -> TrieEncoder:
    """One for each worker process, which serves many tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = TrieEncoder(path)
    return _ENCODERS[path]


@functools.cache
def token_names(path: str) -> list[str]:
    """The tokens of a tokenizer file by id."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    names = {i: t for t, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
    return [names.get(i, "") for i in range(max(names) + 1)]


def bpe_encode(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """Adds ids array<int> to every row of docs: the whole text encoded without special tokens around it.

    Null and empty texts give an empty array. A column ids is replaced. path is a tokenizer
    file that every executor can read.
    """
    out = docs.drop("ids")
    at = out.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder(path)
        for b in batches:
            for part in range(0, b.num_rows, 2000):
                c = b.slice(part, 2000)
                ids = pa.array(model.encode(c.column(at).to_pylist()), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*c.columns, ids], names=[*c.schema.names, "ids"])
        model.forget()

    return out.mapInArrow(run, _with(out, "ids", "array<int>"))


def bpe_decode(rows: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """Adds decoded string to every row: the tokens of ids, special ones too, joined as the tokenizer does.

    The file names no decoder, so tokens stand between single spaces. Null ids give an empty
    text; a column decoded is replaced.
    """
    out = rows.drop("decoded")
    at = out.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = pa.array(token_names(path), pa.large_string())
        for b in batches:
            for part in range(0, b.num_rows, 1000):
                c = b.slice(part, 1000)
                ids = pc.fill_null(c.column(at), pa.scalar([], c.column(at).type))
                lists = pa.LargeListArray.from_arrays(pc.cast(_offsets(ids), pa.int64()), tokens.take(ids.flatten()))
                text = pc.cast(pc.binary_join(lists, pa.scalar(" ", pa.large_string())), pa.string())
                yield pa.RecordBatch.from_arrays([*c.columns, text], names=[*c.schema.names, "decoded"])

    return out.mapInArrow(run, _with(out, "decoded", "string"))


def _offsets(lists: pa.Array) -> pa.Array:
    n = pc.list_value_length(lists).to_pylist()
    at = [0]
    for x in n:
        at.append(at[-1] + x)
    return pa.array(at, pa.int64())


def _with(df: DataFrame, name: str, kind: str) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), f"{name} {kind}"])


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op4_bpe(spark, sf_dir: str) -> DataFrame:
    path = tokenizer_path()
    # Cut, as one stage with both would hold two Python workers for each task.
    ids = cut(bpe_encode(load(spark, sf_dir, "documents").select("doc_id", "text"), path).select("doc_id", "ids"))
    return bpe_decode(ids, path).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
