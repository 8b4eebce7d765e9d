"""Byte-level BPE encoding and decoding with a segment tree over byte positions.

A pre-token's bytes are the leaves; leaf i holds the rank of the pair (live part at i,
next live part) with the position as tie-break, and every inner node the minimum of its
children, so that the root names the leftmost pair of least rank. A merge rewrites three
leaves (the merged position, its predecessor, the position that died) and their
ancestors: O(log n) work. Pre-tokens of one batch that share a tree size are merged side
by side, one tree per row of a matrix; the tree's depth never depends on the batch.

The vocabulary file (ranks of byte strings) is a parameter. It is read once, on the
driver, and broadcast: its size is that of the file (under 1 MB for 50k ranks), whatever
the input.

Null texts count as empty (no ids, the digests of empty strings). Texts are encoded
whole; special tokens in a text are ordinary text. Every row gives one result row; an
empty table an empty result; only doc_id and text are read.
"""

from __future__ import annotations

import base64
import hashlib
import re
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from cardtrail.llm.common import map_batches, slices

#: The White_Space code points (fixed values).
SPACES = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
NONE = np.int64(1) << 62


def vocabulary() -> bytes:
    """The default vocabulary file's bytes."""
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        return file.read()


def _class(prop: str, most: int) -> str:
    """A character class body: the code points up to ``most`` with a Unicode property, as
    the ``regex`` module knows it."""
    import regex

    text = "".join(map(chr, [*range(min(most + 1, 0xD800)), *range(0xE000, most + 1)]))
    runs = [m[0] for m in regex.finditer(rf"\p{{{prop}}}+", text)]
    return "".join(f"{re.escape(r[0])}-{re.escape(r[-1])}" if len(r) > 1 else re.escape(r) for r in runs)


def pretokenizer(most: int) -> re.Pattern:
    """public_tokenizers.PATTERN for the faster ``re``: the same alternatives in the same
    order, with \\p{L}, \\p{N} and \\s as explicit character classes. It holds for texts of
    code points up to ``most``; short classes match faster."""
    letters, numbers = _class("L", most), _class("N", most)
    return re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{numbers}]+| ?[^{SPACES}{letters}{numbers}]+"
                      rf"|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+")


class ByteBpe:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, ranks_file: bytes, most_cached: int = 400_000):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks_file.splitlines()) if a}
        size = max(self.ranks.values()) + 1
        by_rank = {rank: token for token, rank in self.ranks.items()}
        self.token_bytes = _Table([by_rank.get(i, b"") for i in range(size)])
        self.token_digits = _Table([b"%d " % i for i in range(size)])
        pairs = sorted((self.ranks[t[:i]] << 32 | self.ranks[t[i:]], rank) for t, rank in self.ranks.items()
                       for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks)
        self.pair_codes = np.array([p for p, _ in pairs], dtype=np.int64)
        self.pair_ranks = np.array([r for _, r in pairs], dtype=np.int64)
        self.pairs = dict(pairs)
        self.numbers = list(range(size))  # one object per id, shared by all cached tuples
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        self.splitters = [(most, pretokenizer(most).findall) for most in (0xFF, 0xFFFF, 0x10FFFF)]
        self.cache: dict[str, tuple[int, ...]] = {}
        self.most_cached = most_cached

    def _merge_one(self, word: bytes, leaves: int) -> tuple[int, ...]:
        """The same tree for one long byte string, in plain lists."""
        n, ids = len(word), self.byte_ids[np.frombuffer(word, dtype=np.uint8)]
        first = self._rank(ids[:-1], ids[1:])
        shift, none, ids = leaves.bit_length(), 1 << 62, ids.tolist()
        leaf = [none if r == NONE else r << shift | i for i, r in enumerate(first.tolist())]
        tree = [none] * leaves + leaf + [none] * (leaves - len(leaf))
        for node in range(leaves - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])
        after, before, rank_of = [*range(1, n), -1], list(range(-1, n - 1)), self.pairs.get

        def put(node, value):
            tree[node] = value
            while node > 1:
                other = tree[node ^ 1]
                node >>= 1
                value = other if other < value else value
                if tree[node] == value:
                    return
                tree[node] = value

        while (root := tree[1]) < none:
            p = root & ((1 << shift) - 1)
            gone = after[p]
            ids[p], ids[gone] = root >> shift, -1
            nxt, prev = after[gone], before[p]
            after[p] = nxt
            put(leaves + gone, none)
            rank = None
            if nxt >= 0:
                before[nxt] = p
                rank = rank_of(ids[p] << 32 | ids[nxt])
            put(leaves + p, none if rank is None else rank << shift | p)
            if prev >= 0:
                rank = rank_of(ids[prev] << 32 | ids[p])
                put(leaves + prev, none if rank is None else rank << shift | prev)
        return tuple(i for i in ids if i >= 0)

    def split(self, text: str) -> list[str]:
        """The pre-tokens of a text."""
        top = 0x7F if text.isascii() else ord(max(text))
        return next(split for most, split in self.splitters if top <= most)(text)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each merged pair, NONE where the pair doesn't merge."""
        code = left << 32 | right
        at = np.searchsorted(self.pair_codes, code)
        at[at == len(self.pair_codes)] = 0
        return np.where(self.pair_codes[at] == code, self.pair_ranks[at], NONE)

    def merge(self, words: list[bytes]) -> list[tuple[int, ...]]:
        """Ids of each non-empty byte string."""
        out: list = [None] * len(words)
        sizes: dict[int, list[int]] = {}
        for i, word in enumerate(words):
            sizes.setdefault(max(2, 1 << (len(word) - 1).bit_length()), []).append(i)
        for leaves, rows in sizes.items():
            step = max(1, (1 << 17) // leaves)
            for k in range(0, len(rows), step):
                part = rows[k:k + step]
                if len(part) * 64 < leaves:
                    for i in part:
                        out[i] = self._merge_one(words[i], leaves)
                    continue
                for i, ids in zip(part, self._merge_rows([words[i] for i in part], leaves)):
                    out[i] = ids
        return out

    def _merge_rows(self, words: list[bytes], leaves: int) -> list[tuple[int, ...]]:
        n, lens = len(words), np.array([len(w) for w in words])
        place = np.arange(leaves)
        there = place < lens[:, None]
        ids = np.zeros((n, leaves), dtype=np.int64)
        ids[there] = self.byte_ids[np.frombuffer(b"".join(words), dtype=np.uint8)]
        after = np.where(place + 1 < lens[:, None], place + 1, -1)
        before = np.broadcast_to(place - 1, (n, leaves)).copy()
        shift = leaves.bit_length()
        kind = np.int32 if shift <= 13 else np.int64
        none = kind(np.iinfo(kind).max)
        tree = np.full((n, 2 * leaves), none)

        def key(rank, pos):
            return np.where(rank == NONE, none, (rank << shift) | pos).astype(kind)

        r, p = np.nonzero(after >= 0)
        tree[r, leaves + p] = key(self._rank(ids[r, p], ids[r, p + 1]), p)
        level = leaves
        while level > 1:
            tree[:, level // 2:level] = np.minimum(tree[:, level:2 * level:2], tree[:, level + 1:2 * level:2])
            level //= 2
        rows, flat_tree = np.arange(n), tree.reshape(-1)

        def put(r, p, value):
            """Point update of leaf p in row r, then of its ancestors."""
            at, node = flat_tree, r * (2 * leaves) + p + leaves
            at[node] = value
            base = r * (2 * leaves)
            node = p + leaves
            for _ in range(shift - 1):
                node = node >> 1
                left = base + 2 * node
                at[base + node] = np.minimum(at[left], at[left + 1])

        while True:
            root = tree[rows, 1]
            rows = rows[root < none]
            if not len(rows):
                break
            root = tree[rows, 1].astype(np.int64)
            p = root & ((1 << shift) - 1)
            gone = after[rows, p]
            ids[rows, p] = root >> shift
            nxt = after[rows, gone]
            after[rows, p] = nxt
            after[rows, gone] = -2
            has = nxt >= 0
            before[rows[has], nxt[has]] = p[has]
            value = np.full(len(rows), none)
            value[has] = key(self._rank(ids[rows[has], p[has]], ids[rows[has], nxt[has]]), p[has])
            put(rows, gone, none)
            put(rows, p, value)
            prev = before[rows, p]
            has = prev >= 0
            if has.any():
                r, q, m = rows[has], prev[has], p[has]
                put(r, q, key(self._rank(ids[r, q], ids[r, m]), q))
        live = there & (after > -2)
        flat, counts = list(map(self.numbers.__getitem__, ids[live].tolist())), live.sum(1).tolist()
        out, at = [], 0
        for c in counts:
            out.append(tuple(flat[at:at + c]))
            at += c
        return out

    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and where each text's ids end."""
        pieces = [self.split(t) for t in texts]
        cache = self.cache
        new = list(set().union(*pieces).difference(cache))
        if len(cache) + len(new) > self.most_cached:
            cache.clear()
            new = list(set().union(*pieces))
        raw = [w.encode() for w in new]
        whole = [self.ranks.get(b) for b in raw]
        cache.update((w, (r,)) for w, r in zip(new, whole) if r is not None)
        rest = [i for i, r in enumerate(whole) if r is None]
        cache.update(zip([new[i] for i in rest], self.merge([raw[i] for i in rest])))
        got = [list(map(cache.__getitem__, ws)) for ws in pieces]
        ends = np.cumsum([sum(map(len, g)) for g in got], dtype=np.int64)
        flat = chain.from_iterable(chain.from_iterable(got))
        return np.fromiter(flat, dtype=np.int32, count=int(ends[-1]) if len(ends) else 0), ends

    def decode(self, ids: np.ndarray) -> bytes:
        return self.token_bytes.join(ids)[0].tobytes()


class _Table:
    """Byte strings by id; joins those of many ids at once."""

    def __init__(self, strings: list[bytes]):
        self.flat = np.frombuffer(b"".join(strings), dtype=np.uint8)
        self.lens = np.array([len(s) for s in strings], dtype=np.int64)
        self.starts = np.cumsum(self.lens) - self.lens

    def join(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All bytes, and where those of each id end."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.lens)):
            raise ValueError("an id is outside the vocabulary")
        lens = self.lens[ids]
        ends = np.cumsum(lens)
        total = int(ends[-1]) if len(ids) else 0
        return self.flat[np.repeat(self.starts[ids] - ends + lens, lens) + np.arange(total)], ends


_LOADED: dict[bytes, ByteBpe] = {}


def loaded(ranks_file: bytes) -> ByteBpe:
    """The encoder of a vocabulary, built once in each Python worker."""
    key = hashlib.sha256(ranks_file).digest()
    if key not in _LOADED:
        _LOADED[key] = ByteBpe(ranks_file)
    return _LOADED[key]


def _batches(docs: DataFrame, ranks_file: bytes | None, schema: str, rows_of) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(ranks_file if ranks_file is not None else vocabulary())

    def run(batches):
        bpe = loaded(shared.value)
        for pdf in batches:
            texts = [t or "" for t in pdf["text"]]
            for a, b in slices(texts, 1 << 21):
                out = rows_of(bpe, *bpe.encode_batch(texts[a:b]))
                if "text" in out and out["text"].tolist() != texts[a:b]:
                    raise ValueError("decoding the ids doesn't give the text back")
                out.insert(0, "doc_id", pdf["doc_id"].iloc[a:b].array)
                yield out

    return map_batches(docs.select("doc_id", "text"), run, schema)


def encode(docs: DataFrame, ranks_file: bytes | None = None) -> DataFrame:
    """doc_id and the ids of the whole text."""

    def rows(bpe, ids, ends):
        return pd.DataFrame({"ids": np.split(ids, ends[:-1])})

    return _batches(docs, ranks_file, "doc_id long, ids array<int>", rows)


def encode_and_decode(docs: DataFrame, ranks_file: bytes | None = None) -> DataFrame:
    """doc_id, the ids of the whole text, and the text that decoding them gives back; it is
    an error if that isn't the text that went in (null: empty)."""

    def rows(bpe, ids, ends):
        parts = np.split(ids, ends[:-1])
        return pd.DataFrame({"ids": parts, "text": [bpe.decode(p).decode() for p in parts]})

    return _batches(docs, ranks_file, "doc_id long, ids array<int>, text string", rows)


def encode_digests(docs: DataFrame, ranks_file: bytes | None = None) -> DataFrame:
    """doc_id, number of ids, sha256 of the joined decimal ids, sha256 of the bytes that
    decoding the ids gives back."""

    def digests(table: _Table, ids: np.ndarray, ends: np.ndarray, trim: int) -> list[str]:
        data, stops = table.join(ids)
        stops = np.concatenate([[0], stops])[np.concatenate([[0], ends])].tolist()
        view = memoryview(data)
        return [hashlib.sha256(view[a:max(a, b - trim)]).hexdigest() for a, b in zip(stops, stops[1:])]

    def rows(bpe, ids, ends):
        return pd.DataFrame({
            "n_tokens": np.diff(ends, prepend=0),
            "ids_sha256": digests(bpe.token_digits, ids, ends, 1),
            "decoded_sha256": digests(bpe.token_bytes, ids, ends, 0),
        })

    return _batches(docs, ranks_file, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", rows)


def decode(encoded: DataFrame, ranks_file: bytes | None = None) -> DataFrame:
    """doc_id and the decoded bytes of (doc_id, ids); null ids decode to no bytes, an id
    outside the vocabulary is an error."""
    shared = encoded.sparkSession.sparkContext.broadcast(ranks_file if ranks_file is not None else vocabulary())

    def run(batches):
        bpe = loaded(shared.value)
        for pdf in batches:
            pdf["bytes"] = [bpe.decode(np.asarray([] if ids is None else ids, dtype=np.int64)) for ids in pdf["ids"]]
            yield pdf[["doc_id", "bytes"]]

    return map_batches(encoded.select("doc_id", "ids"), run, "doc_id long, bytes binary")
