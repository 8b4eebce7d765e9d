"""Language-model scoring by prediction by partial matching over bytes.

The model is the trie of all contexts of up to ``ORDER`` symbols (bytes, or the mark
before and after a text) with the counts of what follows them in the training documents.
The code of a symbol starts at the longest context seen; a symbol that never followed it
is coded as an escape and left to the context shortened by one symbol, where the symbols
that the longer context would have coded are excluded; below the empty context all
remaining symbols are equally likely. The longest contexts count occurrences, shorter
ones in how many contexts one symbol longer a symbol occurred (update exclusion). With a
count of n and u distinct symbols left after exclusion, a symbol of count c has the
probability (c - DISCOUNT) / n and the escape DISCOUNT * u / n. A text's score is the
log10 probability of its bytes and its end mark.

How the counts reach the documents without a table in every task:

1. Documents are dealt to chunks by hash; a chunk asks for its distinct grams (context and
   symbol, one 54-bit code) and distinct words, with its training counts, in one row per
   (chunk, bucket). A gram's bucket is a hash of its last three context symbols, a word's
   a hash of the word, so that a frequent gram is one entry per chunk.
2. A bucket adds up the counts, walks the trie for every gram asked for, and answers each
   chunk with log probabilities and word counts. Orders 0 to 2 come from a table of at
   most 257^3 counts, which bounds its broadcast whatever the input; it takes a first
   pass over the training texts.
3. Each chunk's documents meet the chunk's answers and are scored.

Words, for the base score, are told apart by 64-bit hashes.

Defined results: null texts are empty (one token, the end). Rows without doc_id fold as
the empty text of an id. Repeated rows are scored, and learnt from, as often as they
come. Without training documents the model is uniform and N is 0. An empty table gives
an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardtrail.llm.common import fold, map_batches, ship, slices

ORDER = 5
BITS = 9
END = 256
SYMBOLS = 257
DISCOUNT = 0.4
SLICE = 1 << 20  # characters whose codes a task holds at once
LOW = 2  # orders up to this one come from the broadcast table


def mask(order: int) -> np.int64:
    return np.int64((1 << BITS * (order + 1)) - 1)


def codes(texts: list[bytes], order: int = ORDER) -> np.ndarray:
    """The codes of all symbols of all texts, end marks included: the symbol in the low
    bits, the symbols before it above, the nearest lowest."""
    size = sum(map(len, texts)) + len(texts)
    symbols = np.full(size + order, END, dtype=np.int64)
    flat = np.frombuffer(b"".join(texts), dtype=np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts])
    place = np.ones(size, dtype=bool)
    place[ends - 1] = False
    symbols[order:][place] = flat
    out = symbols[order:].copy()
    for k in range(1, order + 1):
        out |= symbols[order - k:size + order - k] << np.int64(BITS * k)
    # what stands before a text is marks, not the text before it
    for k in range(order - 1):
        at = ends[:-1] + k
        at = at[at < size]
        here = np.concatenate([[0], ends])[np.searchsorted(ends, at, side="right")]
        seen = (at - here)
        for s in np.unique(seen):
            rows = at[seen == s]
            kept = out[rows] & mask(int(s))
            marks = np.int64(sum(END << BITS * j for j in range(int(s) + 1, order + 1)))
            out[rows] = kept | marks
    return out


def counted(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with the sums of their counts."""
    unique, inverse = np.unique(keys, return_inverse=True)
    return unique, np.bincount(inverse, weights=counts, minlength=len(unique)).astype(np.int64)


class Level:
    """The contexts of one order and what follows them (counts above 0 only)."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.keys, self.counts = keys, counts
        contexts = keys >> np.int64(BITS)
        self.contexts, first, self.of_key = np.unique(contexts, return_index=True, return_inverse=True)
        self.n = np.bincount(self.of_key, weights=counts, minlength=len(self.contexts))
        self.u = np.bincount(self.of_key, minlength=len(self.contexts)).astype(float)
        self.excluded = np.zeros(len(self.contexts))

    def count(self, keys: np.ndarray) -> np.ndarray:
        return _at(self.keys, self.counts, keys)[0]

    def exclude(self, shorter: "Level", order: int) -> None:
        """For each context, how often the next shorter one is followed by its symbols."""
        self.excluded = np.bincount(self.of_key, weights=shorter.count(self.keys & mask(order - 1)), minlength=len(self.contexts))


def _at(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """values by key, 0 for unknown keys; and which are known."""
    if not len(keys):
        return np.zeros(len(wanted), dtype=values.dtype), np.zeros(len(wanted), dtype=bool)
    i = np.searchsorted(keys, wanted)
    i[i == len(keys)] = 0
    known = keys[i] == wanted
    return np.where(known, values[i], 0), known


def shorter(level: Level, order: int) -> Level:
    """The level of ``order``, one below ``level``: each symbol counts once for every
    longer context that it follows."""
    return Level(*counted(level.keys & mask(order), np.ones(len(level.keys))))


def low_levels(keys: np.ndarray, counts: np.ndarray) -> list[Level]:
    """Levels 0 to LOW from the counts of order LOW."""
    levels = [Level(keys, counts)]
    for order in range(LOW - 1, -1, -1):
        levels.insert(0, shorter(levels[0], order))
        levels[1].exclude(levels[0], order + 1)
    return levels


def log_probabilities(grams: np.ndarray, counts: np.ndarray, low: list[Level]) -> np.ndarray:
    """log10 probability of each gram (distinct, in order). ``counts`` are the training
    counts (0: asked for only); the grams hold all training grams of their contexts."""
    seen = counts > 0
    levels = [Level(grams[seen], counts[seen])]
    for order in range(ORDER - 1, LOW, -1):
        levels.insert(0, shorter(levels[0], order))
    levels = low + levels
    for order in range(LOW + 1, ORDER + 1):
        levels[order].exclude(levels[order - 1], order)
    out, todo = np.zeros(len(grams)), np.arange(len(grams))
    less_n, less_u = np.zeros(len(grams)), np.zeros(len(grams))
    for order in range(ORDER, -1, -1):
        if not len(todo):
            break
        level, keys = levels[order], grams[todo] & mask(order)
        contexts = keys >> np.int64(BITS)
        i, known = _at(level.contexts, np.arange(len(level.contexts)), contexts)
        if not len(level.contexts):
            continue
        n = np.where(known, level.n[i] - less_n[todo], 0)
        u = np.where(known, level.u[i] - less_u[todo], 0)
        c = level.count(keys)
        coded = c > 0
        out[todo[coded]] += np.log10((c[coded] - DISCOUNT) / n[coded])
        escaped = ~coded & (n > 0)
        out[todo[escaped]] += np.log10(DISCOUNT * u[escaped] / n[escaped])
        rest = ~coded & known
        less_n[todo[rest]], less_u[todo[rest]] = level.excluded[i[rest]], level.u[i[rest]]
        todo = todo[~coded]
    if len(todo):
        first = low[0].u[0] if len(low[0].u) else 0.0
        out[todo] -= np.log10(SYMBOLS - first)
    return out


class Lookup:
    """Values by 64-bit key: open addressing, probed for many keys at once."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, (2 * len(keys)).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, dtype=np.int64), np.zeros(1 << self.bits)
        rest, at = np.arange(len(keys)), self._home(keys)
        while len(rest):
            free = self.keys[at] == -1
            self.keys[at[free]] = keys[rest[free]]
            done = self.keys[at] == keys[rest]
            self.values[at[done]] = values[rest[done]]
            rest, at = rest[~done], (at[~done] + 1) & ((1 << self.bits) - 1)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __getitem__(self, keys: np.ndarray) -> np.ndarray:
        at = self._home(keys)
        rest = np.flatnonzero(self.keys[at] != keys)
        while len(rest):
            if (self.keys[at[rest]] == -1).any():
                raise KeyError("a gram that the chunk didn't ask for")
            at[rest] = (at[rest] + 1) & ((1 << self.bits) - 1)
            rest = rest[self.keys[at[rest]] != keys[rest]]
        return self.values[at]


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    mixed = keys.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(32)
    return ((mixed * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(33)).astype(np.int64) % buckets


def squeeze(values: np.ndarray, rising: bool = False) -> bytes:
    """An array as bytes: byte by byte plane, compressed; differences if it rises."""
    if rising:
        values = np.diff(values, prepend=values.dtype.type(0))
    return zlib.compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T).tobytes(), 1)


def unsqueeze(data: bytes, dtype, rising: bool = False) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), dtype=np.uint8).reshape(np.dtype(dtype).itemsize, -1)
    values = np.ascontiguousarray(planes.T).reshape(-1).view(dtype)
    return np.cumsum(values, dtype=dtype) if rising else values


def _word_key(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word) - (1 << 63)


def _words(text: bytes) -> list[bytes]:
    """A text's tokens; the end is the empty word."""
    return [*text.lower().split(), b""]


def _texts(pdf: pd.DataFrame) -> list[bytes]:
    return [t.encode() if t else b"" for t in pdf["text"]]


def low_counts(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Counts of order LOW of the training texts of (text, held_out) rows, by gram. At most
    257^3 rows reach the driver."""

    def run(batches):
        seen = np.zeros(0, dtype=np.int64)
        for pdf in batches:
            texts = [t for t, h in zip(_texts(pdf), pdf["held_out"]) if not h]
            for a, b in slices(texts, SLICE):
                seen = np.union1d(seen, codes(texts[a:b], LOW + 1))
        yield pd.DataFrame({"gram": seen})

    longer = map_batches(docs.select("text", "held_out"), run, "gram long").distinct()
    rows = longer.groupBy(F.col("gram").bitwiseAND(F.lit(int(mask(LOW)))).alias("gram")).count().toPandas()
    order = np.argsort(rows["gram"].to_numpy())
    return rows["gram"].to_numpy(dtype=np.int64)[order], rows["count"].to_numpy(dtype=np.int64)[order]


def score_documents(docs: DataFrame, folds: int = 5, held_fold: int = 1, chunk_chars: int = 8 << 20) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    spark = docs.sparkSession
    ship(spark)
    # grouped pandas would carry nullable ids as floats
    docs = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text", (fold("doc_id", folds) == held_fold).alias("held_out"))
    size = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    chunks = int(size // chunk_chars) + 1
    buckets = chunks // 2 + 4
    low = spark.sparkContext.broadcast(low_counts(docs))
    dealt = docs.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks))).repartition(chunks, "chunk")

    def ask(key, pdf):
        texts, held = _texts(pdf), pdf["held_out"].to_numpy()
        grams, words = [], Counter()
        for mine in (False, True):
            part = [t for t, h in zip(texts, held) if h == mine]
            for a, b in slices(part, SLICE):
                k, c = np.unique(codes(part[a:b]), return_counts=True)
                grams.append((k, c * (not mine)))
                for t in part[a:b]:
                    if mine:
                        words.update(dict.fromkeys(_words(t), 0))
                    else:
                        words.update(_words(t))
        g_keys, g_counts = counted(np.concatenate([k for k, _ in grams]), np.concatenate([c for _, c in grams]))
        w_keys = np.fromiter(map(_word_key, words), dtype=np.int64, count=len(words))
        w_counts = np.fromiter(words.values(), dtype=np.int64, count=len(words))
        order = np.argsort(w_keys)
        w_keys, w_counts = w_keys[order], w_counts[order]
        g_to, w_to = _bucket((g_keys >> np.int64(BITS)) & mask(2), buckets), _bucket(w_keys, buckets)
        rows = []
        for bucket in range(buckets):
            g, w = g_to == bucket, w_to == bucket
            rows.append((key[0], bucket, squeeze(g_keys[g], True), squeeze(g_counts[g]), squeeze(w_keys[w], True), squeeze(w_counts[w])))
        return pd.DataFrame(rows, columns=["chunk", "bucket", "grams", "gram_counts", "words", "word_counts"])

    asked = dealt.groupBy("chunk").applyInPandas(
        ask, "chunk long, bucket int, grams binary, gram_counts binary, words binary, word_counts binary")

    def answer(pdf):
        def summed(keys, counts):
            k = [unsqueeze(x, np.int64, True) for x in pdf[keys]]
            unique, inverse = np.unique(np.concatenate(k), return_inverse=True)
            c = np.concatenate([unsqueeze(x, np.int64) for x in pdf[counts]])
            total = np.bincount(inverse, weights=c, minlength=len(unique)).astype(np.int64)
            return k, unique, total, np.split(inverse, np.cumsum([len(x) for x in k])[:-1])

        _, unique, total, where = summed("grams", "gram_counts")
        chances = log_probabilities(unique, total, low_levels(*low.value)).astype(np.float32)
        _, _, word_total, word_where = summed("words", "word_counts")
        return pd.DataFrame({
            "chunk": pdf["chunk"], "grams": pdf["grams"], "chances": [chances[i].tobytes() for i in where],
            "words": pdf["words"], "counts": [squeeze(word_total[i]) for i in word_where],
            "n": int(word_total.sum()), "v": int((word_total > 0).sum())})

    answers = asked.groupBy("bucket").applyInPandas(answer, "chunk long, grams binary, chances binary, words binary, counts binary, n long, v long")

    def score(pdf, replies):
        texts = _texts(pdf)
        joined = {c: np.concatenate([unsqueeze(x, np.int64, c != "counts") for x in replies[c]]) for c in ("grams", "words", "counts")}
        joined["chances"] = np.frombuffer(b"".join(replies["chances"]), dtype=np.float32)
        n, v = int(replies["n"].sum()), int(replies["v"].sum())
        chance = Lookup(joined["grams"], joined["chances"])
        order = np.argsort(joined["words"])
        w_keys, w_counts = joined["words"][order], joined["counts"][order]
        base = np.log10(n + 0.5 * (v + 1))
        parts = []
        for a, b in slices(texts, SLICE):
            part = texts[a:b]
            found = chance[codes(part)]
            scores = np.add.reduceat(found, np.cumsum([0] + [len(t) + 1 for t in part[:-1]]))
            words = [_words(t) for t in part]
            distinct = list(set().union(*words))
            counts = w_counts[np.searchsorted(w_keys, np.fromiter(map(_word_key, distinct), dtype=np.int64, count=len(distinct)))]
            log_of = dict(zip(distinct, np.log10(counts + 0.5).tolist()))
            unknown = {w for w, c in zip(distinct, counts.tolist()) if not c}
            tokens = np.array([len(ws) for ws in words])
            out = pd.DataFrame({
                "n_tokens": tokens,
                "n_known": [len(ws) - sum(map(unknown.__contains__, ws)) for ws in words],
                "train_tokens": n,
                "base_score": [sum(map(log_of.__getitem__, ws)) for ws in words] - tokens * base,
                "score": scores})
            out.insert(0, "held_out", pdf["held_out"].iloc[a:b].to_numpy())
            out.insert(0, "doc_id", pdf["doc_id"].iloc[a:b].to_numpy())
            parts.append(out)
        return pd.concat(parts)

    scored = dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(
        score, "doc_id string, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return scored.withColumn("doc_id", F.col("doc_id").cast("long"))
