import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cardtrail.llm import ppm
from cardtrail.llm.queries import op4_ppm_score

from .helpers import SF0001, documents

END, ORDER = ppm.END, ppm.ORDER


def fold(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 5


def brute_ppm(train, texts):
    """log10 probabilities from a trie of dictionaries, one symbol at a time."""
    counts, longer = defaultdict(Counter), defaultdict(set)
    for t in train:
        s = [END] * ORDER + list(t) + [END]
        for i in range(ORDER, len(s)):
            counts[tuple(s[i - ORDER:i])][s[i]] += 1
            for d in range(ORDER):
                longer[tuple(s[i - d:i]), s[i]].add(s[i - d - 1])
    for (context, symbol), seen in longer.items():
        counts[context][symbol] = len(seen)
    out = []
    for t in texts:
        s, total = [END] * ORDER + list(t) + [END], 0.0
        for i in range(ORDER, len(s)):
            excluded = set()
            for d in range(ORDER, -1, -1):
                here = {k: v for k, v in counts.get(tuple(s[i - d:i]), {}).items() if k not in excluded}
                if not here:
                    continue
                n = sum(here.values())
                if s[i] in here:
                    total += math.log10((here[s[i]] - ppm.DISCOUNT) / n)
                    break
                total += math.log10(ppm.DISCOUNT * len(here) / n)
                excluded |= set(here)
            else:
                total -= math.log10(ppm.SYMBOLS - len(excluded))
        out.append(total)
    return out


def brute(rows):
    tokens = lambda t: (t or "").encode().lower().split() + [b""]
    train = [t for i, t in rows if fold(i) != 1]
    c = Counter(w for t in train for w in tokens(t))
    n, v = sum(c.values()), len(c)
    scores = brute_ppm([(t or "").encode() for t in train], [(t or "").encode() for _, t in rows])
    return [(i, fold(i) == 1, len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n,
             sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(t)), s) for (i, t), s in zip(rows, scores)]


def same(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[5])
    got, want = sorted((tuple(r) for r in got), key=key), sorted(want, key=key)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:5] == w[:5]
        assert g[5] == pytest.approx(w[5], abs=1e-6) and g[6] == pytest.approx(w[6], rel=1e-5, abs=1e-4)


def test_codes():
    texts = ["abc".encode(), b"", b"x", "éa".encode(), b"abcabcabc", b"", b"", b"ab"]
    want = []
    for t in texts:
        s = [END] * ORDER + list(t) + [END]
        want += [sum(s[i - k] << (ppm.BITS * k) for k in range(ORDER + 1)) for i in range(ORDER, len(s))]
    assert ppm.codes(texts).tolist() == want


def test_whole_table_of_short_texts_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SF0001}/documents.parquet").where(F.length("text") < 1500)
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    same(ppm.score_documents(docs, chunk_chars=20_000).collect(), brute(rows))


def test_awkward_rows(spark):
    docs = documents(spark, clash=True).where("doc_id is null or doc_id <> 8")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    same(ppm.score_documents(docs).collect(), brute(rows))
    assert ppm.score_documents(documents(spark, [])).count() == 0
    held = next(i for i in range(100) if fold(i) == 1)
    lone = ppm.score_documents(documents(spark, [(held, "ab", None, None, 2)])).first()
    assert lone["train_tokens"] == 0 and lone["base_score"] == 0 and lone["score"] == pytest.approx(-3 * math.log10(257))


def test_probabilities_sum_to_one():
    rng = random.Random(1)
    train = ["".join(rng.choice("abcé ") for _ in range(30)).encode() for _ in range(30)]
    context = ppm.codes([b"abcab"])[4] << np.int64(ppm.BITS)
    asked = (context | np.arange(ppm.SYMBOLS)) & ppm.mask(ORDER)
    grams = ppm.codes(train)
    keys, counts = ppm.counted(np.concatenate([grams, asked]), np.concatenate([np.ones(len(grams)), np.zeros(len(asked))]))
    low = np.unique(np.unique(ppm.codes(train, ppm.LOW + 1)) & ppm.mask(ppm.LOW), return_counts=True)
    chance = ppm.Lookup(keys, ppm.log_probabilities(keys, counts, ppm.low_levels(*low)))
    assert (10 ** chance[asked]).sum() == pytest.approx(1.0)


def test_model_learns(spark):
    rows = op4_ppm_score(spark, SF0001).collect()
    assert len(rows) == 200
    uniform = sum(r["n_tokens"] for r in rows)
    assert sum(r["score"] for r in rows if r["held_out"]) < 0 < uniform
