import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from cardtrail.llm import divergence
from cardtrail.llm.divergence import audit, share
from cardtrail.llm.queries import ORACLE_SQL, QUERIES

from .helpers import AWKWARD, SF001, documents
from .oracles import same_as_sql

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(rows, min_docs):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    counts, docs = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source, *_ in rows:
        terms = TERM.findall((text or "").translate(lower))
        counts[lang or "", source or ""].update(terms)
        docs[lang or ""].update(set(terms))
    kept = {lang: [t for t, n in of.items() if n >= min_docs] for lang, of in docs.items()}
    whole = defaultdict(Counter)
    for (lang, _), c in counts.items():
        whole[lang].update(c)
    def p(c, terms):
        total = sum(c[t] for t in terms) + 2 * len(terms)
        return {t: 1 + 10**9 * (c[t] + 2) // total for t in terms}
    def f(a, b):
        return (a - b) ** 2 // (a + b)
    shares = {g: p(c, kept[g[0]]) for g, c in counts.items()}
    of_lang = {lang: p(c, kept[lang]) for lang, c in whole.items()}
    out = []
    for (lang, source), own in shares.items():
        pairs = [(sum(f(own[t], other[t]) for t in own), s) for (of, s), other in shares.items() if of == lang and s != source]
        terms = [(f(own[t], of_lang[lang][t]), t) for t in own if counts[lang, source][t] and own[t] > of_lang[lang][t]]
        for part, found in (("pair", pairs), ("term", terms)):
            found.sort(key=lambda x: (-x[0], x[1].encode()))
            out += [(lang, source, part, item, value, i + 1) for i, (value, item) in enumerate(found) if part == "pair" or i < 10]
    return sorted(out)


def check(spark, rows, min_docs, **settings):
    got = audit(documents(spark, rows, clash=True), min_docs, **settings)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == brute(rows, min_docs)


def test_matches_sql(spark):
    same_as_sql(QUERIES["op12_source_divergence"](spark, SF001), ORACLE_SQL["op12_source_divergence"], SF001)


def test_awkward_documents(spark):
    check(spark, AWKWARD, 1)
    check(spark, AWKWARD + [(9007199254740993, "The ÉTÉ été [x_y] a1b", "en", "a", 3)] * 3, 2)
    check(spark, AWKWARD, 10)  # no term is kept: pairs of value 0


def random_rows(sources, docs):
    rng = random.Random(5)
    words = [rng.choice(["The", "qü", "x", "ZZ", "été", "漢"]) + rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(80)]
    return [(i, " ".join(rng.choices(words, k=rng.randint(0, 40))), rng.choice(["en", "de", None]), f"s{rng.randrange(sources) if rng.random() > 0.3 else 0}", 0)
            for i in range(docs)]


def test_many_small_blocks_and_shards(spark):
    rows = random_rows(7, 500)
    check(spark, rows, 10, block_postings=50, shards=3)
    check(spark, rows, 10, shards=1)


def test_many_sources(spark):
    rows = random_rows(520, 700)
    check(spark, [(i, text, "en", source, n) for i, text, _, source, n in rows], 10)


def test_a_text_longer_than_a_slice():
    text = b"ab " * 100 + b"c" * 50 + b" de" * 100
    with pytest.MonkeyPatch.context() as m:
        m.setattr(divergence, "SLICE", 7)
        parts = list(divergence.term_slices(text))
    assert len(parts) > 20 and sum(parts, []) == text.split()


def test_shares_of_counts_beyond_64_bits(spark):
    n, total, v = 3_000_000_000_000, 9_000_000_000_000, 1_000_000
    got = spark.range(1).select(share(F.lit(n), F.lit(total), F.lit(v)).alias("p")).first()["p"]
    assert got == 1 + 10**9 * (n + 2) // (total + 2 * v)


def test_no_documents(spark):
    assert audit(documents(spark, [])).count() == 0


def test_spilled_runs_hold_every_posting():
    rng = random.Random(3)
    groups = {key: Counter({b"": 0} if key[1] else {}) for key in [("a", "x"), ("a", None), ("b", "x"), ("b", ""), ("b", None)]}
    for counts in groups.values():
        counts.update(f"t{rng.randint(0, 900)}".encode() for _ in range(1500))
    for shards in (1, 5):
        rows = [r for batch in divergence.spilled(groups, shards) for r in batch.to_pylist()]
        assert [(r["shard"], r["first"]) for r in rows] == sorted((r["shard"], r["first"]) for r in rows)
        got = {key: {} for key in groups}
        for row in rows:
            for term, numbers in divergence._opened(row):
                assert zlib.crc32(term) % shards == row["shard"]
                for key, n in numbers:
                    assert term not in got[key]
                    got[key][term] = n
        assert got == groups
    assert [batch.num_rows for batch in divergence.spilled({}, 3)] == [0]
