import random

import duckdb
import numpy as np

from cardtrail.llm import neardup
from cardtrail.llm.queries import ORACLE_SQL, op1_near_duplicates

from .helpers import SF001, documents, words


def shingles(text):
    w = words(text)
    if not w:
        return set()
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}


def brute(rows):
    """(doc_id -> smallest reachable doc_id) by comparing all pairs."""
    sets = {i: shingles(t) for i, t in rows}
    label = {i: i for i in sets}
    changed = True
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label


def test_awkward_rows(spark):
    got = {(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(documents(spark, clash=True)).collect()}
    assert (1, 8, 1, True) in got and (2, 8, 1, False) in got
    assert (3, 0, 3, True) in got and (4, 0, 4, True) in got and (5, 0, 5, True) in got
    assert (6, 1, 6, True) in got and (7, 1, 6, False) in got
    assert (9, 3, 9, True) in got and (8, len(shingles(documents(spark).where("doc_id = 8").first()["text"])), 8, True) in got
    assert any(r[0] is None and r[2] is None and r[3] for r in got)


def test_empty_table(spark):
    assert neardup.near_duplicates(documents(spark, [])).count() == 0
    assert neardup.drop_near_duplicates(documents(spark, [])).count() == 0


def test_families_of_near_copies_match_brute_force(spark, monkeypatch):
    # copies changed here and there, chains of changes, a passage that many texts share;
    # small blocks, so that families are cut into several tiles
    monkeypatch.setattr(neardup, "BLOCK", 7)
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    passage = [word() for _ in range(60)]
    rows = []
    for family in range(6):
        text = [word() for _ in range(rng.choice((30, 120, 200)))]
        for _ in range(40):
            copy = list(text)
            for _ in range(rng.randint(0, 8)):
                copy[rng.randrange(len(copy))] = word()
            rows.append(copy)
            if family % 2:
                text = copy  # a chain
    rows += [[word() for _ in range(rng.randint(5, 60))] + passage for _ in range(60)]
    rng.shuffle(rows)
    rows = [(i, " ".join(r)) for i, r in enumerate(rows)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(docs).collect()}
    assert got == brute(rows)


def test_forest_spans_exactly_the_links():
    rng = np.random.default_rng(3)
    base = rng.choice(10**6, 400, replace=False)
    sets = []
    for _ in range(60):
        keep = base[rng.random(400) < 0.9]
        sets.append(np.unique(np.concatenate([keep, rng.choice(10**6, 20)]).astype(np.int64) * 2654435761 % (2**61)))
    every = np.arange(len(sets))
    edges = neardup.forest(sets, every, every)
    for a, b in edges:
        both = len(np.intersect1d(sets[a], sets[b]))
        assert 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both)
    label = list(range(len(sets)))
    for a, b in edges:
        x, y = label[a], label[b]
        label = [min(x, y) if v in (x, y) else v for v in label]
    for a in range(len(sets)):
        for b in range(a):
            both = len(np.intersect1d(sets[a], sets[b]))
            if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                assert label[a] == label[b]


def test_matches_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF001}/documents.parquet'")
    want = {tuple(r) for r in con.execute(ORACLE_SQL["op1_near_duplicates"]).fetchall()}
    got = {(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in op1_near_duplicates(spark, SF001).collect()}
    assert got == want


def near_copies(rng, count, changes=2):
    text = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    out = []
    for _ in range(count):
        copy = list(text)
        for _ in range(changes):
            copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**9)}"
        out.append(np.sort(neardup.shingle_set(" ".join(copy))))
    return out


def test_rows_compared_in_a_family_grow_with_its_size(spark, monkeypatch):
    # one group of near copies of one text, and as many texts that resemble nothing
    monkeypatch.setattr(neardup, "BLOCK", 16)
    rng, rows = random.Random(3), {}
    for size in (100, 200, 400):
        family = near_copies(rng, size)
        members = spark.createDataFrame([(0, i) for i in range(size)], "leader long, class_id long")
        sets = spark.createDataFrame([(i, x.tobytes()) for i, x in enumerate(family)], "class_id long, shingles binary")
        starred = neardup.stars(members, sets).cache()
        assert starred.count() == size and starred.where("bits != 0").count() >= 0.97 * size
        rows[size] = neardup.tiles(members, starred).count()
    assert all(n <= 12 * size for size, n in rows.items())


def test_pairs_outside_the_core_are_all_compared(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 8)
    members = spark.createDataFrame([(0, i) for i in range(60)] + [(100, i) for i in range(100, 105)], "leader long, class_id long")
    starred = spark.createDataFrame([(0, i, 1 if i < 20 else 2 if i < 30 else 3 if i == 30 else 4 if i < 40 else 0, []) for i in range(60)],
                                    "leader long, class_id long, bits int, linked array<long>")
    at = {}
    for r in neardup.tiles(members, starred).collect():
        at.setdefault((r["leader"], r["low"], r["high"]), {}).setdefault(r["block"], set()).add(r["class_id"])
    met = {frozenset((a, b)) for (_, low, high), by in at.items() for a in by.get(low, ()) for b in by.get(high, ()) if a != b}
    core = set(range(31))
    assert all(({a, b} <= core) != (frozenset((a, b)) in met) for a in range(60) for b in range(a))
    assert all(frozenset((a, b)) in met for a in range(100, 105) for b in range(100, a))


def test_clusters_of_representatives():
    assert neardup.core_of([(0, 50)]) == neardup.core_of([]) == 0
    assert neardup.core_of([(0, 50), (1, 5), (2, 6), (4, 9)]) == 4
    assert neardup.core_of([(1, 5), (2, 6), (4, 9), (3, 1)]) == 3


def test_a_block_without_classes_of_its_own():
    import pandas as pd
    sets = [neardup.shingle_set("one two three four five six").tobytes()] * 2
    out = neardup.star(pd.DataFrame({"leader": [1, 1], "class_id": [1, 2], "nth": [0, 1], "shingles": sets}))
    assert len(out) == 0 and out["linked"].dtype == object
