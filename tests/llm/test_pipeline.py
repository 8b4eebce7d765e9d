import os
import subprocess
import sys


import corpus_pipeline
from cardtrail.llm import byte_bpe, mixing, secret_scan, toxicity

from .helpers import SF0001, documents
from .test_neardup import brute


def stage(name):
    return next(f for n, f in corpus_pipeline.STAGES if name in n)


def test_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "toxicity", "MinHash near-dedup", "secret scans", "mixing sources to target weights", "byte-level BPE encoding and decoding"]


def test_near_dedup_keeps_one_of_each_group(spark):
    docs = spark.read.parquet(f"{SF0001}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    first = brute(rows)
    kept = stage("near-dedup")(spark, docs, SF0001)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, c in first.items() if i == c)


def test_near_dedup_of_repeated_rows_and_rows_without_id(spark):
    kept = stage("near-dedup")(spark, documents(spark, clash=True), SF0001)
    ids = sorted((r["doc_id"] for r in kept.collect()), key=str)
    assert ids == sorted([1, 3, 4, 5, 6, 8, 9, None], key=str)


def test_whole_pipeline_matches_the_stages_one_by_one(spark):
    docs = spark.read.parquet(f"{SF0001}/documents.parquet")
    labels = spark.read.parquet(f"{SF0001}/labels.parquet")
    flagged = {r["doc_id"] for r in toxicity.score_documents(docs, labels).collect() if r["predicted"]}
    left = [r for r in docs.collect() if r["doc_id"] not in flagged]
    first = brute([(r["doc_id"], r["text"]) for r in left])
    left = [r for r in left if first[r["doc_id"]] == r["doc_id"]]
    rows = [(r["doc_id"], secret_scan.redact(r["text"] or ""), r["lang"], r["source"], r["n_chars"]) for r in left]
    clean = documents(spark, rows)
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix(clean).collect()}
    got = corpus_pipeline.run(spark, SF0001).collect()
    words, bpe = {}, byte_bpe.loaded(byte_bpe.vocabulary())
    for r in got:
        text = bpe.decode(__import__("numpy").array(r["ids"], dtype="int64")).decode()
        words[r["doc_id"]] = words.get(r["doc_id"], 0) + len(text.encode().split())
        assert text.split() == next(t for i, t, *_ in rows if i == r["doc_id"]).split()[:len(text.split())]
    assert words == {i: n for i, n in taken.items() if n}


def test_awkward_documents_pass_all_stages(spark):
    docs = documents(spark, clash=True)
    for name, f in corpus_pipeline.STAGES[:-1]:
        out = f(spark, docs, SF0001)
        assert out.columns == docs.columns, name
        docs = spark.createDataFrame(out.collect(), out.schema)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF0001).count() == docs.count() > 0
    for name, f in corpus_pipeline.STAGES:
        assert f(spark, documents(spark, []), SF0001).count() == 0, name


def test_entry_lists_the_operators_and_survives_without_them():
    import __spark_entry__

    names = [n for n in __spark_entry__.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    # as if the folders were not there
    code = ("import sys\nclass Gone:\n    def find_spec(self, name, path=None, target=None):\n"
            "        if name in ('corpus_pipeline', 'cardtrail.llm'): raise ModuleNotFoundError(name, name=name)\n"
            "sys.meta_path.insert(0, Gone())\nimport __spark_entry__ as e\n"
            "assert e.queries() and not [n for n in e.queries() if n.startswith('op') or n == 'pipeline']\n"
            "assert set(e.oracle_sql()) == set(e.queries())\n")
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    subprocess.run([sys.executable, "-c", code], check=True, cwd=root, timeout=120)
