import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from cardtrail.llm import byte_bpe
from cardtrail.llm.queries import op7_byte_bpe

from .helpers import SF001, documents


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, byte_bpe.vocabulary().splitlines())}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def digests(library, text):
    ids = library.encode_ordinary(text or "")
    return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def test_random_texts_match_the_library(library):
    rng = random.Random(1)
    letters = "ab '\t\n\r\x0b\x1c\x1f\x85\xa0　​ 1²٣éßñ漢字🙂.,!-'sré́ǅªⅧ_𝒳𐐀"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    texts += ["a" * 5000, " " * 3000 + "x", "".join(rng.choice("abcdefgh") for _ in range(8000)), "<|endoftext|>", "", "\x00\x01", "don't WE'LL"]
    bpe = byte_bpe.loaded(byte_bpe.vocabulary())
    ids, ends = bpe.encode_batch(texts)
    start = 0
    for text, end in zip(texts, ends.tolist()):
        assert ids[start:end].tolist() == library.encode_ordinary(text)
        assert bpe.decode(ids[start:end]) == text.encode()
        start = end


def test_tree_forms_agree():
    bpe = byte_bpe.loaded(byte_bpe.vocabulary())
    rng = random.Random(2)
    for _ in range(100):
        word = bytes(rng.choice(b"abcdeth ") for _ in range(rng.randint(2, 60)))
        leaves = max(2, 1 << (len(word) - 1).bit_length())
        assert bpe._merge_one(word, leaves) == bpe._merge_rows([word], leaves)[0]


def test_whole_table_matches_the_library(spark, library):
    got = {r["doc_id"]: tuple(r)[1:] for r in op7_byte_bpe(spark, SF001).collect()}
    docs = spark.read.parquet(f"{SF001}/documents.parquet").collect()
    assert got == {r["doc_id"]: digests(library, r["text"]) for r in docs}


def test_awkward_rows_and_round_trip(spark, library):
    docs = documents(spark, clash=True)
    rows = docs.collect()
    want = sorted(((r["doc_id"], *digests(library, r["text"])) for r in rows), key=str)
    assert sorted((tuple(r) for r in byte_bpe.encode_digests(docs).collect()), key=str) == want
    back = byte_bpe.decode(byte_bpe.encode(docs)).collect()
    assert sorted(((r["doc_id"], bytes(r["bytes"])) for r in back), key=str) == sorted(((r["doc_id"], (r["text"] or "").encode()) for r in rows), key=str)
    assert byte_bpe.encode_digests(documents(spark, [])).count() == 0
    with pytest.raises(Exception, match="outside the vocabulary"):
        byte_bpe.decode(spark.createDataFrame([(1, [60000])], "doc_id long, ids array<int>")).collect()
