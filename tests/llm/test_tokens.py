import random

import pytest

from codewell.llm.tokens import SpeculativeBpe, encode_corpus

PATH = "/opt/tokenizers/byte_bpe_50k.tiktoken"


@pytest.fixture(scope="module")
def judge():
    import os

    from tokenizers import Tokenizer

    t = Tokenizer.from_file(os.path.join(os.path.dirname(PATH), "byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda texts: [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_equals_the_public_encoder(judge):
    rng = random.Random(3)
    odd = "aeiouxyz  \n\t'sdé😀日本ñ  \x1c\x85​.,!?0123456789<|>ABCß́٠ªİ"
    texts = ["".join(rng.choice(odd) for _ in range(rng.randint(1, 60))) for _ in range(3000)]
    texts += ["<|endoftext|> is text", " " * 700, "a" * 5000, "ab" * 700 + "\n\n", "I'm you're they'll 'tis", "\r\n\r\n x", "zzxxqqjj" * 90]
    bpe = SpeculativeBpe.load(PATH)
    assert bpe.encode_batch(texts) == judge(texts)
    assert bpe.merged_words > 0


def test_long_merge_equals_short():
    bpe = SpeculativeBpe.load(PATH)
    rng = random.Random(5)
    for _ in range(200):
        w = bytes(rng.choice(b"abcdetionrs ") for _ in range(rng.randint(1, 200)))
        assert bpe._merge_long(w) == bpe.merge(w)


def test_rows_and_empties(spark):
    df = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "hey", 0), (3, "hey", 0), (None, " ", 0)], "doc_id long, text string, ids int")
    rows = {(r.doc_id, tuple(r.ids)) for r in encode_corpus(df, "doc_id", "text", PATH).collect()}
    assert rows == {(1, ()), (2, ()), (3, (20342,)), (None, (220,))}
    assert encode_corpus(df, "doc_id", "text", PATH).count() == 5
    assert encode_corpus(df.limit(0), "doc_id", "text", PATH).count() == 0
