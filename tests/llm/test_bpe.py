import os
import random

import pytest

from lodestrata.llm import bpe

PATH = bpe.default_path()
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary file")


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


def test_same_ids_as_the_library(reference):
    rng = random.Random(7)
    letters = "abAB aoetnrs  \n\t'12'llé中文字的了是🙂́²Ⅷ_\x1c　 <|endoftext|>"
    texts = ["".join(rng.choices(letters, k=rng.randrange(1, 200))) for _ in range(1500)]
    texts += ["a" * 4000, "ab" * 2000, " " * 999, "<|endoftext|>", "aA" * 800, "的" * 1500, "don't we'll I'D", "\r\n \n", "x_y __z"]
    encoder = bpe.load(PATH)
    assert [t for t in texts if encoder.encode(t) != reference(t)] == []


def test_words_of_every_shape(reference):
    rng = random.Random(8)
    encoder = bpe.load(PATH)
    words = ["".join(rng.choices("etaoinshrdl", k=rng.randrange(1, 30))) for _ in range(4000)]
    assert [w for w in words if encoder.encode(w) != reference(w)] == []


def test_every_token_of_the_vocabulary_that_merges_reach(reference):
    encoder = bpe.load(PATH)
    texts = [t.encode("latin-1").decode("utf-8", "ignore") for t in list(encoder.whole)[::7]]
    assert [t for t in texts if encoder.encode(t) != reference(t)] == []


def test_table(spark, reference):
    rows = [(1, None), (2, ""), (3, "Hello  world"), (3, "Hello  world"), (4, "x" * 200_000), (None, " ")]
    df = spark.createDataFrame([(a, b, [1], "k") for a, b in rows], "doc_id bigint, text string, ids array<int>, key string")
    got = sorted([(r.doc_id or 0, r.ids) for r in bpe.token_ids(df, "doc_id", "text").collect()])
    assert got == sorted([(a or 0, reference(b) if b else []) for a, b in rows])
    assert bpe.token_ids(df.limit(0), "doc_id", "text").count() == 0
