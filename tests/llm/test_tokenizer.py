import random

import pytest
from tokenizers import Tokenizer

from tessera.llm import tokenizer

FOLDER = tokenizer.TOKENIZERS


@pytest.fixture(scope="module")
def exact():
    t = Tokenizer.from_file(f"{FOLDER}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


def test_against_the_library(exact):
    bpe = tokenizer.ByteBPE(f"{FOLDER}/byte_bpe_50k.tiktoken")
    rnd = random.Random(5)
    alphabet = "ab  \n\t'sétxyz09\x1c\x85　​中文é́٣Ⅷ²👍<|endoftext|>Ġ\x00\x1f._-"
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 80))) for _ in range(3000)]
    texts += ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(1, 300))) for _ in range(1500)]
    texts += ["a" * 6000, "=" * 5000, "ab" * 4000, "<|endoftext|>", "don't we'll", "  leading and  double "]
    assert [x.tolist() for x in bpe.encode_batch(texts)] == [exact(t) for t in texts]
    assert bpe.failing > 0  # exact merging was needed and used


def test_every_pair_check_agrees_with_merging():
    bpe = tokenizer.ByteBPE(f"{FOLDER}/byte_bpe_50k.tiktoken")
    import numpy as np

    words = {v: k for k, v in bpe.ranks.items()}
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 50256, 4000), rng.integers(0, 50256, 4000)
    got = bpe.check_pairs(a, b)
    assert all(bool(g) == (bpe._exact(words[x] + words[y]) == [x, y]) for x, y, g in zip(a.tolist(), b.tolist(), got))


def test_column(spark, exact):
    rows = [(1, "Hello  world\r\n", "x"), (2, None, "x"), (3, "", "x"), (1, "Hello  world\r\n", "x"), (None, "中文", "x"), (5, "w " * 100_000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = [(r[0], r[1]) for r in tokenizer.encode_column(df, "doc_id", "text").collect()]
    assert sorted(got, key=str) == sorted(((k, exact(t) if t else []) for k, t, _ in rows), key=str)
    assert tokenizer.encode_column(df.limit(0), "doc_id", "text").count() == 0


def test_small_cache_changes_nothing(monkeypatch, exact):
    monkeypatch.setattr(tokenizer, "CACHE_WORDS", 3)
    bpe = tokenizer.ByteBPE(f"{FOLDER}/byte_bpe_50k.tiktoken")
    texts = ["one two three four", "five six seven", "one eight"]
    assert [x.tolist() for t in texts for x in bpe.encode_batch([t])] == [exact(t) for t in texts]
