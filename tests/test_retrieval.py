import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import fusion, lexical, vector

from .test_functions import brute_tokens

CHUNKS = "chunk_seq long, content string, file_path string, extra string, tokens string"
ASKED = "query_id long, question string, token string"


def brute_bm25(docs, question):
    sets = [brute_tokens(f"{c or ''} {p or ''}") for _, c, p in docs]
    n, df = len(sets), Counter(t for s in sets for t in s)
    raw = {t: math.log(n - d + 0.5) - math.log(d + 0.5) for t, d in df.items()}
    mean = sum(raw.values()) / len(raw) if raw else 0
    idf = {t: v if v >= 0 else 0.25 * mean for t, v in raw.items()}
    avg = sum(map(len, sets)) / n if n else 0
    out = {}
    for (k, _, _), s in zip(docs, sets):
        shared = brute_tokens(question) & s
        if shared:
            out[k] = sum(idf[t] * 2.5 / (1 + 1.5 * (0.25 + 0.75 * len(s) / avg)) for t in shared)
    return out


def brute_bonus(docs, question):
    names = [t for t in brute_tokens(question) if "." in t]
    pats = names + [t.split(".")[0] for t in names]
    out = {}
    for k, _, p in docs:
        if p:
            name = p.replace("\\", "/").split("/")[-1].lower()
            b = sum((10 if x in (name, name.split(".")[0]) else 5) for x in pats if x in name) + sum(2 for x in pats if x in p.lower())
            if b:
                out[k] = b
    return out


DOCS = [(0, "read the file now", "src/foo.py"), (1, "read the other file", "src/foo.js"), (2, None, None), (3, "", "lib/Foo.py.bak"), (4, "the the the", "a\\foo.py"), (5, "中文 搜索 read", "x")]


QUESTIONS = ["foo.py", "read the file", "a.py a.js foo.py", "搜索", "", None, "unknownword"]


@pytest.mark.parametrize("docs", [DOCS, DOCS[:1], DOCS[:2], []])
def test_top_against_brute_force(spark, docs):
    chunks = spark.createDataFrame([(*d, "e", "t") for d in docs], CHUNKS)
    asked = spark.createDataFrame([(i, q, "t") for i, q in enumerate(QUESTIONS)], ASKED)
    index = lexical.build(chunks)
    rows = lexical.top(index, chunks, asked).orderBy("q", "rank").collect()
    for i, question in enumerate(QUESTIONS):
        got = [(r["chunk"], r["score"]) for r in rows if r["q"] == i]
        words, bonus = brute_bm25(docs, question or ""), brute_bonus(docs, question or "")
        want = {k: round(words.get(k, 0) + bonus.get(k, 0), 6) for k in words.keys() | bonus.keys()}
        want = sorted(((k, s) for k, s in want.items() if s > 0), key=lambda x: (-x[1], x[0]))[:10]
        assert [k for k, _ in got] == [k for k, _ in want] and [s for _, s in got] == pytest.approx([s for _, s in want], abs=2e-6)
    index.clear()


def test_boost_example(spark):
    chunks = spark.createDataFrame([(0, "", "src/foo.py", "", "")], CHUNKS)
    asked = spark.createDataFrame([(1, "foo.py", "")], ASKED)
    assert [tuple(r) for r in lexical.boost(chunks, asked).collect()] == [(1, 0, 24.0)]


def test_vectors(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 8)).astype(np.float32)
    x[10] = x[11] = x[12]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [1.0])]
    base = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    queries = spark.createDataFrame([(i, x[i].tolist()) for i in (0, 11)] + [(5, None)], "query_id long, query_vector array<float>")
    got = {}
    for r in vector.top(base, queries, 4).orderBy("q", "rank").collect():
        got.setdefault(r["q"], []).append(r["chunk"])
    for q, near in got.items():
        d = ((x.astype(float) - x[q].astype(float)) ** 2).sum(1).round(6)
        assert near == sorted(range(300), key=lambda i: (d[i], i))[:4]
    assert set(got) == {0, 11}
    assert vector.top(base.limit(0), queries).count() == 0 and vector.top(base, queries.limit(0)).count() == 0


def test_rrf_equals_stable_insertion_order(spark):
    rnd = random.Random(3)
    for _ in range(5):
        v, w = rnd.sample(range(15), rnd.randint(0, 10)), rnd.sample(range(15), rnd.randint(0, 10))
        score = {}
        for ranked in (v, w):
            for i, d in enumerate(ranked, 1):
                score[d] = score.get(d, 0) + 1 / (60 + i)
        want = [d for d, _ in sorted(score.items(), key=lambda x: -round(x[1], 12))][:10]
        as_df = lambda ids: spark.createDataFrame([(0, d, i) for i, d in enumerate(ids, 1)], "q long, chunk long, rank int")
        assert [r["chunk"] for r in fusion.rrf(as_df(v), as_df(w)).orderBy("rank").collect()] == want


def test_context_and_prompt(spark):
    df = spark.createDataFrame([(2, "b.py", "B", 0), (1, "a.py", "A", 7)], "rank int, p string, c string, l long")
    got = df.agg(fusion.context(F.col("rank"), F.col("p"), F.col("c"), F.col("l")).alias("x")).select("x", fusion.prompt(F.lit("Q?"), F.col("x")).alias("y")).first()
    assert got["x"] == "[文档 1] 文件: a.py (行 7)\nA\n\n[文档 2] 文件: b.py\nB\n" and got["x"] in got["y"] and "Q?" in got["y"]


def test_embedding_batches_and_retries(spark):
    provider = vector.HashingEmbedder(16)
    df = spark.createDataFrame([(i, None if i == 3 else f"text {i}") for i in range(70)], "i int, content string")
    rows = vector.embed(df, provider).collect()
    assert len(rows) == 70 and all(len(r["embedding"]) == 16 for r in rows)
    calls, slept = [], []

    def flaky(texts):
        calls.append(len(texts))
        if len(calls) < 3:
            raise RuntimeError("Rate limit reached")
        return [[0.0]] * len(texts)

    assert vector.with_retry(flaky, ["a"], sleep=slept.append) == [[0.0]] and slept == [1.0, 2.0]
    with pytest.raises(vector.EmbeddingError):
        vector.with_retry(lambda t: (_ for _ in ()).throw(RuntimeError("invalid API key")), ["a"], sleep=lambda s: pytest.fail("no wait"))
    with pytest.raises(vector.EmbeddingError):
        vector.with_retry(lambda t: [], ["a"], retries=1, sleep=lambda s: None)
