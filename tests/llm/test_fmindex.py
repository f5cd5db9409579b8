import random

import numpy as np

from tessera.llm import fmindex as fm

ITEM = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"


def brute(docs, items, n=12):
    found = set()
    for d, text in docs:
        words = fm.words_of(text or "")
        wins = {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}
        for k, item in items:
            w = fm.words_of(item or "")
            if any(tuple(w[i : i + n]) in wins for i in range(len(w) - n + 1)):
                found.add((d, k))
    return found


def test_index_counts_and_locates():
    rng = np.random.default_rng(0)
    seq = np.concatenate([[0], rng.integers(1, 5, 700), [0], rng.integers(1, 5, 300), [0]])
    index = fm.FMIndex(seq, 4)
    phrases = rng.integers(1, 5, (200, 5))
    hit, lo, hi = index.search(phrases)
    want = {i: [p for p in range(len(seq) - 4) if (seq[p : p + 5] == q).all()] for i, q in enumerate(phrases)}
    assert set(hit.tolist()) == {i for i, p in want.items() if p}
    for i, a, b in zip(hit, lo, hi):
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want[i]


def test_suffix_order():
    rng = np.random.default_rng(1)
    for sigma, n in ((1, 60), (2, 300), (50, 400), (3_000_000, 200)):
        seq = np.concatenate([[0], rng.integers(1, sigma + 1, n), [0], rng.integers(1, sigma + 1, n // 2), np.full(40, sigma), [0]])
        zero = np.flatnonzero(seq == 0)
        spell = [(0, int(np.searchsorted(zero, i))) if c == 0 else (1, int(c)) for i, c in enumerate(seq)]
        assert fm.FMIndex._suffixes(seq).tolist() == sorted(range(len(seq)), key=lambda i: spell[i:])


def test_every_word_is_indexed():
    shard = fm.Shard(fm.Phrases([(1, ITEM)], 12))
    shard.add(5, f"pad {ITEM} pad of other words " * 20)
    shard.add(6, "no word of it")
    assert shard.length == 1 + len(fm.words_of(f"pad {ITEM} pad of other words " * 20)) + 1 + 4 + 1
    assert len([r for r in shard.leaks() if r[0] == 5]) == 20


def test_layouts_and_edges(spark):
    half = " ".join(ITEM.split()[:12])
    docs = [
        (1, f"before {ITEM} after"), (2, "# One, TWO three\n# four: five 'six' seven\n#  eight NINE ten\r\n# eleven twelve."), (3, " ".join(ITEM.split()[:11])), (4, None), (5, ""), (6, " \n!"),
        (7, f"x {half} y {ITEM}"), (8, "ｏｎｅ t​wo three four five six seven eight nine ten eleven twelve"), (1, f"before {ITEM} after"), (9, f"{ITEM} " * 2000),
    ]
    items = [(10, ITEM), (11, ITEM), (12, None), (13, "too short"), (None, ITEM), (14, "")]
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], "doc_id long, text string, words string, item_id int").repartition(3)
    leaks = fm.find_leaks(df, spark.createDataFrame([(i, t, "y") for i, t in items], "item_id long, text string, doc_id string"))
    got = {(r[0], r[1]) for r in leaks.collect()}
    assert got == {(d, i) for d in (1, 2, 7, 8, 9) for i in (10, 11)} == brute(docs, [x for x in items if x[0]])
    spans = {r["doc_id"]: (r["span_start"], r["span_end"]) for r in leaks.collect() if r["doc_id"] == 1}
    assert docs[0][1][slice(*spans[1])] == ITEM
    merged = [r for r in fm.removal_spans(leaks).collect() if r["doc_id"] == 7]
    assert len(merged) == 2 and all(r["item_ids"] == [10, 11] for r in merged)
    assert fm.find_leaks(df.limit(0), spark.createDataFrame(items, "item_id long, text string")).count() == 0
    assert fm.find_leaks(df, spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_random_against_brute_force(spark, monkeypatch):
    rnd = random.Random(2)
    make = lambda n: " ".join(rnd.choice("abc") for _ in range(n))
    items = [(i, make(18)) for i in range(40)]
    docs = [(i, make(rnd.randint(0, 120)) + (" " + " ".join(rnd.choice(items)[1].split()[2:16]) if i % 3 else "")) for i in range(150)]
    want = brute(docs, items)
    got = fm.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r[0], r[1]) for r in got.collect()} == want
    monkeypatch.setattr(fm, "ITEMS_LIMIT", 200)  # the test set in parts
    got = fm.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r[0], r[1]) for r in got.collect()} == want


def test_small_shards_and_blocks(monkeypatch):
    monkeypatch.setattr(fm, "BLOCK", 2)
    shard = fm.Shard(fm.Phrases([(1, ITEM)], 12))
    shard.add(5, f"pad {ITEM} pad")
    assert [r[:2] for r in shard.leaks()] == [(5, 1)] and shard.leaks() == []
