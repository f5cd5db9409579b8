import numpy as np
import pytest

from tessera.llm import vptree


def brute(x, keys, k):
    pairs = set()
    d = np.sqrt(((x[:, None, :] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    for i in range(len(x)):
        for j in np.lexsort((keys, d[i]))[:k]:
            if np.isfinite(d[i][j]):
                pairs.add((min(keys[i], keys[j]), max(keys[i], keys[j])))
    return pairs


def run(spark, rows, **how):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, k string, v string, region int")
    return {tuple(r) for r in vptree.neighbour_pairs(vptree.nearest(df, size=8, **how)).collect()}


def rows_of(x, keys):
    return [(int(k), [float(e) for e in v], "a", "b", 1) for k, v in zip(keys, x)]


@pytest.fixture()
def clusters():
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(c, s, (n, 8)) for c, s, n in ((0, 1, 300), (6, 0.1, 500), (-9, 3, 150), (2, 0.0, 0))]).astype(np.float32).astype(np.float64)
    return x, rng.permutation(len(x)).astype(np.int64)


def test_exact_over_many_shards(spark, clusters, monkeypatch):
    x, keys = clusters
    for name, value in (("SHARD_ROWS", 64), ("SAMPLE_ROWS", 200), ("QUERY_ROWS", 100), ("LEAF", 8)):
        monkeypatch.setattr(vptree, name, value)
    want = brute(x, keys, 5)
    assert run(spark, rows_of(x, keys)) == want
    relaxed = run(spark, rows_of(x, keys), factor=1.5)
    assert len(relaxed & want) >= 0.9 * len(want)


def test_hot_cell_is_split_by_hash(spark, monkeypatch):
    """A third of the rows lie so close together that no vantage point cuts them."""
    for name, value in (("SHARD_ROWS", 64), ("SAMPLE_ROWS", 24), ("QUERY_ROWS", 50), ("LEAF", 8), ("SPLIT_ROWS", 70)):
        monkeypatch.setattr(vptree, name, value)
    rng = np.random.default_rng(7)
    x = np.concatenate([np.ones((200, 8)) + rng.normal(0, 1e-3, (200, 8)), rng.normal(4, 2, (400, 8))]).astype(np.float32).astype(np.float64)
    keys = rng.permutation(len(x)).astype(np.int64)
    assert run(spark, rows_of(x, keys)) == brute(x, keys, 5)


def test_few_regions_are_asked():
    """Bounds hold for every row, and few regions are left."""
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0, 1, 16) + rng.normal(0, 0.05, (n, 16)) for n in rng.integers(5, 60, 120)])
    router = vptree.Router(x[rng.choice(len(x), 128, replace=False)])
    cell, d = router.cells(x)
    sizes = router.group({int(c): int((cell == c).sum()) for c in set(cell)}, {int(c): float(d[cell == c].max()) for c in set(cell)}, 200)
    assert sum(sizes.values()) == len(x) and len(sizes) > 12
    far = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(far, np.inf)
    bound = np.sort(far, axis=1)[:, 4]
    meets, region = router.reach(x, bound, 1.0), router.region[cell]
    for i in range(len(x)):
        assert meets[i, region[far[i] <= bound[i]]].all()
    assert meets.sum(1).mean() < 3


def test_recall_of_a_relaxed_factor(spark, sf):
    """On ids divisible by 50 against all rows of the table."""
    df = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/chunk_embeddings.parquet")
    rows = vptree.valid_vectors(df, "vec_id", "embedding", 64).toPandas()
    x, keys = np.array(rows.v.tolist(), np.float64), rows.k.to_numpy()
    for factor, least in ((1.0, 1.0), (2.0, 0.9)):
        near = {}
        for r in vptree.nearest(df, factor=factor).where("vec_id % 50 = 0").collect():
            near.setdefault(r["vec_id"], set()).add(r["neighbour"])
        hits = total = 0
        for i in np.flatnonzero(keys % 50 == 0):
            d = ((x - x[i]) ** 2).sum(1)
            d[i] = np.inf
            want = set(keys[np.lexsort((keys, d))[:5]].tolist())
            hits, total = hits + len(want & near[int(keys[i])]), total + 5
        assert hits >= least * total


def test_dirty_and_repeated(spark, clusters):
    x, keys = clusters
    x, keys = x[:40], keys[:40]
    good = rows_of(x, keys)
    bad = [(5000, None, "", "", 0), (5001, [], "", "", 0), (5002, [1.0] * 7, "", "", 0), (5003, [float("nan")] * 8, "", "", 0), (5004, [None] + [1.0] * 7, "", "", 0), (5005, [float("inf")] * 8, "", "", 0), (None, [1.0] * 8, "", "", 0)]
    assert run(spark, good + bad + good[:7]) == brute(x, keys, 5)


def test_ties_and_small_tables(spark):
    same = [(i, [1.0] * 8, "", "", 0) for i in range(9)]
    assert run(spark, same) == brute(np.ones((9, 8)), np.arange(9), 5)
    assert run(spark, same[:3]) == {(0, 1), (0, 2), (1, 2)}
    assert run(spark, same[:1]) == set() == run(spark, [])


def test_pruning_leaves_out_work(clusters):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(c * 50, 1, (200, 8)) for c in range(20)])
    search = vptree.Search(np.arange(len(x)), x, 5, 1.0)
    search(np.arange(len(x)), x, np.full(len(x), np.inf))
    assert search.scanned < 0.3 * len(x) ** 2
