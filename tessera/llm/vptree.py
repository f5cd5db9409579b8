"""The k most similar vectors for every vector, by vantage-point trees.

Vantage points from a bounded sample cut the space into cells, each of the vectors
nearest to its point.  A tree over the points groups the cells into regions of at
most ``SHARD_ROWS`` rows by the cells' true counts; a region that cannot be cut
further (many equal or very close vectors) is split by a hash beyond ``SPLIT_ROWS``.
Each shard builds its own vantage-point tree.  First every vector searches the
shard it lies in, which bounds the distance of its k-th neighbour.  With that bound
the triangle inequality tells which other cells may hold a nearer vector: none
nearer than the distance to the cell's point less the cell's radius, nor nearer
than half of what the cell's point is farther than the nearest point.  Only the
regions of those cells are searched, and the candidates of all shards are merged.

``factor`` relaxes the pruning: a subtree or cell is left out when its lower bound
times the factor reaches the present k-th distance.  Factor 1 is exact.

Edge cases: vectors that are null, of another size, or hold a null or
non-finite element take no part; each key counts once (of several rows the
smallest vector); equal distances are ordered by key; with fewer than k+1
vectors all others are the neighbours; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, spread

#: Vectors fetched for vantage points at most, and points to a region.
SAMPLE_ROWS = 16_384
POINTS = 16
SHARD_ROWS = 8_192
SPLIT_ROWS = 65_536
QUERY_ROWS = 16_384
LEAF = 512
SPARE = 8


class Node:
    __slots__ = ("vp", "radius", "inside", "outside", "rows", "region")


def _split(x: np.ndarray, rows: np.ndarray, rng: np.random.Generator) -> tuple[int, float, np.ndarray] | None:
    """Vantage point (of a few the one that spreads most), median radius, who is inside."""
    tries = rng.choice(rows, min(6, len(rows)), replace=False)
    probe = x[rng.choice(rows, min(256, len(rows)), replace=False)]
    spread = [np.std(np.sqrt(((probe - x[t]) ** 2).sum(1))) for t in tries]
    vp = int(tries[int(np.argmax(spread))])
    d = np.sqrt(((x[rows] - x[vp]) ** 2).sum(1))
    radius = float(np.median(d))
    inside = d <= radius
    if inside.all():
        inside = d < radius
        if not inside.any():
            return None  # all at one distance
        radius = float(d[inside].max())
    return vp, radius, inside


def build(x: np.ndarray, leaf: int, seed: int = 1) -> Node:
    rng = np.random.default_rng(seed)

    def make(rows: np.ndarray) -> Node:
        node = Node()
        node.rows = node.region = None
        part = _split(x, rows, rng) if len(rows) > leaf else None
        if part is None:
            node.rows = rows
            return node
        node.vp, node.radius, inside = part
        node.inside, node.outside = make(rows[inside]), make(rows[~inside])
        return node

    return make(np.arange(len(x)))


class Search:
    """Batched search of one shard's tree for many queries."""

    def __init__(self, keys: np.ndarray, x: np.ndarray, k: int, factor: float):
        self.keys, self.x, self.k, self.factor = keys, x, k, factor
        self.norm = (x * x).sum(1)
        self.root = build(x, LEAF)
        self.scanned = 0

    def __call__(self, qkeys: np.ndarray, q: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows (-1: none) and distances of up to k neighbours within ``bound``."""
        self.q, self.qkeys, self.qnorm = q, qkeys, (q * q).sum(1)
        width = self.k + SPARE
        self.best = np.full((len(q), width), np.inf)
        self.at = np.full((len(q), width), -1, np.int64)
        self.tau = bound.astype(float).copy()
        self._visit(self.root, np.arange(len(q)), None)
        # distances once more without cancellation, ties by key
        pick = self.at.clip(0)
        exact = np.empty(self.best.shape)
        for a in range(0, len(q), 4096):
            exact[a : a + 4096] = np.sqrt(((self.x[pick[a : a + 4096]] - q[a : a + 4096, None, :]) ** 2).sum(2))
        exact[self.at < 0] = np.inf
        order = np.lexsort((self.keys[pick], exact), axis=1)[:, : self.k]
        return np.take_along_axis(self.at, order, 1), np.take_along_axis(exact, order, 1)

    def _visit(self, node: Node, some: np.ndarray, _: None) -> None:
        if node.rows is not None:
            for a in range(0, len(some), 4096):
                self._scan(node.rows, some[a : a + 4096])
            return
        d = np.sqrt(((self.q[some] - self.x[node.vp]) ** 2).sum(1))
        first_in = d <= node.radius
        for nearer in (True, False):
            for inside, child in ((True, node.inside), (False, node.outside)):
                go = first_in == (inside == nearer)
                if not nearer:
                    gap = (d - node.radius) if inside else (node.radius - d)
                    go &= gap * self.factor < self.tau[some]
                if go.any():
                    self._visit(child, some[go], None)

    def _scan(self, rows: np.ndarray, some: np.ndarray) -> None:
        self.scanned += len(rows) * len(some)
        d2 = self.qnorm[some, None] + self.norm[rows] - 2 * (self.q[some] @ self.x[rows].T)
        d = np.sqrt(np.maximum(d2, 0))
        d[self.qkeys[some, None] == self.keys[rows]] = np.inf
        d[d > self.tau[some, None] * (1 + 1e-9) + 1e-9] = np.inf
        hit = np.isfinite(d).any(1)
        if not hit.any():
            return
        some, d = some[hit], d[hit]
        both = np.concatenate([self.best[some], d], axis=1)
        ids = np.concatenate([self.at[some], np.broadcast_to(rows, d.shape)], axis=1)
        keep = np.argpartition(both, self.best.shape[1] - 1, axis=1)[:, : self.best.shape[1]]
        self.best[some] = np.take_along_axis(both, keep, 1)
        ids = np.take_along_axis(ids, keep, 1)
        ids[~np.isfinite(self.best[some])] = -1
        self.at[some] = ids
        kth = np.partition(self.best[some], self.k - 1, axis=1)[:, self.k - 1]
        self.tau[some] = np.minimum(self.tau[some], kth)


class Router:
    """Cells around vantage points, and the regions they are grouped into."""

    def __init__(self, points: np.ndarray):
        self.points = np.unique(points, axis=0) if len(points) else np.zeros((1, 1))
        self.norm = (self.points**2).sum(1)
        self.radius = np.full(len(self.points), -np.inf)  # of an empty cell

    def distances(self, q: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum((q * q).sum(1)[:, None] + self.norm - 2 * q @ self.points.T, 0))

    def cells(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cell of each vector and the distance to its point."""
        cell, d = np.zeros(len(q), np.int32), np.zeros(len(q))
        for a in range(0, len(q), 2048):
            all_ = self.distances(q[a : a + 2048])
            cell[a : a + 2048] = all_.argmin(1)
            d[a : a + 2048] = all_.min(1)
        return cell, d

    def group(self, counts: dict[int, int], radius: dict[int, float], rows: int) -> dict[int, int]:
        """Cut the points into regions of at most so many rows; returns the rows of each."""
        n = np.zeros(len(self.points), np.int64)
        for c, rows_ in counts.items():
            n[c], self.radius[c] = rows_, radius[c]
        self.region = np.zeros(len(self.points), np.int32)
        rng, sizes = np.random.default_rng(2), {}
        todo = [np.arange(len(self.points))]
        while todo:
            some = todo.pop()
            part = _split(self.points, some, rng) if len(some) > 1 and n[some].sum() > rows else None
            if part is not None:
                todo += [some[~part[2]], some[part[2]]]
                continue
            self.region[some] = len(sizes)
            sizes[len(sizes)] = int(n[some].sum())
        self.order = np.argsort(self.region, kind="stable")
        self.starts = np.searchsorted(self.region[self.order], np.arange(len(sizes)))
        return sizes

    def reach(self, q: np.ndarray, bound: np.ndarray, factor: float) -> np.ndarray:
        """Whether the ball of each query may meet each region."""
        out = []
        for a in range(0, len(q), 2048):
            d = self.distances(q[a : a + 2048])
            low = np.maximum(d - self.radius, (d - d.min(1)[:, None]) / 2)
            meets = low * factor <= bound[a : a + 2048, None] * (1 + 1e-9) + 1e-6
            out.append(np.logical_or.reduceat(meets[:, self.order], self.starts, axis=1))
        return np.concatenate(out) if out else np.zeros((0, len(self.starts)), bool)


def _usable(df: DataFrame, key: str, vector: str, size: int) -> DataFrame:
    good = (F.size(vector) == size) & F.forall(vector, lambda e: e.isNotNull() & (F.abs(e) < F.lit(float("inf"))) & ~F.isnan(e))
    return df.where(F.col(key).isNotNull() & F.coalesce(good, F.lit(False)))


def valid_vectors(df: DataFrame, key: str, vector: str, size: int) -> DataFrame:
    """(k, v): each key once, whole vectors of ``size`` finite elements only."""
    return _usable(df, key, vector, size).groupBy(F.col(key).alias("k")).agg(F.min(vector).alias("v"))


def _matrix(v: pd.Series) -> np.ndarray:
    return np.array(v.tolist(), dtype=np.float64) if len(v) else np.zeros((0, 1))


def nearest(df: DataFrame, key: str = "vec_id", vector: str = "embedding", size: int = 64, k: int = 5, factor: float = 1.0) -> DataFrame:
    """(key, neighbour, distance, rank) of the k nearest other vectors."""
    spark = df.sparkSession
    vectors = valid_vectors(df, key, vector, size)
    usable = spread(_usable(df, key, vector, size).select(F.col(key).alias("k"), F.col(vector).alias("v")))
    total = usable.count()
    wanted = int(np.clip(POINTS * -(-2 * total // SHARD_ROWS), POINTS, SAMPLE_ROWS))
    fraction = min(1.0, 1.2 * wanted / max(1, total))
    router = Router(_matrix(usable.where(F.pmod(F.xxhash64("k"), F.lit(1 << 30)) < int(fraction * (1 << 30))).limit(wanted).select("v").toPandas().v))

    def measured(batches):
        for pdf in batches:
            cell, d = router.cells(_matrix(pdf.v))
            yield pd.DataFrame({"cell": cell, "d": d}).groupby("cell").d.agg(["size", "max"]).reset_index()

    # one row a vantage point, of which there are SAMPLE_ROWS at most
    cells = usable.select("v").mapInPandas(measured, "cell int, size bigint, max double").groupBy("cell").agg(F.sum("size").alias("n"), F.max("max").alias("r")).collect()
    sizes = router.group({c.cell: c.n for c in cells}, {c.cell: c.r for c in cells}, SHARD_ROWS)
    salts = np.array([-(-n // SPLIT_ROWS) if n > SPLIT_ROWS else 1 for n in sizes.values()], np.int32)
    shared = spark.sparkContext.broadcast((router, salts))

    def routed(batches):
        router, salts = shared.value
        for pdf in batches:
            region = router.region[router.cells(_matrix(pdf.v))[0]]
            yield pdf.assign(region=region, salt=(pd.util.hash_array(pdf.k.to_numpy()) % salts[region]).astype(np.int32))

    placed = vectors.mapInPandas(routed, "k bigint, v array<float>, region int, salt int").repartition(max(8, int(salts.sum())), "region", "salt")

    def own(pdf: pd.DataFrame) -> pd.DataFrame:
        router, salts = shared.value
        x, keys, rows, asks = _matrix(pdf.v), pdf.k.to_numpy(), [], []
        region, salt = int(pdf.region[0]), int(pdf.salt[0])
        search = Search(keys, x, k, factor)
        others = np.array([(r, s) for r, n in enumerate(salts) for s in range(n)], np.int32)
        others = others[(others[:, 0] != region) | (others[:, 1] != salt)]
        for a in range(0, len(x), QUERY_ROWS):
            q = x[a : a + QUERY_ROWS]
            at, d = search(keys[a : a + QUERY_ROWS], q, np.full(len(q), np.inf))
            rows += [([int(keys[i]) for i in ai if i >= 0], [float(e) for e in di if np.isfinite(e)]) for ai, di in zip(at, d)]
            meets = router.reach(q, d[:, k - 1] if d.shape[1] >= k else np.full(len(q), np.inf), factor)
            asks += [others[m].tobytes() for m in meets[:, others[:, 0]]]
        return pd.DataFrame({"k": keys, "v": pdf.v, "region": pdf.region, "salt": pdf.salt, "n": [r[0] for r in rows], "d": [r[1] for r in rows], "asks": [np.frombuffer(b, np.int32).tolist() for b in asks]})

    first = cut(placed.groupBy("region", "salt").applyInPandas(own, "k bigint, v array<float>, region int, salt int, n array<bigint>, d array<double>, asks array<int>"))
    # the shards a vector asks, as (region, salt) one after another
    each = F.explode(F.expr("transform(sequence(0, int(size(asks) / 2) - 1), i -> struct(asks[2 * i] as region, asks[2 * i + 1] as salt))")).alias("to")
    asking = first.where(F.size("asks") > 0)
    bound = F.when(F.size("d") >= k, F.element_at("d", k)).otherwise(F.lit(float("inf"))).alias("bound")
    asks = asking.select("k", "v", bound, each).select("to.region", "to.salt", "k", "v", "bound").toDF("region", "salt", "k", "v", "bound")
    # a shard that very many ask is searched in blocks, each with a copy of the shard
    blocks = asking.select(each).groupBy("to.region", "to.salt").agg(F.ceil(F.count("*") / QUERY_ROWS).cast("int").alias("blocks"))
    points = first.select("region", "salt", "k", "v").toDF("region", "salt", "k", "v").join(F.broadcast(blocks), ["region", "salt"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    asks = asks.join(F.broadcast(blocks), ["region", "salt"]).withColumn("block", F.pmod(F.xxhash64("k"), "blocks").cast("int")).drop("blocks")

    def other(points: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        keys, out = points.k.to_numpy(), []
        if not len(points) or not len(asks):
            return pd.DataFrame(out, columns=["k", "n", "d"], dtype=object)
        search = Search(keys, _matrix(points.v), k, factor)
        at, d = search(asks.k.to_numpy(), _matrix(asks.v), asks.bound.to_numpy())
        for q, ai, di in zip(asks.k.tolist(), at, d):
            if ai[0] >= 0:
                out.append((q, [int(keys[i]) for i in ai if i >= 0], [float(e) for e in di if np.isfinite(e)]))
        return pd.DataFrame(out, columns=["k", "n", "d"], dtype=object)

    group = ["region", "salt", "block"]
    rest = points.groupBy(*group).cogroup(asks.groupBy(*group)).applyInPandas(other, "k bigint, n array<bigint>, d array<double>")
    pairs = first.select("k", "n", "d").unionByName(rest).select("k", F.explode(F.arrays_zip("n", "d")).alias("p")).select("k", "p.n", "p.d")
    rank = F.row_number().over(Window.partitionBy("k").orderBy("d", "n"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("k").alias(key), F.col("n").alias("neighbour"), F.col("d").alias("distance"), "rank")


def neighbour_pairs(near: DataFrame, key: str = "vec_id") -> DataFrame:
    """(vec_low, vec_high): either is among the nearest of the other."""
    return near.select(F.least(key, "neighbour").alias("vec_low"), F.greatest(key, "neighbour").alias("vec_high")).distinct()
