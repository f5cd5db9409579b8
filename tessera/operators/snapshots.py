"""What changed between full snapshots, by invertible Bloom lookup tables.

Every record of a snapshot becomes a pair of hashes (key, values).  Records fall
into buckets by the key's hash, and each bucket of each snapshot is summed up in
a table of a fixed number of cells (count and XORs), three cells per record plus
one digest cell over all.  Subtracting the tables of two snapshots leaves only
the differing pairs, which are peeled off cell by cell; a bucket whose table
does not peel to nothing, or whose digest disagrees, is summed up again with
four times the cells.  A pair only in the newer snapshot and one only in the
older make a key changed, added or removed.  Once the records are reduced to
hashes, cells and recovered pairs are all that is shuffled; the pairs get their
names from the records in place, while they are few enough to be sent to them.

Edge cases: rows without snapshot number are ignored; null equals null in keys
and values; of several rows of one key in one snapshot the latest delivery
counts (a null time is the earliest; at equal times the greatest values); a
snapshot number without delivery is passed over; the first snapshot, a single
one, and an empty table give no rows; other columns vary without effect.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

ROWS_PER_BUCKET = 1024
CELLS = 64  # per hash function, at first
LEVELS = 7
#: Recovered pairs (28 bytes each) that are sent to the records to be named; more are joined.
SENT = 1_000_000
_P = [np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)]


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _xx_long(value: np.ndarray, seed: np.ndarray) -> np.ndarray:
    h = seed + _P[4] + np.uint64(8)
    h = h ^ (_rotl(value * _P[1], 31) * _P[0])
    h = _rotl(h, 27) * _P[0] + _P[3]
    h = (h ^ (h >> np.uint64(33))) * _P[1]
    h = (h ^ (h >> np.uint64(29))) * _P[2]
    return h ^ (h >> np.uint64(32))


def xxhash64(*columns: np.ndarray) -> np.ndarray:
    """The engine's xxhash64 over 64-bit columns."""
    h = np.full(len(columns[0]), 42, np.uint64)
    with np.errstate(over="ignore"):
        for c in columns:
            h = _xx_long(c.astype(np.int64).view(np.uint64), h)
    return h.view(np.int64)


def _hash(*columns: Column) -> Column:
    return F.xxhash64(*[F.coalesce(c.cast("string"), F.lit("\0")) for c in columns])


def latest(df: DataFrame, snapshot: str, time: str, keys: list[Column], values: list[Column], identity: list[str]) -> DataFrame:
    """(snapshot, identity..., kh, vh): one row per key and snapshot."""
    named = [c.alias(n) for c, n in zip(keys, identity)]
    rows = df.where(F.col(snapshot).isNotNull()).select(F.col(snapshot).alias("snapshot"), *named, F.struct(F.col(time).alias("t"), *[v.alias(f"v{i}") for i, v in enumerate(values)]).alias("r"))
    rows = rows.groupBy("snapshot", *identity).agg(F.max("r").alias("r"))
    key = [F.col(n) for n in identity]
    return rows.select("snapshot", *identity, _hash(*key).alias("kh"), _hash(*key, *[F.col(f"r.v{i}") for i in range(len(values))]).alias("vh"))


def sketch(records: DataFrame, cells: int, level: int) -> DataFrame:
    """Cells of every (snapshot, bucket); the last one is the digest."""
    h = F.xxhash64("kh", "vh", F.lit(level).cast("long"))
    spots = [F.struct((F.lit(j * cells) + F.pmod(F.shiftrightunsigned("h", 21 * j).bitwiseAND(F.lit(0x1FFFFF).cast("long")), F.lit(cells).cast("long"))).cast("int").alias("cell"), F.col("h").alias("x")) for j in range(3)]
    digest = F.struct(F.lit(3 * cells).alias("cell"), F.xxhash64("vh", "kh").alias("x"))
    rows = records.withColumn("h", h).select("snapshot", "bucket", "kh", "vh", F.explode(F.array(*spots, digest)).alias("c"))
    return rows.groupBy("snapshot", "bucket", F.col("c.cell").alias("cell")).agg(F.count("*").alias("n"), F.bit_xor("kh").alias("kx"), F.bit_xor("vh").alias("vx"), F.bit_xor("c.x").alias("hx"))


def subtract(cells: DataFrame, order: DataFrame) -> DataFrame:
    """Newer minus older for each (snapshot, before) of ``order``; zero cells are left out."""
    newer = cells.join(F.broadcast(order.select("snapshot")), "snapshot").withColumn("pair", F.col("snapshot"))
    older = cells.join(F.broadcast(order.select(F.col("snapshot").alias("pair"), F.col("before").alias("snapshot"))), "snapshot").withColumn("n", -F.col("n"))
    both = newer.select("pair", "bucket", "cell", "n", "kx", "vx", "hx").unionByName(older.select("pair", "bucket", "cell", "n", "kx", "vx", "hx"))
    summed = both.groupBy("pair", "bucket", "cell").agg(F.sum("n").alias("n"), *[F.bit_xor(x).alias(x) for x in ("kx", "vx", "hx")])
    return summed.where((F.col("n") != 0) | (F.col("kx") != 0) | (F.col("vx") != 0) | (F.col("hx") != 0))


def _peel(pdf: pd.DataFrame, cells: int, level: int) -> pd.DataFrame:
    """Peel all buckets of a batch together; sign 0 marks a failed bucket."""
    width, groups = 3 * cells + 1, len(pdf)
    n, kx, vx, hx = (np.zeros(groups * width, np.int64) for _ in range(4))
    sizes = pdf.cells.map(len).to_numpy()
    flat = [tuple(c.values()) if isinstance(c, dict) else tuple(c) for row in pdf.cells for c in row]
    table = np.array(flat, dtype=np.int64).reshape(-1, 5)
    at = np.repeat(np.arange(groups), sizes) * width + table[:, 0]
    n[at], kx[at], vx[at], hx[at] = table[:, 1], table[:, 2], table[:, 3], table[:, 4]
    digest = np.arange(groups) * width + 3 * cells
    dn, dx = n[digest].copy(), hx[digest].copy()
    n[digest] = kx[digest] = vx[digest] = hx[digest] = 0
    out = []
    while True:
        pure = np.flatnonzero(np.abs(n) == 1)
        pure = pure[xxhash64(kx[pure], vx[pure], np.full(len(pure), level)) == hx[pure]]
        if not len(pure):
            break
        g, k, v, h, s = pure // width, kx[pure], vx[pure], hx[pure], n[pure]
        _, first = np.unique(np.stack([g, h]), axis=1, return_index=True)
        g, k, v, h, s = g[first], k[first], v[first], h[first], s[first]
        out.append((g, k, v, s))
        u = h.view(np.uint64)
        for j in range(3):
            spot = g * width + j * cells + ((u >> np.uint64(21 * j)) & np.uint64(0x1FFFFF)).astype(np.int64) % cells
            np.subtract.at(n, spot, s)
            np.bitwise_xor.at(kx, spot, k)
            np.bitwise_xor.at(vx, spot, v)
            np.bitwise_xor.at(hx, spot, h)
        if sum(len(o[0]) for o in out) > 2 * groups * width:
            break
    g, k, v, s = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 4
    np.subtract.at(dn, g, s)
    np.bitwise_xor.at(dx, g, xxhash64(v, k))
    bad = (np.abs(n) + np.abs(kx) + np.abs(vx)).reshape(groups, width).any(1) | (dn != 0) | (dx != 0)
    keep = ~bad[g]
    g, k, v, s = g[keep], k[keep], v[keep], s[keep]
    failed = np.flatnonzero(bad)
    pair, bucket = pdf.pair.to_numpy(), pdf.bucket.to_numpy()
    both = np.concatenate([g, failed])
    zero = np.zeros(len(failed), np.int64)
    return pd.DataFrame({"pair": pair[both], "bucket": bucket[both], "kh": np.concatenate([k, zero]), "vh": np.concatenate([v, zero]), "sign": np.concatenate([s, zero]).astype(np.int32)})


def peel(difference: DataFrame, cells: int, level: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for a in range(0, len(pdf), 512):
                yield _peel(pdf.iloc[a : a + 512], cells, level)

    # at most 3 * cells + 1 cells a bucket
    groups = difference.groupBy("pair", "bucket").agg(F.collect_list(F.struct(F.col("cell").cast("long").alias("cell"), "n", "kx", "vx", "hx")).alias("cells"))
    return groups.mapInPandas(run, "pair int, bucket int, kh long, vh long, sign int")


def changes(records: DataFrame, identity: list[str], cells: int = CELLS, rows_per_bucket: int = ROWS_PER_BUCKET, series: int = 1) -> DataFrame:
    """(snapshot, identity..., change_kind) from ``latest`` records.

    Several series of snapshots go through together where their numbers differ
    modulo ``series``; each is compared within itself.
    """
    records = cut(records)
    sizes = records.groupBy("snapshot").count()
    largest = sizes.agg(F.max("count")).first()[0] or 0
    buckets = max(1, -(-largest // rows_per_bucket))
    records = records.withColumn("bucket", F.pmod("kh", F.lit(buckets).cast("long")).cast("int"))
    order = sizes.select("snapshot", F.lag("snapshot").over(Window.partitionBy(F.pmod("snapshot", F.lit(series))).orderBy("snapshot")).alias("before")).where(F.col("before").isNotNull())
    order = cut(order)  # a row per snapshot
    todo, found, level, failed = records, [], 0, None
    while True:
        difference = subtract(sketch(todo, cells, level), order)
        if failed is not None:  # a snapshot of a failed pair also borders on a pair that did not fail
            difference = difference.join(failed, ["pair", "bucket"], "left_semi")
        peeled = cut(peel(difference, cells, level))
        found.append(peeled.where("sign <> 0"))
        failed = peeled.where("sign = 0").select("pair", "bucket")
        if level == LEVELS or failed.isEmpty():
            break
        cells, level = 4 * cells, level + 1
        again = failed.join(F.broadcast(order), failed.pair == order.snapshot).select(F.explode(F.array("snapshot", "before")).alias("snapshot"), "bucket").distinct()
        todo = records.join(again, ["snapshot", "bucket"], "left_semi")
    if level == LEVELS and not failed.isEmpty():  # not seen in practice: these buckets row by row
        last = records.join(failed.select(F.col("pair").alias("snapshot"), "bucket"), ["snapshot", "bucket"]).select(F.col("snapshot").alias("pair"), "bucket", "kh", "vh", F.lit(1).alias("sign"))
        older = failed.join(F.broadcast(order), failed.pair == order.snapshot).select("pair", "bucket", F.col("before").alias("snapshot"))
        first = records.join(older, ["snapshot", "bucket"]).select("pair", "bucket", "kh", "vh", F.lit(-1).alias("sign"))
        found.append(last.unionByName(first).groupBy("pair", "bucket", "kh", "vh").agg(F.sum("sign").cast("int").alias("sign")).where("sign <> 0"))
    pairs = reduce(DataFrame.unionByName, found).select("pair", "kh", "vh", "sign").distinct()
    side = pairs.join(F.broadcast(order.withColumnRenamed("snapshot", "pair")), "pair").withColumn("snapshot", F.when(F.col("sign") > 0, F.col("pair")).otherwise(F.col("before")))
    side = side.select("snapshot", "kh", "vh", "pair", "sign")
    named = records.join(F.broadcast(side) if pairs.count() <= SENT else side, ["snapshot", "kh", "vh"])
    kinds = named.groupBy("pair", *identity).agg(F.max("sign").alias("new"), F.min("sign").alias("old"))
    kind = F.when(F.col("new") != F.col("old"), "changed").when(F.col("new") > 0, "added").otherwise("removed")
    return kinds.select(F.col("pair").alias("snapshot"), *identity, kind.alias("change_kind"))


def repository_and_file_changes(repositories: DataFrame, files: DataFrame) -> DataFrame:
    """Both kinds of records of the test tables; repositories have the path ''."""
    white = r"^\s+|\s+$"
    who = F.lower(F.regexp_replace("repository_identifier", white, ""))
    records, identity = [], ["repository_identifier", "file_path"]
    for kind, (df, path, values) in enumerate(
        (
            (repositories, F.lit(""), [F.col("repository_url"), F.col("total_files"), F.col("total_chunks"), F.lower("last_commit_hash")]),
            (files, F.col("file_path"), [F.col("file_type"), F.col("file_size"), F.col("line_count"), F.lower("content_hash")]),
        )
    ):
        found = latest(df, "snapshot_no", "delivered_at", [who, path], values, identity)
        records.append(found.withColumn("snapshot", F.col("snapshot") * 2 + kind))
    found = changes(records[0].unionByName(records[1]), identity, series=2)
    return found.select(F.floor(F.col("snapshot") / 2).cast("int").alias("snapshot_no"), *identity, "change_kind")
