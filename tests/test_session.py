from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from tessera import session
from tessera.operators import catalog


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("limit", [200_000, 1])
def test_each_key_once_without_moving_the_rest(spark, tmp_path, limit):
    rows = [(1, "a", "x"), (1, "a", "x"), (2, "b", "y"), (None, "c", "z"), (None, "c", "z"), (3, None, "_key"), (4, "d", "u"), (4, "e", "v")]
    spark.createDataFrame(rows, "id long, text string, _n string").repartition(3).write.parquet(str(tmp_path / "t"))
    df = session.once(spark.read.parquet(str(tmp_path / "t")), "id", "text", limit=limit)
    got = sorted(map(str, map(tuple, df.collect())))
    assert [g for g in got if "(4" not in g] == sorted(map(str, [(1, "a"), (2, "b"), (None, "c"), (3, None)])) and len(got) == 5
    if limit > 1:
        assert "Exchange hashpartitioning" not in plan_of(df)
    assert session.once(spark.read.parquet(str(tmp_path / "t")).where("id = 99"), "id", "text").count() == 0


def test_a_cluster_needs_a_shared_folder():
    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: d), sparkContext=SimpleNamespace(master="spark://x:7077", getCheckpointDir=lambda: None))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(cluster)


def test_no_window_over_a_whole_collection(spark):
    """A collection of very many files is numbered range by range."""
    df = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("r"), (F.col("id") % 50).cast("string"))).alias("repository_identifier"), F.concat(F.lit("f"), F.col("id").cast("string")).alias("file_path"), F.lit(0).alias("local_idx"))
    out = catalog.assign_chunk_ids(df)
    hot = [r[0] for r in out.where("repository_identifier = 'hot'").orderBy("file_path").select("chunk_seq").collect()]
    assert hot == list(range(len(hot)))
    windows = [x for x in plan_of(out).splitlines() if " Window " in x]
    assert windows and all("_range" in x or "file_path" in x for x in windows if "_n#" in x or "row_number" in x)
