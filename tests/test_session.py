from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from quirewise.functions.frames import bounded_blocks
from quirewise.functions.sizing import broadcast_checked, fits_broadcast, spread
from quirewise.session import CHECKPOINT_CONF, materialize, work_folder


def fake(conf):
    return SimpleNamespace(
        conf=SimpleNamespace(get=lambda key, default=None: conf.get(key, default)),
        sparkContext=SimpleNamespace(applicationId="test-app"),
    )


def test_work_folder_is_the_clusters(tmp_path):
    assert work_folder(fake({CHECKPOINT_CONF: "hdfs://shared/x/", "spark.master": "yarn"})) == "hdfs://shared/x"
    local = fake({"spark.master": "local[2]"})
    assert work_folder(local) == work_folder(local)
    with pytest.raises(RuntimeError, match=CHECKPOINT_CONF):
        work_folder(fake({"spark.master": "yarn"}))


def test_materialize_keeps_rows_and_schema(spark):
    df = spark.createDataFrame([(1, None), (2, ["a"])], "id int, tags array<string>")
    back = materialize(df, "t")
    assert back.schema == df.schema and sorted(back.collect()) == sorted(df.collect())
    assert materialize(df.limit(0), "t").count() == 0


def test_broadcast_is_refused_past_the_bound(spark):
    df = spark.range(100).withColumn("s", F.lit("x" * 100))
    assert fits_broadcast(df) and not fits_broadcast(df, max_rows=99) and not fits_broadcast(df, max_bytes=5000)
    assert "broadcast" in broadcast_checked(df)._jdf.queryExecution().toString().lower()
    assert "broadcast" not in broadcast_checked(df, max_rows=10)._jdf.queryExecution().toString().lower()


def test_blocks_cover_everything_even_with_one_repeated_row(spark):
    df = spark.createDataFrame([(1, "same")] * 500, "query_id int, text string")
    blocks = list(bounded_blocks(df, 100))
    sizes = [b.count() for b in blocks]
    assert sum(sizes) == 500 and len(blocks) == 10 and max(sizes) <= 100
    assert len(list(bounded_blocks(df, 500))) == 1
    assert sum(b.count() for b in bounded_blocks(df, 10_000, "text", 400)) == 500


def test_spread_leaves_large_and_shuffled_plans_alone(spark):
    cores = spark.sparkContext.defaultParallelism
    assert spread(spark.range(0, 100, 1, 1)).rdd.getNumPartitions() == cores
    assert spread(spark.range(0, 100, 1, cores + 1)).rdd.getNumPartitions() == cores + 1
    grouped = spark.range(10).groupBy("id").count()
    assert spread(grouped) is grouped
