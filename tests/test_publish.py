"""A publication is seen as a whole: a job that fails midway leaves the earlier output."""
import os

import pytest
from pyspark.sql import functions as F

from tunekiln.sources.publish import POINTER, current, publish, read_published, replace


def test_a_failed_job_leaves_the_earlier_output(spark, tmp_path):
    path = str(tmp_path / "out")
    assert current(spark, path) is None
    with pytest.raises(FileNotFoundError):
        read_published(spark, path)
    publish(spark.range(10).toDF("a"), path)
    rows = lambda: sorted(r.a for r in read_published(spark, path, schema="a bigint").collect())
    first = current(spark, path)
    assert rows() == list(range(10))
    bad = spark.range(0, 1000, 1, 8).select(F.when(F.col("id") == 900, F.raise_error(F.lit("a task fails"))).otherwise(F.col("id")).cast("bigint").alias("a"))
    with pytest.raises(Exception, match="a task fails"):
        publish(bad, path)
    assert rows() == list(range(10)) and current(spark, path) == first
    publish(spark.range(5).toDF("a"), path)
    assert rows() == list(range(5))
    opened = read_published(spark, path, schema="a bigint")
    publish(spark.range(7).toDF("a"), path)
    assert opened.count() == 5 and rows() == list(range(7))  # a reader of the version before goes on
    publish(spark.range(2).toDF("a"), path)
    left = [n for n in os.listdir(path) if n.startswith("_v-")]
    assert rows() == [0, 1] and len(left) == 2 and first.rsplit("/", 1)[1] not in left  # the failed job's folder is gone too
    assert os.path.exists(f"{path}/{POINTER}")


def test_partitions_and_empty_results(spark, tmp_path):
    path = str(tmp_path / "train")
    publish(spark.sql("SELECT 'train' AS split, 1 AS a UNION ALL SELECT 'test', 2"), path, "parquet", ["split"])
    assert {tuple(r) for r in read_published(spark, path, "parquet").select("split", "a").collect()} == {("train", 1), ("test", 2)}
    assert any(f.endswith("split=test") for f, _, _ in os.walk(path))
    publish(spark.range(0).toDF("a"), path + "2", "parquet")
    assert read_published(spark, path + "2", "parquet", "a bigint").count() == 0


def test_replace_leaves_a_plain_folder(spark, tmp_path):
    path = str(tmp_path / "train")
    bad = spark.range(0, 100, 1, 4).select(F.when(F.col("id") == 90, F.raise_error(F.lit("a task fails"))).otherwise(F.col("id")).cast("bigint").alias("id"))
    for n in (10, 4):
        replace(spark.range(n).withColumn("split", F.col("id") % 2), path, "parquet", ["split"])
        with pytest.raises(Exception, match="a task fails"):
            replace(bad, path)
        assert spark.read.parquet(path).count() == n and os.listdir(tmp_path) == ["train"]
