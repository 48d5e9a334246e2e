"""The checkpoint folder on a master that is not this process."""
import os
from types import SimpleNamespace

import pytest
from pyspark.sql import DataFrameWriter

import __spark_entry__
from tunekiln import session

from conftest import SF001


@pytest.fixture
def cluster(spark, monkeypatch):
    """The session as it stands, with the master's name of a cluster whose machines mount the folder."""
    session.checkpoint_dir(spark)
    monkeypatch.setattr(spark.sparkContext, "master", "spark://host:7077")
    monkeypatch.setattr(session, "_TRIED", set(), raising=False)
    return spark


def test_a_mounted_file_folder_is_taken(cluster):
    folder = session.checkpoint_dir(cluster)
    assert folder.startswith("file:") and session._TRIED == {folder}
    assert not [f for f in os.listdir(folder.removeprefix("file:")) if "-try-" in f]
    for query in ("agg_advice_v", "op4_token_efficiency_secrets"):
        assert __spark_entry__.queries()[query](cluster, SF001).count() > 0


def test_a_folder_that_loses_rows_is_refused(cluster, monkeypatch):
    written = DataFrameWriter.parquet

    def losing(self, path, *args, **kwargs):
        written(self, path, *args, **kwargs)
        os.remove(next(f.path for f in os.scandir(path.removeprefix("file:")) if f.name.startswith("part-")))

    monkeypatch.setattr(DataFrameWriter, "parquet", losing)
    with pytest.raises(RuntimeError, match="not shared"):
        session.prepare(cluster)
    cluster.conf.set("spark.tunekiln.checkpointDirIsMounted", "true")
    try:
        session.prepare(cluster)
    finally:
        cluster.conf.unset("spark.tunekiln.checkpointDirIsMounted")


def test_without_a_setting_the_warehouse_is_taken():
    folders, conf = [], {"spark.sql.warehouse.dir": "hdfs://shared/warehouse/"}
    sc = SimpleNamespace(master="spark://host:7077", getConf=lambda: {}, setCheckpointDir=folders.append,
                         getCheckpointDir=lambda: folders[-1] if folders else None)
    stub = SimpleNamespace(sparkContext=sc, conf=SimpleNamespace(get=lambda key, default=None: conf.get(key, default)))
    assert session.checkpoint_dir(stub) == session.checkpoint_dir(stub) == "hdfs://shared/warehouse/tunekiln-scratch"
    assert len(folders) == 1
