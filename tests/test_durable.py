from types import SimpleNamespace

import pytest

from corpusprep.functions.durable import shared_folder, stored


def _session(master, **conf):
    settings = {k.replace("_", "."): v for k, v in conf.items()}
    return SimpleNamespace(
        conf=SimpleNamespace(get=lambda name, default=None: settings.get(name, default)),
        sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: None),
    )


def test_the_named_folder_is_taken_anywhere():
    for master in ("local[2]", "spark://host:7077"):
        assert shared_folder(_session(master, spark_checkpoint_dir="hdfs://x/shared/")) == "hdfs://x/shared"


def test_without_one_the_warehouse_must_be_shared():
    warehouse = {"spark_sql_warehouse_dir": "s3a://bucket/wh"}
    assert shared_folder(_session("yarn", **warehouse)) == "s3a://bucket/wh/_shared"
    assert shared_folder(_session("local[2]", spark_sql_warehouse_dir="file:/tmp/wh")) == "file:/tmp/wh/_shared"
    for local in ("file:/tmp/wh", "/tmp/wh"):
        with pytest.raises(RuntimeError):
            shared_folder(_session("yarn", spark_sql_warehouse_dir=local))


def test_stored_tables_are_read_back(spark):
    df = stored(spark.range(5))
    assert sorted(r.id for r in df.collect()) == list(range(5)) and "stored-" in df.inputFiles()[0]
