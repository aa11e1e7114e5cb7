"""Tables in the shared folder."""

import os
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from skein import storage


def test_tables_are_written_and_read_back(spark):
    rows = spark.range(100).select("id", (F.col("id") % 3).cast("int").alias("k"), F.lit("x").alias("s"))
    back = storage.materialise(rows.groupBy("k", "s").agg(F.sum("id").alias("n")), "sums", by=("k",))
    assert back.columns == ["k", "s", "n"] and back.schema["k"].dataType.simpleString() == "int"
    assert {r.k: r.n for r in back.collect()} == {k: sum(range(k, 100, 3)) for k in range(3)}
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
    path = back._skein_path.removeprefix("file://")
    assert os.path.isdir(path)
    storage.discard(back)
    assert not os.path.exists(path)


def test_empty_tables_keep_their_columns(spark):
    back = storage.materialise(spark.range(5).where("id > 9").select("id", F.lit(1).alias("k")), "none", by=("k",))
    assert back.columns == ["id", "k"] and back.count() == 0


def test_each_piece_of_work_has_a_partition_of_its_own(spark):
    table = storage.each_alone(spark, [(k,) for k in range(23)], "k long")
    assert sorted(r.n for r in table.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()) == [1] * 23
    assert storage.each_alone(spark, [], "k long").count() == 0


@pytest.mark.parametrize("master, refused", [("spark://host:7077", True), ("yarn", True), ("local-cluster[3,2,1024]", True), ("local", False), ("local[8]", False)])
def test_a_cluster_needs_a_shared_folder(master, refused):
    nothing = SimpleNamespace(get=lambda *_: None, set=lambda *_: None)
    spark = SimpleNamespace(conf=nothing, sparkContext=SimpleNamespace(master=master, getConf=lambda: nothing))
    if refused:
        with pytest.raises(ValueError, match="shared folder"):
            storage.shared_root(spark)
    else:
        assert storage.shared_root(spark).startswith("file://")
