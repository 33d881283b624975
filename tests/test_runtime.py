"""Where lineage is cut."""

import time

import pytest
from pyspark.sql import functions as F

from seedlift import runtime


class Unset:
    def get(self, *_):
        return None


def test_pin_uses_the_named_folder(spark):
    pinned = runtime.pin(spark.range(5), "five")
    assert pinned.count() == 5 and runtime.at_most(pinned, 5) and not runtime.at_most(pinned, 4)
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        assert all(f"{named}/five-" in f for f in pinned.inputFiles())


def test_local_sessions_get_a_folder_of_their_own():
    local = type("Session", (), {"conf": Unset(), "sparkContext": type("C", (), {"master": "local[2]"})})
    assert runtime.checkpoint_root(local) == runtime.checkpoint_root(local)


def test_no_machine_local_folder_on_a_cluster():
    cluster = type("Session", (), {"conf": Unset(), "sparkContext": type("C", (), {"master": "yarn"})})
    with pytest.raises(RuntimeError):
        runtime.checkpoint_root(cluster)


def test_a_scope_leaves_nothing_behind(spark):
    with runtime.scratch(spark):
        inside = runtime.pin(spark.range(5), "gone")
        files = inside.inputFiles()
        assert inside.count() == 5 and files
    path = spark._jvm.org.apache.hadoop.fs.Path(files[0])
    assert not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    assert runtime.pin(spark.range(3), "stays").count() == 3


def test_what_is_kept_outlives_the_inner_scope_only(spark):
    def exists(name):
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)

    with runtime.scratch(spark):
        with runtime.scratch(spark):
            gone = runtime.pin(spark.range(5), "gone").inputFiles()
            kept = runtime.pin(spark.range(5), "kept", keep=True)
        assert not exists(gone[0]) and kept.count() == 5
        files = kept.inputFiles()
    assert not exists(files[0])


def test_a_pin_leaves_no_shuffle_files(spark):
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {f.getName() for f in spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(blocks.getAllFiles())}
    before = files()
    pinned = runtime.pin(spark.range(1000).groupBy((F.col("id") % 10).alias("k")).count())
    for _ in range(50):
        left = {f for f in files() - before if f.startswith("shuffle_")}
        if not left:
            break
        time.sleep(0.1)
    assert not left and pinned.count() == 10
