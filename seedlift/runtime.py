"""Session set-up and the one way this package cuts lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "seedlift", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are written for; `conf` wins."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        # Call sites on every column cost more than building the plan.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
    }
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for cut lineage: `spark.checkpoint.dir` of the session.

    Only a local session without that setting gets a folder of its own; on a
    cluster a machine-local folder would be lost with the machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    return _local_root()


@cache
def _local_root() -> str:
    return tempfile.mkdtemp(prefix="seedlift-")


_scopes: list[list[str]] = []


def new_folder(spark: SparkSession, tag: str, keep: bool = False) -> str:
    """A folder name under the checkpoint folder; inside `scratch()` it goes when the scope ends, or the one around it for `keep`."""
    path = f"{checkpoint_root(spark)}/{tag}-{uuid.uuid4().hex}"
    scopes = _scopes[:-1] if keep else _scopes
    if scopes:
        scopes[-1].append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete what is pinned inside once the block ends; write results elsewhere before that."""
    _scopes.append([])
    try:
        yield
    finally:
        for name in _scopes.pop():
            _delete(spark, name)


def _delete(spark: SparkSession, name: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def unpin(pinned: DataFrame) -> None:
    """Delete a table as `pin` returned it, before its scope ends; nothing may read it any more."""
    for name in {f.rsplit("/", 1)[0] for f in pinned.inputFiles()}:
        _delete(pinned.sparkSession, name)


#: Shuffle files go with the query that wrote them, not when the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def pin(df: DataFrame, tag: str = "pin", keep: bool = False) -> DataFrame:
    """Write `df` once as Parquet under the checkpoint folder and read it back; with `keep` it outlives the `scratch()` around it.

    Unlike `checkpoint()` this computes the plan once, keeps column pruning, and
    the files outlive any executor. The shuffle files of the plan go once it is written.
    """
    spark = df.sparkSession
    path = new_folder(spark, tag, keep)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


# Aim for ranges of this many bytes by the optimizer's estimate.
RANGE_BYTES = 16 << 20


def range_count(df: DataFrame) -> int:
    """Ranges to cut `df` into: by estimated size, at most the session's shuffle partitions."""
    estimate = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    wanted = int(str(estimate)) // RANGE_BYTES + 2
    return min(pieces(df.sparkSession), wanted)


def pieces(spark: SparkSession) -> int:
    """How many ranges or salts to cut hot data into."""
    return max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))


# A table up to this many values (rows x columns) may be copied to every executor.
SMALL_VALUES = 1_000_000


def at_most(df: DataFrame, rows: int) -> bool:
    """Whether `df` holds no more than `rows` rows; reads no further than that."""
    return df.limit(rows + 1).count() <= rows
