"""Session settings and the one place that cuts lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from contextlib import contextmanager
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession

T = TypeVar("T")
_open_scopes: list[list[str]] = []
_shared: dict[tuple, tuple] = {}


def build_session(app_name: str = "opsloom", master: str | None = None,
                  shuffle_partitions: int | None = None) -> SparkSession:
    """Session with the settings the operators are designed for.

    On a cluster leave ``master`` and ``shuffle_partitions`` unset: the submit
    command names the master and AQE coalesces the shuffle partitions.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # split a hot join key even where that costs a shuffle for a later aggregation
        .config("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
        .config("spark.ui.enabled", "false")
        # call-site capture costs milliseconds per Column call, which adds up in wide plans
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a folder of this machine; on a cluster
    a missing setting is an error because executors must share the folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        named = tempfile.mkdtemp(prefix="opsloom-checkpoint-")
    sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame, codec: str | None = None) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and continue from the written table. ``codec``: the files' compression, or
    the session's.

    Needed where two later branches must see the same partition layout, and so
    that a lost executor costs a re-read instead of a recomputation. Parquet keeps
    column pruning and gives the planner real sizes, which a checkpointed RDD does not.
    """
    spark = df.sparkSession
    path = scratch_folder(spark, "opsloom")
    df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder name under the shared checkpoint folder. The folder goes when the driver ends, or with the
    :func:`intermediate_tables` scope that it is made in."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    target, files = file_system(spark, path)
    files.deleteOnExit(target)
    if _open_scopes:
        _open_scopes[-1].append(path)
    return path


def file_system(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def shared(spark: SparkSession, name: str, source: str, build: Callable[[], T]) -> T:
    """What ``build`` makes of the files at ``source``: made once a session and state of the files, and kept until the driver
    ends, or to the end of the :func:`intermediate_tables` scope that it is made in."""
    target, files = file_system(spark, source)
    state = tuple((str(f.getPath()), f.getLen(), f.getModificationTime()) for f in files.listStatus(target))
    key = (spark.sparkContext.applicationId, name, source, state)
    if key not in _shared:
        _shared[key] = build(), _open_scopes[-1] if _open_scopes else None
    return _shared[key][0]


@contextmanager
def intermediate_tables(spark: SparkSession):
    """Intermediate tables written inside are deleted at the end, so results must be collected or stored before."""
    made: list[str] = []
    _open_scopes.append(made)
    try:
        yield
    finally:
        _open_scopes[:] = [scope for scope in _open_scopes if scope is not made]
        for key in [key for key, (_, scope) in _shared.items() if scope is made]:
            del _shared[key]
        for path in made:
            target, files = file_system(spark, path)
            files.delete(target, True)
