"""Session settings and the shared folder for checkpoints."""

from __future__ import annotations

import atexit
import contextlib
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only by local sessions that name no shared folder, as in tests.
LOCAL_CHECKPOINTS = "/tmp/checkpoints"
#: Of each thread, so that none drops another's: the tables that :func:`written` has left, oldest first.
_LEFT = threading.local()
#: Folders that are removed as this process ends.
_SWEPT: set[str] = set()


def build(master: str = "local[*]", partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with UTC times and adaptive execution; ``conf`` wins."""
    builder = (
        SparkSession.builder.master(master)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``; a local master may do without."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return LOCAL_CHECKPOINTS


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again.

    Tables of an application stand in one folder; :func:`drop_tables` removes
    some of them, :func:`drop_written` all.
    """
    spark = df.sparkSession
    path = f"{_written_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _left(spark).append(path)
    return spark.read.parquet(path)


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder for files of another format beside the tables of :func:`written`, dropped with them."""
    path = f"{_written_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _left(spark).append(path)
    return path


def tables(spark: SparkSession) -> list[str]:
    """Paths of the tables that :func:`written` has left in this thread, oldest first."""
    return list(_left(spark))


def _left(spark: SparkSession) -> list[str]:
    return _LEFT.__dict__.setdefault(spark.sparkContext.applicationId, [])


def drop_tables(spark: SparkSession, paths: list[str]) -> None:
    """Remove written tables; what was read from them must be written itself by now."""
    for path in paths:
        _delete(spark, path)
        _left(spark).remove(path)


def drop_written(spark: SparkSession) -> None:
    """Remove all tables that :func:`written` has left; results read from them are lost."""
    _delete(spark, _written_folder(spark))
    _left(spark).clear()


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _written_folder(spark: SparkSession) -> str:
    folder = f"{shared_folder(spark)}/tables/{spark.sparkContext.applicationId}"
    if folder not in _SWEPT:
        _SWEPT.add(folder)
        atexit.register(_sweep, spark, folder)
    return folder


def _sweep(spark: SparkSession, folder: str) -> None:
    """Remove an application's tables as its driver ends; a session that was stopped before cannot."""
    with contextlib.suppress(Exception):
        if spark.sparkContext._jsc is not None:
            _delete(spark, folder)
