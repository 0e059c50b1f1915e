"""What the jobs need from the session: one folder that every executor reaches, and
frames kept for a while."""

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, else the context's
    checkpoint folder, else one below the warehouse."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return named or f"{spark.conf.get('spark.sql.warehouse.dir')}/_scratch"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path of its own below the shared folder, removed when the driver ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    place, files = _on_files(spark, path)
    files.deleteOnExit(place)
    return path


def drop_scratch(spark: SparkSession, path: str) -> None:
    """Remove a scratch path that nothing reads any more."""
    place, files = _on_files(spark, path)
    files.delete(place, True)


def exists(spark: SparkSession, path: str) -> bool:
    place, files = _on_files(spark, path)
    return files.exists(place)


def written(frame: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The frame as a table written below the shared folder, and its path."""
    spark = frame.sparkSession
    path = scratch_path(spark, name)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path), path


@contextmanager
def kept(frame: DataFrame, level: StorageLevel = StorageLevel.DISK_ONLY) -> Iterator[DataFrame]:
    """The frame, stored by executors on first use and released at the end of the scope.
    Blocks that are lost with an executor are made again from the frame's own plan."""
    stored = frame.persist(level)
    try:
        yield stored
    finally:
        stored.unpersist()


def use_checkpoints(spark: SparkSession) -> None:
    """Make ``DataFrame.checkpoint`` write to the shared folder."""
    folder = shared_folder(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)


def _on_files(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())
