"""Cutting lineage: tables written to the shared checkpoint folder."""

from __future__ import annotations

import atexit
import dataclasses
import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []
_places: dict[int, tuple[DataFrame, str]] = {}
_own: dict[str, str] = {}
_FREES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def checkpoint_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; where that is unset, a folder of its own on a single machine.

    On a cluster such a folder would lie on each machine by itself, so there
    an unset folder is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = "file://" + tempfile.mkdtemp(prefix="lumenry-checkpoint-")
        folder = _own[app]
    return folder


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """What is made and runs within leaves no shuffle files; else they stay until the driver happens to collect its garbage."""
    before = spark.conf.get(_FREES, None)
    spark.conf.set(_FREES, "true")
    try:
        yield
    finally:
        spark.conf.unset(_FREES) if before is None else spark.conf.set(_FREES, before)


def stage(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as parquet to the shared folder and read back: one computation, no lineage.

    The files survive the loss of any executor; they are removed by
    ``clear_stages``, or when the application ends. Shuffle files of the
    computation go at once.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with shuffles_freed(spark):
        df.write.option("compression", "zstd").parquet(path)
    _written.append((spark, path))
    found = spark.read.schema(df.schema).parquet(path)
    _places[id(found)] = (found, path)
    return found


def discard(staged: DataFrame) -> None:
    """Removes the files of a staged table that nothing reads any more."""
    _, path = _places.pop(id(staged))
    _remove(staged.sparkSession, path)
    _written.remove((staged.sparkSession, path))


@dataclasses.dataclass
class SharedFile:
    """A file that the driver writes at ``path`` and all tasks can map once it is published."""

    path: str
    everywhere: bool  # whether the tasks find it at that path; else by ``SparkFiles``

    def publish(self, spark: SparkSession) -> str:
        """The path, or the name, by which tasks find it."""
        if self.everywhere:
            return self.path
        spark.sparkContext.addFile(self.path)
        return os.path.basename(self.path)


def shared_file(spark: SparkSession, name: str) -> SharedFile:
    """A new file in the checkpoint folder where that is a mounted one, else one of the driver's that Spark hands to the tasks.

    The latter stays until the driver ends, as Spark offers it to every task.
    """
    name, where = f"{name}-{uuid.uuid4().hex}", spark.sparkContext._jvm.org.apache.hadoop.fs.Path(checkpoint_dir(spark))
    where = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(where).toUri()
    everywhere = where.getScheme() == "file"
    home = where.getPath() if everywhere else tempfile.mkdtemp(prefix="lumenry-shared-")
    os.makedirs(home, exist_ok=True)
    path = os.path.join(home, name)
    if everywhere:
        _written.append((spark, f"file://{path}"))
    else:
        atexit.register(shutil.rmtree, home, True)
    return SharedFile(path, everywhere)


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def clear_stages() -> None:
    """Removes all files written so far; for long sessions, between queries whose results are written."""
    _places.clear()
    while _written:
        try:
            _remove(*_written.pop())
        except Exception:  # the session has ended
            continue


atexit.register(clear_stages)
