"""Intermediate tables in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of the session's ``spark.checkpoint.dir``. Where that is unset, a local session gets a temporary one; on a cluster it is an error, as executors share no local folder."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="ringloom-"))
    return sc.getCheckpointDir().rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


class _Made:
    """Paths of the tables that the innermost scratch() has seen written. Functions travel with what they name, and a context stays where it is: executors get an empty one."""

    def __init__(self) -> None:
        self.paths: ContextVar[list[str] | None] = ContextVar("made", default=None)

    def __reduce__(self):
        return _Made, ()


_MADE = _Made()


def settle(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Write `df` once as Parquet in the shared folder, packed by `codec` or as the session has it, and read it back: what follows neither recomputes it nor depends on the executors that made it. The table goes with the session at the latest."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path, compression=codec)
    file = spark._jvm.org.apache.hadoop.fs.Path(path)
    file.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(file)
    if (made := _MADE.paths.get()) is not None:
        made.append(path)
    return at(spark.read.schema(df.schema).parquet(path), path)


def at(df: DataFrame, path: str) -> DataFrame:
    """`df`, marked as read from the table at `path`."""
    df.settled_at = path
    return df


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Delete the tables that settle() writes inside, at its end, but for those that are handed to the function that it gives; these are left to the scratch() around it, if any."""
    made: list[str] = []
    kept: set[str] = set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df.settled_at)
        return df

    token = _MADE.paths.set(made)
    try:
        yield keep
    finally:
        _MADE.paths.reset(token)
        outer = _MADE.paths.get()
        for path in made:
            if path not in kept:
                _delete(spark, path)
            elif outer is not None:
                outer.append(path)


def _delete(spark: SparkSession, path: str) -> None:
    file = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = file.getFileSystem(spark._jsc.hadoopConfiguration())
    system.delete(file, True)
    system.cancelDeleteOnExit(file)


def drop_table(df: DataFrame) -> None:
    """Delete a table that settle() wrote and nothing reads any more; or that which `df`, derived from it, reads first."""
    path = getattr(df, "settled_at", None) or next((f.rpartition("/")[0] for f in df.inputFiles()), None)
    if path:
        _delete(df.sparkSession, path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
