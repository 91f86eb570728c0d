"""Tables: the driver's inputs, and what operators write to cut lineage."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no spark.checkpoint.dir and its one machine is this one.
LOCAL_SHARED_DIR = "/tmp/checkpoints/threadloom"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local one if the master is local; a cluster has to name one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (named or LOCAL_SHARED_DIR).rstrip("/")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by keys into as many partitions as spark.sql.shuffle.partitions says. Adaptive execution does not merge these: for rows that are few bytes but much work to join."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


_SCOPES = threading.local()


@contextmanager
def written() -> Iterator[list[str]]:
    """The paths that settled writes in this thread while the block runs."""
    stack = _SCOPES.__dict__.setdefault("stack", [])
    stack.append([])
    try:
        yield stack[-1]
    finally:
        stack.pop()


def settled(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again.

    This cuts the lineage: a lost executor costs the tasks that it was running, not the stages before.
    The table stays as long as returned frames may read it; `removed` takes away those that none does.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/threadloom/{name}-{uuid.uuid4().hex}"
    for paths in _SCOPES.__dict__.get("stack", []):
        paths.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, paths: list[str]) -> None:
    """Deletes tables of settled that nothing reads any more, and empties the list."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    for path in paths:
        where = hadoop.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    paths.clear()
