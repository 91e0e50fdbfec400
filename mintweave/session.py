"""Session settings for local runs, and lineage cutting that survives lost executors."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "mintweave", cores: str | int = "*", partitions: int = 8) -> SparkSession:
    """A ``local[...]`` session for tests and the benchmark."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    A cluster names one on shared storage.  Only where none is named (tests, a
    laptop) a temporary folder is made and the session pointed at it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="spark-mintweave-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


_under: ContextVar[str | None] = ContextVar("under", default=None)


def run_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own for one run, in the shared folder; it comes into being with its first table."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def writing_under(folder: str) -> Iterator[None]:
    """Tables that ``cut`` writes meanwhile go to ``folder``, so that a run can remove all of its own."""
    before = _under.set(folder)
    try:
        yield
    finally:
        _under.reset(before)


def remove_folder(spark: SparkSession, folder: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def cut(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Used once per round of an iterative job and once per stage that several
    later stages read.  Unlike an executor-local cache the result outlives the
    executors that made it, and it is computed once.
    """
    spark = df.sparkSession
    path = f"{(_under.get() or shared_folder(spark)).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
