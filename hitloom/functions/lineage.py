"""Tables that cut lineage: written once to the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []
_WRITTEN: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; one of our own in local mode where none is named, an error on a cluster."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        path = found.get() if found.isDefined() else None
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="hitloom-rounds-")
        _OWN.append(path)
        spark.sparkContext.setCheckpointDir(path)
    return path


def settled(df: DataFrame, name: str = "round") -> DataFrame:
    """df as a written table: a loop's plan stays short, and a lost executor costs one round at most.

    Results may read it later, so it stays until the driver ends or ``tidy_rounds``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/hitloom-{name}-{uuid.uuid4().hex}"
    _WRITTEN.append((spark, path))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def filesystem(spark: SparkSession, path: str):
    """Hadoop's path and file system of a path, whatever it lies on."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


@atexit.register
def tidy_rounds() -> None:
    while _WRITTEN:
        with contextlib.suppress(Exception):  # the session may have ended already
            spark, path = _WRITTEN.pop()
            p, fs = filesystem(spark, path)
            fs.delete(p, True)
    while _OWN:
        shutil.rmtree(_OWN.pop(), ignore_errors=True)
