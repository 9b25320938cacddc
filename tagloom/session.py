"""Sessions: what Python workers need to find this package, and where tables are written on the way."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def importable(spark: SparkSession) -> None:
    """Let Python workers started from now on import this package where it lies on a path they can read."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])


_local: dict[int, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a folder of our own only where that is unset and all runs on this machine."""
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if given:
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    key = id(spark.sparkContext)
    if key not in _local:
        _local[key] = tempfile.mkdtemp(prefix="tagloom-")
        atexit.register(shutil.rmtree, _local[key], ignore_errors=True)
    return f"file://{_local[key]}"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is put there goes when the driver ends."""
    target = f"{shared_dir(spark)}/tagloom-{name}-{uuid.uuid4().hex[:12]}"
    path = spark._jvm.org.apache.hadoop.fs.Path(target)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(path)
    return target


def written(df: DataFrame, name: str) -> DataFrame:
    """``df``, written to the shared folder and read again: made once, and kept when executors are lost. It goes when the driver ends."""
    spark = df.sparkSession
    target = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(target)
    return spark.read.schema(df.schema).parquet(target)


#: Rows that a task of ``spread`` takes, about.
SPREAD_ROWS = 20_000


def spread(rows: DataFrame, key: str, files: int = 1) -> DataFrame:
    """``rows``, dealt by ``key`` to a task a core and at least one for 20,000 of the ``files`` that each row becomes.

    Few bytes are few tasks to Spark, however much is computed from each row: before Python
    looks at what was made from the rows of a small table they are dealt by number.
    """
    n = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() * files // SPREAD_ROWS))
    return rows.repartition(n, key)
