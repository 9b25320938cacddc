"""Tables that cut a job's lineage, in the folder all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import importable, shared_dir

def free_name(taken: list[str], name: str) -> str:
    """``name``, lengthened until no column is called so."""
    while name.lower() in {t.lower() for t in taken}:
        name += "_"
    return name


def quoted(name: str) -> str:
    """A column's name as an expression, whatever it holds."""
    return "`" + name.replace("`", "``") + "`"


class Workspace:
    """Parquet tables of one operator run, each written once and then re-read.

    Unlike a local checkpoint, a written table survives a lost executor. ``drop``
    removes a table that no later step reads; all go when the driver ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        importable(spark)
        self.spark = spark
        self.root = f"{shared_dir(spark)}/tagloom-{name}-{uuid.uuid4().hex[:12]}"
        path, fs = self._hadoop(self.root)
        fs.mkdirs(path)
        fs.deleteOnExit(path)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        df.write.option("compression", codec).mode("overwrite").parquet(self.path(name))
        return self.read(name, df.schema)

    def read(self, name: str, schema=None) -> DataFrame:
        reader = self.spark.read
        return (reader.schema(schema) if schema is not None else reader).parquet(self.path(name))

    def drop(self, name: str) -> None:
        path, fs = self._hadoop(self.path(name))
        fs.delete(path, True)

    def _hadoop(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        return path, path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
