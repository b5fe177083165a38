"""Tables between the steps of an operator, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``. On a local master alone, a temporary folder is set if there is none."""
    found = spark.sparkContext.getConf().get(CHECKPOINT_KEY) or spark.conf.get(CHECKPOINT_KEY, None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_KEY} to a folder that the driver and all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="spark-")
    spark.conf.set(CHECKPOINT_KEY, folder)
    return folder


class Scratch:
    """Tables that an operator writes on its way. Each cuts the lineage: a lost executor costs its tasks only.

    ``drop`` deletes those that nothing reads any more; ``close`` deletes all but ``keep``.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def written(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{shared_folder(self.spark)}/{name}-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(path)
        found = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(found)] = (found, path)
        return found

    def drop(self, *tables: DataFrame) -> None:
        for df in tables:
            _, path = self.paths.pop(id(df))
            where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)

    def close(self, *keep: DataFrame) -> None:
        kept = {id(df) for df in keep}
        self.drop(*[df for key, (df, _) in list(self.paths.items()) if key not in kept])


def is_empty(df: DataFrame) -> bool:
    return df.limit(1).count() == 0
