"""Tables written below the shared ``spark.checkpoint.dir``: they cut lineage and survive lost executors."""

from __future__ import annotations

import shutil
import uuid

from pyspark.sql import DataFrame, SparkSession

from corpuscope.session import ensure_checkpoint_dir
from corpuscope.sources import store


class Scratch:
    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Delete tables or folders that no later step reads."""
        conf = self.spark._jsc.hadoopConfiguration()
        for n in names:
            local = store.local_path(self.path(n))
            if local is not None:  # Hadoop takes ten times as long over a tree of small files
                shutil.rmtree(local, ignore_errors=True)
                continue
            p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(n))
            p.getFileSystem(conf).delete(p, True)
