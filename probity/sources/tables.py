"""Written tables that cut lineage, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


class Store:
    def __init__(self, spark: SparkSession, tag: str):
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root and not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = root or f"file://{tempfile.gettempdir()}/probity-scratch"
        self.spark, self.root, self.n = spark, f"{root}/{tag}-{uuid.uuid4().hex}", 0
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)

    def keep(self, df: DataFrame, codec: str | None = None) -> DataFrame:
        """codec: zstd for digests, which the default one leaves as they are. Spark may broadcast a table that is small as written."""
        self.n += 1
        path = f"{self.root}/{self.n}"
        (df.write.option("compression", codec) if codec else df.write).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)
