"""Vectors by content: a table that grows by what it doesn't have.

A row's key is the digest of what the embedder is and of the text, so equal
texts are embedded once, whoever asks, and a changed reference costs one call.
New rows are appended by a Spark job: tasks that commit, all or none. Two jobs
that append at the same time may embed the same; one of the rows is read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .backends import Embedder, with_vectors

SCHEMA = "key string, vector array<float>"


def identity(embedder: Embedder) -> str:
    """What tells embedders apart: the class and the settings."""
    return f"{type(embedder).__name__} {sorted((k, repr(v)) for k, v in vars(embedder).items())}"


class VectorStore:
    def __init__(self, folder: str):
        self.folder = folder.rstrip("/")

    def vectors(self, spark: SparkSession) -> DataFrame:
        """SCHEMA: one row for each key."""
        done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/_SUCCESS")
        if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
            return spark.createDataFrame([], SCHEMA)
        return spark.read.schema(SCHEMA).parquet(self.folder).dropDuplicates(["key"])

    def of(self, df: DataFrame, text: str, embedder: Embedder, to: str = "vector", batch_size: int = 128) -> DataFrame:
        """df with to, each text's vector; what the store lacks is embedded and kept first. A null text has none."""
        keyed = df.withColumn("_key", F.sha2(F.concat_ws("\x1f", F.lit(identity(embedder)), F.col(text)), 256))
        asked = keyed.where(F.col(text).isNotNull()).groupBy(F.col("_key").alias("key")).agg(F.any_value(text).alias("text"))
        unseen = asked.join(self.vectors(df.sparkSession).select("key"), "key", "left_anti")
        with_vectors(unseen, "text", embedder, "vector", batch_size).select("key", "vector").write.mode("append").parquet(self.folder)
        found = self.vectors(df.sparkSession).withColumnsRenamed({"key": "_key", "vector": "_vector"})
        return keyed.join(found, "_key", "left").withColumn(to, F.when(F.col(text).isNotNull(), F.col("_vector"))).drop("_key", "_vector")
