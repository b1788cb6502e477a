"""A session with settings that suit the engine."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parents[1])


def importable(spark: SparkSession) -> None:
    """Python workers find this package where the driver found it."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all machines share.

    Where it is unset, one of our own if the session runs on one machine (as
    in tests), else an error: executors couldn't read each other's files.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isEmpty():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="opinarium-"))
    return jsc.getCheckpointDir().get()


def written(df: DataFrame, name: str, level: int = 3, row_group: int | None = None) -> DataFrame:
    """The rows, as a Parquet table in the shared folder: later reads survive lost executors.

    The folder is removed when the application ends. level: of zstd. row_group: bytes after which a row group ends, however few its rows.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", level)
    if row_group:
        writer = writer.option("parquet.block.size", row_group).option("parquet.page.size.row.check.min", 1)
    writer.parquet(path)
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    return spark.read.schema(df.schema).parquet(path)


def session(master: str | None = None, partitions: int | None = None, **conf: str) -> SparkSession:
    """Adaptive execution, Arrow and UTC; a cluster's own master and partition counts stay unless given."""
    builder = SparkSession.builder.appName("opinarium")
    if master:
        builder = builder.master(master)
    settings = {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true", "spark.sql.session.timeZone": "UTC"}
    if partitions:
        settings["spark.sql.shuffle.partitions"] = str(partitions)
    for k, v in (settings | conf).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
