"""Row ids and batches.

Batches of a table that goes to a model are made within partitions: no
ordering of the whole table, no shuffle. numbered_batches() makes the same
batches for any partitioning, through ranks within ranges of ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import written


def _placed(df: DataFrame) -> DataFrame:
    """df with each row's partition and its place there."""
    return df.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)})


def _numbered(placed: DataFrame, to: str) -> DataFrame:
    """_placed() rows with consecutive numbers in the order of their partitions.

    Numbers within a partition start at the sum of the partitions before it.
    That sum is a window over counts, one row a partition, not over rows.
    """
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("_part", F.coalesce(before, F.lit(0)).alias("_base"))
    return placed.join(F.broadcast(offsets), "_part").withColumn(to, (F.col("_base") + F.col("_at")).cast("long")).drop("_part", "_at", "_base")


def with_row_id(df: DataFrame, name: str = "row_id") -> DataFrame:
    """df with consecutive row ids from 0 in the order of its partitions.

    Partitions are counted first, so they must come out alike twice, as those of a scan do.
    """
    return _numbered(_placed(df), name)


def dense_rank_by_range(df: DataFrame, key: str, to: str) -> DataFrame:
    """df with the place of each row (from 0) in the order of key, by range partitions: no task sees the whole table.

    The ranges come from a sample, so rows are written with their places: counts and rows then see the same ones.
    Taking the sample runs all of its input, so rows are written before, too: what made them is computed once.
    """
    ranged = written(df, "unranked").repartitionByRange(F.col(key)).sortWithinPartitions(key)
    return _numbered(written(_placed(ranged), "ranged"), to)


def numbered_batches(df: DataFrame, key: str, size: int, to: str = "batch_id") -> DataFrame:
    """df with consecutive batches of size rows in the order of key."""
    out = dense_rank_by_range(df, key, "_place")
    return out.withColumn(to, F.floor(F.col("_place") / size).cast("long")).drop("_place")


def gathered(df: DataFrame, batch: str, idx: str, txt: str) -> DataFrame:
    """One row a batch with its items (idx, txt) in order of idx."""
    return df.groupBy(batch).agg(F.sort_array(F.collect_list(F.struct(F.col(idx).alias("idx"), F.col(txt).alias("txt")))).alias("items"))
