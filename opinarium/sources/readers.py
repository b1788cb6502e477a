"""Tables of comments from CSV, Excel, Parquet or what Spark reads."""

from __future__ import annotations

import csv

from pyspark.sql import DataFrame, SparkSession

from ..plans.config import require_columns
from .records import MISSING, OPTIONS, read_split
from .sheets import read_sheet

SNIFFED = 64 << 10
SEPARATORS = ",;\t|"


#: Scans of at least so many bytes in fewer splits than cores are dealt out; row-wise work then uses all cores.
SPREAD_BYTES = 4 << 20


def scan(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """A Parquet table, or columns of it.

    A file whose few row groups would keep cores idle is dealt out once;
    tables with a split for each core or more are read as they lie.
    """
    df = spark.read.parquet(path)
    df = df.select(*columns) if columns else df
    plan = df._jdf.queryExecution()
    cores = spark.sparkContext.defaultParallelism
    if int(str(plan.optimizedPlan().stats().sizeInBytes())) >= SPREAD_BYTES and plan.toRdd().getNumPartitions() < cores:
        return df.repartition(cores)
    return df


def _head(spark: SparkSession, path: str) -> str:
    """The first characters of a file, through Spark's file systems."""
    jvm = spark.sparkContext._jvm
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(hadoop)
    if fs.getFileStatus(where).isDirectory():
        files = [f for f in fs.listStatus(where) if f.isFile() and not f.getPath().getName().startswith(("_", "."))]
        where = sorted(files, key=lambda f: f.getPath().getName())[0].getPath()
    stream = fs.open(where)
    try:
        data = bytes(b & 255 for b in jvm.org.apache.commons.io.IOUtils.toByteArray(jvm.org.apache.commons.io.input.BoundedInputStream(stream, SNIFFED)))
    finally:
        stream.close()
    return data.decode("utf-8-sig", "ignore")


def separator(sample: str, fallback: bool = True) -> str:
    """The delimiter that the sample suggests; where it suggests none, a semicolon, then a comma, if its first line has one."""
    try:
        return csv.Sniffer().sniff(sample, SEPARATORS).delimiter
    except csv.Error:
        if not fallback:
            raise
    first = sample.split("\n", 1)[0]
    return ";" if ";" in first else ","


def read_csv(spark: SparkSession, path: str, sep: str | None = None, fallback: bool = True, multi_line: bool = True, keep_empty: bool = False) -> DataFrame:
    """All columns as text; quoted fields may hold doubled quotes and, unless multi_line is off, line ends; a byte-order mark is dropped.

    Files are read by byte ranges either way; where no field holds a line end, multi_line=False saves a pass over them.
    keep_empty: quoted empty cells are empty texts, and only unquoted ones are missing.
    """
    sep = sep or separator(_head(spark, path), fallback)
    if multi_line:
        return read_split(spark, path, sep, keep_empty)
    return spark.read.csv(path, header=True, sep=sep, encoding="utf-8", **OPTIONS, **({"nullValue": MISSING} if keep_empty else {}))


def read_excel(spark: SparkSession, path: str) -> DataFrame:
    """The first sheet, its first row as header, all columns as text; read by ranges of rows (see sheets)."""
    return read_sheet(spark, path)


def read_table(spark: SparkSession, path: str, *required: str, fallback: bool = True, multi_line: bool = True, keep_empty: bool = False) -> DataFrame:
    """A table by its extension, with its required columns checked."""
    name = path.lower().rstrip("/")
    if name.endswith(".xls"):
        raise ValueError("the binary format of old sheets isn't read; save as .xlsx")
    if name.endswith(".xlsx"):
        out = read_excel(spark, path)
    elif name.endswith(".parquet"):
        out = spark.read.parquet(path)
    elif name.endswith((".json", ".jsonl", ".ndjson")):
        out = spark.read.json(path)
    else:
        out = read_csv(spark, path, fallback=fallback, multi_line=multi_line, keep_empty=keep_empty)
    require_columns(out, *required)
    return out
