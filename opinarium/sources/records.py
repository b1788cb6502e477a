"""Records of CSV files with line ends in quoted fields, read by byte ranges.

Whether a range starts within quotes is not known where it is read. So a first
pass follows each range's lines from both states, speculatively, which gives
the range's end for either start; a prefix over the ranges of a file (a row
each) then tells the true starts, and a second pass cuts the records. What a
range has of a record that began before it, or ends after it, is put together
by the record's number: at most two parts a range. A quote that never closes
takes the rest of its file, less the last line end.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import importable

OPTIONS = {"quote": '"', "escape": '"'}
#: Stands for a missing cell where quoted empty ones are kept apart; no character.
MISSING = "﷐"


def quoted_after(line: str, quoted: bool, sep: str) -> bool:
    """Whether the end of a line is within quotes, if its start is.

    Quotes count where a field starts; doubled ones are text; after the
    closing quote a field goes on to the next separator.
    """
    at = 0
    while True:
        if not quoted:
            while not line.startswith('"', at):
                at = line.find(sep, at)
                if at < 0:
                    return False
                at += len(sep)
            at += 1
        while True:
            at = line.find('"', at)
            if at < 0:
                return True
            if not line.startswith('"', at + 1):
                break
            at += 2
        at = line.find(sep, at + 1)
        if at < 0:
            return False
        at += len(sep)
        quoted = False


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of all files: file, start (of the range) and line, a range's lines in order and together."""
    return spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").alias("line"))


def _ranges(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[str, int, pa.Array]]:
    """(file, start, lines) for the runs of rows of one range."""
    for batch in batches:
        files, starts = batch.column("file").to_pylist(), batch.column("start").to_pylist()
        begin = 0
        for i in range(1, batch.num_rows + 1):
            if i == batch.num_rows or starts[i] != starts[begin] or files[i] != files[begin]:
                yield files[begin], starts[begin], batch.column("line").slice(begin, i - begin)
                begin = i


def _ends(lines: DataFrame, sep: str) -> DataFrame:
    """file, start, plain and inside for each range: whether its end is within quotes if its start isn't, and if it is."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, int], tuple[bool, bool]] = {}
        for file, start, part in _ranges(batches):
            plain, inside = found.get((file, start), (False, True))
            for line in part.filter(pc.match_substring(part, '"')).to_pylist():
                ends = quoted_after(line, False, sep), quoted_after(line, True, sep)
                plain, inside = ends[plain], ends[inside]
            found[file, start] = plain, inside
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*((*k, *v) for k, v in found.items())) if found else ((),) * 4, (pa.string(), pa.int64(), pa.bool_(), pa.bool_()))], names=["file", "start", "plain", "inside"])

    return lines.mapInArrow(run, "file string, start long, plain boolean, inside boolean")


def starts_within(ends: DataFrame) -> DataFrame:
    """file and start of the ranges that start within quotes.

    A range passes its start's state on, turns it round or sets it. What was
    set last, and how often it has been turned since, is the state.
    """
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    known = ends.select("file", "start", F.when(F.col("plain") == F.col("inside"), F.col("plain")).alias("sets"), (F.col("plain") & ~F.col("inside")).cast("int").alias("turns"))
    counted = known.withColumn("turned", F.coalesce(F.sum("turns").over(before), F.lit(0)))
    last = F.last(F.when(F.col("sets").isNotNull(), F.struct(F.col("sets").cast("int").alias("state"), "turned")), ignorenulls=True).over(before)
    seen = counted.withColumn("last", last).withColumn("state", (F.coalesce("last.state", F.lit(0)) + F.col("turned") - F.coalesce("last.turned", F.lit(0))) % 2)
    return seen.where("state = 1").select("file", "start")


def read_records(spark: SparkSession, path: str, sep: str) -> DataFrame:
    """file, start, first (whether it is its file's first) and record for all records of a path's files; blank lines are none.

    Of the ranges, the driver learns those that start within quotes.
    """
    importable(spark)
    lines = _lines(spark, path)
    within = {(r["file"], r["start"]) for r in starts_within(_ends(lines, sep)).collect()}
    schema = "file string, start long, first boolean, opens boolean, closes boolean, number long, record string"
    kinds = (pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.bool_(), pa.int64(), pa.string())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: tuple[str, int] | None = None
        held: list[str] = []
        quoted = opened = fresh = False
        number = 0
        out: list[tuple] = []

        def put(closes: bool, ends: bool) -> None:
            # A part that doesn't end here ends with the line end that follows it, within the field.
            nonlocal fresh, number
            record = "\n".join(held) + ("" if ends else "\n")
            held.clear()
            if opened and closes:
                record = record.removesuffix("\r")
            if record or not (opened and closes):
                out.append((*at, fresh, opened, closes, number, record))
                number += 1
                fresh = False

        for file, start, part in _ranges(batches):
            if (file, start) != at:
                if held:
                    put(False, False)
                at, number = (file, start), 0
                quoted = at in within
                opened, fresh = not quoted, start == 0
            some = pc.match_substring(part, '"').to_pylist()
            for line, marks in zip(part.to_pylist(), some):
                if fresh and not held:
                    line = line.removeprefix("﻿")
                if marks:
                    quoted = quoted_after(line, quoted, sep)
                held.append(line)
                if not quoted:
                    put(True, True)
                    opened = True
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], names=[x.split()[0] for x in schema.split(", ")])
                out.clear()
        if held:
            put(False, False)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], names=[x.split()[0] for x in schema.split(", ")])

    parts = lines.mapInArrow(run, schema)
    whole = parts.where("opens and closes").select("file", "start", "first", "record")
    split = parts.where("not (opens and closes)")
    so_far = Window.partitionBy("file").orderBy("start", "number").rowsBetween(Window.unboundedPreceding, 0)
    joined = split.withColumn("of", F.sum(F.col("opens").cast("int")).over(so_far)).groupBy("file", "of").agg(F.min("start").alias("start"), F.max("first").alias("first"), F.sort_array(F.collect_list(F.struct("start", "number", "record"))).alias("parts"))
    record = F.regexp_replace(F.array_join(F.transform("parts", lambda p: p["record"]), ""), r"\r?\n?\z", "")
    return whole.unionByName(joined.select("file", "start", "first", record.alias("record")))


def read_split(spark: SparkSession, path: str, sep: str, keep_empty: bool = False) -> DataFrame:
    """A CSV table with its header's columns, all text: what Spark's multiLine gives, but by byte ranges.

    keep_empty: quoted empty cells are empty texts, others nulls; else both are nulls.
    """
    schema = spark.read.csv(path, header=True, sep=sep, multiLine=True, encoding="utf-8", **OPTIONS).schema
    records = read_records(spark, path, sep).where("not first")
    given = OPTIONS | {"sep": sep} | ({"nullValue": MISSING} if keep_empty else {})
    return records.select(F.from_csv(F.replace("record", F.lit("\r\n"), F.lit("\n")), ", ".join(f"`{f.name.replace('`', '``')}` string" for f in schema), given).alias("_")).select("_.*")
