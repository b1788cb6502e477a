"""Exports: distributed CSV, a single file for download, previews, JSON of details."""

from __future__ import annotations

import io

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sheets import write_book, write_sheets  # noqa: F401

#: Rows of a file that is made on the driver.
DOWNLOAD_ROWS = 1_000_000


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True, quote='"', escape='"')


def download_bytes(df: DataFrame, kind: str = "csv") -> tuple[bytes, str]:
    """A file with a byte-order mark (csv) or one sheet named result (xlsx), and its media type.

    It is made on the driver: over DOWNLOAD_ROWS rows are an error, not cut; write_csv() and write_sheets() have no such limit.
    """
    table = df.limit(DOWNLOAD_ROWS + 1).toPandas()
    if len(table) > DOWNLOAD_ROWS:
        raise ValueError(f"over {DOWNLOAD_ROWS} rows; use write_csv()")
    if kind == "xlsx":
        buffer = io.BytesIO()
        write_book(buffer, list(table.columns), iter(table.astype(object).where(table.notna(), None).itertuples(index=False)))
        return buffer.getvalue(), "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet"
    return table.to_csv(index=False).encode("utf-8-sig"), "text/csv"


def export_name(source: str, tool: str = "relevance") -> tuple[str, str]:
    """The file name and kind of a result: the input's family, but Excel for categories."""
    if tool == "categories":
        return "categorized.xlsx", "xlsx"
    stem, _, extension = source.rsplit("/", 1)[-1].rpartition(".")
    kind = "xlsx" if extension.lower() in ("xlsx", "xls") else "csv"
    return f"filtered_{stem or extension}.{kind}", kind


def preview(df: DataFrame, key: str, n: int = 30) -> DataFrame:
    return df.orderBy(key).limit(n)


def details(relevance: Column, sentiment: Column | None = None) -> Column:
    """JSON of an item's results."""
    parts = [F.struct(F.array(relevance).alias("results")).alias("relevance")]
    return F.to_json(F.struct(*parts, *([sentiment.alias("sentiment")] if sentiment is not None else [])))
