"""Sheets as a data source: what is written comes back, ranges join up, failed jobs leave nothing."""

import zipfile

import pytest
from pyspark.sql import functions as F

from opinarium.sources import readers, sheets, writers


def test_round_trip(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sheets, "RANGE", 7)
    monkeypatch.setattr(sheets, "ROWS", 20)
    rows = [(i, ["текст", None, "", ' <&">\n\r\t', "x" * 3000, "😀", "\x01"][i % 7], i / 4, i % 3 == 0) for i in range(60)]
    df = spark.createDataFrame(rows, "n long, `Текст` string, x double, b boolean").coalesce(1)
    writers.write_sheets(df, str(tmp_path / "out"))
    files = sorted(f for f in (tmp_path / "out").iterdir() if f.suffix == ".xlsx")
    assert len(files) == 3 and (tmp_path / "out" / "_SUCCESS").exists()
    got = {}
    for f in files:
        part = readers.read_table(spark, str(f), "Текст")
        assert part.columns == ["n", "Текст", "x", "b"] and part.rdd.getNumPartitions() == 3
        got |= {int(r["n"]): (r["Текст"], float(r["x"]), r["b"]) for r in part.collect()}
    want = lambda t: t if t is None else t.replace("\x01", "�")
    assert got == {n: (want(t), x, "TRUE" if b else "FALSE") for n, t, x, b in rows}


def test_a_failed_job_leaves_no_file(spark, tmp_path):
    df = spark.range(100, numPartitions=4).select(F.when(F.col("id") == 77, F.raise_error(F.lit("stop"))).otherwise(F.col("id")).alias("n"))
    with pytest.raises(Exception, match="stop"):
        writers.write_sheets(df, str(tmp_path / "out"))
    assert not [f for f in (tmp_path / "out").glob("*") if not f.name.startswith("_")]


def test_sheets_of_other_makers(spark, tmp_path):
    """Shared and rich strings, rows and cells left out, formulas, no stated dimension, equal and missing names in the header."""
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    path = tmp_path / "a.xlsx"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="b" sheetId="3" r:id="rId7"/><sheet name="a" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/><Relationship Id="rId7" Target="/xl/worksheets/sheet2.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>имя</t></si><si><r><t>a</t></r><r><t> b</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData/></worksheet>")
        z.writestr("xl/worksheets/sheet2.xml", f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>0</v></c></row><row r="2"><c r="B2"><f>1+1</f><v>2.0</v></c></row><row r="5"><c r="A5" t="s"><v>1</v></c><c r="C5" t="b"><v>1</v></c><c r="AA5"><v>9</v></c></row><row><c t="str"><v>x</v></c><c><v>1.5</v></c></row></sheetData></worksheet>')
    df = readers.read_table(spark, str(path), "имя")
    assert df.columns == ["имя", "_c1", "имя.1"]
    assert [tuple(r) for r in df.collect()] == [(None, "2", None), ("a b", None, "TRUE"), ("x", "1.5", None)]
    with pytest.raises(ValueError, match="xlsx"):
        readers.read_table(spark, "old.xls")


def test_download(spark):
    df = spark.createDataFrame([(1, "а"), (2, None)], "n long, t string")
    data, kind = writers.download_bytes(df, "xlsx")
    assert kind.endswith("sheet") and data[:2] == b"PK"


def test_column_names():
    for i, name in ((0, "A"), (25, "Z"), (26, "AA"), (701, "ZZ"), (702, "AAA")):
        assert sheets.column_name(i) == name and sheets.column_of(f"{name}12") == i
