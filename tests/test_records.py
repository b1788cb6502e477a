"""CSV by byte ranges against the one-task reader."""

import random

import pytest

from opinarium.sources import readers, records


@pytest.fixture
def small_ranges(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "97")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def both(spark, path, sep=","):
    plain = spark.read.csv(str(path), header=True, sep=sep, multiLine=True, encoding="utf-8", **records.OPTIONS)
    found = records.read_split(spark, str(path), sep)
    assert found.columns == plain.columns
    key = lambda df: sorted(map(str, map(tuple, df.collect())))
    return key(found), key(plain)


def cell(rng, sep):
    kind = rng.random()
    text = "".join(rng.choices(["a", "Ж", "b c", '""', "\n", "\n\n", sep, "x" * 40, "😀", "."], k=rng.randrange(5)))
    if kind < 0.5:
        return f'"{text}"'
    return "".join(c for c in text if c not in '"\n' and c != sep) + ('5" pipe' if kind > 0.95 else "")


@pytest.mark.parametrize("seed, sep", [(1, ","), (2, ";"), (3, "\t"), (4, ",")])
def test_equal_to_the_one_task_reader(spark, small_ranges, tmp_path, seed, sep):
    """Quotes and line ends across the edges of ranges, fields over several ranges, blank lines, several files with headers."""
    rng = random.Random(seed)
    for part in range(3):
        rows = [sep.join(["id", '"te""xt"' if seed == 4 else "text", "more"])] + [sep.join([str(i), cell(rng, sep), cell(rng, sep)]) for i in range(60)]
        rows.insert(9, "")
        rows.insert(20, sep.join(["long", '"' + "\n".join(["line"] * 90) + '"', ""]))
        (tmp_path / f"p{part}.csv").write_bytes((("﻿" if part == 1 else "") + "\n".join(rows) + "\n" * (part % 2)).encode())
    got, want = both(spark, tmp_path, sep)
    assert got == want and len(got) > 150
    assert records._lines(spark, str(tmp_path)).rdd.getNumPartitions() > 20


def test_windows_line_ends_and_odd_files(spark, small_ranges, tmp_path):
    files = {
        "crlf": 'a,b\r\n1,"x\r\ny"\r\n2,z\r\n', "header": '"a\nb",c\n1,2\n', "only": "a,b\n", "short": "a,b\n1\n1,2,3\n", "late": 'a,b\n"x"y,2\n"p" ,3\n', "quotes": 'a,b\n"""",""\n"","""a"""\n', "blank": "a,b\n\n\n1,2\n\n",
    }
    for name, text in files.items():
        (tmp_path / f"{name}.csv").write_bytes(text.encode())
        got, want = both(spark, tmp_path / f"{name}.csv")
        assert got == want, name


def test_a_quote_that_never_closes(spark, small_ranges, tmp_path):
    """The rest of the file is one field, less its last line end."""
    (tmp_path / "open.csv").write_text('a,b\n1,2\n3,"never\nclosed\n' + "x\n" * 100)
    got = sorted(map(tuple, records.read_split(spark, str(tmp_path / "open.csv"), ",").collect()))
    assert got == [("1", "2"), ("3", "never\nclosed\n" + "x\n" * 99 + "x")]


def test_empty_and_missing_cells(spark, tmp_path):
    (tmp_path / "e.csv").write_text('a,b\n1,""\n2,\n"",x\n')
    read = lambda **more: sorted(map(str, map(tuple, readers.read_csv(spark, str(tmp_path / "e.csv"), **more).collect())))
    assert read() == sorted(map(str, [("1", None), ("2", None), (None, "x")]))
    assert read(keep_empty=True) == read(keep_empty=True, multi_line=False) == sorted(map(str, [("1", ""), ("2", None), ("", "x")]))


def test_states_of_lines():
    for line, plain, inside in [("a,b", False, True), ('a,"b', True, False), ('"', True, False), ('""', False, True), ('x"y', False, False), ('","', False, True), ('a"",b', False, True), ('","x","', True, True), ('"a""', True, False), ("", False, True)]:
        assert (records.quoted_after(line, False, ","), records.quoted_after(line, True, ",")) == (plain, inside), line
