"""The parallel reader of delimited text: chunks cut anywhere give the rows that one pass over the whole text gives."""

import pytest

from loadlens.sources import delimited
from loadlens.sources.delimited import read_capture, read_delimited, rows_of

SPLIT = "spark.sql.files.maxPartitionBytes"


def whole(text, separator=","):
    """A pass over the text by characters."""
    rows, row, cell, quoted, i = [], [], "", False, 0
    while i < len(text):
        c = text[i]
        if c == '"':
            if quoted and text[i + 1 : i + 2] == '"':
                cell, i = cell + '"', i + 1
            else:
                quoted = not quoted
        elif quoted or c not in (separator, "\r", "\n"):
            cell += c
        elif c == separator:
            row, cell = [*row, cell], ""
        else:
            i += c == "\r" and text[i + 1 : i + 2] == "\n"
            rows, row, cell = [*rows, [*row, cell]], [], ""
        i += 1
    return [r for r in [*rows, [*row, cell]] if any(r)]


def read(spark, path, bytes_):
    before = spark.conf.get(SPLIT)
    spark.conf.set(SPLIT, bytes_)
    spark.conf.set("spark.sql.files.openCostInBytes", 0)
    try:
        return [r.cells for r in sorted(read_capture(spark, str(path)).collect(), key=lambda r: (r.path, r.line))]
    finally:
        spark.conf.set(SPLIT, before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


TEXTS = {
    "cells": "a,b,c\n" + "".join(f'{i},"said ""x,{i}""\nand, then\r\n\n{i}",é{i}\r\n' for i in range(400)),
    "one long cell": 'a,b\n1,"' + "line, of text\n" * 600 + '"\n2,"z"\n',
    "quotes anywhere": 'a"b,c\nd"e,""x,"""",y\n""\n,\n\n"u\rv"\rw,x\n',
    "unclosed": 'a,b\n1,2\n3,"never\nclosed,\n4,5',
    "no end": "a,b\r\n1,2\r\n3,4",
    "semicolons": "a;b;c\n" + "".join(f"{i};{i},5;x\n" for i in range(300)),
}


@pytest.mark.parametrize("name", TEXTS)
@pytest.mark.parametrize("size", [97, 1000, 10_000_000])
def test_chunks_give_what_one_pass_gives(spark, tmp_path, name, size):
    text = TEXTS[name]
    if size == 97 and name == "cells":
        text = text[:4000]
    (tmp_path / "f.csv").write_bytes(text.encode())
    assert read(spark, tmp_path, size) == whole(text, ";" if name == "semicolons" else ",")


def test_rows_of_equals_a_pass_by_characters():
    hypothesis = pytest.importorskip("hypothesis")
    given, st = hypothesis.given, hypothesis.strategies

    @given(st.text(alphabet='a",\r\n;', max_size=40))
    def check(text):
        assert [r for r in rows_of(text, ",") if any(r)] == whole(text)

    check()


def test_encodings_marks_and_files_side_by_side(spark, tmp_path):
    text = 'é,"x\ny"\nü,2\n'
    for name, raw in (("a", b"\xef\xbb\xbf" + text.encode()), ("b", b"\xff\xfe" + text.encode("utf-16-le")), ("c", b"\xfe\xff" + text.encode("utf-16-be")), ("d", text.replace(",", "\t").encode()), ("e", b""), ("f", b"\n\n")):
        (tmp_path / f"{name}.csv").write_bytes(raw)
    rows = read_capture(spark, str(tmp_path)).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r.path, r.line)):
        got.setdefault((r.path[-5], r.encoding), []).append(r.cells)
    assert got == {(n, e): [["é", "x\ny"], ["ü", "2"]] for n, e in (("a", "UTF-8"), ("b", "UTF-16LE"), ("c", "UTF-16BE"), ("d", "UTF-8"))}


def test_what_is_too_large_is_reported(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(delimited, "MOST_ROW", 500)
    monkeypatch.setattr(delimited, "MOST_WHOLE", 500)
    (tmp_path / "a.csv").write_text('a,b\n1,"' + "x\n" * 600)
    (tmp_path / "b.csv").write_bytes(b"\xff\xfe" + ("a,b\n" * 200).encode("utf-16-le"))
    rows, problems = read_delimited(spark, str(tmp_path))
    assert [r.cells for r in rows.collect()] == [["a", "b"]]
    assert {(r.path[-5], r.problem.split(" begins")[0].split(" of ")[0]) for r in problems.collect()} == {("a", "a row"), ("b", "a file")}


def test_a_file_is_read_by_many_tasks(spark, tmp_path):
    (tmp_path / "f.csv").write_text(TEXTS["cells"])
    spark.conf.set(SPLIT, 2000)
    try:
        assert delimited._raw(spark, str(tmp_path)).rdd.getNumPartitions() > 5
    finally:
        spark.conf.unset(SPLIT)


def test_rows_of_one_line_are_split_where_they_are(spark, tmp_path):
    (tmp_path / "a.csv").write_text('"a","b,c","d"\n"","","x"\r\n"","",""\n\n",",",",","\n')
    (tmp_path / "b.csv").write_text("a;b\r\n1;2,5\n;\n")
    (tmp_path / "c.csv").write_text('\n' * 100 + "a\tb\n1\t2\n")
    (tmp_path / "d.csv").write_text("".join(f"{i},x\n" for i in range(500)))
    rows = read_capture(spark, str(tmp_path))
    want = {"a": [["a", "b,c", "d"], ["", "", "x"], [",", ",", ","]], "b": [["a", "b"], ["1", "2,5"]], "c": [["a", "b"], ["1", "2"]], "d": [[str(i), "x"] for i in range(500)]}
    got = {n: [r.cells for r in sorted(rows.collect(), key=lambda r: r.line) if r.path[-5] == n] for n in want}
    assert got == want
    assert [r.line for r in rows.where("path like '%c.csv'").orderBy("line").collect()] == [100, 101]
    assert "MapInArrow" not in rows._jdf.queryExecution().toString()
    # one odd line takes the other way alone
    (tmp_path / "d.csv").write_text("".join(f"{i},x\n" for i in range(500)) + 'a"",b\n1,"2""3"\nu\rv,w\n')
    rows = read_capture(spark, str(tmp_path)).where("path like '%d.csv'").orderBy("line").collect()
    assert [r.cells for r in rows] == [[str(i), "x"] for i in range(500)] + [["a", "b"], ["1", '2"3'], ["u"], ["v", "w"]]
