"""Quoted line breaks in files that are read in many ranges."""

import codecs
import csv
import io
import random

import pytest

from shopledger.sources import readers, records


def cells(draw, sep):
    parts = ["", "plain", "  padded ", 'says "so"', "two\nlines", "a\r\nb", f"x{sep}y", '"', "é 数", 'tail"\n', "\n\n\n", "=1+1", "5\" pipe"]
    return [draw.choice(parts) for _ in range(3)]


def text_of(rows, sep, end, quoting=csv.QUOTE_MINIMAL):
    out = io.StringIO()
    csv.writer(out, delimiter=sep, lineterminator=end, quoting=quoting).writerows([["a", "b", "c"], *rows])
    return out.getvalue()


@pytest.fixture
def small_ranges(spark):
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {k: spark.conf.get(k) for k in keys}
    spark.conf.set(keys[0], "97")
    spark.conf.set(keys[1], "1")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize(("sep", "end", "encoding"), [(",", "\n", "utf-8-sig"), (";", "\r\n", "cp1252"), ("|", "\n", "gb18030"), ("\t", "\r\n", "utf-8-sig")])
def test_ranges_give_the_rows_of_the_whole_file(spark, tmp_path, small_ranges, sep, end, encoding):
    draw, want = random.Random(sep), []
    for k in range(3):
        rows = [cells(draw, sep) for _ in range(150)] + [["long", "x\n" * 400, "end"], ["last", "", "row"]]
        if encoding == "cp1252":
            rows = [[c.replace("数", "ü") for c in r] for r in rows]
        want += rows
        body = text_of(rows, sep, end).encode("utf-8" if encoding == "utf-8-sig" else encoding)
        (tmp_path / f"{k}.csv").write_bytes((codecs.BOM_UTF8 if encoding == "utf-8-sig" and k else b"") + body)
    df = readers.read_csv(spark, str(tmp_path), ["a", "b", "c"], encoding, sep, multi_line=True)
    assert records.lines_of(spark, str(tmp_path)).rdd.getNumPartitions() > 50
    assert sorted(map(tuple, df.collect())) == sorted(map(tuple, want))
    assert df.select("b").filter("b = ''").count() == sum(r[1] == "" for r in want)


def test_many_ranges_inside_fields(spark, tmp_path, small_ranges, monkeypatch):
    monkeypatch.setattr(records, "SENT", 2)
    rows = [["k", "line\n" * 60 + str(i), "v"] for i in range(40)]
    (tmp_path / "t.csv").write_bytes(text_of(rows, ",", "\n").encode())
    df = readers.read_csv(spark, str(tmp_path / "t.csv"), ["a", "b", "c"], multi_line=True)
    assert sorted(map(tuple, df.collect())) == sorted(map(tuple, rows))


def test_an_unquoted_quote_is_a_character(spark, tmp_path, small_ranges):
    body = "a,b\n" + "".join(f'{k}" pipe,"{k}\nx"\n' for k in range(60)) + "\n"
    (tmp_path / "t.csv").write_text(body)
    got = readers.read_csv(spark, str(tmp_path / "t.csv"), ["a", "b"], multi_line=True).collect()
    assert sorted(map(tuple, got)) == sorted((f'{k}" pipe', f"{k}\nx") for k in range(60))


@pytest.mark.parametrize("body", ["a,b\n1\n", "a,b\n1,2,3\n", 'a,b\n1,"x\n', 'a,b\n1,"x"y\n', "a,c\n1,2\n", 'a,b\n"1\n2"\n', b"a,b\n1,\xff\n"])
def test_faulty_files_fail(spark, tmp_path, body):
    (tmp_path / "t.csv").write_bytes(body if isinstance(body, bytes) else body.encode())
    with pytest.raises(Exception, match=r"cells|quotes|quote|header|decode|codec"):
        readers.read_csv(spark, str(tmp_path / "t.csv"), ["a", "b"], multi_line=True).collect()


def test_a_header_alone(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b\n")
    assert readers.read_csv(spark, str(tmp_path / "t.csv"), ["a", "b"], multi_line=True).count() == 0
