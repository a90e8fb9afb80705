"""Archives as a data source: parsing, checksums, pruning by name, and one reading of each."""

import hashlib
import io
import json
import os
import shutil
import zipfile

import pytest

from barloom.sources import archives, files, klines
from barloom.sources.archive_source import parse_member, period_of, read_archives

HEAD = "open_time,open,high,low,close,volume,close_time,quote_volume"


def put(root, name, members, checksum=True):
    """An archive of CSV members, each a list of lines."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for member, lines in members.items():
            z.writestr(member, "\n".join(lines))
    folder = os.path.join(root, "S", "monthly")
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "wb") as f:
        f.write(out.getvalue())
    if checksum:
        with open(os.path.join(folder, name + ".CHECKSUM"), "w") as f:
            f.write(f"{hashlib.sha256(out.getvalue()).hexdigest()}  {name}\n")
    return os.path.join(folder, name)


def bar(k, price=100.0, millis=True):
    at = 1704067200 + 1800 * k
    return f"{at * 1000 if millis else at},{price},{price + 1},{price - 1},{price + 0.5},0,{at * 1000 + 1799999 if millis else at + 1799.999},0"


def test_rows_equal_those_of_the_line_parser(spark, tmp_path):
    root = str(tmp_path)
    put(root, "S-30m-2024-01.zip", {"a.csv": [HEAD, *(bar(k) for k in range(3)), "", " , ,"], "b.CSV": [bar(k, millis=False) for k in range(5)], "note.txt": ["x"]})
    put(root, "S-30m-2024-02.zip", {"c.csv": ["2024-02-01T00:00:00Z,1,2,0.5,1.5,2024-02-01T00:29:59.999Z"], "d.csv": ["Close Time,Open Time,LOW,high,open,close", "1706747399999,1706745600000,1,4,2,3", "x,y,1,4,two,3"], "e.csv": []})
    got = read_archives(spark, root)
    names = ["open_time", "open", "high", "low", "close", "close_time"]
    want = klines.parse_lines(archives.zip_lines(spark, root))
    key = lambda r: tuple(map(repr, r))
    assert sorted((tuple(r) for r in got.select("member", *names).collect()), key=key) == sorted((tuple(r) for r in want.select("member", *names).collect()), key=key)
    assert {r.member: r.n for r in got.groupBy("member").agg({"row": "max"}).toDF("member", "n").collect()} == {"a.csv": 2, "b.CSV": 4, "c.csv": 0, "d.csv": 1}


def test_checksums_are_held_against_what_is_read(spark, tmp_path):
    root = str(tmp_path)
    path = put(root, "S-30m-2024-01.zip", {"a.csv": [bar(0)]})
    lone = put(root, "S-30m-2024-03.zip", {"a.csv": [bar(9)]}, checksum=False)
    assert read_archives(spark, root, checksum="if_present").count() == 2
    with pytest.raises(Exception, match="has no checksum"):
        read_archives(spark, root).count()
    os.remove(lone)
    with open(path + ".CHECKSUM", "w") as f:
        f.write("0" * 64)
    with pytest.raises(Exception, match="does not match its checksum"):
        read_archives(spark, root).count()


def test_archives_outside_the_dates_are_not_touched(spark, tmp_path):
    root = str(tmp_path)
    put(root, "S-30m-2024-01.zip", {"a.csv": [bar(0)]})
    for name in ("S-30m-2023-11.zip", "S-30m-2024-03.zip", "S-30m-2024-02-09.zip"):
        with open(put(root, name, {}), "wb") as f:
            f.write(b"no archive at all")
    assert read_archives(spark, root, "2024-01-01", "2024-01-31").count() == 1
    with pytest.raises(Exception, match="checksum"):
        read_archives(spark, root, "2024-01-01", "2024-03-01").count()
    assert str(period_of("S-30m-2024-02.zip")[1]) == "2024-02-29" and period_of("S.zip") is None


def test_prepare_reads_archives_once_and_reports(spark, tmp_path, monkeypatch):
    root, target = str(tmp_path / "raw"), str(tmp_path / "bars")
    put(root, "S-30m-2024-01.zip", {"a.csv": [HEAD, *(bar(k) for k in range(10))], "b.csv": [bar(9), *(bar(k) for k in range(12, 20))]})
    real = klines.bars_ops.merge

    def merge(df, *more):
        shutil.rmtree(root)  # whatever comes later can't read an archive again
        return real(df, *more)

    monkeypatch.setattr(klines.bars_ops, "merge", merge)
    assert klines.prepare(spark, root, "S", 30, "2024-01-01", "2024-01-31", target, source={"market": "index"}) == 1
    assert spark.read.parquet(target).count() == 18
    report = json.loads(files.read_text(spark, target + ".report.json"))
    assert (report["rows"], report["duplicate_count"], report["gap_count"], report["missing_bars"]) == (18, 1, 1, 2)
    assert report["archives"] == ["S-30m-2024-01.zip"] and report["market"] == "index" and report["data_preflight"]["passed"]
    assert report["gap_ranges"][0]["missing_bars"] == 2 and report["last_close_time"].startswith("2024-01-01 09:59:59.999")


def test_prepare_refuses_cells_it_cannot_read(spark, tmp_path):
    put(str(tmp_path / "raw"), "S-30m-2024-01.zip", {"a.csv": [bar(0), bar(1).replace("100.5", "oops")]})
    with pytest.raises(ValueError, match="cannot be read"):
        klines.prepare(spark, str(tmp_path / "raw"), "S", 30, "2024-01-01", "2024-01-31", str(tmp_path / "bars"))
    with pytest.raises(ValueError, match="no bar"):
        put(str(tmp_path / "other"), "S-30m-2024-01.zip", {"a.csv": [bar(0)]})
        klines.prepare(spark, str(tmp_path / "other"), "S", 30, "2024-02-01", "2024-02-28", str(tmp_path / "bars"))
    assert not (tmp_path / "bars").exists()
    assert len(parse_member(b"")) == 0 and parse_member(b"1,2\n").isna().sum().sum() == 4


def test_small_files(spark, tmp_path):
    at = str(tmp_path / "deep" / "x.json")
    files.write_text(spark, at, "é")
    assert files.read_text(spark, at) == "é" and files.exists(spark, at) and files.names(spark, str(tmp_path)) == ["deep/x.json"]
    with pytest.raises(FileExistsError):
        files.write_text(spark, at, "other")
    files.write_text(spark, at, "other", overwrite=True)
    assert files.read_text(spark, at) == "other"
    files.delete(spark, at)
    assert not files.exists(spark, at)
