import datetime as dt
import hashlib

import pytest

from prematch import schema
from prematch.sources import manifest, tables, xlsx


def test_csv_tokens_and_missing(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('x,y\n1,"a\nb"\nNA,\n')
    rows = tables.read_csv(spark, str(path), multiline=True).collect()
    assert [(r.x, r.y) for r in rows] == [("1", "a\nb"), (None, None)]
    with pytest.raises(FileNotFoundError):
        tables.read_csv(spark, str(tmp_path / "none.csv"))


def test_union_aligns_by_name(spark, tmp_path):
    for year, text in ((2020, "tourney_id,match_num,tourney_date,winner_id,loser_id\nt,1,20200101,w,l\n"), (2021, "match_num,tourney_id,tourney_date,winner_id,loser_id,extra\n2,u,20210101,a,b,z\n"), (2022, "<!DOCTYPE html>\n"), (2023, "x\n1\n")):
        (tmp_path / f"atp_matches_{year}.csv").write_text(text)
    got, skipped = tables.history_years(spark, str(tmp_path), 2019, 2023)
    assert {(r.match_num, r.tourney_id, r.extra) for r in got.collect()} == {("1", "t", None), ("2", "u", "z")} and len(skipped) == 3


def test_sniffing(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a;b\n1;2\n3;4\n")
    (tmp_path / "b.tsv").write_text("a\tb\n")
    (tmp_path / "c.txt").write_text("one\ntwo\n")
    assert [tables.sniff_separator(str(tmp_path / n)) for n in ("a.csv", "b.tsv", "c.txt")] == [";", "\t", ","]


def test_ragged(spark, tmp_path):
    (tmp_path / "r.txt").write_text("a,b,c\n1\n1,2,3,4\n")
    assert [tuple(r) for r in tables.ragged_rows(spark, str(tmp_path / "r.txt"), 3).collect()] == [("a", "b", "c"), ("1", "", ""), ("1", "2", "3,4")]


def test_paging(spark):
    df = spark.range(10)
    assert [r.id for r in tables.page(df, 8, 5, ["id"]).collect()] == [8, 9]
    assert [r.id for r in tables.page(df, 99, 5, ["id"]).collect()] == [9]
    assert (tables.next_offset(0, 4, 10), tables.next_offset(8, 4, 10), tables.previous_offset(2, 4), tables.line_offset(0, 10), tables.line_offset(99, 10)) == (4, 6, 0, 0, 9)


def test_xlsx_and_merge(spark, tmp_path):
    head = ["ATP", "Location ", "Date", "Winner", None, "Empty"]
    xlsx.write_xlsx(str(tmp_path / "2021.xlsx"), [head, [1, "Rome", dt.date(2021, 5, 3), "A B.", "z", None], [2, None, dt.date(2021, 5, 4), "C & D.", None, None]])
    xlsx.write_xlsx(str(tmp_path / "2020.xlsx"), [["Winner", "ATP"], ["E F.", 7.5]])
    rows = xlsx.read_xlsx(spark, str(tmp_path / "2021.xlsx"))
    assert rows.columns == ["ATP", "Location ", "Date", "Winner", "column_4", "Empty"]
    merged = tables.yearly_workbooks(spark, str(tmp_path))
    assert merged.columns == schema.RAW_COLUMNS
    assert [(r.source_year, r.ATP, r.Date, r.Winner, r.Location) for r in merged.orderBy("source_year", "ATP").collect()] == [("2020", "7.5", None, "E F.", None), ("2021", "1", "2021-05-03", "A B.", "Rome"), ("2021", "2", "2021-05-04", "C & D.", None)]
    with pytest.raises(ValueError):
        xlsx.read_xlsx(spark, "old.xls")


def test_manifest(spark, tmp_path):
    (tmp_path / "2021.xlsx").write_bytes(b"abc")
    rows = manifest.manifest(spark, str(tmp_path), 2020, 2021, url="http://x/{year}").orderBy("year").collect()
    assert [(r.exists_locally, r.file_size_bytes, r.sha256) for r in rows] == [(False, None, None), (True, 3, hashlib.sha256(b"abc").hexdigest())]
    assert rows[1].source_url == "http://x/2021"
    with pytest.raises(ValueError):
        manifest.manifest(spark, str(tmp_path), 2021, 2020)


def test_files(spark, tmp_path):
    (tmp_path / ".git").mkdir()
    (tmp_path / ".git" / "x.csv").write_text("a\n")
    (tmp_path / "B.csv").write_text("a\n1\n")
    (tmp_path / "a.CSV").write_text("a\n1\n")
    assert [p.rsplit("/", 1)[1] for p in tables.find_files(str(tmp_path))] == ["a.CSV", "B.csv"]
    assert tables.first_existing([str(tmp_path / "no"), str(tmp_path / "B.csv")]).endswith("B.csv")
    df = tables.read_any(spark, str(tmp_path / "B.csv"))
    tables.write_csv(df, str(tmp_path / "out" / "one.csv"), single=True)
    assert (tmp_path / "out" / "one.csv").read_text() == "a\n1\n"
    assert tables.peek(df) == {"rows": 1, "columns": ["a"], "head": [{"a": "1"}]}
    tables.download((tmp_path / "B.csv").as_uri(), str(tmp_path / "copy" / "c.csv"))
    assert (tmp_path / "copy" / "c.csv").read_text() == "a\n1\n"
    tables.write_json({"a": 1}, str(tmp_path / "m.json"))
    assert tables.read_json(str(tmp_path / "m.json")) == {"a": 1}


def test_other_stores(spark, tmp_path):
    """Every source works on paths that only Hadoop's file systems understand."""
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.sources.link./in", tmp_path.as_uri())
    top = "viewfs://sources/in"
    (tmp_path / "past").mkdir()
    (tmp_path / "past" / "atp_matches_2020.csv").write_text("tourney_id,match_num,tourney_date,winner_id,loser_id\nt,1,20200101,w,l\n")
    (tmp_path / "past" / "atp_matches_2021.csv").write_text("<html>\n")
    rows, skipped = tables.history_years(spark, f"{top}/past", 2019, 2021)
    assert [r.winner_id for r in rows.collect()] == ["w"] and len(skipped) == 2
    xlsx.write_xlsx(str(tmp_path / "2020.xlsx"), [["Winner", "ATP"], ["E F.", 7.5]])
    assert [r.Winner for r in tables.yearly_workbooks(spark, top).collect()] == ["E F."]
    (tmp_path / "s.csv").write_text("a;b\n1;2\n3;4\n")
    assert tables.sniff_separator(f"{top}/s.csv") == ";" and tables.first_existing([f"{top}/no", f"{top}/s.csv"]) == f"{top}/s.csv"
    assert [p.rsplit("/", 1)[1] for p in tables.find_files(top)] == ["2020.xlsx", "atp_matches_2020.csv", "atp_matches_2021.csv", "s.csv"]
    tables.write_csv(tables.read_any(spark, f"{top}/s.csv"), f"{top}/out/one.csv", single=True)
    assert (tmp_path / "out" / "one.csv").read_text() == "a,b\n1,2\n3,4\n"
    tables.write_json({"a": 1}, f"{top}/m.json")
    assert tables.read_json(f"{top}/m.json") == {"a": 1}
