"""Sources, sinks and text helpers."""
import pytest
from pyspark.sql import functions as F

from scrubjay.functions import dates
from scrubjay.functions.text import extract_tagged, keyword_fallback, strip_code_fence
from scrubjay.sources import io


def test_read_missing_path(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        io.read_table(spark, str(tmp_path / "nope.parquet"))


def test_unsupported_suffix(spark, tmp_path):
    p = tmp_path / "x.xlsx"
    p.write_text("a")
    with pytest.raises(ValueError):
        io.read_table(spark, str(p))


def test_suffix_is_case_insensitive():
    assert io.detect_format("/a/B.PARQUET") == "parquet" and io.detect_format("x.Csv") == "csv"


def test_csv_bad_cell_becomes_null(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_text("a,b\n1,2\nx,3\n")
    rows = io.read_table(spark, str(p), schema="a int, b int").orderBy("b").collect()
    assert [(r["a"], r["b"]) for r in rows] == [(1, 2), (None, 3)]


def test_strptime_translation():
    assert dates.to_spark_pattern("%Y-%m-%d") == "yyyy-MM-dd"
    assert dates.to_spark_pattern("%d-%b-%Y", lenient=True) == "d-MMM-yyyy"
    assert dates.to_spark_pattern("%Y%m%d", lenient=True) == "yyyyMMdd"


def test_tagged_lines_and_fences(spark):
    df = spark.createDataFrame([("x\nTASK: Deduplication\n  TASK: type_coercion",), ("run entity_resolution now",),
                                ("```python\nprint(1)\n```",), ("```\nonly",)], "t string")
    r = df.select(extract_tagged(F.col("t")).alias("a"), keyword_fallback(F.col("t"), ["entity_resolution"]).alias("b"),
                  strip_code_fence(F.col("t")).alias("c")).collect()
    assert r[0]["a"] == ["deduplication", "type_coercion"]
    assert r[1]["b"] == ["entity_resolution"]
    assert r[2]["c"] == "print(1)" and r[3]["c"] == "only"


def test_csv_bad_rows_are_kept_and_flagged(spark, tmp_path):
    from scrubjay.sources import io
    path = str(tmp_path / "t.csv")
    (tmp_path / "t.csv").write_text('id,name,size\n1,"two\nlines, ""quoted""",5\nx,  blanks ,6\n3,short\n4,a,7,extra\n5,,oops\n6,é,8\n', encoding="utf-8")
    rows = io.read_csv_flagged(spark, path, "id int, name string, size int").collect()
    got = [(r["id"], r["name"], r["size"], r["__flagged__"], r["__flag_reason__"]) for r in rows]
    assert got[0] == (1, 'two\nlines, "quoted"', 5, False, None) and got[-1] == (6, "é", 8, False, None)
    assert got[1][:4] == (None, "  blanks ", 6, True) and got[4][:4] == (5, None, None, True)
    assert [g[4] for g in got[1:5]] == ["csv_parse"] * 4 and len(got) == 6
    assert [r["__corrupt_record"] is not None for r in rows] == [False, True, True, True, True, False]
    only = io.read_csv_flagged(spark, path, "id int, name string, size int").filter("__flagged__").count()
    assert only == 4  # judged whatever is selected
    odd = spark.createDataFrame([(1, " a\r\nb\\ "), (2, ""), (3, None), (4, 'q"')], "id int, t string")
    io.write_csv_plain(odd, str(tmp_path / "odd.csv"))
    back = io.read_csv_flagged(spark, str(tmp_path / "odd.csv"), "id int, t string")
    assert sorted((r["id"], r["t"], r["__flagged__"]) for r in back.collect()) == [(i, t, False) for i, t in [(1, " a\r\nb\\ "), (2, None), (3, None), (4, 'q"')]]
