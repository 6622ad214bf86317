"""Cleaning tasks refuse half-declared parameters; phones of any length stay whole."""
import pytest
from pyspark.sql import functions as F

from scrubjay.operators import standardize as S
from scrubjay.plans import clean as C
from scrubjay.plans.clean import run_task


def test_fuzzy_mode_needs_its_field(spark):
    with pytest.raises(ValueError):
        run_task(spark.range(3), "deduplication", mode="fuzzy")


def test_long_digit_strings_are_not_cut(spark):
    df = spark.createDataFrame([("1" + "2" * 20_000,)], "p string")
    area, number = S.phone_parts(F.col("p"), F.lit("1"), F.lit(10), F.lit(7))
    got = df.select(area.alias("a"), number.alias("n")).first()
    assert (len(got["a"]), len(got["n"])) == (19_993, 7)


def test_custom_arrow_counts_in_one_pass(spark):
    def odd_rows(batches):
        import pyarrow.compute as pc
        for b in batches:
            b = b.filter(pc.equal(pc.bit_wise_and(b.column("id"), 1), 1))
            yield b.append_column("__flagged__", pc.equal(b.column("id"), 7))

    res = C.apply_custom_arrow(spark.range(0, 100, 1, 5), odd_rows, "id long, __flagged__ boolean", max_row_reduction=0.4)
    row = res.audit.first()
    assert (row["rows_before"], row["rows_after"], row["flagged_record_count"], row["row_delta_rate"]) == (100, 50, 1, -0.5)
    assert res.status == "human_review" and [r["id"] for r in res.flagged.collect()] == [7] and res.clean.count() == 49
    assert res.output.columns == ["id", "__flagged__", "__flag_reason__"]

    def same(batches):
        yield from batches

    for empty in (spark.range(0), spark.range(5).filter("id > 9")):
        row = C.apply_custom_arrow(empty, same, "id long").audit.first()
        assert (row["rows_before"], row["rows_after"], row["flagged_record_count"], row["circuit_breaker_hit"]) == (0, 0, 0, False)


def test_declared_formats(spark):
    rows = [(1, "2024-03-05", "(010) 12345678", "12-34", "$1,200.50"), (2, "junk", "12", "no", "free"), (3, None, None, None, None)]
    df = spark.createDataFrame(rows, "id long, day string, phone string, zip string, price string")
    rules = [{"field": "day", "target_format": "%d/%m/%Y"}, {"field": "phone", "target_format": "{area}/{number}"},
             {"field": "zip", "target_format": "postal"}, {"field": "price", "target_format": "money"}]
    got = {r["id"]: r for r in C.clean(df, "format_standardization", field_rules=rules).output.collect()}
    assert (got[1]["day"], got[1]["phone"], got[1]["zip"], str(got[1]["price"])) == ("05/03/2024", "10/12345678", "001234", "1200.50")
    assert got[2]["__flagged__"] and not got[1]["__flagged__"] and not got[3]["__flagged__"]
    assert [got[2][c] for c in ("day", "phone", "zip", "price")] == [None] * 4
    for bad in ([{"field": "day", "target_format": "iso"}], [{"field": "none", "target_format": "%Y"}], [rules[0], rules[0]]):
        with pytest.raises(ValueError):
            run_task(df, "format_standardization", field_rules=bad)
