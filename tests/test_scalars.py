import pytest
from pyspark.sql import functions as F

from concord.functions import scalars as fn

NUMBERS = [("001.2300", "1.23"), ("1e3", "1000"), ("-0.0", "0"), ("+7", "7"), (".5", "0.5"), ("5.", "5"), ("-00.10", "-0.1"), ("000", "0"), ("100", "100"), ("NaN", None), ("Infinity", None), ("abc", None), ("", None), (None, None), ("\t 001.2300 \n", "1.23"), ("1" * 42, "1" * 42), ("0." + "1" * 30, "0." + "1" * 30), ("-1e-5", "-0.00001"), ("1e-20", "0." + "0" * 19 + "1"), ("1e25", "1" + "0" * 25), ("-12.50e+3", "-12500"), ("0e99", "0"), ("-0E-5", "0"), ("1.25e1", "12.5"), ("00120e-1", "12"), (".5e2", "50"), ("1e400", "1" + "0" * 400), ("120e99999", "12e100000"), ("1e9999999999999999999", None), (".", None), ("e5", None), ("1e", None)]


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_numbers(spark):
    rows = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(NUMBERS)], "i int, v string").select("i", fn.norm_number(F.col("v")).alias("n")).collect()
    assert {r.i: r.n for r in rows} == {i: b for i, (_, b) in enumerate(NUMBERS)}


def test_doubles(spark):
    rows = [(1e20, "1" + "0" * 20), (1e-19, "0." + "0" * 18 + "1"), (-1.5e22, "-15" + "0" * 21), (0.1, "0.1"), (float("nan"), None), (float("inf"), None)]
    df = spark.createDataFrame(rows, "v double, want string").withColumn("got", fn.norm_number(F.col("v")))
    assert [r.got for r in df.collect()] == [r.want for r in df.collect()]


def test_comparable_forms(spark):
    assert [one(spark, fn.norm_comparable(F.lit(x))) for x in ("1.0", "x", " 2 ")] == ["n:1", "s:x", "n:2"]


def test_sides_of_a_row(spark):
    df = spark.createDataFrame([("push", "L", "R"), ("pull", "L", "R")], "way string, l string, r string")
    source, target = fn.source_and_target(F.col("way"), F.col("l"), F.col("r"))
    assert [tuple(x) for x in df.select(source, target).collect()] == [("L", "R"), ("R", "L")]


def test_keys_of_different_types_are_equal(spark):
    for v, kind in ((F.lit("1"), "string"), (F.lit(1), "int"), (F.lit(True), "boolean"), (F.lit("001"), "string"), (F.lit(1.0).cast("decimal(5,2)"), "decimal(5,2)")):
        assert one(spark, fn.norm_key(v, kind)) == "number:1"
    assert one(spark, fn.norm_key(F.lit("2026-03-17T12:00:00+02:00"))) == "datetime:2026-03-17T10:00:00.000000+00:00"
    assert one(spark, fn.norm_key(F.lit("2026-03-17T12:00"))) == "datetime:2026-03-17T12:00:00.000000"
    assert one(spark, fn.norm_key(F.lit("  "))) == ""
    assert one(spark, fn.norm_key(F.lit(None).cast("string"))) is None


@pytest.mark.parametrize("parts,valid", [([], False), (["a"], True), (["a", None], False), (["a", ""], False)])
def test_valid_keys(spark, parts, valid):
    assert one(spark, fn.valid_key(F.lit(parts).cast("array<string>") if parts else F.array().cast("array<string>"))) is valid


@pytest.mark.parametrize("a,b,same", [("9", "9.0", True), ("2025-12-03T16:33:48", "2025-12-03 16:33:48", True), ("1972-08-21", "1972-08-21 00:00:00", True), (None, "", False), ("x", "X", False)])
def test_differences(spark, a, b, same):
    c = lambda v: fn.norm_diff(F.lit(v).cast("string"))
    assert one(spark, c(a).eqNullSafe(c(b))) is same


def test_effective_modified_and_watermark(spark):
    t = lambda v: F.lit(v).cast("string")
    since = F.lit("2026-03-17 10:00:00").cast("timestamp_ntz")
    assert one(spark, fn.changed_since(fn.effective_modified(t(None), t("2026-03-17 11:00:00")), since)) is True
    assert one(spark, fn.changed_since(fn.effective_modified(t("2026-03-17 09:00:00"), t("2026-03-17 11:00:00")), since)) is False
    assert one(spark, fn.effective_modified(t("not-a-date"), t("2026-03-17 11:00:00"))) is None
    berlin = fn.effective_modified(t("2026-03-17 10:30:00"), t(None), "UTC", "Europe/Berlin")
    assert one(spark, fn.changed_since(berlin, F.lit("2026-03-17 11:00:00").cast("timestamp_ntz"))) is True
    assert one(spark, fn.shift_zone(t("2026-03-17 10:00:00"), "UTC", "Europe/Berlin")) == "2026-03-17 11:00:00"
    assert one(spark, fn.shift_zone(t("soon"), "UTC", "Europe/Berlin")) == "soon"


def test_display(spark):
    assert one(spark, fn.display_key({"name": F.lit("TASK-1")}, {}, F.lit("pk"))) == "name=TASK-1"
    assert one(spark, fn.fit(F.lit("x" * 150))) == "x" * 137 + "..."
    assert one(spark, fn.as_bool(F.lit(" Yes "))) is True
    assert one(spark, fn.positive_int(F.lit("-3"), 7)) == 7


def test_summer_time(spark):
    cases = [("2026-03-29 00:59:59", "2026-03-29 01:59:59"), ("2026-03-29 01:00:00", "2026-03-29 03:00:00"), ("2026-07-01 00:00:00", "2026-07-01 02:00:00"), ("2026-10-25 00:59:59", "2026-10-25 02:59:59"), ("2026-10-25 01:00:00", "2026-10-25 02:00:00"), ("1995-10-01 00:00:00", "1995-10-01 01:00:00")]
    df = spark.createDataFrame(cases, "utc string, berlin string").withColumn("got", fn.shift_zone(F.col("utc"), "UTC", "Europe/Berlin"))
    assert [r.got for r in df.collect()] == [b for _, b in cases]


def test_zones_are_checked_in_summer():
    from concord import registry

    assert not any("WHERE" in registry.oracle_sql()[q] for q in ("zone_conversion", "zone_conversion_all_year"))
