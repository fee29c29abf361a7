from datetime import date, datetime

from pyspark.sql import functions as F

from forecastops import functions as fn


def values(df, column):
    return [r[0] for r in df.select(column).collect()]


def test_hhmm(spark):
    raw = ["930", "2359", "2400", "1075", "12.7", "x", None, "0", "NaN", "12345"]
    df = spark.createDataFrame([(v, date(2024, 1, 31)) for v in raw], "t string, d date").coalesce(1)
    assert values(df, fn.hhmm_text("t")) == ["09:30", "23:59", "24:00", "10:75", "00:12", None, None, "00:00", None, "12:345"]
    assert values(df, fn.hhmm_hour("t")) == [9, 23, None, None, 0, None, None, 0, None, None]
    assert values(df, fn.at_time("d", "t"))[:3] == [datetime(2024, 1, 31, 9, 30), datetime(2024, 1, 31, 23, 59), None]


def test_safe_casts(spark):
    df = spark.createDataFrame([("12",), ("12.7",), ("n/a",), ("",), (None,), ("NaN",)], "c string").coalesce(1)
    assert values(df, fn.to_count("c")) == [12, None, None, None, None, None]
    assert values(df, fn.to_number("c")) == [12.0, 12.7, None, None, None, None]


def test_months(spark):
    df = spark.createDataFrame([("2023-05",), ("2023-13",), ("abc",), (None,), ("2023-05-17",)], "c string").coalesce(1)
    assert values(df, fn.valid_month_text("c")) == ["2023-05", None, None, None, "2023-05"]
    assert values(df, fn.month_start_of_text("c")) == [date(2023, 5, 1), None, None, None, date(2023, 5, 1)]
    parts = spark.createDataFrame([(2023, 2), (2023, 13), (None, 1), (0, 1)], "y int, m int").coalesce(1)
    assert values(parts, fn.month_start("y", "m")) == [date(2023, 2, 1), None, None, None]


def test_weeks_and_weekends(spark):
    df = spark.createDataFrame([(date(2024, 1, 1),), (date(2024, 1, 6),), (date(2024, 1, 7),), (None,)], "d date").coalesce(1)
    assert values(df, fn.weekday_monday0("d")) == [0, 5, 6, None]
    assert values(df, fn.week_bucket("d")) == [date(2024, 1, 1)] * 3 + [None]
    assert values(df, fn.is_weekend("d")) == [0, 1, 1, 0]
    assert values(df, fn.day_type("d")) == ["Weekday", "Weekend", "Weekend", "Weekday"]


def test_numbers(spark):
    df = spark.createDataFrame([(1.0, None), (None, None), (0.0, 4.0), (float("nan"), 3.0)], "a double, b double").coalesce(1)
    assert values(df, fn.row_total([fn.nan_to_null("a"), "b"])) == [1.0, 0.0, 4.0, 3.0]
    assert values(df, fn.row_total_strict([fn.nan_to_null("a"), "b"])) == [None, None, 4.0, None]
    assert values(df, fn.zero_to_null("a"))[2] is None
    assert values(df, fn.percent_change("a", "b"))[2] is None
    assert values(df, fn.clip("b", 3.5, 3.8)) == [None, None, 3.8, 3.5]
    halves = spark.createDataFrame([(0.5,), (1.5,), (2.5,)], "x double").coalesce(1)
    assert values(halves, fn.half_even("x")) == [0.0, 2.0, 2.0]


def test_trend_band_is_open(spark):
    df = spark.createDataFrame([(1.0,), (1.01,), (-1.0,), (-1.01,)], "c double").coalesce(1)
    assert values(df, fn.trend_label("c")) == ["No Significant Change", "Increase", "No Significant Change", "Decrease"]


def test_noise_depends_on_the_key_only(spark):
    df = spark.range(5000)
    draw = fn.keyed_normal(F.lit("7"), F.col("id")).alias("z")
    one, many = df.coalesce(1).select("id", draw), df.repartition(13).select("id", draw)
    assert one.exceptAll(many).count() == 0
    mean, std = one.agg(F.avg("z"), F.stddev("z")).first()
    assert abs(mean) < 0.05 and abs(std - 1) < 0.05


def test_year_range_reaches_the_scan(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").filter(fn.year_range("o_orderdate", 1996, 1997))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderdate" in plan
