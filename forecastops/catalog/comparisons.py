"""Profiles and two-year comparisons. The stand-in history has full years 1996 and 2000."""

from __future__ import annotations

from forecastops.catalog.registry import query
from forecastops.catalog.tables import history_hourly, rounded
from forecastops.operators import compare as c

BASE, TARGET = 1996, 2000

PAIR = f"""pair AS (SELECT facility, ts, total_vehicles, CAST(year(ts) AS INT) AS year, CAST(month(ts) AS INT) AS month,
  CAST(date_trunc('week', ts) AS DATE) AS week, CASE WHEN isodow(ts) >= 6 THEN 'Weekend' ELSE 'Weekday' END AS day_type, CAST(hour(ts) AS INT) AS hour
  FROM history_hourly WHERE year(ts) IN ({BASE}, {TARGET}))"""


def pair(spark, d):
    rows = history_hourly(spark, d)
    return c.year_pair(rows, rows, BASE, TARGET)


def cube(spark, d, keys=c.CUBE_KEYS):
    return c.calendar_cube(pair(spark, d), keys=keys)


@query("profile_holiday_flag", """SELECT facility, week, ROUND(mean_value, 4) AS mean_value,
  CASE WHEN make_date(year(week), 12, 25) BETWEEN week AND week + 6 OR make_date(year(week + 6), 1, 1) BETWEEN week AND week + 6 THEN 1 ELSE 0 END AS holiday_week
FROM (SELECT facility, CAST(date_trunc('week', ts) AS DATE) AS week, AVG(total_vehicles) AS mean_value FROM history_hourly GROUP BY 1, 2)""")
def profile_holiday_flag(spark, d):
    return rounded(c.mark_holidays(c.profile(history_hourly(spark, d), "week")), ["mean_value"])


YEARLY = f"""yr AS (SELECT facility, AVG(CASE WHEN year = {BASE} THEN total_vehicles END) AS avg_base, AVG(CASE WHEN year = {TARGET} THEN total_vehicles END) AS avg_target
  FROM pair GROUP BY facility),
yearly AS (SELECT facility, ROUND(avg_base, 4) AS avg_base, ROUND(avg_target, 4) AS avg_target, round_even((avg_target - avg_base) / avg_base * 100, 2) AS percent_change
  FROM yr WHERE avg_base IS NOT NULL AND avg_target IS NOT NULL)"""
TREND = "CASE WHEN percent_change > 1 THEN 'Increase' WHEN percent_change < -1 THEN 'Decrease' ELSE 'No Significant Change' END AS trend"


@query("cmp_yearly", f"WITH {PAIR}, {YEARLY} SELECT *, {TREND} FROM yearly")
def cmp_yearly(spark, d):
    return rounded(c.year_change(cube(spark, d, ["facility", "year"]), BASE, TARGET), ["avg_base", "avg_target"])


@query("cmp_monthly", f"WITH {PAIR} SELECT facility, year, month, ROUND(AVG(total_vehicles), 4) AS mean_value FROM pair GROUP BY 1, 2, 3")
def cmp_monthly(spark, d):
    keys = ["facility", "year", "month"]
    return rounded(c.cube_mean(cube(spark, d, keys), keys), ["mean_value"])


@query("cmp_weekly", f"WITH {PAIR} SELECT facility, year, week, ROUND(AVG(total_vehicles), 4) AS mean_value FROM pair GROUP BY 1, 2, 3")
def cmp_weekly(spark, d):
    keys = ["facility", "year", "week"]
    return rounded(c.cube_mean(cube(spark, d, keys), keys), ["mean_value"])


@query("cmp_hourly", f"WITH {PAIR} SELECT facility, year, day_type, hour, ROUND(AVG(total_vehicles), 4) AS mean_value FROM pair GROUP BY 1, 2, 3, 4")
def cmp_hourly(spark, d):
    keys = ["facility", "year", "day_type", "hour"]
    return rounded(c.cube_mean(cube(spark, d, keys), keys), ["mean_value"])


SUMMER = f"""mo AS (SELECT facility, year, month, AVG(total_vehicles) AS v FROM pair WHERE month IN (6, 7, 8) GROUP BY 1, 2, 3),
su AS (SELECT facility, AVG(CASE WHEN year = {BASE} THEN v END) AS summer_base, AVG(CASE WHEN year = {TARGET} THEN v END) AS summer_target FROM mo GROUP BY 1),
summer AS (SELECT facility, ROUND(summer_base, 4) AS summer_base, ROUND(summer_target, 4) AS summer_target, ROUND((summer_target - summer_base) / summer_base * 100, 4) AS summer_change,
  CASE WHEN summer_target > summer_base THEN 'Increase' WHEN summer_target < summer_base THEN 'Decrease' ELSE '-' END AS summer_trend
  FROM su WHERE summer_base IS NOT NULL AND summer_target IS NOT NULL)"""


@query("cmp_summer", f"WITH {PAIR}, {SUMMER} SELECT * FROM summer")
def cmp_summer(spark, d):
    return rounded(c.summer_change(cube(spark, d, ["facility", "year", "month"]), BASE, TARGET), ["summer_base", "summer_target", "summer_change"])


RUSH = f"""hr AS (SELECT facility, year, hour, AVG(total_vehicles) AS v FROM pair WHERE day_type = 'Weekday' GROUP BY 1, 2, 3),
ru AS (SELECT facility, MAX(CASE WHEN year = {BASE} THEN v END) AS rush_base, MAX(CASE WHEN year = {TARGET} THEN v END) AS rush_target FROM hr GROUP BY 1),
rc AS (SELECT *, (rush_target - rush_base) / rush_base * 100 AS ch FROM ru WHERE rush_base IS NOT NULL AND rush_target IS NOT NULL),
rush AS (SELECT facility, ROUND(rush_base, 4) AS rush_base, ROUND(rush_target, 4) AS rush_target, ROUND(ch, 4) AS rush_change,
  CASE WHEN abs(ch) < 5 THEN 'Flattened' WHEN ch > 5 THEN 'Sharpened' ELSE 'Reduced' END AS rush_trend FROM rc)"""


@query("cmp_rush_hour", f"WITH {PAIR}, {RUSH} SELECT * FROM rush")
def cmp_rush_hour(spark, d):
    out = c.rush_hour_change(cube(spark, d, ["facility", "year", "day_type", "hour"]), BASE, TARGET)
    return rounded(out, ["rush_base", "rush_target", "rush_change"])


@query("cmp_summary", f"""WITH {PAIR}, {YEARLY}, {SUMMER}, {RUSH}
SELECT y.*, {TREND}, s.* EXCLUDE (facility), r.* EXCLUDE (facility) FROM yearly y LEFT JOIN summer s ON s.facility = y.facility LEFT JOIN rush r ON r.facility = y.facility""")
def cmp_summary(spark, d):
    out = c.recovery_summary(cube(spark, d), BASE, TARGET)
    return rounded(out, ["avg_base", "avg_target", "summer_base", "summer_target", "summer_change", "rush_base", "rush_target", "rush_change"])
