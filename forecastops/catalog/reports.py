"""The fourteen reports; the comparison SQL joins row by row, as the reports are stated."""

from __future__ import annotations

from forecastops.catalog.registry import query
from forecastops.plans import reports as r
from forecastops.sources import standins as t

C6 = t.CARRIERS
W6 = t.WEATHER


def _sums(cols, prefix=""):
    return ", ".join(f"CAST(SUM({prefix}{c}) AS BIGINT) AS {c}" for c in cols)


def _pb_sums():
    return ", ".join(f"CAST(SUM(p.{c}) AS BIGINT) AS passenger_{c}, CAST(SUM(b.{c}) AS BIGINT) AS bus_{c}" for c in C6)


WEATHER_MONTH = ("SELECT CAST(year(date) AS INT) AS year, CAST(month(date) AS INT) AS month, "
                 + ", ".join(f"MAX({c}) AS {c}" for c in W6) + " FROM weather GROUP BY 1, 2")
TERMINAL_MONTH = """SELECT CAST(substring(date,1,4) AS INT) AS year, CAST(substring(date,6,2) AS INT) AS month,
  CAST(SUM(TRY_CAST(buses_count AS BIGINT)) AS BIGINT) AS total_buses,
  CAST(SUM(TRY_CAST(passengers_count AS BIGINT)) AS BIGINT) AS total_passengers
FROM terminal_a WHERE TRY_CAST(substring(date,1,4) AS INT) IS NOT NULL GROUP BY 1, 2"""


@query("report_q01", f"""WITH wm AS ({WEATHER_MONTH}), tm AS ({TERMINAL_MONTH})
SELECT CAST(year(c.date) AS INT) AS year, CAST(month(c.date) AS INT) AS month, {_sums([*C6, 'total'], 'c.')},
  tm.total_buses, tm.total_passengers, {', '.join('wm.' + c for c in W6)}
FROM carrier_daily c
LEFT JOIN tm ON year(c.date) = tm.year AND month(c.date) = tm.month
LEFT JOIN wm ON year(c.date) = wm.year AND month(c.date) = wm.month
GROUP BY year(c.date), month(c.date), tm.total_buses, tm.total_passengers, {', '.join('wm.' + c for c in W6)}""")
def report_q01(spark, d):
    return r.carriers_with_terminal_and_weather(t.carrier_daily(spark, d), t.terminal_a(spark, d), t.weather(spark, d))


RIGHT_CHAIN = """WITH td AS (SELECT DISTINCT substring(CAST(date AS VARCHAR),1,4) AS year, substring(CAST(date AS VARCHAR),6,2) AS month, fac_g FROM traffic_history)
SELECT td.year, td.month, td.fac_g, TRY_CAST(a.buses_count AS BIGINT) AS a_buses, TRY_CAST(a.passengers_count AS BIGINT) AS a_passengers,
  TRY_CAST(b.buses_count AS BIGINT) AS b_buses, TRY_CAST(b.passengers_count AS BIGINT) AS b_passengers,
  CAST(d.total AS BIGINT) AS d_total, CAST(d.bus_total AS BIGINT) AS d_bus_total
FROM td RIGHT JOIN terminal_a a ON td.year = substring(a.date,1,4) AND td.month = substring(a.date,6,2)
RIGHT JOIN terminal_b b ON td.year = substring(b.date,1,4) AND td.month = substring(b.date,6,2)
RIGHT JOIN passenger_bus_weekly d ON td.year = substring(CAST(d.start_date AS VARCHAR),1,4) AND td.month = substring(CAST(d.start_date AS VARCHAR),6,2)"""


@query("report_q02", RIGHT_CHAIN)
def report_q02(spark, d):
    return r.facility_months_right_chain(t.traffic_history(spark, d), t.terminal_a(spark, d), t.terminal_b(spark, d),
                                         t.passenger_bus_weekly(spark, d))


def month_ctes(a, b, d, departures):
    """Monthly sums of the three count tables; each argument maps result name to source column."""
    def one(name, table, date, sums):
        cols = ", ".join(f"CAST(SUM(TRY_CAST({c} AS BIGINT)) AS BIGINT) AS {n}" for n, c in sums.items())
        return (f"{name} AS (SELECT substring(CAST({date} AS VARCHAR),1,4) AS year, substring(CAST({date} AS VARCHAR),6,2) AS month, "
                f"{cols} FROM {table} GROUP BY 1, 2)")
    return ",\n".join([one("am", "terminal_a", "date", a), one("bm", "terminal_b", "date", b),
                       one("dm", departures, "start_date", d)])


def month_joins(*names):
    return "\n".join(f"LEFT JOIN {n} ON td.year = {n}.year AND td.month = {n}.month" for n in names)


Q3_CTES = f"""td AS (SELECT DISTINCT substring(CAST(date AS VARCHAR),1,4) AS year, substring(CAST(date AS VARCHAR),6,2) AS month, fac_g, time FROM traffic_history),
{month_ctes({'a_passengers': 'passengers_count'}, {'b_passengers': 'passengers_count'}, {'d_passengers': 'total'}, 'passenger_weekly')},
wr AS (SELECT substring(CAST(date AS VARCHAR),1,4) AS year, substring(CAST(date AS VARCHAR),6,2) AS month, {', '.join(W6)},
  ROW_NUMBER() OVER (PARTITION BY substring(CAST(date AS VARCHAR),1,4), substring(CAST(date AS VARCHAR),6,2) ORDER BY date) AS rn FROM weather),
w1 AS (SELECT * FROM wr WHERE rn = 1)"""
Q3_SELECT = f"""SELECT DISTINCT td.year, td.month, td.fac_g, td.time, am.a_passengers, bm.b_passengers, dm.d_passengers,
  {', '.join('w1.' + c for c in W6)}
FROM td {month_joins('am', 'bm', 'dm', 'w1')}"""


@query("report_q03", f"WITH {Q3_CTES}\n{Q3_SELECT}")
def report_q03(spark, d):
    return r.facility_hours_with_counts(t.traffic_history(spark, d), t.terminal_a(spark, d), t.terminal_b(spark, d),
                                        t.passenger_weekly(spark, d), t.weather(spark, d))


PB_JOIN = "passenger_weekly p JOIN bus_weekly b ON p.start_date = b.start_date AND p.end_date = b.end_date"


@query("report_q04", f"""SELECT CAST(year(p.start_date) AS INT) AS year, CAST(month(p.start_date) AS INT) AS month, {_pb_sums()}
FROM {PB_JOIN} GROUP BY 1, 2""")
def report_q04(spark, d):
    return r.passengers_with_buses(t.passenger_weekly(spark, d), t.bus_weekly(spark, d))


@query("report_q05", f"""SELECT CAST(year(p.start_date) AS INT) AS year, CAST(month(p.start_date) AS INT) AS month,
  {', '.join(f'p.{c} AS passenger_{c}, b.{c} AS bus_{c}' for c in C6)}
FROM passenger_weekly p JOIN bus_weekly b ON p.start_date = b.start_date""")
def report_q05(spark, d):
    return r.passengers_with_buses_rows(t.passenger_weekly(spark, d), t.bus_weekly(spark, d))


@query("report_q06", f"""SELECT CAST(year(c.date) AS INT) AS year, CAST(month(c.date) AS INT) AS month, {_sums([*C6, 'total'], 'c.')},
  CAST(SUM(TRY_CAST(a.buses_count AS BIGINT)) AS BIGINT) AS total_buses,
  CAST(SUM(TRY_CAST(a.passengers_count AS BIGINT)) AS BIGINT) AS total_passengers
FROM carrier_daily c JOIN terminal_a a ON strftime(c.date, '%Y-%m') = a.date GROUP BY 1, 2""")
def report_q06(spark, d):
    return r.carriers_with_terminal_sums(t.carrier_daily(spark, d), t.terminal_a(spark, d))


@query("report_q07", f"""SELECT CAST(year(c.date) AS INT) AS year, CAST(month(c.date) AS INT) AS month, {', '.join('c.' + c for c in [*C6, 'total'])},
  a.buses_count, a.passengers_count
FROM carrier_daily c JOIN terminal_a a ON strftime(c.date, '%Y-%m') = a.date""")
def report_q07(spark, d):
    return r.carriers_with_terminal_rows(t.carrier_daily(spark, d), t.terminal_a(spark, d))


STAR_FROM = """FROM carrier_daily c
LEFT JOIN terminal_b b ON b.date = substring(CAST(c.date AS VARCHAR),1,7)
LEFT JOIN terminal_a a ON a.date = substring(CAST(c.date AS VARCHAR),1,7)
LEFT JOIN passenger_bus_weekly d ON substring(CAST(d.start_date AS VARCHAR),1,7) = substring(CAST(c.date AS VARCHAR),1,7)"""
TERMINAL_COLS = ["date", "route", "buses_count", "passengers_count"]
D_COLS = ["start_date", "total", "bus_total", *C6, *[f"bus_{c}" for c in C6]]


@query("report_q08", f"""SELECT c.*, {', '.join(f'b.{c} AS b_{c}' for c in TERMINAL_COLS)}, {', '.join(f'a.{c} AS a_{c}' for c in TERMINAL_COLS)},
  {', '.join(f'd.{c} AS d_{c}' for c in D_COLS)}
{STAR_FROM}""")
def report_q08(spark, d):
    return r.four_table_star(t.carrier_daily(spark, d), t.terminal_b(spark, d), t.terminal_a(spark, d),
                             t.passenger_bus_weekly(spark, d))


@query("report_q09", f"""SELECT c.date, c.af, c.nf, c.ro, b.route AS b_route, b.buses_count AS b_buses_count, b.passengers_count AS b_passengers_count,
  a.route AS a_route, a.buses_count AS a_buses_count, a.passengers_count AS a_passengers_count,
  d.start_date AS d_start_date, d.total AS d_total, d.bus_total AS d_bus_total, d.af AS d_af, d.bus_af AS d_bus_af
{STAR_FROM}""")
def report_q09(spark, d):
    return r.four_table_star_chosen(t.carrier_daily(spark, d), t.terminal_b(spark, d), t.terminal_a(spark, d),
                                    t.passenger_bus_weekly(spark, d))


@query("report_q10", f"""WITH td AS (SELECT DISTINCT substring(CAST(date AS VARCHAR),1,4) AS year, substring(CAST(date AS VARCHAR),6,2) AS month, fac_g FROM traffic_history),
{month_ctes({'a_buses': 'buses_count', 'a_passengers': 'passengers_count'}, {'b_buses': 'buses_count', 'b_passengers': 'passengers_count'}, {'d_total': 'total', 'd_bus_total': 'bus_total'}, 'passenger_bus_weekly')}
SELECT td.year, td.month, td.fac_g, am.a_buses, am.a_passengers, bm.b_buses, bm.b_passengers, dm.d_total, dm.d_bus_total
FROM td {month_joins('am', 'bm', 'dm')}""")
def report_q10(spark, d):
    return r.facility_months_with_counts(t.traffic_history(spark, d), t.terminal_a(spark, d), t.terminal_b(spark, d),
                                         t.passenger_bus_weekly(spark, d))


@query("report_q11", f"""SELECT h.*, {', '.join(f'w.{c} AS w_{c}' for c in W6)}
FROM traffic_history h LEFT JOIN weather w ON h.date = w.date""")
def report_q11(spark, d):
    return r.traffic_with_weather(t.traffic_history(spark, d), t.weather(spark, d))


@query("report_q12", f"""SELECT h.*, {', '.join(f'w.{c}' for c in W6)}
FROM traffic_history h LEFT JOIN weather w ON h.date = w.date ORDER BY h.date""")
def report_q12(spark, d):
    return r.traffic_with_weather_chosen(t.traffic_history(spark, d), t.weather(spark, d))


def month_summary_sql():
    return """SELECT CAST(year(h.date) AS INT) AS year, CAST(month(h.date) AS INT) AS month, COUNT(*) AS record_count,
  ROUND(AVG(h.lane), 4) AS avg_lane, ROUND(AVG(h.time), 4) AS avg_time, CAST(SUM(h.total) AS BIGINT) AS total_vehicles,
  CAST(SUM(h.class_1) AS BIGINT) AS total_class_1, CAST(SUM(h.class_9) AS BIGINT) AS total_class_9, MAX(h.fac_b) AS sample_fac_b,
  CAST(SUM(h.buses) AS BIGINT) AS total_buses, MAX(h.fac_g) AS sample_fac_g, MAX(h.day_name) AS sample_day_name,
  ROUND(AVG(w.awnd), 4) AS avg_wind_speed, SUM(w.prcp) AS total_precipitation, SUM(w.snow) AS total_snowfall,
  SUM(w.snwd) AS total_snow_depth, ROUND(AVG(w.tmax), 4) AS avg_tmax, ROUND(AVG(w.tmin), 4) AS avg_tmin
FROM traffic_history h LEFT JOIN weather w ON h.date = w.date GROUP BY 1, 2"""


def rounded(df, cols, digits=4):
    from pyspark.sql import functions as F
    return df.withColumns({c: F.round(c, digits) for c in cols})


@query("report_q13", month_summary_sql())
def report_q13(spark, d):
    out = r.traffic_month_summary(t.traffic_history(spark, d), t.weather(spark, d))
    return rounded(out, ["avg_lane", "avg_time", "avg_wind_speed", "avg_tmax", "avg_tmin"])


@query("report_q14", f"""WITH wm AS ({WEATHER_MONTH})
SELECT CAST(year(p.start_date) AS INT) AS year, CAST(month(p.start_date) AS INT) AS month, {_pb_sums()}, {', '.join('wm.' + c for c in W6)}
FROM {PB_JOIN}
LEFT JOIN wm ON year(p.start_date) = wm.year AND month(p.start_date) = wm.month
GROUP BY year(p.start_date), month(p.start_date), {', '.join('wm.' + c for c in W6)}""")
def report_q14(spark, d):
    return r.passengers_buses_weather(t.passenger_weekly(spark, d), t.bus_weekly(spark, d), t.weather(spark, d))
