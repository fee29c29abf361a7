"""Registration of queries with their comparison SQL.

The SQL is plain text for an independent engine that knows only the base tables, so the stand-in tables
it names are put in front of it as common table expressions.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

CARRIER_PAIRS = {"af": ("A", "F"), "ao": ("A", "O"), "nf": ("N", "F"), "no": ("N", "O"), "rf": ("R", "F"), "ro": ("R", "O")}


def _carrier_sums(value: str) -> str:
    return ",\n  ".join(
        f"CAST(SUM(CASE WHEN l_returnflag='{f}' AND l_linestatus='{s}' THEN {value} END) AS BIGINT) AS {c}"
        for c, (f, s) in CARRIER_PAIRS.items())


def _weekly(value: str, total: str) -> str:
    return f"""SELECT CAST(DATE_TRUNC('week', l_shipdate) AS DATE) AS start_date,
  CAST(CAST(DATE_TRUNC('week', l_shipdate) AS DATE) + INTERVAL '6' DAY AS DATE) AS end_date,
  {_carrier_sums(value)}, CAST(SUM({value}) AS BIGINT) AS {total}
FROM lineitem GROUP BY CAST(DATE_TRUNC('week', l_shipdate) AS DATE)"""


def _terminal(status: str) -> str:
    return f"""SELECT SUBSTRING(CAST(CAST(o_orderdate AS DATE) AS STRING),1,7) AS date, o_orderpriority AS route,
  CASE WHEN COUNT(*) % 11 = 0 THEN 'n/a' ELSE CAST(COUNT(*) AS STRING) END AS buses_count,
  CASE WHEN COUNT(*) % 13 = 0 THEN '' ELSE CAST(CAST(FLOOR(MAX(o_totalprice)) AS BIGINT) AS STRING) END AS passengers_count
FROM orders WHERE o_orderstatus = '{status}'
GROUP BY SUBSTRING(CAST(CAST(o_orderdate AS DATE) AS STRING),1,7), o_orderpriority"""


ROLE_SQL = {
    "traffic": """SELECT CAST(ts AS DATE) AS date, CAST(user_id % 8 AS INT) AS lane,
  CAST(EXTRACT(HOUR FROM ts) * 100 + EXTRACT(MINUTE FROM ts) AS INT) AS time, event_type AS facility,
  CASE WHEN event_id % 4 = 0 THEN CAST(FLOOR(value) AS BIGINT) END AS auto,
  CASE WHEN event_id % 4 = 1 THEN CAST(FLOOR(value) AS BIGINT) END AS small_trucks,
  CASE WHEN event_id % 4 = 2 THEN CAST(FLOOR(value) AS BIGINT) END AS large_trucks,
  CASE WHEN event_id % 4 = 3 THEN CAST(FLOOR(value) AS BIGINT) END AS busses
FROM events""",
    "weather": """SELECT d AS date,
  CASE WHEN EXTRACT(DAY FROM d) % 9 = 0 THEN NULL ELSE CAST(FLOOR(mx/1000) AS DOUBLE) END AS awnd,
  CAST(n % 5 AS DOUBLE) AS prcp,
  CASE WHEN EXTRACT(MONTH FROM d) IN (12,1,2) THEN CAST(n % 7 AS DOUBLE) ELSE 0.0 END AS snow,
  CASE WHEN EXTRACT(DAY FROM d) % 10 = 0 THEN NULL ELSE CAST(n % 3 AS DOUBLE) END AS snwd,
  CAST(FLOOR(mx/5000) AS DOUBLE) AS tmax, CAST(FLOOR(mn/5000) AS DOUBLE) AS tmin
FROM (SELECT CAST(o_orderdate AS DATE) AS d, COUNT(*) AS n, MAX(o_totalprice) AS mx, MIN(o_totalprice) AS mn
      FROM orders GROUP BY CAST(o_orderdate AS DATE)
      UNION ALL
      SELECT CAST(ts AS DATE), COUNT(*), MAX(value)*1000, MIN(value)*1000 FROM events GROUP BY CAST(ts AS DATE)) x""",
    "carrier_daily": f"""SELECT CAST(l_shipdate AS DATE) AS date,
  {_carrier_sums('l_quantity')}, CAST(SUM(l_quantity) AS BIGINT) AS total
FROM lineitem GROUP BY CAST(l_shipdate AS DATE)""",
    "terminal_a": _terminal("F"),
    "terminal_b": _terminal("O"),
    "passenger_weekly": _weekly("l_quantity", "total"),
    "bus_weekly": _weekly("1", "bus_total"),
    "traffic_history": """SELECT CAST(o_orderdate AS DATE) AS date, CAST(o_custkey % 8 AS INT) AS lane, CAST(o_orderkey % 24 AS INT) AS time,
  CAST(FLOOR(o_totalprice / 1000) AS BIGINT) AS total, CAST(o_orderkey % 97 AS BIGINT) AS class_1,
  CAST(o_orderkey % 13 AS BIGINT) AS class_9, CAST(o_orderkey % 5 AS BIGINT) AS buses,
  o_orderstatus AS fac_b, o_orderpriority AS fac_g,
  CASE WHEN CAST(DATE_TRUNC('week', o_orderdate) AS DATE) = CAST(o_orderdate AS DATE) THEN 'Monday' ELSE 'Other' END AS day_name
FROM orders""",
    "passenger_bus_weekly": """SELECT p.start_date, p.total, b.bus_total, p.af, p.ao, p.nf, p.no, p.rf, p.ro,
  b.af AS bus_af, b.ao AS bus_ao, b.nf AS bus_nf, b.no AS bus_no, b.rf AS bus_rf, b.ro AS bus_ro
FROM passenger_weekly p JOIN bus_weekly b ON p.start_date = b.start_date AND p.end_date = b.end_date""",
}
# Tables derived from the stand-ins that several comparisons share.
DERIVED_SQL = {
    "traffic_hourly": """SELECT facility, CAST(date AS TIMESTAMP) + to_hours(CAST(time // 100 AS BIGINT)) AS ts,
  CAST(SUM(coalesce(auto,0)+coalesce(small_trucks,0)+coalesce(large_trucks,0)+coalesce(busses,0)) AS BIGINT) AS total_vehicles
FROM traffic GROUP BY 1, 2""",
    "history_hourly": """SELECT fac_g AS facility, CAST(date AS TIMESTAMP) + to_hours(CAST(time AS BIGINT)) AS ts,
  CAST(SUM(total) AS BIGINT) AS total_vehicles
FROM traffic_history GROUP BY 1, 2""",
    "carrier_monthly": """SELECT CAST(year(date) AS INT) AS year, CAST(month(date) AS INT) AS month,
  CAST(SUM(af) AS BIGINT) AS af, CAST(SUM(ao) AS BIGINT) AS ao, CAST(SUM(nf) AS BIGINT) AS nf,
  CAST(SUM(no) AS BIGINT) AS no, CAST(SUM(rf) AS BIGINT) AS rf, CAST(SUM(ro) AS BIGINT) AS ro,
  CAST(SUM(total) AS BIGINT) AS total
FROM carrier_daily GROUP BY 1, 2""",
}
ALL_SQL = {**ROLE_SQL, **DERIVED_SQL}


def _needed(sql: str, found: dict[str, str]) -> None:
    for name, text in ALL_SQL.items():
        if name not in found and re.search(rf"(?i)\b(from|join)\s+{name}\b", sql):
            _needed(text, found)
            found[name] = text


def with_tables(sql: str) -> str:
    """``sql`` preceded by the definitions of every stand-in table it reads."""
    found: dict[str, str] = {}
    _needed(sql, found)
    if not found:
        return sql
    ctes = ",\n".join(f"{name} AS (\n{text}\n)" for name, text in found.items())
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` is its comparison text, left out where SQL cannot state the result."""
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_tables(sql)
        return fn

    return register
