"""Calendar expressions.

Everything works on ``date`` and ``timestamp_ntz`` so that results do not depend on the session zone.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = [
    "day_type", "hhmm_hour", "hhmm_number", "hhmm_text", "hour_start", "iso_text", "is_weekend",
    "month_bucket", "month_key", "month_number", "month_start", "month_start_of_text", "month_text",
    "at_time", "time_text", "valid_month_text", "week_bucket", "weekday_monday0", "year_range", "year_text",
]

WEEKEND = (5, 6)  # Monday is 0


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def iso_text(c) -> Column:
    """``yyyy-MM-dd`` text of a date; text passes through unchanged."""
    return _col(c).cast("string")


def year_text(c) -> Column:
    return F.substring(iso_text(c), 1, 4)


def month_text(c) -> Column:
    return F.substring(iso_text(c), 6, 2)


def month_key(c) -> Column:
    """``yyyy-MM`` prefix of a date or of ISO text."""
    return F.substring(iso_text(c), 1, 7)


def valid_month_text(c) -> Column:
    """``yyyy-MM`` prefix, NULL unless it names a real month.

    The value has at most 9,999 x 12 distinct states, which bounds every table grouped by it.
    """
    key = month_key(c)
    return F.when(key.rlike("^[0-9]{4}-(0[1-9]|1[0-2])$"), key)


def month_start(year, month) -> Column:
    """First day of a month given as numbers; NULL outside the calendar."""
    y, m = _col(year).cast("int"), _col(month).cast("int")
    return F.when(m.between(1, 12) & y.between(1, 9999), F.make_date(y, m, F.lit(1)))


def month_start_of_text(c) -> Column:
    """First day of a ``yyyy-MM`` month; parsed by position because a date cast is engine-specific."""
    key = valid_month_text(c)
    return F.make_date(F.substring(key, 1, 4).cast("int"), F.substring(key, 6, 2).cast("int"), F.lit(1))


def month_number(c) -> Column:
    """Months since year 0, so that differences count calendar months."""
    d = _col(c)
    return F.year(d) * 12 + F.month(d) - 1


def week_bucket(c) -> Column:
    """Monday of the week as a date."""
    d = _col(c).cast("date")
    return F.date_sub(d, F.weekday(d))


def month_bucket(c) -> Column:
    return F.trunc(_col(c).cast("date"), "month")


def weekday_monday0(c) -> Column:
    return F.weekday(_col(c))


def is_weekend(c) -> Column:
    """1 on Saturday and Sunday, 0 otherwise; a missing date counts as a weekday."""
    return F.when(weekday_monday0(c).isin(*WEEKEND), 1).otherwise(0)


def day_type(c) -> Column:
    return F.when(weekday_monday0(c).isin(*WEEKEND), "Weekend").otherwise("Weekday")


def hhmm_number(c) -> Column:
    """Integer part of an ``hhmm`` value read from raw text; NULL when it is not a number."""
    value = _col(c).try_cast("double")
    return F.when(~F.isnan(value), value).try_cast("bigint")


def hhmm_text(c) -> Column:
    """``930`` becomes ``09:30``. Longer numbers are kept whole, as zero-filling does."""
    digits = hhmm_number(c).cast("string")
    padded = F.when(F.length(digits) >= 4, digits).otherwise(F.lpad(digits, 4, "0"))
    return F.concat(F.substring(padded, 1, 2), F.lit(":"), padded.substr(3, 20))


def _hhmm_valid(n: Column) -> Column:
    return (n >= 0) & (n < 2400) & (n % 100 < 60)


def hhmm_hour(c) -> Column:
    """Hour of an ``hhmm`` value, NULL when it names no time of day (``2400``, ``1075``)."""
    n = hhmm_number(c)
    return F.when(_hhmm_valid(n), F.floor(n / 100).cast("int"))


def at_time(date, hhmm) -> Column:
    """Timestamp of a date and an ``hhmm`` value; NULL when either part is invalid."""
    n = hhmm_number(hhmm)
    offset = F.make_dt_interval(F.lit(0), F.floor(n / 100).cast("int"), (n % 100).cast("int"))
    return F.when(_hhmm_valid(n), _col(date).cast("timestamp_ntz") + offset)


def hour_start(ts) -> Column:
    """The timestamp cut to its hour."""
    t = _col(ts)
    return t.cast("date").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.hour(t))


def time_text(ts) -> Column:
    """``HH:mm`` of a timestamp, by its parts: formatting would pass through the session zone."""
    def two(part):
        return F.lpad(part.cast("string"), 2, "0")

    return F.concat(two(F.hour(_col(ts))), F.lit(":"), two(F.minute(_col(ts))))


def year_range(c, first: int, last: int) -> Column:
    """Years ``first``..``last`` as a range on the raw column, which a Parquet scan can prune by."""
    d = _col(c)
    return (d >= F.lit(f"{first:04d}-01-01").cast("date")) & (d < F.lit(f"{last + 1:04d}-01-01").cast("date"))
