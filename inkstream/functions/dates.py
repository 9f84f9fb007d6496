"""Date functions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkstream.functions.text import c

ZONE = "Europe/Copenhagen"
# Names of months in dates.
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]


def week_start(ts: Column, zone: str = ZONE) -> Column:
    """Monday 00:00 of the local week, as an instant."""
    return F.to_utc_timestamp(F.date_trunc("week", F.from_utc_timestamp(ts, zone)), zone)


def week_end(ts: Column, zone: str = ZONE) -> Column:
    """a millisecond before the next local week."""
    monday = F.date_trunc("week", F.from_utc_timestamp(ts, zone))
    return F.to_utc_timestamp(monday + F.expr("INTERVAL 7 DAYS") - F.expr("INTERVAL 1 MILLISECOND"), zone)


def week_label(ts: Column, zone: str = ZONE, calendar_year: bool = False) -> Column:
    """year and week of the local date. ``calendar_year`` pairs the week with Monday's calendar year."""
    local = F.from_utc_timestamp(ts, zone)
    monday = F.date_trunc("week", local)
    year = F.year(monday if calendar_year else monday + F.expr("INTERVAL 3 DAYS"))
    return F.concat(year.cast("string"), F.lit("-W"), F.lpad(F.weekofyear(local).cast("string"), 2, "0"))


def label_range(label: str, zone: str = ZONE) -> tuple[dt.datetime, dt.datetime]:
    """first and last instant of a labelled week, as UTC; ValueError for a week that the year has not."""
    import zoneinfo

    year, week = label.split("-W")
    monday = dt.datetime.combine(dt.date.fromisocalendar(int(year), int(week), 1), dt.time(), zoneinfo.ZoneInfo(zone))
    end = dt.datetime.combine(monday.date() + dt.timedelta(7), dt.time(), zoneinfo.ZoneInfo(zone))
    return monday.astimezone(dt.UTC), end.astimezone(dt.UTC) - dt.timedelta(milliseconds=1)


def label_start(label: str | Column, zone: str = ZONE) -> Column:
    """F61 as an expression: Monday 00:00 of a labelled week, as an instant; null for weeks beyond 1 to 53 and for a week 53
    that the year has not."""
    year, week = (F.nullif(F.regexp_extract(c(label), r"^(\d{4})-W(\d{1,2})$", k), F.lit("")).cast("int") for k in (1, 2))
    monday = F.date_add(F.date_trunc("week", F.make_date(year, F.lit(1), F.lit(4))).cast("date"), (week - 1) * 7)
    return F.when(week.between(1, 53) & (F.weekofyear(monday) == week), F.to_utc_timestamp(monday.cast("timestamp"), zone))


def label_end(label: str | Column, zone: str = ZONE) -> Column:
    """the last millisecond of a labelled week."""
    return week_end(label_start(label, zone), zone)


def previous_label(label: str | Column) -> Column:
    """the week before by number; before week 1 comes week 52 of the year before."""
    year, week = (F.regexp_extract(c(label), r"^(\d{4})-W(\d{1,2})$", k).cast("int") for k in (1, 2))
    return F.when(week > 1, F.concat(year.cast("string"), F.lit("-W"), F.lpad((week - 1).cast("string"), 2, "0"))).otherwise(F.concat((year - 1).cast("string"), F.lit("-W52")))


def shown_label(label: str | Column) -> Column:
    """F68."""
    year, week = (F.regexp_extract(c(label), r"^(\d{4})-W(\d{1,2})$", k).cast("int") for k in (1, 2))
    return F.concat(F.lit("Week "), week.cast("string"), F.lit(", "), year.cast("string"))


def best_date(x: str | Column, hint: str | Column, now: Column) -> Column:
    """F64: relative dates and "D Month YYYY" where the hint allows them, else usual formats; null if none fits."""
    s, hint = F.trim(c(x)), c(hint)
    ago = r"(?i)^(\d+)\s+(hour|day|week|month)s?\s+ago$"
    n, unit = F.regexp_extract(s, ago, 1).try_cast("int"), F.lower(F.regexp_extract(s, ago, 2))
    back = F.when(unit == "hour", now - F.make_interval(hours=n)).when(unit == "day", now - F.make_interval(days=n)).when(unit == "week", now - F.make_interval(weeks=n)).when(unit == "month", now - F.make_interval(months=n))
    days = F.regexp_extract(s, r"(?i)^(\d+)\s+days?$", 1).try_cast("int")
    named = F.try_to_timestamp(F.when(s.rlike(r"(?i)^\d{1,2}\s+(" + "|".join(MONTHS) + r")\s+\d{4}$"), F.regexp_replace(F.initcap(s), r"\s+", " ")), F.lit("d MMMM yyyy"))
    relative = hint == "RELATIVE"
    usual = F.coalesce(F.try_to_timestamp(s), F.try_to_timestamp(s, F.lit("MMM d, yyyy")))
    return F.coalesce(F.when(relative, back), F.when(relative, now - F.make_interval(days=days)), F.when(relative | (hint == "D MMMM YYYY"), named), usual)


def valid_date(x: str | Column, now_year: int) -> Column:
    """the instant if it parses and its year is between 2015 and next year, else null."""
    t = F.try_to_timestamp(c(x))
    return F.when(F.year(t).between(2015, now_year + 1), t)


def feed_date(x: str | Column) -> Column:
    """RFC 822 or ISO; the weekday in front is dropped."""
    s = F.regexp_replace(F.trim(c(x)), r"^[A-Za-z]{3},\s*", "")
    return F.coalesce(F.try_to_timestamp(s, F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(s, F.lit("d MMM yyyy HH:mm:ss z")), F.try_to_timestamp(s))


def ordinal(day: Column) -> Column:
    return F.when(day.isin(11, 12, 13), "th").when(day % 10 == 1, "st").when(day % 10 == 2, "nd").when(day % 10 == 3, "rd").otherwise("th")


def shown_range(start: Column, end: Column) -> Column:
    """like "Jan 5-11th 2026", or with both months."""
    last = F.concat(F.dayofmonth(end).cast("string"), ordinal(F.dayofmonth(end)), F.lit(" "), F.year(end).cast("string"))
    same = F.month(start) == F.month(end)
    return F.when(same, F.concat(F.date_format(start, "MMM d"), F.lit("-"), last)).otherwise(F.concat(F.date_format(start, "MMM d"), F.lit(" - "), F.date_format(end, "MMM "), last))
