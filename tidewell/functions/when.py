"""Calendar functions in a city's local time, as column expressions. The present is always a parameter."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TZ = "Europe/Tallinn"
# Weekday names as listings write them, Monday first.
DAYS = ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"]
# How long a pick is valid without its own end: hours for tonight, days for a weekday, days else.
VALID_HOURS_TONIGHT, VALID_DAYS_WEEKDAY, VALID_DAYS_ELSE = 36, 8, 90
# Hours of civil dawn and dusk by city and month, January first.
SUN = {
    "tallinn": ([8.9, 7.9, 6.6, 5.3, 3.9, 3.0, 3.5, 4.9, 6.1, 7.3, 8.2, 8.9], [16.4, 17.7, 19.0, 21.2, 22.7, 23.8, 23.3, 21.9, 20.3, 18.8, 16.7, 15.9]),
    "helsinki": ([9.0, 8.0, 6.6, 5.2, 3.7, 2.6, 3.2, 4.8, 6.1, 7.4, 8.4, 9.1], [16.3, 17.7, 19.1, 21.3, 22.9, 23.9, 23.6, 22.0, 20.3, 18.7, 16.6, 15.8]),
    "riga": ([8.6, 7.7, 6.5, 5.4, 4.2, 3.6, 4.0, 5.1, 6.1, 7.1, 7.9, 8.5], [16.8, 17.9, 19.0, 21.0, 22.2, 23.0, 22.8, 21.6, 20.2, 18.8, 16.9, 16.2]),
    "vilnius": ([8.3, 7.5, 6.4, 5.4, 4.4, 3.9, 4.2, 5.2, 6.1, 7.0, 7.7, 8.2], [16.9, 17.9, 18.9, 20.8, 21.9, 22.6, 22.4, 21.3, 20.0, 18.7, 16.9, 16.3]),
}


def local(ts: Column, tz: str = TZ) -> Column:
    return F.from_utc_timestamp(ts, tz)


def local_date(ts: Column, tz: str = TZ) -> Column:
    return F.to_date(local(ts, tz))


def local_minutes(ts: Column, tz: str = TZ) -> Column:
    t = local(ts, tz)
    return F.hour(t) * 60 + F.minute(t)


def weekday_index(day: Column) -> Column:
    """0 for 'Mon' to 6 for 'Sun', by the first three letters; null for anything else."""
    at = F.array_position(F.array(*(F.lit(d) for d in DAYS)), F.initcap(F.substring(F.trim(day), 1, 3)))
    return F.when(at > 0, (at - 1).cast("int"))


def resolve_date(starts_at: Column, day: Column, today: Column, tz: str = TZ) -> Column:
    """The date of a listing: of its start; else today for 'tonight'; else the coming day of that name; else null."""
    ahead = F.pmod(weekday_index(day) - F.weekday(today), F.lit(7))
    return F.coalesce(local_date(starts_at, tz), F.when(F.lower(F.trim(day)).startswith("ton"), today), F.date_add(today, ahead))


def is_tonight(date: Column, today: Column, flag: Column | None = None, day: Column | None = None) -> Column:
    """Today's, or flagged so, or with a day that reads Tonight: dates only widen what is stated."""
    stated = F.lit(False) if flag is None else F.coalesce(flag, F.lit(False))
    named = F.lit(False) if day is None else F.coalesce(F.lower(F.trim(day)).startswith("ton"), F.lit(False))
    return stated | named | F.coalesce(date == today, F.lit(False))


def is_tomorrow(date: Column, today: Column) -> Column:
    return F.coalesce(date == F.date_add(today, 1), F.lit(False))


def is_this_week(date: Column, today: Column, flag: Column | None = None, tonight: Column | None = None) -> Column:
    """Today and the six days after, or flagged so, or tonight."""
    stated = [F.coalesce(c, F.lit(False)) for c in (flag, tonight) if c is not None]
    return functools.reduce(Column.__or__, stated, F.coalesce(date.between(today, F.date_add(today, 6)), F.lit(False)))


def stamped(df: DataFrame, date: Column, today: Column) -> DataFrame:
    """df (tonight, this_week, day) with both flags widened by the date; stated ones stay."""
    tonight = is_tonight(date, today, F.col("tonight"), F.col("day"))
    return df.withColumns({"tonight": tonight, "this_week": is_this_week(date, today, F.col("this_week"), tonight)})


def weekend(today: Column) -> Column:
    """Sunday: itself; Saturday: with Sunday; else the coming Friday to Sunday."""
    d = F.weekday(today)
    friday = F.date_add(today, F.pmod(F.lit(4) - d, F.lit(7)))
    one = F.when(d == 6, F.array(today)).when(d == 5, F.array(today, F.date_add(today, 1)))
    return F.coalesce(one, F.sequence(friday, F.date_add(friday, 2)))


def matches_window(window: str, date: Column, today: Column, tonight: Column | None = None, this_week: Column | None = None) -> Column:
    """Does a listing fall in a named window: date:YYYY-MM-DD, tonight, tomorrow, weekend, thisweek; others hold all.
    tonight, this_week: stamped flags, where there are any."""
    if window == "tonight":
        return is_tonight(date, today, tonight)
    if window == "thisweek":
        return is_this_week(date, today, this_week, tonight)
    if window.startswith("date:"):
        return F.coalesce(date == F.to_date(F.lit(window[5:])), F.lit(False))
    if window == "weekend":
        return F.coalesce(F.array_contains(weekend(today), date), F.lit(False))
    return is_tomorrow(date, today) if window == "tomorrow" else F.lit(True)


def clock_minutes(text: Column) -> Column:
    """Minutes of a clock at a text's start, '19:30' or '19.30'; null without one."""
    h = F.regexp_extract(text, r"^\s*(\d{1,2})[:.](\d{2})", 1).try_cast("int")
    m = F.regexp_extract(text, r"^\s*(\d{1,2})[:.](\d{2})", 2).try_cast("int")
    return h * 60 + m


def start_minutes(starts_at: Column, time: Column, tz: str = TZ) -> Column:
    return F.coalesce(local_minutes(starts_at, tz), clock_minutes(time))


def stated_minutes(starts_at: Column, time: Column, tz: str = TZ) -> Column:
    """Start minutes that someone stated: null without a clock, at midnight, or if the start is exactly midnight UTC."""
    bare = F.coalesce(F.date_format(starts_at, "HH:mm:ss") == "00:00:00", F.lit(False))
    return F.when(~bare, F.nullif(start_minutes(starts_at, time, tz), F.lit(0)))


def doors_ok(minutes: Column, now: Column, rule: str) -> Column:
    """rule: any, now (not started), or HH:MM (from then on). Unknown times pass `any` only."""
    if rule == "any":
        return F.lit(True)
    h, _, m = rule.partition(":")
    return F.coalesce(minutes >= (now if rule == "now" else F.lit(int(h) * 60 + int(m or 0))), F.lit(False))


def valid_until(day: Column, now: Column) -> Column:
    tonight = F.lower(F.trim(day)).startswith("ton")
    hours = F.when(tonight, VALID_HOURS_TONIGHT).when(F.coalesce(F.trim(day), F.lit("")) != "", VALID_DAYS_WEEKDAY * 24).otherwise(VALID_DAYS_ELSE * 24)
    return F.timestamp_add("HOUR", hours, now)


def freshness(now: Column, stale_after: Column, expire_after: Column) -> Column:
    """Of a cached row: fresh, stale (usable while it is renewed) or expired."""
    return F.when(now < stale_after, "fresh").when(now < expire_after, "stale").otherwise("expired")


def cooled_down(failed_at: Column, now: Column, days: int = 14) -> Column:
    return failed_at.isNull() | (failed_at < F.timestamp_add("DAY", F.lit(-days), now))


def roll_year(month: Column, day: Column, today: Column, past_days: int) -> Column:
    """A date without a year: this year's, or next year's if that is more than past_days ago; null if there is none."""
    this = F.try_to_date(F.format_string("%04d-%02d-%02d", F.year(today), month, day), "yyyy-MM-dd")
    then = F.try_to_date(F.format_string("%04d-%02d-%02d", F.year(today) + 1, month, day), "yyyy-MM-dd")
    return F.when(F.datediff(today, this) > past_days, then).otherwise(this)


def dotted_date(text: Column, today: Column, past_days: int = 31) -> Column:
    """'24.12.' or '24.12.2026'."""
    part = lambda i: F.regexp_extract(text, r"(\d{1,2})\.(\d{1,2})\.(\d{4})?", i).try_cast("int")
    full = F.try_to_date(F.format_string("%04d-%02d-%02d", part(3), part(2), part(1)), "yyyy-MM-dd")
    return F.coalesce(F.when(part(3).isNotNull(), full), roll_year(part(2), part(1), today, past_days))


def month_name_date(text: Column, today: Column, past_days: int = 7) -> Column:
    """'24 December' by the month's first three letters."""
    names = F.array(*(F.lit(m) for m in "jan feb mar apr may jun jul aug sep oct nov dec".split()))
    month = F.nullif(F.array_position(names, F.lower(F.substring(F.regexp_extract(text, r"\d{1,2}\.?\s+(\p{L}{3,})", 1), 1, 3))).cast("int"), F.lit(0))
    return roll_year(month, F.regexp_extract(text, r"(\d{1,2})\.?\s+\p{L}{3,}", 1).try_cast("int"), today, past_days)


def offset_timestamp(text: Column, offset: str = "+02:00") -> Column:
    """A stamp without a zone read at a fixed offset (which knows no summer time); stamps with a zone keep theirs."""
    zoned = text.rlike(r"(Z|[+-]\d{2}:?\d{2})$")
    return F.try_to_timestamp(F.when(zoned, text).otherwise(F.concat(text, F.lit(offset))))


def is_day(hour: Column, month: Column, city: str = "tallinn") -> Column:
    dawn, dusk = (F.get(F.array(*(F.lit(v) for v in side)), month - 1) for side in SUN.get(city, SUN["tallinn"]))
    return (hour >= dawn) & (hour < dusk)


def dusk_label(month: Column, city: Column) -> Column:
    """The clock at which dusk falls, by the city's table (the first one's for other cities)."""
    tables = {name: F.array(*(F.lit(v) for v in dusk)) for name, (_, dusk) in SUN.items()}
    chosen = tables["tallinn"]
    for name, table in tables.items():
        chosen = F.when(city == name, table).otherwise(chosen)
    at = F.get(chosen, month.cast("int") - 1)
    hour = F.floor(at)
    return F.format_string("%02d:%02d", F.least(hour, F.lit(23)), F.floor((at - hour) * 60 + 0.5) % 60)


def easter(year: Column) -> Column:
    """Easter Sunday of the Gregorian calendar, in integer arithmetic (Meeus, Jones and Butcher)."""
    i = lambda c: F.floor(c).cast("int")
    a, b, c = year % 19, i(year / 100), year % 100
    h = (19 * a + b - i(b / 4) - i((b - i((b + 8) / 25) + 1) / 3) + 15) % 30
    k = (32 + 2 * (b % 4) + 2 * i(c / 4) - h - c % 4) % 7
    n = h + k - 7 * i((a + 11 * h + 22 * k) / 451) + 114
    return F.make_date(year, i(n / 31), n % 31 + 1)
