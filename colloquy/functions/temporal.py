"""Dates of relative expressions as column forms (phrases in texts: operators.phrases)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Formats of dialogue times, tried in order.
FORMATS = ("yyyy/MM/dd HH:mm", "h:mm a 'on' d MMMM, yyyy", "h:mm a 'on' d MMMM yyyy", "h a 'on' d MMMM, yyyy", "h a 'on' d MMMM yyyy")


def parse_time(text: Column) -> Column:
    """A dialogue time, with or without a weekday in brackets; null where no format fits."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(text, "\\s*\\([A-Za-z]+\\)", ""), "\\s+", " "))
    fixed = F.regexp_replace(F.regexp_replace(plain, "(?i)\\bam\\b", "AM"), "(?i)\\bpm\\b", "PM")
    return F.coalesce(*(F.try_to_timestamp(fixed, F.lit(f)) for f in FORMATS))


def monday(day: Column) -> Column:
    return F.date_trunc("week", day).cast("date")


def weekday_target(day: Column, weekday: int, which: str) -> Column:
    """last: the nearest earlier such weekday (a week ago on the day itself); this: in the Monday week; next: the nearest later one."""
    now = F.weekday(day)
    if which == "this":
        return F.date_add(monday(day), weekday)
    if which == "last":
        delta = F.pmod(now - weekday, F.lit(7))
        return F.date_sub(day, F.when(delta == 0, 7).otherwise(delta))
    delta = F.pmod(F.lit(weekday) - now, F.lit(7))
    return F.date_add(day, F.when(delta == 0, 7).otherwise(delta))


def week_range(day: Column, which: str) -> tuple[Column, Column]:
    start = F.date_add(monday(day), {"last": -7, "this": 0, "next": 7}[which])
    return start, F.date_add(start, 6)


def weekend_range(day: Column, which: str) -> tuple[Column, Column]:
    start = F.date_add(monday(day), {"last": -2, "this": 5, "next": 12}[which])
    return start, F.date_add(start, 1)


def month_range(day: Column, offset: int) -> tuple[Column, Column]:
    start = F.add_months(F.trunc(day, "month"), offset)
    return start, F.last_day(start)


def year_range(day: Column, offset: int) -> tuple[Column, Column]:
    y = F.year(day) + offset
    return F.make_date(y, F.lit(1), F.lit(1)), F.make_date(y, F.lit(12), F.lit(31))


def season_range(label_year: Column, season: str) -> tuple[Column, Column]:
    """Meteorological; a winter ends in the year after its label."""
    first = {"spring": 3, "summer": 6, "autumn": 9, "fall": 9, "winter": 12}[season]
    start = F.make_date(label_year, F.lit(first), F.lit(1))
    return start, F.last_day(F.add_months(start, 2))


def contained(day: Column, start: Column, end: Column, granularity: Column) -> Column:
    """Whether a date lies in a coarse range: day: equal; week: within seven days of the start; month and year: the same; season and range: between; weekend and time: never."""
    g = granularity
    return (
        F.when(day.isNull() | start.isNull(), False)
        .when(g == "day", day == start)
        .when(g == "week", F.abs(F.date_diff(day, start)) <= 7)
        .when(g == "month", (F.year(day) == F.year(start)) & (F.month(day) == F.month(start)))
        .when(g == "year", F.year(day) == F.year(start))
        .when(g.isin("season", "range"), day.between(start, F.coalesce(end, start)))
        .otherwise(False)
    )


def boundary(operator: Column, start: Column, end: Column) -> tuple[Column, Column]:
    """Open intervals: before ends a microsecond before the start, after starts one after the end, since starts at the start."""
    micro = F.expr("interval 1 microsecond")
    return F.when(operator == "after", end + micro).when(operator == "since", start), F.when(operator == "before", start - micro)
