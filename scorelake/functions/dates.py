"""Date columns: inclusive event intervals and calendar-year week labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def event_end(start: Column, duration_days: Column, interruption: Column | None = None) -> Column:
    """Last day of an event, counted inclusively; an earlier interruption clips it."""
    end = F.date_add(start, F.greatest(F.coalesce(duration_days, F.lit(0)) - 1, F.lit(0)).cast("int"))
    return end if interruption is None else F.least(end, interruption)


def exclusive_end(start: Column, duration_days: Column) -> Column:
    """Start plus duration, used for the stored end time; NULL without a duration."""
    return F.when(duration_days.isNotNull(), F.date_add(start, duration_days.cast("int")))


def week_number(day: Column) -> Column:
    """Weeks start on Monday; days before the first Monday are in week 0."""
    return F.floor((F.dayofyear(day) + 6 - F.weekday(day)) / 7).cast("int")


def week_key(day: Column) -> Column:
    return F.concat(
        F.lpad(F.year(day).cast("string"), 4, "0"), F.lit("-W"), F.lpad(week_number(day).cast("string"), 2, "0")
    )


def monday(day: Column) -> Column:
    return F.date_sub(day, F.weekday(day))


def overlap_days(start_a: Column, end_a: Column, start_b: Column, end_b: Column) -> Column:
    """Days shared by two closed intervals, 0 when they do not meet."""
    shared = F.datediff(F.least(end_a, end_b), F.greatest(start_a, start_b)) + 1
    return F.greatest(shared, F.lit(0))
