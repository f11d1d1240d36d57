"""Calendar expressions and the expected-volume curve."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Base daily volume, weekday weights (Monday first), month weights (January first),
# holiday boost (20 December to 5 January), and growth from 30 % at launch to 100 % in 540 days.
BASE_EVENTS_PER_DAY = 5000
WEEKDAY_WEIGHT = [1.00, 1.00, 1.00, 1.05, 1.15, 1.35, 1.25]
MONTH_WEIGHT = [1.05, 0.95, 0.90, 0.88, 0.85, 0.80, 0.78, 0.82, 0.90, 1.00, 1.08, 1.15]
HOLIDAY_BOOST = 1.30
LAUNCH_DATE = "2025-01-01"
GROWTH_START, GROWTH_GAIN, GROWTH_DAYS = 0.30, 0.70, 540


def day_of_week(day: Column) -> Column:
    """Sunday = 0 … Saturday = 6."""
    return F.dayofweek(day) - 1


def is_weekend(day: Column) -> Column:
    return day_of_week(day).isin(0, 6)


def is_holiday(day: Column) -> Column:
    month, dom = F.month(day), F.dayofmonth(day)
    return ((month == 12) & (dom >= 20)) | ((month == 1) & (dom <= 5))


def weekday_weight(day: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, WEEKDAY_WEIGHT)), F.weekday(day) + 1)


def month_weight(day: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, MONTH_WEIGHT)), F.month(day))


def growth_ramp(day: Column) -> Column:
    age = F.greatest(F.datediff(day, F.lit(LAUNCH_DATE).cast("date")), F.lit(0))
    ramp = F.lit(GROWTH_START) + F.lit(GROWTH_GAIN) * age / F.lit(float(GROWTH_DAYS))
    return F.least(ramp, F.lit(1.0))


def expected_events(day: Column) -> Column:
    """Events expected on a day: whole number, at least 1."""
    volume = F.lit(float(BASE_EVENTS_PER_DAY)) * weekday_weight(day) * month_weight(day)
    volume = F.when(is_holiday(day), volume * F.lit(HOLIDAY_BOOST)).otherwise(volume)
    return F.greatest(F.floor(volume * growth_ramp(day)).cast("long"), F.lit(1).cast("long"))


def date_dimension(spark: SparkSession, first: str, last: str) -> DataFrame:
    """One row per day from ``first`` to ``last``, both included."""
    days = F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))
    return with_calendar(spark.range(1).select(F.explode(days).alias("event_date")))


def with_calendar(days: DataFrame, column: str = "event_date") -> DataFrame:
    """Add the calendar columns to any frame that has a date."""
    day = F.col(column)
    return days.withColumns({
        "day_of_week": day_of_week(day),
        "is_weekend": is_weekend(day),
        "is_holiday": is_holiday(day),
        "weekday_weight": weekday_weight(day),
        "month_weight": month_weight(day),
        "growth": growth_ramp(day),
        "expected_events": expected_events(day),
    })
