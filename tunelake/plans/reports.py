"""The queries people ask of the marts."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunelake.functions.calendar import with_calendar


def _yesterday(as_of: date | None) -> Column:
    today = F.current_date() if as_of is None else F.lit(as_of)
    return F.date_sub(today, 1)


def last_days(daily: DataFrame, n: int = 7) -> DataFrame:
    """The ``n`` most recent days."""
    return daily.orderBy(F.desc("event_date")).limit(n)


def top_tracks_of_yesterday(top_tracks: DataFrame, n: int = 10, as_of: date | None = None) -> DataFrame:
    return (
        top_tracks.where(F.col("event_date") == _yesterday(as_of))
        .orderBy("daily_rank").limit(n)
    )


def genres_of_yesterday(genres: DataFrame, as_of: date | None = None) -> DataFrame:
    return genres.where(F.col("event_date") == _yesterday(as_of)).orderBy("daily_rank")


def volume_against_expected(daily_volume: DataFrame) -> DataFrame:
    """Actual streams of each day next to the calendar's expected number."""
    return with_calendar(daily_volume).withColumn(
        "actual_to_expected", F.expr("total_streams / cast(expected_events as double)")
    )
