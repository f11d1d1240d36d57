"""Pattern checks over the loaded data: seasonality and concentration."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from tunelake.functions.calendar import is_weekend
from tunelake.operators.pareto import pareto_share
from tunelake.plans.marts import daily_volume

# The limits a ratio must exceed and a share must reach.
MIN_WEEKEND_RATIO, MIN_EVENING_RATIO, MIN_SEASON_RATIO = 1.10, 3.0, 1.10
MIN_USER_SHARE, MIN_TRACK_SHARE, MIN_ARTIST_SHARE = 70.0, 70.0, 60.0
EVENING_HOURS, OVERNIGHT_HOURS = (18, 22), (2, 5)
WINTER_MONTHS, SUMMER_MONTHS = (11, 12, 1), (6, 7, 8)


def _ratio(high: Column, low: Column) -> Column:
    """NULL if either side is missing or zero: too little data for a verdict."""
    return F.when((high != 0) & (low != 0), high.cast("double") / low.cast("double"))


def weekend_ratio(daily: DataFrame) -> DataFrame:
    """Average streams of a weekend day against a weekday."""
    streams, weekend = F.col("total_streams"), is_weekend(F.col("event_date"))
    return daily.agg(
        F.avg(F.when(weekend, streams)).alias("avg_weekend"),
        F.avg(F.when(~weekend, streams)).alias("avg_weekday"),
    ).withColumn("ratio", _ratio(F.col("avg_weekend"), F.col("avg_weekday")))


def evening_ratio(events: DataFrame) -> DataFrame:
    """Streams started in the evening against those started overnight."""
    hour = F.hour("started_at")
    return events.agg(
        F.sum(F.when(hour.between(*EVENING_HOURS), 1)).alias("evening"),
        F.sum(F.when(hour.between(*OVERNIGHT_HOURS), 1)).alias("overnight"),
    ).withColumn("ratio", _ratio(F.col("evening"), F.col("overnight")))


def seasonal_ratio(daily: DataFrame) -> DataFrame:
    """Average streams of a winter day against a summer day."""
    streams, month = F.col("total_streams"), F.month("event_date")
    return daily.agg(
        F.avg(F.when(month.isin(*WINTER_MONTHS), streams)).alias("winter_avg"),
        F.avg(F.when(month.isin(*SUMMER_MONTHS), streams)).alias("summer_avg"),
    ).withColumn("ratio", _ratio(F.col("winter_avg"), F.col("summer_avg")))


def pareto_users(events: DataFrame) -> DataFrame:
    return pareto_share(events, "user_id")


def pareto_tracks(events: DataFrame) -> DataFrame:
    return pareto_share(events, "track_id")


def pareto_artists(events: DataFrame, tracks: DataFrame) -> DataFrame:
    """Streams of unknown tracks are left out. Streams are counted per track before the join, so
    the events themselves do not shuffle on a track id."""
    return _pareto_artists(_per_track(events), tracks)


def _per_track(events: DataFrame) -> DataFrame:
    return events.groupBy("track_id").agg(F.count("*").alias("n"))


def _pareto_artists(per_track: DataFrame, tracks: DataFrame) -> DataFrame:
    per_artist = per_track.join(tracks.select("track_id", "artist_id"), "track_id")
    return pareto_share(per_artist, "artist_id", weight="n")


def _verdict(df: DataFrame, check: str, value: str, limit: float, reached: bool) -> DataFrame:
    actual = F.col(value)
    ok = actual >= limit if reached else actual > limit
    return df.select(
        F.lit(check).alias("check"),
        actual.alias("value"),
        F.lit(limit).alias("threshold"),
        F.when(actual.isNull(), "info").when(ok, "pass").otherwise("fail").alias("status"),
    )


def pattern_summary(
    events: DataFrame, tracks: DataFrame, daily: DataFrame | None = None
) -> DataFrame:
    """All six checks as (check, value, threshold, status). A check without enough data has status
    ``info`` and counts neither way. ``daily`` is the built daily mart; without it the days are
    counted from the events. The counts per track are the same exchange for tracks and artists."""
    daily = daily_volume(events) if daily is None else daily
    per_track = _per_track(events)
    checks = [
        _verdict(weekend_ratio(daily), "weekend_vs_weekday", "ratio", MIN_WEEKEND_RATIO, False),
        _verdict(evening_ratio(events), "evening_vs_overnight", "ratio", MIN_EVENING_RATIO, False),
        _verdict(seasonal_ratio(daily), "winter_vs_summer", "ratio", MIN_SEASON_RATIO, False),
        _verdict(pareto_users(events), "top_users", "top_pct", MIN_USER_SHARE, True),
        _verdict(
            pareto_share(per_track, "track_id", weight="n"), "top_tracks", "top_pct",
            MIN_TRACK_SHARE, True
        ),
        _verdict(
            _pareto_artists(per_track, tracks), "top_artists", "top_pct", MIN_ARTIST_SHARE, True
        ),
    ]
    return reduce(DataFrame.unionByName, checks)


def all_passed(summary: list[Row]) -> bool:
    """True if no check of a collected summary failed; ``info`` counts neither way."""
    return all(row.status != "fail" for row in summary)
