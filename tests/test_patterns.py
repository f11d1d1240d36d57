"""Pattern checks, calendar and keys."""

import hashlib
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tunelake.functions import calendar as cal
from tunelake.functions import keys
from tunelake.plans import patterns, reports


def days(spark, volume):
    rows = [(date(2025, 1, 1) + timedelta(d), volume(date(2025, 1, 1) + timedelta(d)))
            for d in range(365)]
    return spark.createDataFrame(rows, "event_date date, total_streams long")


def test_weekend_and_season(spark):
    daily = days(spark, lambda d: (130 if d.weekday() >= 5 else 100) * (2 if d.month in (11, 12, 1)
                                                                        else 1))
    assert patterns.weekend_ratio(daily).first().ratio == pytest.approx(1.3, rel=0.02)
    assert patterns.seasonal_ratio(daily).first().ratio == pytest.approx(2, rel=0.02)


def test_missing_side_gives_no_ratio(spark):
    daily = days(spark, lambda d: 5).where("month(event_date) = 6")
    assert patterns.seasonal_ratio(daily).first().ratio is None
    events = spark.createDataFrame([(datetime(2025, 1, 1, 19),)], "started_at timestamp_ntz")
    assert tuple(patterns.evening_ratio(events).first()) == (1, None, None)


def test_evening_hours_are_inclusive(spark):
    hours = [17, 18, 22, 23, 1, 2, 5, 6]
    events = spark.createDataFrame([(datetime(2025, 1, 1, h, 59, 59),) for h in hours],
                                   "started_at timestamp_ntz")
    assert tuple(patterns.evening_ratio(events).first()) == (2, 2, 1.0)


def test_summary_statuses(spark):
    rows = [(f"e{i}", "u1" if i % 10 else f"u{i}", f"t{i % 4}", datetime(2025, 6, 2, 20),
             date(2025, 6, 2)) for i in range(40)]
    events = spark.createDataFrame(
        rows, "event_id string, user_id string, track_id string, started_at timestamp_ntz, "
              "event_date date")
    tracks = spark.createDataFrame([("t0", "a"), ("t1", "b")], "track_id string, artist_id string")
    found = {r.check: r.status for r in patterns.pattern_summary(events, tracks).collect()}
    assert found == {
        "weekend_vs_weekday": "info", "evening_vs_overnight": "info", "winter_vs_summer": "info",
        "top_users": "pass", "top_tracks": "info", "top_artists": "info",
    }
    assert patterns.all_passed(patterns.pattern_summary(events, tracks).collect())


def expected(d):
    """The curve in plain Python, one factor after the other."""
    n = 5000 * cal.WEEKDAY_WEIGHT[d.weekday()] * cal.MONTH_WEIGHT[d.month - 1]
    if (d.month, d.day) >= (12, 20) or (d.month, d.day) <= (1, 5):
        n *= 1.30
    age = max(0, (d - date(2025, 1, 1)).days)
    return max(1, int(n * min(0.30 + 0.70 * age / 540, 1.0)))


def test_expected_volume(spark):
    rows = cal.date_dimension(spark, "2024-11-01", "2026-12-31").collect()
    assert len(rows) == 791
    assert {r.event_date: r.expected_events for r in rows} == {
        r.event_date: expected(r.event_date) for r in rows}
    by_day = {r.event_date: r for r in rows}
    assert by_day[date(2025, 1, 4)].day_of_week == 6 and by_day[date(2025, 1, 4)].is_weekend
    assert by_day[date(2025, 1, 5)].is_holiday and not by_day[date(2025, 1, 6)].is_holiday
    assert by_day[date(2024, 12, 20)].is_holiday and not by_day[date(2024, 12, 19)].is_holiday


def test_keys(spark):
    row = spark.range(3, 4).select(
        keys.surrogate_key(F.lit("user"), F.col("id")).alias("user"),
        keys.event_key(F.lit("2025-01-04").cast("date"), F.col("id")).alias("event"),
        keys.natural_event_key(F.lit("2025-01-04").cast("date"), F.col("id")).alias("natural"),
    ).first()

    def shaped(text):
        h = hashlib.md5(text.encode()).hexdigest()
        return "-".join([h[:8], h[8:12], h[12:16], h[16:20], h[20:]])

    assert tuple(row) == (shaped("user-3"), shaped("event-2025-01-04-3"), "ev-2025-01-04-3")


def test_reports(spark):
    daily = days(spark, lambda d: d.day)
    assert [r.event_date for r in reports.last_days(daily, 2).collect()] == [
        date(2025, 12, 31), date(2025, 12, 30)]
    ranks = spark.createDataFrame(
        [(date(2025, 1, 4), r) for r in (3, 1, 2)] + [(date(2025, 1, 5), 1)],
        "event_date date, daily_rank long")
    top = reports.top_tracks_of_yesterday(ranks, 2, as_of=date(2025, 1, 5)).collect()
    assert [r.daily_rank for r in top] == [1, 2]
    assert reports.genres_of_yesterday(ranks, as_of=date(2025, 1, 5)).count() == 3
    yesterday = date.today() - timedelta(1)
    recent = spark.createDataFrame([(yesterday, 1)], "event_date date, daily_rank long")
    assert reports.genres_of_yesterday(recent).count() == 1
    row = reports.volume_against_expected(daily).where("event_date = '2025-06-10'").first()
    assert row.actual_to_expected == pytest.approx(10 / expected(date(2025, 6, 10)))
