"""Staging, enrichment and marts on the awkward rows, in both join strategies."""

import re

import pytest
from pyspark.sql import functions as F

from small_data import DAY1, DAY2, mart_inputs, raw_tables, staged
from tunelake.functions import measures as m
from tunelake.plans import marts
from tunelake.plans.enrich import enriched_events
from tunelake.plans.staging import stg_stream_events


@pytest.fixture(params=["broadcast", "shuffle"])
def models(request, spark):
    if request.param == "shuffle":
        request.getfixturevalue("no_broadcast")
    return staged(spark)


def rows_by(df, *keys):
    return {tuple(row[k] for k in keys) if len(keys) > 1 else row[keys[0]]: row
            for row in df.collect()}


def test_staged_events(spark):
    events = rows_by(staged(spark)["stg_stream_events"], "event_id")
    assert events["e1"].event_date == DAY1 and events["e2"].event_date == DAY1
    assert events["e4"].event_date == DAY2
    assert events["e1"].pct_played == 80.0
    assert events["e8"].pct_played == 6.6  # half rounds up
    assert events["e6"].pct_played is None  # zero duration
    assert events["e5"].is_completed is None


def test_staging_accepts_iso_text(spark):
    raw = raw_tables(spark)["stream_events"]
    text = raw.withColumn("started_at", F.date_format("started_at", "yyyy-MM-dd'T'HH:mm:ss"))
    assert sorted(stg_stream_events(text).collect()) == sorted(stg_stream_events(raw).collect())


def test_staged_tracks(spark):
    tracks = rows_by(staged(spark)["stg_tracks"], "track_id")
    assert tracks["t2"].duration_seconds == 200.1
    assert tracks["t2"].is_explicit is True


def test_enriched_keeps_every_event_and_nulls_unknown_ids(models):
    fact = rows_by(enriched_events(*mart_inputs(models)), "event_id")
    assert len(fact) == 9 and len(next(iter(fact.values()))) == 29
    assert fact["e5"].track_id is None and fact["e5"].user_id == "u2"
    assert fact["e6"].user_id is None and fact["e6"].track_id == "t2"
    assert fact["e4"].track_id == "t3" and fact["e4"].artist_id is None
    assert (fact["e9"].user_id, fact["e9"].track_id) == (None, None)
    assert fact["e1"].artist_country == "US" and fact["e3"].user_country == "DE"
    assert fact["e2"].track_duration_ms_catalog == 200_050


def test_daily(models):
    days = rows_by(marts.daily_listening_stats(*mart_inputs(models)), "event_date")
    one, two = days[DAY1], days[DAY2]
    assert (one.total_streams, one.active_users, one.unique_tracks_played,
            one.unique_artists_played) == (3, 2, 2, 2)
    assert (two.total_streams, two.active_users, two.unique_tracks_played,
            two.unique_artists_played) == (6, 1, 3, 2)
    assert one.completed_streams == 1 and one.completion_rate_pct == 33.33
    assert two.completed_streams == 1 and two.completion_rate_pct == 16.67  # NULL flag counts below
    assert two.skipped_streams == 4 and two.offline_streams == 0
    assert (two.streams_ios, two.streams_web, two.streams_chromecast) == (2, 0, 1)
    assert (one.streams_free, one.streams_premium, two.streams_premium, two.streams_student) == (
        2, 1, 3, 0)
    assert one.avg_pct_played == pytest.approx((80 + 29 + 50) / 3)
    assert two.avg_pct_played == pytest.approx((90 + 10 + 12.3 + 6.6 + 1) / 5)
    assert one.total_listening_hours == pytest.approx(159_000 / 3_600_000)


def test_top_tracks(models):
    top = rows_by(marts.top_tracks_daily(*mart_inputs(models)), "event_date", "track_id")
    assert top[DAY1, "t1"].daily_rank == 1 and top[DAY1, "t1"].unique_listeners == 2
    unknown = top[DAY2, None]  # e5, e7 and e9 form one entry
    assert (unknown.stream_count, unknown.unique_listeners, unknown.daily_rank) == (3, 1, 1)
    assert unknown.track_title is None
    assert [top[DAY2, t].daily_rank for t in ("t2", "t3", "t4")] == [2, 3, 4]  # ties by id
    assert top[DAY2, "t2"].unique_listeners == 0  # its listener is unknown
    assert top[DAY2, "t3"].artist_id is None and top[DAY2, "t3"].genre == "Jazz"


def test_top_tracks_cuts_at_k(models):
    top = marts.top_tracks_daily(*mart_inputs(models), k=2).collect()
    assert sorted((r.event_date, r.daily_rank) for r in top) == [
        (DAY1, 1), (DAY1, 2), (DAY2, 1), (DAY2, 2)]


def test_genres(models):
    genres = rows_by(marts.genre_trends(*mart_inputs(models)), "event_date", "genre")
    assert set(genres) == {(DAY1, "Pop"), (DAY1, "Rock"), (DAY2, "Jazz"), (DAY2, "Rock")}
    assert genres[DAY1, "Pop"].pct_of_daily_streams == 66.67
    assert genres[DAY2, "Jazz"].pct_of_daily_streams == 50.0  # no genre: not in the total
    assert genres[DAY2, "Jazz"].daily_rank == genres[DAY2, "Rock"].daily_rank == 1
    assert genres[DAY2, "Rock"].unique_listeners == 0 and genres[DAY2, "Rock"].unique_artists == 1
    assert genres[DAY2, "Jazz"].unique_artists == 0 and genres[DAY2, "Jazz"].unique_tracks == 1
    assert genres[DAY2, "Rock"].avg_pct_played is None


def test_users(models):
    users = rows_by(marts.user_activity(*mart_inputs(models)), "user_id")
    assert set(users) == {"u1", "u2", "idle"}
    idle = users["idle"]
    assert (idle.total_streams, idle.unique_tracks, idle.total_listening_hours,
            idle.shuffle_streams) == (0, 0, 0.0, 0)
    assert idle.completion_rate_pct is None and idle.top_genre is None
    u2 = users["u2"]
    assert (u2.total_streams, u2.unique_tracks, u2.unique_artists, u2.active_days) == (4, 3, 1, 2)
    assert (u2.first_stream_date, u2.last_stream_date) == (DAY1, DAY2)
    assert u2.top_genre == "Jazz"  # Jazz and Pop tie
    assert (u2.preferred_platform, u2.preferred_device) == ("ios", "mobile")
    assert users["u1"].preferred_platform == "ios"  # ios and web tie
    assert users["u1"].shuffle_streams == 1 and u2.offline_streams == 1


@pytest.mark.parametrize("value, digits, expected", [
    (1.005, 2, 1.0), (54.949999999999996, 1, 55.0), (0.25, 1, 0.3), (-0.25, 1, -0.3), (2.5, 0, 3.0),
    (0.0, 1, 0.0), (33.333333, 2, 33.33),
])
def test_round_half_matches_scaling(spark, value, digits, expected):
    got = spark.range(1).selectExpr(f"{m.round_half(f'{value!r}D', digits)} as x").first().x
    assert got == expected


def test_marts_equal_grouping_the_enriched_events(spark, models):
    """The marts aggregate before they look up; grouping after gives the same."""
    inputs = mart_inputs(models)
    enriched_events(*inputs).createOrReplaceTempView("fact")
    plain = spark.sql("""
        select event_date, count(*) total_streams, count(distinct user_id) active_users,
               count(distinct track_id) unique_tracks_played,
               count(distinct artist_id) unique_artists_played
        from fact group by event_date""")
    mart = marts.daily_listening_stats(*inputs).select(plain.columns)
    assert sorted(mart.collect()) == sorted(plain.collect())


@pytest.mark.parametrize("threshold", ["10m", "-1"])
def test_user_activity_reads_events_twice_and_meets_the_catalog_once(spark, threshold):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        mart = marts.user_activity(*mart_inputs(staged(spark)))
        plan = mart._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    lines = plan.split("\n")
    pairs = [x for x in lines if re.search(r"Exchange hashpartitioning\(user_id#\d+, track_id#\d+", x)]
    assert len(pairs) == 1
    values = [x for x in lines if re.search(
        r"Exchange hashpartitioning\(user_id#\d+, kind#\d+, value#\d+", x)]
    assert len(values) == 1
    scans = sum("Scan parquet" in x and "ms_played" in x or "Scan parquet" in x and "track_id" in x
                and "user_id" in x for x in lines)
    # With nothing broadcast, the hot tracks are counted in a pass of their own.
    assert scans == 2


def test_track_columns_do_not_travel_with_the_events(spark, models, no_broadcast):
    fact = enriched_events(*mart_inputs(models))
    plan = fact._jdf.queryExecution().optimizedPlan()
    while "Join" not in plan.nodeName():
        plan = plan.children().apply(0)
    # The last join is the track's, and what it joins has none of the track's columns yet.
    carried = plan.children().apply(0).output()
    columns = [carried.apply(i).name() for i in range(carried.size())]
    assert "username" in columns and "track_title" not in columns


def test_user_rows_are_dealt_by_user_before_they_are_summed(spark, models, no_broadcast):
    events, tracks, artists, users = mart_inputs(models)
    activity = marts.user_activity(events, tracks, artists, users)
    plan = activity._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression [user_id") == 2
    # Where hot keys are counted changes nothing.
    other = marts.user_activity(events, tracks, artists, users, keys_of={
        "user_id": events.limit(1), "track_id": events.limit(2)})
    assert sorted(map(str, other.collect())) == sorted(map(str, activity.collect()))
