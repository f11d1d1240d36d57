"""Staging models: one per raw table, with final names and types.

The casts accept both forms of the raw tables: typed columns, or ISO text for dates and times.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from tunelake.functions import measures as m


def stg_artists(raw: DataFrame) -> DataFrame:
    return raw.selectExpr(
        "artist_id",
        "name as artist_name",
        "genre",
        "country",
        "cast(monthly_listeners as int) as monthly_listeners",
        "cast(created_at as date) as created_date",
        "cast(popularity_rank as int) as popularity_rank",
    )


def stg_albums(raw: DataFrame) -> DataFrame:
    return raw.selectExpr(
        "album_id",
        "title as album_title",
        "artist_id",
        "cast(release_date as date) as release_date",
        "cast(num_tracks as int) as num_tracks",
        "genre",
    )


def stg_tracks(raw: DataFrame) -> DataFrame:
    return raw.selectExpr(
        "track_id",
        "title as track_title",
        "artist_id",
        "album_id",
        "cast(duration_ms as int) as duration_ms",
        f"{m.seconds('duration_ms')} as duration_seconds",
        "genre",
        "cast(release_year as int) as release_year",
        "cast(explicit as boolean) as is_explicit",
        "cast(tempo_bpm as int) as tempo_bpm",
        "cast(energy_score as double) as energy_score",
        "cast(popularity_rank as int) as popularity_rank",
    )


def stg_users(raw: DataFrame) -> DataFrame:
    return raw.selectExpr(
        "user_id",
        "username",
        "email",
        "country",
        "subscription_type",
        "age_group",
        "cast(joined_at as date) as joined_date",
        "cast(popularity_rank as int) as popularity_rank",
    )


def stg_stream_events(raw: DataFrame) -> DataFrame:
    """Events with their day and percentage played. A table partitioned by ``event_date`` already
    has that column; it is kept as it is, so filters on it prune partitions."""
    stored = "event_date" in raw.columns
    day = "event_date" if stored else "cast(cast(started_at as timestamp_ntz) as date)"
    return raw.selectExpr(
        "event_id",
        "user_id",
        "track_id",
        "cast(started_at as timestamp_ntz) as started_at",
        f"{day} as event_date",
        "cast(ms_played as int) as ms_played",
        "cast(track_duration_ms as int) as track_duration_ms",
        f"{m.percent_played('ms_played', 'track_duration_ms')} as pct_played",
        "cast(completed as boolean) as is_completed",
        "cast(skipped as boolean) as is_skipped",
        "device_type",
        "platform",
        "cast(shuffle_mode as boolean) as is_shuffle",
        "cast(offline_mode as boolean) as is_offline",
    )


MODELS = {
    "artists": stg_artists,
    "albums": stg_albums,
    "tracks": stg_tracks,
    "users": stg_users,
    "stream_events": stg_stream_events,
}


def stage(raw: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Staged models by name (``stg_<table>``) for the raw tables given."""
    return {f"stg_{table}": MODELS[table](df) for table, df in raw.items()}
