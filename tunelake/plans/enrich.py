"""The catalog (tracks with their artists) and the enriched event fact."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame

from tunelake.functions import measures as m
from tunelake.operators.lookups import lookup


#: The columns of an enriched event, by the model they come from.
ENRICHED = {
    "event": [
        "event_id", "started_at", "event_date", "ms_played", "track_duration_ms", "pct_played",
        "is_completed", "is_skipped", "device_type", "platform", "is_shuffle", "is_offline",
    ],
    "track": [
        "track_id", "track_title", "genre", "release_year", "is_explicit", "tempo_bpm",
        "energy_score", "duration_ms as track_duration_ms_catalog",
    ],
    "artist": ["artist_id", "artist_name", "country as artist_country"],
    "user": ["user_id", "username", "country as user_country", "subscription_type", "age_group",
             "joined_date"],
}


def catalog(tracks: DataFrame, artists: DataFrame) -> DataFrame:
    """Staged tracks with their artist. ``artist_id`` is the artist's own: NULL if the track names
    an artist that does not exist. Joining the dimensions first means a fact needs one lookup to
    reach both."""
    artist = artists.selectExpr("artist_id", "artist_name", "country as artist_country")
    return lookup(tracks, artist, "artist_id", spread="track_id")


#: What of an event goes through the lookups: columns of many values first, then those of few, which
#: compress as one. The percentage played follows from others and is worked out at the end.
CARRIED = [
    "event_id", "user_id", "track_id", "started_at", "ms_played", "track_duration_ms", "event_date",
    "is_completed", "is_skipped", "is_shuffle", "is_offline", "device_type", "platform",
]


def enriched_events(
    events: DataFrame, tracks: DataFrame, artists: DataFrame, users: DataFrame,
    keys_of: Mapping[str, DataFrame] | None = None,
) -> DataFrame:
    """Staged events with their track, artist and user. Every event is kept; ids of dimension rows
    that do not exist are NULL.

    The user comes first and the track, which has most columns, last, so that these never travel with
    the events. ``keys_of`` may name for ``track_id`` and ``user_id`` a table in which hot keys are
    counted, if the events themselves are made by joins."""
    song = catalog(tracks, artists).selectExpr(
        "track_id", "track_title", "genre", "release_year", "is_explicit", "tempo_bpm",
        "energy_score", "duration_ms as track_duration_ms_catalog",
        "artist_id", "artist_name", "artist_country",
    )
    listener = users.selectExpr(
        "user_id", "username", "country as user_country", "subscription_type", "age_group",
        "joined_date",
    )
    keys_of = {"user_id": events, "track_id": events, **(keys_of or {})}
    fact = events.select(*CARRIED)
    for dim, key in ((listener, "user_id"), (song, "track_id")):
        fact = lookup(fact, dim, key, spread="event_id", keys_of=keys_of[key])
    fact = fact.selectExpr(
        "*", f"{m.percent_played('ms_played', 'track_duration_ms')} as pct_played")
    return fact.select(*(c.rsplit(" as ", 1)[-1] for names in ENRICHED.values() for c in names))
