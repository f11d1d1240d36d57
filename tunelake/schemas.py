"""Fixed schemas, keys and value domains of the raw tables.

Values below are fixed: names, types, keys and accepted values must be exactly these.
"""

from __future__ import annotations

from pyspark.sql import types as T

STRING, INT, DOUBLE, BOOL, DATE = (
    T.StringType(), T.IntegerType(), T.DoubleType(), T.BooleanType(), T.DateType(),
)
TIMESTAMP = T.TimestampNTZType()


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


LINEAGE = {"_dlt_load_id": STRING, "_dlt_id": STRING}

RAW = {
    "artists": _schema(
        artist_id=STRING, name=STRING, genre=STRING, country=STRING,
        monthly_listeners=INT, created_at=DATE, popularity_rank=INT, **LINEAGE,
    ),
    "albums": _schema(
        album_id=STRING, title=STRING, artist_id=STRING, release_date=DATE,
        num_tracks=INT, genre=STRING, **LINEAGE,
    ),
    "tracks": _schema(
        track_id=STRING, title=STRING, artist_id=STRING, album_id=STRING, duration_ms=INT,
        genre=STRING, release_year=INT, explicit=BOOL, tempo_bpm=INT, energy_score=DOUBLE,
        popularity_rank=INT, **LINEAGE,
    ),
    "users": _schema(
        user_id=STRING, username=STRING, email=STRING, country=STRING,
        subscription_type=STRING, age_group=STRING, joined_at=DATE, popularity_rank=INT,
        **LINEAGE,
    ),
    "stream_events": _schema(
        event_id=STRING, user_id=STRING, track_id=STRING, started_at=TIMESTAMP,
        ms_played=INT, track_duration_ms=INT, completed=BOOL, skipped=BOOL,
        device_type=STRING, platform=STRING, shuffle_mode=BOOL, offline_mode=BOOL, **LINEAGE,
    ),
}

PRIMARY_KEY = {
    "artists": "artist_id",
    "albums": "album_id",
    "tracks": "track_id",
    "users": "user_id",
    "stream_events": "event_id",
}
EVENTS = "stream_events"
DIMENSIONS = ["artists", "albums", "tracks", "users"]

# Accepted values, in their natural order.
PLATFORMS = ["ios", "android", "web", "chromecast", "alexa"]
DEVICE_TYPES = ["mobile", "desktop", "tablet", "smart_speaker", "tv"]
SUBSCRIPTION_TYPES = ["free", "premium", "family", "student"]
AGE_GROUPS = ["13-17", "18-24", "25-34", "35-44", "45-54", "55+"]


def landed(table: str) -> T.StructType:
    """The schema of a landed JSON record: the raw columns, with dates and timestamps as ISO text
    and no lineage columns."""
    return T.StructType([
        T.StructField(f.name, STRING if f.dataType in (DATE, TIMESTAMP) else f.dataType)
        for f in RAW[table].fields
        if f.name not in LINEAGE
    ])


def envelope(table: str) -> T.StructType:
    """The schema of one landed page: its records and the paging fields around them."""
    return T.StructType([
        T.StructField("data", T.ArrayType(landed(table))),
        T.StructField("date", STRING),
        T.StructField("page", INT),
        T.StructField("page_size", INT),
        T.StructField("total", INT),
        T.StructField("has_more", BOOL),
    ])
