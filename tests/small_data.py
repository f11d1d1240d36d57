"""A small set of raw tables with the awkward rows: unknown track and user, a track without artist
or genre, an idle user, NULL flags, ties, a zero duration, events next to midnight."""

from __future__ import annotations

from datetime import date, datetime
from functools import cache

from tunelake.plans.staging import stage
from tunelake.schemas import RAW
from tunelake.session import scratch_path
from tunelake.sources.tables import from_rows, read_raw

NO_LINEAGE = (None, None)
DAY1, DAY2 = date(2025, 1, 3), date(2025, 1, 4)


def at(day: date, hour: int, minute: int = 0, second: int = 0) -> datetime:
    return datetime(day.year, day.month, day.day, hour, minute, second)


ARTISTS = [
    ("a1", "Ann", "Pop", "US", 100, date(2020, 1, 1), 1),
    ("a2", "Bob", "Rock", "GB", 50, date(2021, 1, 1), 2),
]
ALBUMS = [("b1", "First", "a1", date(2022, 5, 1), 2, "Pop")]
TRACKS = [
    ("t1", "One", "a1", "b1", 100_000, "Pop", 2020, False, 120, 0.5, 1),
    ("t2", "Two", "a2", "b1", 200_050, "Rock", 2021, True, 90, 0.7, 2),
    ("t3", "Three", "gone", "b1", 150_000, "Jazz", 2022, False, 100, 0.1, 3),
    ("t4", "Four", "a1", "b1", 150_000, None, 2022, False, 100, 0.1, 4),
]
USERS = [
    ("u1", "una", "u1@x", "US", "free", "18-24", date(2025, 1, 1), 1),
    ("u2", "duo", "u2@x", "DE", "premium", "25-34", date(2025, 1, 2), 2),
    ("idle", "idle", "i@x", "DE", "student", "55+", date(2025, 1, 2), 3),
]
EVENTS = [
    # id, user, track, start, played, duration, completed, skipped, device, platform, shuffle, off
    ("e1", "u1", "t1", at(DAY1, 0), 80_000, 100_000, True, False, "mobile", "ios", True, False),
    ("e2", "u1", "t2", at(DAY1, 23, 59, 59), 29_000, 100_000, False, True, "tv", "web", False,
     False),
    ("e3", "u2", "t1", at(DAY1, 19), 50_000, 100_000, False, False, "mobile", "ios", False, True),
    ("e4", "u2", "t3", at(DAY2, 0), 90_000, 100_000, True, False, "desktop", "alexa", None, None),
    ("e5", "u2", "nope", at(DAY2, 3), 10_000, 100_000, None, None, "tv", "android", None, None),
    ("e6", "ghost", "t2", at(DAY2, 4), 10_000, 0, False, True, "tv", "chromecast", False, False),
    ("e7", "ghost", "lost", at(DAY2, 20), 12_345, 100_000, False, True, "tv", "other", False,
     False),
    ("e8", "u2", "t4", at(DAY2, 21), 6_550, 100_000, False, True, "mobile", "ios", True, False),
    ("e9", None, None, at(DAY2, 22), 1_000, 100_000, False, True, "mobile", "ios", True, False),
]


@cache
def _written(spark):
    """Files have a size that the planner knows; rows from Python do not."""
    rows = {"artists": ARTISTS, "albums": ALBUMS, "tracks": TRACKS, "users": USERS,
            "stream_events": EVENTS}
    root = scratch_path(spark, "small")
    for table, values in rows.items():
        frame = from_rows(spark, [row + NO_LINEAGE for row in values], table)
        frame.coalesce(1).write.parquet(f"{root}/{table}")
    return root


def raw_tables(spark):
    return {table: read_raw(spark, f"{_written(spark)}/{table}", table) for table in RAW}


def staged(spark):
    return stage(raw_tables(spark))


def mart_inputs(models):
    return (models["stg_stream_events"], models["stg_tracks"], models["stg_artists"],
            models["stg_users"])
