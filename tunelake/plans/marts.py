"""The four marts, from staged models.

They give what grouping the enriched events would give, but aggregate *before* they look up: the
events are first reduced to one row per (day, user), (day, track) and so on, combined within each
task, and only those rows meet a dimension. Raw events never shuffle on a user or track id alone,
so neither a hot user nor a hot track ends up in one task, and a dimension too large to broadcast
costs a shuffle of the reduced rows only. A track's rows may still be many there: hot ones are salted.

Dimension keys are unique (the loads keep them so, and the data tests check it).
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunelake.functions import measures as m
from tunelake.operators.lookups import (
    fits_broadcast, hot_keys, in_parts, known_key, lookup,
)
from tunelake.operators.ranking import top_per_group
from tunelake.plans.enrich import catalog
from tunelake.schemas import PLATFORMS, SUBSCRIPTION_TYPES

TOP_TRACKS = 100

# Sums that can be summed again at a coarser grain.
ADDITIVE = [
    "count(*) as streams",
    "sum(ms_played) as ms",
    f"sum({m.tenths('pct_played')}) as tenths",
    "count(pct_played) as played",
    "sum(cast(is_completed as int)) as completions",
    "sum(cast(is_skipped as int)) as skips",
    "sum(cast(is_shuffle as int)) as shuffles",
    "sum(cast(is_offline as int)) as offlines",
]
AVG_PCT = f"{m.mean_of_tenths('sum(tenths)', 'sum(played)')} as avg_pct_played"
COMPLETION_RATE = f"{m.rate_pct('sum(completions)', 'sum(streams)')} as completion_rate_pct"
SKIP_RATE = f"{m.rate_pct('sum(skips)', 'sum(streams)')} as skip_rate_pct"


def _exprs(sql: list[str]) -> list[Column]:
    return [F.expr(s) for s in sql]


def _stack(*parts: DataFrame) -> DataFrame:
    """Rows of all parts; a measure that a part lacks is NULL there and drops out of the sums."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def daily_volume(events: DataFrame) -> DataFrame:
    """Streams per day: all that the day-level pattern checks need."""
    return events.groupBy("event_date").agg(F.expr("count(*) as total_streams"))


def daily_listening_stats(
    events: DataFrame, tracks: DataFrame, artists: DataFrame, users: DataFrame
) -> DataFrame:
    """One row per day: volume, engagement, platform and subscription breakdown.

    Three reductions of the events meet in a single final aggregate on the day: the events' own
    measures, (day, user) and (day, track).
    """
    measures = events.groupBy("event_date").agg(*_exprs(
        ADDITIVE + [f"sum({m.matches('platform', p)}) as streams_{p}" for p in PLATFORMS]
    ))

    per_user = events.groupBy("event_date", "user_id").agg(F.expr("count(*) as n"))
    listeners = lookup(per_user, users.select("user_id", "subscription_type"), "user_id")
    listeners = listeners.selectExpr(
        "event_date",
        "cast(user_id is not null as int) as users",
        *(f"{m.matches('subscription_type', s, 'n')} as streams_{s}" for s in SUBSCRIPTION_TYPES),
    )

    songs = catalog(tracks, artists).select("track_id", "artist_id")
    heard = lookup(events.select("event_date", "track_id").distinct(), songs, "track_id")
    performers = heard.groupBy("event_date", "artist_id").agg(
        F.expr("count(track_id) as tracks"),
        F.expr("cast(artist_id is not null as int) as artists"),
    ).drop("artist_id")

    return (
        _stack(measures, listeners, performers)
        .groupBy("event_date")
        .agg(*_exprs([
            "sum(streams) as total_streams",
            "sum(users) as active_users",
            "sum(tracks) as unique_tracks_played",
            "sum(artists) as unique_artists_played",
            f"{m.hours('sum(ms)')} as total_listening_hours",
            AVG_PCT,
            "sum(completions) as completed_streams",
            "sum(skips) as skipped_streams",
            COMPLETION_RATE,
            SKIP_RATE,
            *(f"sum(streams_{v}) as streams_{v}" for v in PLATFORMS + SUBSCRIPTION_TYPES),
            "sum(offlines) as offline_streams",
            "sum(shuffles) as shuffle_streams",
        ]))
        .orderBy(F.desc("event_date"))
    )


def top_tracks_daily(
    events: DataFrame,
    tracks: DataFrame,
    artists: DataFrame,
    users: DataFrame,
    k: int = TOP_TRACKS,
) -> DataFrame:
    """The ``k`` most streamed tracks of each day. Streams of unknown tracks form one entry with
    no track. Ties go to the lower track id. Titles are looked up for the winners only."""
    keyed = known_key(events, tracks, "track_id", spread="event_id")
    keyed = known_key(keyed, users, "user_id", spread="event_id")
    rate = m.rate_pct("sum(cast(is_completed as int))", "count(*)")
    per_track = keyed.groupBy("event_date", "track_id").agg(*_exprs([
        "count(*) as stream_count",
        "count(distinct user_id) as unique_listeners",
        f"{m.hours('sum(ms_played)')} as listening_hours",
        f"{m.mean_of_tenths('sum(' + m.tenths('pct_played') + ')', 'count(pct_played)')}"
        " as avg_pct_played",
        "sum(cast(is_completed as int)) as completions",
        "sum(cast(is_skipped as int)) as skips",
        f"{rate} as completion_rate_pct",
    ]))
    winners = top_per_group(per_track, "event_date", "stream_count", "track_id", k)
    songs = catalog(tracks, artists).select(
        "track_id", "track_title", "artist_id", "artist_name", "genre", "release_year"
    )
    return (
        lookup(winners, songs, "track_id")
        .select(
            "event_date", "track_id", "track_title", "artist_id", "artist_name", "genre",
            "release_year", "stream_count", "unique_listeners", "listening_hours",
            "avg_pct_played", "completions", "skips", "completion_rate_pct", "daily_rank",
        )
        .orderBy(F.desc("event_date"), F.asc("daily_rank"))
    )


def genre_trends(
    events: DataFrame, tracks: DataFrame, artists: DataFrame, users: DataFrame,
    keys_of: Mapping[str, DataFrame] | None = None,
) -> DataFrame:
    """One row per day and genre: volume, share of the day and rank. Streams without a genre are
    left out before shares are taken. The rank window sees one row per genre and day. For ``keys_of``
    see ``enriched_events``."""
    songs = catalog(tracks, artists).select("track_id", "artist_id", "genre")

    per_track = events.groupBy("event_date", "track_id").agg(*_exprs(ADDITIVE))
    per_artist = (
        lookup(per_track, songs, "track_id").where("genre is not null")
        .groupBy("event_date", "genre", "artist_id")
        .agg(*_exprs([
            *(f"sum({c}) as {c}" for c in ("streams", "ms", "tenths", "played", "completions")),
            "count(*) as tracks",
            "cast(artist_id is not null as int) as artists",
        ]))
        .drop("artist_id")
    )

    # A user's repeated plays of a track on a day are one row before they meet the catalog.
    plays = events.select("event_date", "track_id", "user_id").distinct()
    audience = (
        lookup(plays, songs.select("track_id", "genre"), "track_id", spread="user_id",
               keys_of=(keys_of or {}).get("track_id", events))
        .where("genre is not null").select("event_date", "genre", "user_id").distinct()
    )
    listeners = lookup(audience, users.select("user_id"), "user_id").selectExpr(
        "event_date", "genre", "cast(user_id is not null as int) as users"
    )

    per_genre = _stack(per_artist, listeners).groupBy("event_date", "genre").agg(*_exprs([
        "sum(streams) as stream_count",
        "sum(users) as unique_listeners",
        "sum(tracks) as unique_tracks",
        "sum(artists) as unique_artists",
        f"{m.hours('sum(ms)')} as listening_hours",
        AVG_PCT,
        COMPLETION_RATE,
    ]))
    of_day = m.rate_pct("stream_count", "sum(stream_count) over (partition by event_date)")
    rank = "rank() over (partition by event_date order by stream_count desc)"
    return per_genre.selectExpr(
        "*", f"{of_day} as pct_of_daily_streams", f"cast({rank} as bigint) as daily_rank"
    ).orderBy(F.desc("event_date"), F.asc("daily_rank"))


NAMES = [a.rsplit(" as ", 1)[1] for a in ADDITIVE]
VALUES = ["n", *NAMES[1:]]


def _plays(events: DataFrame) -> DataFrame:
    return events.groupBy("user_id", "track_id").agg(F.expr("count(*) as n"))


#: What the reduction of a user's days, platforms and devices reads of an event.
USED = ["user_id", "event_date", "platform", "device_type", "ms_played", "pct_played", "is_completed",
        "is_skipped", "is_shuffle", "is_offline"]


def _used(events: DataFrame, *place: str) -> DataFrame:
    """Rows of (user, kind, value) for the days, platforms and devices of a user, with measures for
    the days. Columns ``place`` are those that the events are dealt by, if they are."""
    used = events.groupBy("user_id", *place, "event_date", "platform", "device_type").agg(
        *_exprs(ADDITIVE)).drop(*place)
    sums, none = ", ".join(NAMES), ", ".join(f"cast(null as {t})" for _, t in used.dtypes[4:])
    return used.selectExpr(
        "user_id",
        f"stack(3, 'day', cast(event_date as string), {sums}, "
        f"'platform', platform, streams, {none.split(', ', 1)[1]}, "
        f"'device', device_type, streams, {none.split(', ', 1)[1]}) as (kind, value, {sums})",
    ).withColumnRenamed("streams", "n")


def _dealt(rows: DataFrame, hot: DataFrame, spread: str) -> DataFrame:
    """The rows of a user together, those of a hot user in parts, so that what is summed per user is
    summed there and only sums go on."""
    return in_parts(rows, hot, "user_id", spread).repartition("user_id", "__part")


def user_values(events: DataFrame) -> DataFrame:
    """What ``user_activity`` needs of the events, in sums that can be added and subtracted: rows of
    (user, kind, value) for tracks, days, platforms and devices."""
    plays = _plays(events).selectExpr(
        "user_id", "'track' as kind", "cast(track_id as string) as value", "n")
    return summed_values(_stack(plays, _used(events)))


def summed_values(*parts: DataFrame, keep_zero: bool = False) -> DataFrame:
    """One row per (user, kind, value) that is still there; with ``keep_zero``, that has changed: its
    measures may differ although the number of streams is the same."""
    sums = _stack(*parts).groupBy("user_id", "kind", "value").agg(*_exprs([
        f"sum({c}) as {c}" for c in VALUES]))
    changed = " or ".join(f"coalesce({c}, 0) <> 0" for c in VALUES)
    return sums.where(changed if keep_zero else "n <> 0")


def user_activity(
    events: DataFrame, tracks: DataFrame, artists: DataFrame, users: DataFrame,
    keys_of: Mapping[str, DataFrame] | None = None,
) -> DataFrame:
    """One row per user, with zeros for a user who never listened.

    The events are reduced twice: by the user's track, which then meets the catalog, and by the
    user's day, platform and device. Both become rows of (user, kind, value): what a user heard or
    used, and how often. These are summed once on all three, so that even the busiest user's rows
    are spread over tasks, and arrive at the user as one row per value. With users too many to broadcast,
    a task would see few rows of each; then they are dealt by user first, hot users in parts. For
    ``keys_of`` see ``enriched_events``.
    """
    keys_of = {"user_id": events, "track_id": events, **(keys_of or {})}
    if fits_broadcast(users):
        return _activity(_plays(events), _used(events), tracks, artists, users, keys_of["track_id"])
    hot = F.broadcast(hot_keys(keys_of["user_id"], "user_id"))
    used = _used(_dealt(events, hot, "event_id").select(*USED, "__part"), "__part")
    return _activity(_plays(events), used, tracks, artists, users, keys_of["track_id"], hot)


def activity_of(
    values: DataFrame, tracks: DataFrame, artists: DataFrame, users: DataFrame
) -> DataFrame:
    """The same from ``user_values``, without the events."""
    plays = values.where("kind = 'track'").selectExpr("user_id", "value as track_id", "n")
    return _activity(plays, values.where("kind <> 'track'"), tracks, artists, users, plays)


def _activity(
    plays: DataFrame, used: DataFrame, tracks: DataFrame, artists: DataFrame, users: DataFrame,
    keys_of: DataFrame, hot: DataFrame | None = None,
) -> DataFrame:
    songs = catalog(tracks, artists).select("track_id", "artist_id", "genre")
    heard = lookup(plays, songs, "track_id", spread="user_id", keys_of=keys_of)
    if hot is not None:
        heard = _dealt(heard, hot, "track_id")
    heard = heard.selectExpr(
        "user_id",
        "stack(2, 'genre', genre, n, 0L, 'artist', cast(artist_id as string), 0L, "
        "cast(track_id is not null as bigint)) as (kind, value, n, tracks)",
    )
    per_value = _stack(heard, used).groupBy("user_id", "kind", "value").agg(*_exprs([
        f"sum({c}) as {c}" for c in ("n", "tracks", *NAMES[1:])]))

    def known(kind: str, what: str = "value") -> str:
        return f"case when kind = '{kind}' and value is not null then {what} end"

    def favourite(kind: str) -> str:
        return f"min({known(kind, 'struct(-n as place, value)')}).value"

    totals = per_value.withColumn("streams", F.expr("if(kind = 'day', n, null)")).groupBy(
        "user_id").agg(*_exprs([
            "sum(streams) as total_streams",
            "sum(tracks) as unique_tracks",
            f"count({known('artist')}) as unique_artists",
            f"count({known('day')}) as active_days",
            f"{m.hours('sum(ms)')} as total_listening_hours",
            AVG_PCT,
            COMPLETION_RATE,
            SKIP_RATE,
            f"cast(min({known('day')}) as date) as first_stream_date",
            f"cast(max({known('day')}) as date) as last_stream_date",
            "sum(shuffles) as shuffle_streams",
            "sum(offlines) as offline_streams",
            f"{favourite('genre')} as top_genre",
            f"{favourite('platform')} as preferred_platform",
            f"{favourite('device')} as preferred_device",
        ]))

    def or_zero(column: str) -> str:
        return f"coalesce({column}, 0) as {column}"

    return users.join(totals, "user_id", "left").selectExpr(
        "user_id", "username", "country", "subscription_type", "age_group", "joined_date",
        or_zero("total_streams"), or_zero("unique_tracks"), or_zero("unique_artists"),
        or_zero("active_days"), or_zero("total_listening_hours"), "avg_pct_played",
        "completion_rate_pct", "skip_rate_pct", "first_stream_date", "last_stream_date",
        "top_genre", "preferred_platform", "preferred_device", or_zero("shuffle_streams"),
        or_zero("offline_streams"),
    )
