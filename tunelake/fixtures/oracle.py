"""The same results as DuckDB SQL over the supplied tables, written independently of the models:
plain joins, then one GROUP BY per result."""

from __future__ import annotations

from tunelake.fixtures.mapping import (
    EVENT_DURATION_MS, EVENT_PLATFORM, FLAG_PLATFORM, LINE_DURATION_MS, SEGMENT_SUBSCRIPTION,
    STATUS_DEVICE,
)
from tunelake.functions import calendar as cal
from tunelake.plans import patterns as pc
from tunelake.plans.quality_suite import (
    COLUMN_TESTS, NOT_NULL, RANGE_TESTS, SHARE_TEST, UNIQUE, Accepted, References,
)
from tunelake.schemas import AGE_GROUPS, DEVICE_TYPES, PLATFORMS, SUBSCRIPTION_TYPES


def _names(column: str, names: dict[str, str]) -> str:
    whens = " ".join(f"WHEN {column} = '{k}' THEN '{v}'" for k, v in names.items())
    return f"CASE {whens} ELSE lower({column}) END"


def _pick(values: list[str], index: str) -> str:
    return f"([{', '.join(repr(v) for v in values)}])[{index} % {len(values)} + 1]"


def _in(values) -> str:
    return "(" + ", ".join(repr(v) for v in values) + ")"


# The raw tables.
RAW = {
    "raw_artists": """
        SELECT p_brand AS artist_id, p_brand AS name, MIN(p_type) AS genre,
               CAST(COUNT(*) % 25 AS VARCHAR) AS country,
               CAST(COUNT(*) AS INTEGER) AS monthly_listeners,
               DATE '2015-01-01' + CAST(MIN(p_partkey) % 3650 AS INTEGER) AS created_at,
               CAST(substring(p_brand, 7) AS INTEGER) AS popularity_rank
        FROM part GROUP BY p_brand""",
    "raw_albums": """
        SELECT p_brand || '-' || p_size AS album_id, 'Album ' || p_size AS title,
               p_brand AS artist_id, DATE '2000-01-01' + p_size AS release_date,
               CAST(COUNT(*) AS INTEGER) AS num_tracks, MIN(p_type) AS genre
        FROM part GROUP BY p_brand, p_size""",
    "raw_tracks": """
        SELECT p_partkey AS track_id, p_name AS title, p_brand AS artist_id,
               p_brand || '-' || p_size AS album_id,
               CAST(ROUND(p_retailprice * 100) AS INTEGER) AS duration_ms, p_type AS genre,
               CAST(2000 + p_partkey % 26 AS INTEGER) AS release_year,
               p_partkey % 7 = 0 AS explicit, p_size + 60 AS tempo_bpm,
               p_size / 50.0::DOUBLE AS energy_score,
               CAST(p_partkey % 1000000 + 1 AS INTEGER) AS popularity_rank
        FROM part""",
    "raw_users": f"""
        SELECT c_custkey AS user_id, c_name AS username,
               lower(c_name) || '@example.com' AS email, CAST(c_nationkey AS VARCHAR) AS country,
               {_names('c_mktsegment', SEGMENT_SUBSCRIPTION)} AS subscription_type,
               {_pick(AGE_GROUPS, 'c_custkey')} AS age_group,
               DATE '2023-01-01' + CAST(c_custkey % 365 AS INTEGER) AS joined_at,
               CAST(c_custkey % 1000000 + 1 AS INTEGER) AS popularity_rank
        FROM customer""",
    "raw_stream_events": f"""
        SELECT *, ms_played >= track_duration_ms * 0.8::DOUBLE AS completed,
               ms_played < track_duration_ms * 0.3::DOUBLE AS skipped
        FROM (SELECT event_id, user_id,
                     CAST(json_extract_string(props, '$.k') AS BIGINT) AS track_id,
                     ts AS started_at, CAST(ROUND(value * 1000) AS INTEGER) AS ms_played,
                     {EVENT_DURATION_MS} AS track_duration_ms,
                     {_pick(DEVICE_TYPES, 'event_id')} AS device_type,
                     {_names('event_type', EVENT_PLATFORM)} AS platform,
                     event_id % 5 < 2 AS shuffle_mode, event_id % 20 = 0 AS offline_mode
              FROM events)""",
    "raw_line_events": f"""
        SELECT *, ms_played >= track_duration_ms * 0.8::DOUBLE AS completed,
               ms_played < track_duration_ms * 0.3::DOUBLE AS skipped
        FROM (SELECT l_orderkey || '-' || l_linenumber AS event_id, o_custkey AS user_id,
                     l_partkey AS track_id, o_orderdate AS started_at,
                     CAST(ROUND(l_quantity * 1000) AS INTEGER) AS ms_played,
                     {LINE_DURATION_MS} AS track_duration_ms,
                     {_names('l_linestatus', STATUS_DEVICE)} AS device_type,
                     {_names('l_returnflag', FLAG_PLATFORM)} AS platform,
                     l_tax > 0.04::DOUBLE AS shuffle_mode, l_discount = 0 AS offline_mode
              FROM lineitem JOIN orders ON l_orderkey = o_orderkey)""",
}


def _stg_events(raw: str) -> str:
    return f"""
        SELECT event_id, user_id, track_id, started_at, CAST(started_at AS DATE) AS event_date,
               ms_played, track_duration_ms,
               ROUND(ms_played::DOUBLE / track_duration_ms::DOUBLE * 100, 1) AS pct_played,
               completed AS is_completed, skipped AS is_skipped, device_type, platform,
               shuffle_mode AS is_shuffle, offline_mode AS is_offline
        FROM {raw}"""


STAGED = {
    "stg_artists": """
        SELECT artist_id, name AS artist_name, genre, country, monthly_listeners,
               created_at AS created_date, popularity_rank FROM raw_artists""",
    "stg_albums": """
        SELECT album_id, title AS album_title, artist_id, release_date, num_tracks, genre
        FROM raw_albums""",
    "stg_tracks": """
        SELECT track_id, title AS track_title, artist_id, album_id, duration_ms,
               ROUND(duration_ms::DOUBLE / 1000, 1) AS duration_seconds, genre, release_year,
               explicit AS is_explicit, tempo_bpm, energy_score, popularity_rank
        FROM raw_tracks""",
    "stg_users": """
        SELECT user_id, username, email, country, subscription_type, age_group,
               joined_at AS joined_date, popularity_rank FROM raw_users""",
    "stg_stream_events": _stg_events("raw_stream_events"),
    "stg_line_events": _stg_events("raw_line_events"),
}


def _enriched(events: str) -> str:
    return f"""
        SELECT ev.* EXCLUDE (user_id, track_id), tr.track_id, tr.track_title, tr.genre,
               tr.release_year, tr.is_explicit, tr.tempo_bpm, tr.energy_score,
               tr.duration_ms AS track_duration_ms_catalog, ar.artist_id, ar.artist_name,
               ar.country AS artist_country, us.user_id, us.username,
               us.country AS user_country, us.subscription_type, us.age_group, us.joined_date
        FROM {events} ev
        LEFT JOIN stg_tracks tr ON tr.track_id = ev.track_id
        LEFT JOIN stg_artists ar ON ar.artist_id = tr.artist_id
        LEFT JOIN stg_users us ON us.user_id = ev.user_id"""


_AVG = "ROUND(AVG(CAST(pct_played AS DECIMAL(18, 1))), 8) AS avg_pct_played"
_HOURS = "CAST(SUM(ms_played) AS DOUBLE) / 1000 / 3600"


def _rate(flag: str) -> str:
    return f"ROUND(CAST(SUM({flag}::INT) AS DOUBLE) * 100 / COUNT(*), 2)"


def _pivot(column: str, values: list[str]) -> str:
    return ", ".join(
        f"COUNT(*) FILTER (WHERE {column} = '{v}') AS streams_{v}" for v in values
    )


def _daily(fact: str) -> str:
    return f"""
        SELECT event_date, COUNT(*) AS total_streams, COUNT(DISTINCT user_id) AS active_users,
               COUNT(DISTINCT track_id) AS unique_tracks_played,
               COUNT(DISTINCT artist_id) AS unique_artists_played,
               {_HOURS} AS total_listening_hours, {_AVG},
               CAST(SUM(is_completed::INT) AS BIGINT) AS completed_streams,
               CAST(SUM(is_skipped::INT) AS BIGINT) AS skipped_streams,
               {_rate('is_completed')} AS completion_rate_pct,
               {_rate('is_skipped')} AS skip_rate_pct,
               {_pivot('platform', PLATFORMS)},
               {_pivot('subscription_type', SUBSCRIPTION_TYPES)},
               CAST(SUM(is_offline::INT) AS BIGINT) AS offline_streams,
               CAST(SUM(is_shuffle::INT) AS BIGINT) AS shuffle_streams
        FROM {fact} GROUP BY event_date"""


def _top(fact: str) -> str:
    return f"""
        SELECT event_date, track_id, track_title, artist_id, artist_name, genre, release_year,
               COUNT(*) AS stream_count, COUNT(DISTINCT user_id) AS unique_listeners,
               {_HOURS} AS listening_hours, {_AVG},
               CAST(SUM(is_completed::INT) AS BIGINT) AS completions,
               CAST(SUM(is_skipped::INT) AS BIGINT) AS skips,
               {_rate('is_completed')} AS completion_rate_pct,
               ROW_NUMBER() OVER (PARTITION BY event_date
                                  ORDER BY COUNT(*) DESC, track_id NULLS LAST) AS daily_rank
        FROM {fact}
        GROUP BY event_date, track_id, track_title, artist_id, artist_name, genre, release_year
        QUALIFY daily_rank <= 100"""


def _genres(fact: str) -> str:
    return f"""
        SELECT event_date, genre, COUNT(*) AS stream_count,
               COUNT(DISTINCT user_id) AS unique_listeners,
               COUNT(DISTINCT track_id) AS unique_tracks,
               COUNT(DISTINCT artist_id) AS unique_artists,
               {_HOURS} AS listening_hours, {_AVG},
               {_rate('is_completed')} AS completion_rate_pct,
               ROUND(COUNT(*) * 100::DOUBLE / CAST(SUM(COUNT(*)) OVER (PARTITION BY event_date)
                     AS DOUBLE), 2) AS pct_of_daily_streams,
               RANK() OVER (PARTITION BY event_date ORDER BY COUNT(*) DESC) AS daily_rank
        FROM {fact} WHERE genre IS NOT NULL GROUP BY event_date, genre"""


def _users(fact: str) -> str:
    return f"""
        SELECT us.user_id, us.username, us.country, us.subscription_type, us.age_group,
               us.joined_date, COUNT(event_id) AS total_streams,
               COUNT(DISTINCT track_id) AS unique_tracks,
               COUNT(DISTINCT artist_id) AS unique_artists,
               COUNT(DISTINCT event_date) AS active_days,
               COALESCE({_HOURS}, 0) AS total_listening_hours, {_AVG},
               CASE WHEN COUNT(event_id) > 0 THEN {_rate('is_completed')} END
                   AS completion_rate_pct,
               CASE WHEN COUNT(event_id) > 0 THEN {_rate('is_skipped')} END AS skip_rate_pct,
               MIN(event_date) AS first_stream_date, MAX(event_date) AS last_stream_date,
               MODE() WITHIN GROUP (ORDER BY genre) AS top_genre,
               MODE() WITHIN GROUP (ORDER BY platform) AS preferred_platform,
               MODE() WITHIN GROUP (ORDER BY device_type) AS preferred_device,
               CAST(COALESCE(SUM(is_shuffle::INT), 0) AS BIGINT) AS shuffle_streams,
               CAST(COALESCE(SUM(is_offline::INT), 0) AS BIGINT) AS offline_streams
        FROM stg_users us LEFT JOIN {fact} ev ON ev.user_id = us.user_id
        GROUP BY us.user_id, us.username, us.country, us.subscription_type, us.age_group,
                 us.joined_date"""


MODELS = RAW | STAGED | {
    "int_enriched_events": _enriched("stg_stream_events"),
    "int_enriched_lines": _enriched("stg_line_events"),
    "daily_listening_stats": _daily("int_enriched_events"),
    "top_tracks_daily": _top("int_enriched_events"),
    "genre_trends": _genres("int_enriched_events"),
    "user_activity": _users("int_enriched_events"),
    "daily_listening_stats_l": _daily("int_enriched_lines"),
    "top_tracks_daily_l": _top("int_enriched_lines"),
    "genre_trends_l": _genres("int_enriched_lines"),
    "user_activity_l": _users("int_enriched_lines"),
    "daily_volume": """
        SELECT event_date, COUNT(*) AS total_streams FROM stg_stream_events GROUP BY 1""",
    "order_volume": """
        SELECT CAST(o_orderdate AS DATE) AS event_date, COUNT(*) AS total_streams
        FROM orders GROUP BY 1""",
}


def sql(select: str) -> str:
    """A statement that can name any model."""
    ctes = ",\n".join(f"{name} AS ({body})" for name, body in MODELS.items())
    return f"WITH {ctes}\n{select}"


def _ratio(name: str, high: str, low: str, source: str) -> str:
    return (f"SELECT *, CASE WHEN {high} <> 0 AND {low} <> 0 "
            f"THEN {high}::DOUBLE / {low}::DOUBLE END AS ratio FROM ({name} FROM {source})")


def weekend(daily: str) -> str:
    return _ratio(
        "SELECT AVG(total_streams) FILTER (WHERE dayofweek(event_date) IN (0, 6)) AS avg_weekend,"
        " AVG(total_streams) FILTER (WHERE dayofweek(event_date) NOT IN (0, 6)) AS avg_weekday",
        "avg_weekend", "avg_weekday", daily)


def evening(events: str) -> str:
    return _ratio(
        "SELECT NULLIF(COUNT(*) FILTER (WHERE hour(started_at) BETWEEN 18 AND 22), 0) AS evening,"
        " NULLIF(COUNT(*) FILTER (WHERE hour(started_at) BETWEEN 2 AND 5), 0) AS overnight",
        "evening", "overnight", events)


def seasonal(daily: str) -> str:
    return _ratio(
        "SELECT AVG(total_streams) FILTER (WHERE month(event_date) IN (11, 12, 1)) AS winter_avg,"
        " AVG(total_streams) FILTER (WHERE month(event_date) IN (6, 7, 8)) AS summer_avg",
        "winter_avg", "summer_avg", daily)


def pareto(key: str, source: str) -> str:
    """Ranks every key, as one would on a small table."""
    return f"""
        SELECT CAST(SUM(n) FILTER (WHERE place <= keys * 0.2) AS DOUBLE) * 100 / MAX(total)
                   AS top_pct,
               MAX(keys) AS n_keys, CAST(MAX(total) AS BIGINT) AS n_rows
        FROM (SELECT n, ROW_NUMBER() OVER (ORDER BY n DESC) AS place, COUNT(*) OVER () AS keys,
                     SUM(n) OVER () AS total
              FROM (SELECT {key}, COUNT(*) AS n FROM {source} GROUP BY {key}))"""


_ARTIST_PLAYS = ("(SELECT tr.artist_id FROM {events} ev JOIN stg_tracks tr "
                 "ON tr.track_id = ev.track_id)")


def pareto_artists(events: str) -> str:
    return pareto("artist_id", _ARTIST_PLAYS.format(events=events))


def summary() -> str:
    checks = [
        ("weekend_vs_weekday", "ratio", weekend("daily_volume"), pc.MIN_WEEKEND_RATIO, ">"),
        ("evening_vs_overnight", "ratio", evening("stg_stream_events"), pc.MIN_EVENING_RATIO, ">"),
        ("winter_vs_summer", "ratio", seasonal("daily_volume"), pc.MIN_SEASON_RATIO, ">"),
        ("top_users", "top_pct", pareto("user_id", "stg_stream_events"), pc.MIN_USER_SHARE, ">="),
        ("top_tracks", "top_pct", pareto("track_id", "stg_stream_events"), pc.MIN_TRACK_SHARE,
         ">="),
        ("top_artists", "top_pct", pareto_artists("stg_stream_events"), pc.MIN_ARTIST_SHARE,
         ">="),
    ]
    return " UNION ALL ".join(
        f"""SELECT '{name}' AS "check", {value} AS value, {limit}::DOUBLE AS threshold,
                   CASE WHEN {value} IS NULL THEN 'info' WHEN {value} {op} {limit} THEN 'pass'
                        ELSE 'fail' END AS status FROM ({body})"""
        for name, value, body, limit, op in checks
    )


def _table(model: str) -> str:
    return model.replace("raw.", "raw_")


def _outcome(model: str, column: str, test: str, failed: str) -> str:
    return (f"""SELECT '{model}' AS model, '{column}' AS "column", '{test}' AS test, n_failed,
                       n_failed = 0 AS passed FROM (SELECT {failed})""")


def _column_tests():
    for model, columns in COLUMN_TESTS.items():
        for column, tests in columns.items():
            for test in tests:
                yield model, column, test


def not_null() -> str:
    return " UNION ALL ".join(
        _outcome(m, c, "not_null", f"COUNT(*) - COUNT({c}) AS n_failed FROM {_table(m)}")
        for m, c, test in _column_tests() if test == NOT_NULL
    )


def unique() -> str:
    return " UNION ALL ".join(
        _outcome(m, c, "unique", f"COUNT(*) AS n_failed FROM (SELECT {c} FROM {_table(m)} "
                 f"WHERE {c} IS NOT NULL GROUP BY {c} HAVING COUNT(*) > 1)")
        for m, c, test in _column_tests() if test == UNIQUE
    )


def accepted_values() -> str:
    return " UNION ALL ".join(
        _outcome(m, c, "accepted_values", f"COUNT(DISTINCT {c}) AS n_failed FROM {_table(m)} "
                 f"WHERE {c} NOT IN {_in(test.values)}")
        for m, c, test in _column_tests() if isinstance(test, Accepted)
    )


def relationships() -> str:
    return " UNION ALL ".join(
        _outcome(m, c, "relationships", f"COUNT(*) AS n_failed FROM {_table(m)} WHERE {c} NOT IN "
                 f"(SELECT {test.field} FROM {test.model})")
        for m, c, test in _column_tests() if isinstance(test, References)
    )


def ranges(models: tuple[str, ...]) -> str:
    return " UNION ALL ".join(
        _outcome(m, c, name, f"COUNT(*) AS n_failed FROM {m} WHERE {c} NOT BETWEEN {lo} AND {hi}")
        for m, c, lo, hi, name in RANGE_TESTS if m in models
    )


def shares() -> str:
    m, group, c, lo, hi, name = SHARE_TEST
    return _outcome(m, c, name, f"COUNT(*) AS n_failed FROM (SELECT {group} FROM {m} GROUP BY "
                    f"{group} HAVING ROUND(SUM({c}), 0) NOT BETWEEN {lo} AND {hi})")


def calendar(days: str) -> str:
    weekday = ", ".join(map(str, cal.WEEKDAY_WEIGHT))
    month = ", ".join(map(str, cal.MONTH_WEIGHT))
    return f"""
        SELECT *, total_streams / expected_events::DOUBLE AS actual_to_expected
        FROM (SELECT *, GREATEST(1, CAST(FLOOR({cal.BASE_EVENTS_PER_DAY}::DOUBLE * weekday_weight
                  * month_weight * CASE WHEN is_holiday THEN {cal.HOLIDAY_BOOST}::DOUBLE
                  ELSE 1::DOUBLE END * growth) AS BIGINT)) AS expected_events
              FROM (SELECT event_date, total_streams,
                           CAST(dayofweek(event_date) AS INTEGER) AS day_of_week,
                           dayofweek(event_date) IN (0, 6) AS is_weekend,
                           strftime(event_date, '%m%d') >= '1220'
                               OR strftime(event_date, '%m%d') <= '0105' AS is_holiday,
                           ([{weekday}]::DOUBLE[])[isodow(event_date)] AS weekday_weight,
                           ([{month}]::DOUBLE[])[month(event_date)] AS month_weight,
                           LEAST(1::DOUBLE, {cal.GROWTH_START}::DOUBLE + {cal.GROWTH_GAIN}::DOUBLE
                               * GREATEST(0, event_date - DATE '{cal.LAUNCH_DATE}')
                               / {cal.GROWTH_DAYS}::DOUBLE) AS growth
                    FROM {days}))"""
