"""The declared data tests of every table and model."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tunelake.operators import quality as q
from tunelake.schemas import AGE_GROUPS, DEVICE_TYPES, PLATFORMS, SUBSCRIPTION_TYPES


@dataclass(frozen=True)
class Accepted:
    values: tuple[str, ...]


@dataclass(frozen=True)
class References:
    model: str
    field: str


UNIQUE, NOT_NULL = "unique", "not_null"
KEY = [UNIQUE, NOT_NULL]
SUBSCRIPTION = Accepted(tuple(SUBSCRIPTION_TYPES))

# Which tests each column has.
COLUMN_TESTS = {
    "raw.artists": {"artist_id": KEY, "name": [NOT_NULL]},
    "raw.albums": {"album_id": KEY, "artist_id": [NOT_NULL]},
    "raw.tracks": {"track_id": KEY, "artist_id": [NOT_NULL]},
    "raw.users": {"user_id": KEY, "subscription_type": [SUBSCRIPTION]},
    "raw.stream_events": {
        "event_id": KEY, "user_id": [NOT_NULL], "track_id": [NOT_NULL], "started_at": [NOT_NULL],
    },
    "stg_artists": {
        "artist_id": KEY, "artist_name": [NOT_NULL], "genre": [NOT_NULL],
        "popularity_rank": [NOT_NULL],
    },
    "stg_albums": {
        "album_id": KEY, "artist_id": [NOT_NULL, References("stg_artists", "artist_id")],
        "album_title": [NOT_NULL],
    },
    "stg_tracks": {
        "track_id": KEY,
        "artist_id": [NOT_NULL, References("stg_artists", "artist_id")],
        "album_id": [NOT_NULL, References("stg_albums", "album_id")],
        "track_title": [NOT_NULL], "genre": [NOT_NULL], "duration_ms": [NOT_NULL],
    },
    "stg_users": {
        "user_id": KEY, "username": [NOT_NULL],
        "subscription_type": [NOT_NULL, SUBSCRIPTION],
        "age_group": [NOT_NULL, Accepted(tuple(AGE_GROUPS))],
    },
    "stg_stream_events": {
        "event_id": KEY,
        "user_id": [NOT_NULL, References("stg_users", "user_id")],
        "track_id": [NOT_NULL, References("stg_tracks", "track_id")],
        "started_at": [NOT_NULL], "event_date": [NOT_NULL], "ms_played": [NOT_NULL],
        "platform": [NOT_NULL, Accepted(tuple(PLATFORMS))],
        "device_type": [NOT_NULL, Accepted(tuple(DEVICE_TYPES))],
    },
    "int_enriched_events": {
        "event_id": KEY, "user_id": [NOT_NULL], "track_id": [NOT_NULL], "artist_id": [NOT_NULL],
        "event_date": [NOT_NULL], "ms_played": [NOT_NULL], "subscription_type": [SUBSCRIPTION],
    },
    "daily_listening_stats": {
        "event_date": KEY, "total_streams": [NOT_NULL], "active_users": [NOT_NULL],
        "completion_rate_pct": [NOT_NULL], "skip_rate_pct": [NOT_NULL],
    },
    "top_tracks_daily": {
        "event_date": [NOT_NULL], "track_id": [NOT_NULL], "daily_rank": [NOT_NULL],
        "stream_count": [NOT_NULL],
    },
    "user_activity": {
        "user_id": KEY, "username": [NOT_NULL], "subscription_type": [NOT_NULL, SUBSCRIPTION],
        "total_streams": [NOT_NULL],
    },
    "genre_trends": {
        "event_date": [NOT_NULL], "genre": [NOT_NULL], "stream_count": [NOT_NULL],
        "pct_of_daily_streams": [NOT_NULL],
    },
}

# Model, column and allowed range; and the day total of the genre shares.
RANGE_TESTS = [
    ("daily_listening_stats", "completion_rate_pct", 0, 100, "completion_rate_valid"),
    ("daily_listening_stats", "skip_rate_pct", 0, 100, "skip_rate_valid"),
    ("top_tracks_daily", "daily_rank", 1, 100, "rank_range"),
]
SHARE_TEST = ("genre_trends", "event_date", "pct_of_daily_streams", 99, 101, "shares_sum_to_100")


def _value_tests_of(
    model: str, nulls: bool = True, values: bool = True
) -> tuple[list[str], dict[str, list[str]]]:
    """The columns that must not be null, and those with a list of values."""
    columns = COLUMN_TESTS[model]
    not_null = [c for c, tests in columns.items() if nulls and NOT_NULL in tests]
    accepted = {c: list(t.values) for c, tests in columns.items() for t in tests
                if values and isinstance(t, Accepted)}
    return not_null, accepted


def _value_checks(models: dict[str, DataFrame], nulls: bool, values: bool) -> DataFrame:
    """The checks that look at single values: one pass over each model that has any."""
    found = {}
    for model in COLUMN_TESTS:
        not_null, accepted = _value_tests_of(model, nulls, values)
        if model in models and (not_null or accepted):
            found[model] = [q.column_checks(models[model], not_null, accepted)]
    return q.suite(found)


def not_null_tests(models: dict[str, DataFrame]) -> DataFrame:
    return _value_checks(models, nulls=True, values=False)


def accepted_values_tests(models: dict[str, DataFrame]) -> DataFrame:
    """``n_failed`` is the number of different values outside the list."""
    return _value_checks(models, nulls=False, values=True)


def value_tests(models: dict[str, DataFrame]) -> DataFrame:
    """Both of the above, from the same pass."""
    return _value_checks(models, nulls=True, values=True)


def _each(models: dict[str, DataFrame]):
    for model, columns in COLUMN_TESTS.items():
        if model in models:
            for column, tests in columns.items():
                for test in tests:
                    yield model, models[model], column, test


def _collect(results) -> DataFrame:
    by_model: dict[str, list[DataFrame]] = {}
    for model, frame in results:
        by_model.setdefault(model, []).append(frame)
    return q.suite(by_model)


def unique_tests(models: dict[str, DataFrame]) -> DataFrame:
    """``n_failed`` is the number of repeated values."""
    return _collect(
        (model, q.outcome(q.duplicate_failures(df, column), column, UNIQUE))
        for model, df, column, test in _each(models) if test == UNIQUE
    )


def relationship_tests(models: dict[str, DataFrame]) -> DataFrame:
    """``n_failed`` is the number of child rows without a parent."""
    return _collect(
        (model, q.outcome(
            q.orphan_failures(df, column, models[test.model], test.field),
            column, "relationships", "sum(n_rows)"))
        for model, df, column, test in _each(models) if isinstance(test, References)
    )


def range_tests(models: dict[str, DataFrame]) -> DataFrame:
    return _collect(
        (model, q.outcome(q.range_failures(models[model], column, low, high), column, name))
        for model, column, low, high, name in RANGE_TESTS if model in models
    )


def share_tests(models: dict[str, DataFrame]) -> DataFrame:
    model, group, column, low, high, name = SHARE_TEST
    failures = q.group_sum_failures(models[model], group, column, low, high)
    return q.suite({model: [q.outcome(failures, column, name)]})


def watched(model: str, df: DataFrame) -> q.Watched:
    """A model that is tested, value by value, in the pass that writes it."""
    ranges = [(column, name, q.out_of_range(column, low, high))
              for of, column, low, high, name in RANGE_TESTS if of == model]
    return q.Watched(df, q.value_conditions(*_value_tests_of(model)) + ranges)


def watched_tests(written: dict[str, q.Watched], stored: dict[str, DataFrame]) -> DataFrame:
    """The tests of single values of models that were ``watched`` as they were written. Without
    failures nothing is read; a model with some is read again for their exact numbers."""
    spark = next(iter(stored.values())).sparkSession
    bad = {model: set(w.failing()) for model, w in written.items()}
    good = [(model, column, test, 0, True) for model, w in written.items()
            for column, test, _ in w.conditions if (column, test) not in bad[model]]
    result = spark.createDataFrame(
        good, "model string, column string, test string, n_failed bigint, passed boolean")
    again = {model: stored[model] for model, found in bad.items() if found}
    for model, df in again.items():
        ranges = [(c, name) for of, c, _, _, name in RANGE_TESTS if of == model]
        checks = value_tests({model: df})
        if ranges:
            checks = checks.unionByName(range_tests({model: df}))
        wanted = spark.createDataFrame(sorted(bad[model]), "column string, test string")
        result = result.unionByName(checks.join(F.broadcast(wanted), ["column", "test"], "left_semi"))
    return result


def all_tests(models: dict[str, DataFrame]) -> DataFrame:
    """Every declared test over the given models, which should be read from storage: a model is
    scanned once for all checks of single values, and once for each other test."""
    result = value_tests(models)
    for tests in (unique_tests, relationship_tests, range_tests, share_tests):
        result = result.unionByName(tests(models))
    return result
