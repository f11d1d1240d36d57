"""The declared tests, on good rows and on rows that break each of them."""

from collections import Counter

import pytest

from small_data import raw_tables, staged
from tunelake.operators import quality as q
from tunelake.plans import jobs, quality_suite
from tunelake.plans.quality_suite import COLUMN_TESTS, NOT_NULL, RANGE_TESTS, UNIQUE, Accepted


def failed(df):
    return {(r.model, r.column, r.test): r.n_failed for r in df.collect() if not r.passed}


def test_number_of_declared_tests():
    kinds = Counter(
        t if isinstance(t, str) else type(t).__name__
        for columns in COLUMN_TESTS.values() for tests in columns.values() for t in tests
    )
    assert kinds == {UNIQUE: 13, NOT_NULL: 59, "Accepted": 7, "References": 5}
    assert len(RANGE_TESTS) + 1 == 4


def test_column_checks_in_one_pass(spark, tmp_path):
    rows = [(1, None), (None, None), (3, "x"), (4, "y"), (5, "y"), (6, "z")]
    spark.createDataFrame(rows, "a int, b string").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    found = q.column_checks(df, ["a", "b"], {"b": ["x"]})
    assert {(r.column, r.test): r.n_failed for r in found.collect()} == {
        ("a", "not_null"): 1, ("b", "not_null"): 2, ("b", "accepted_values"): 2}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.split("== Initial Plan ==")[0].count("Scan parquet") == 1
    none = q.column_checks(df.where("a = 3"), ["a"], {"b": ["x"]})
    assert {r.n_failed for r in none.collect()} == {0}


def test_each_kind_can_fail(spark):
    df = spark.createDataFrame(
        [("a", "x", 5.0), ("a", "y", 50.0), ("a", "y", None), (None, None, 150.0)],
        "k string, v string, n double")
    assert [tuple(r) for r in q.duplicate_failures(df, "k").collect()] == [("a", 3)]
    parent = spark.createDataFrame([("x",)], "p string")
    assert [tuple(r) for r in q.orphan_failures(df, "v", parent, "p").collect()] == [("y", 2)]
    assert q.range_failures(df, "n", 10, 100).count() == 2
    assert {r.k for r in q.group_sum_failures(df, "k", "n", 99, 101).collect()} == {"a", None}
    assert q.outcome(q.range_failures(df, "n", 0, 200), "n", "range").first().n_failed == 0


@pytest.fixture(scope="module")
def models(spark):
    models = staged(spark)
    return (
        {f"raw.{t}": df for t, df in raw_tables(spark).items()} | models
        | {"int_enriched_events": jobs.enriched(models)} | jobs.build_marts(models)
    )


def test_null_and_unique_outcomes(models):
    nulls = failed(quality_suite.not_null_tests(models))
    assert nulls["raw.stream_events", "user_id", "not_null"] == 1
    assert nulls["int_enriched_events", "user_id", "not_null"] == 3
    assert nulls["int_enriched_events", "track_id", "not_null"] == 3
    assert nulls["int_enriched_events", "artist_id", "not_null"] == 4
    assert nulls["stg_tracks", "genre", "not_null"] == 1
    assert nulls["top_tracks_daily", "track_id", "not_null"] == 1
    assert failed(quality_suite.unique_tests(models)) == {}


def test_value_and_reference_outcomes(models):
    assert failed(quality_suite.accepted_values_tests(models)) == {
        ("stg_stream_events", "platform", "accepted_values"): 1}
    assert failed(quality_suite.relationship_tests(models)) == {
        ("stg_tracks", "artist_id", "relationships"): 1,
        ("stg_stream_events", "user_id", "relationships"): 2,
        ("stg_stream_events", "track_id", "relationships"): 2,
    }


def test_range_and_share_outcomes(spark, models):
    assert failed(quality_suite.range_tests(models)) == {}
    assert failed(quality_suite.share_tests(models)) == {}
    broken = {
        "daily_listening_stats": models["daily_listening_stats"].selectExpr(
            "event_date", "completion_rate_pct + 90 as completion_rate_pct",
            "-1D as skip_rate_pct"),
        "top_tracks_daily": models["top_tracks_daily"].selectExpr("daily_rank - 1 as daily_rank"),
        "genre_trends": models["genre_trends"].where("genre <> 'Jazz'"),
    }
    assert failed(quality_suite.range_tests(broken)) == {
        ("daily_listening_stats", "completion_rate_pct", "completion_rate_valid"): 2,
        ("daily_listening_stats", "skip_rate_pct", "skip_rate_valid"): 2,
        ("top_tracks_daily", "daily_rank", "rank_range"): 2,
    }
    assert list(failed(quality_suite.share_tests(broken)).values()) == [1]


def test_accepted_is_a_value():
    assert Accepted(("a",)) == Accepted(("a",))


def test_watched_frames_count_as_they_are_written(spark, tmp_path):
    conditions = q.value_conditions(["a"], {"b": ["x"]}) + [("a", "low", q.out_of_range("a", 1, 4))]
    rows = [(1, None), (None, "x"), (3, "y"), (9, "x")]
    for n, (part, wanted) in enumerate([
        (rows, [("a", "not_null"), ("b", "accepted_values"), ("a", "low")]),
        (rows[:1], []), (rows[3:], [("a", "low")]), ([], []),
    ]):
        watched = q.Watched(spark.createDataFrame(part, "a int, b string"), conditions)
        watched.df.write.parquet(str(tmp_path / str(n)))
        assert watched.failing() == wanted
    never = q.Watched(spark.range(1).where("false").selectExpr("id as a", "'x' as b"), conditions)
    never.df.write.parquet(str(tmp_path / "never"))
    assert never.failing() == []


def test_watched_tests_equal_the_tests(spark, models, tmp_path):
    marts = {name: models[name] for name in jobs.MARTS}
    marts["user_activity"] = marts["user_activity"].replace("premium", "gold", "subscription_type")
    marts["top_tracks_daily"] = marts["top_tracks_daily"].withColumn(
        "daily_rank", models["top_tracks_daily"].daily_rank - 1)
    written, stored = {}, {}
    for name, df in marts.items():
        written[name] = quality_suite.watched(name, df)
        written[name].df.write.parquet(str(tmp_path / name))
        stored[name] = spark.read.parquet(str(tmp_path / name))
    found = quality_suite.watched_tests(written, stored)
    wanted = quality_suite.value_tests(stored).unionByName(quality_suite.range_tests(stored))
    assert sorted(found.collect()) == sorted(wanted.select(*found.columns).collect())
    assert {(r.model, r.column) for r in found.collect() if not r.passed} >= {
        ("user_activity", "subscription_type"), ("top_tracks_daily", "daily_rank")}


def test_watched_tests_read_nothing_if_all_is_well(spark, models, tmp_path):
    watched = quality_suite.watched("daily_listening_stats", models["daily_listening_stats"])
    watched.df.write.parquet(str(tmp_path / "daily"))
    gone = spark.read.schema(models["daily_listening_stats"].schema).parquet(str(tmp_path / "daily"))
    found = quality_suite.watched_tests(
        {"daily_listening_stats": watched}, {"daily_listening_stats": gone})
    assert "Scan parquet" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 7 and found.where("not passed").count() == 0
