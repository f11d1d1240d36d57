"""Landing, stored tables, jobs, command line and streams."""

import json
import os
import subprocess
import sys
from datetime import date, datetime

import pytest

from small_data import DAY1, DAY2, EVENTS, raw_tables
from tunelake.__main__ import main
from tunelake.plans import jobs
from tunelake.schemas import RAW
from tunelake.session import checkpoint_root, default_root
from tunelake.sinks.store import Store, schema_name
from tunelake.sources import landing
from tunelake.sources.tables import day_range, events_between, from_rows
from tunelake.streaming import ingest

TODAY = date(2025, 1, 5)


@pytest.fixture
def store(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    store.create_raw_tables()
    return store


def event(key, day=DAY1, played=1, hour=1, user="u1"):
    return (key, user, "t1", datetime(day.year, day.month, day.day, hour), played, 100, True,
            False, "tv", "ios", True, False, None, None)


def batch(spark, *rows):
    return from_rows(spark, rows, "stream_events")


def stored(store):
    return {r.event_id: (r.event_date, r.ms_played) for r in store.read("raw", "stream_events")
            .collect()}


def test_schema_routing():
    assert schema_name("marts", "prod") == "marts"
    assert schema_name(" marts ", "prod") == "marts"
    assert schema_name("marts", "dev") == "dev_marts"
    assert schema_name(None, "prod", default="main") == "main"
    assert Store(None, "/r/", "prod").path("raw", "users") == "/r/raw/users"


def test_day_range():
    assert day_range(today=TODAY) == (DAY2, DAY2)
    assert day_range("2025-01-01", today=TODAY) == (date(2025, 1, 1), DAY2)
    with pytest.raises(ValueError):
        day_range("2025-01-03", "2025-01-02", TODAY)
    with pytest.raises(ValueError):
        day_range("2025-01-03", "2025-01-06", TODAY)


def test_events_between_includes_both_ends(spark):
    events = raw_tables(spark)["stream_events"]
    assert events_between(events, DAY1, DAY1).count() == 3
    assert events_between(events, DAY1, DAY2).count() == 9
    plan = events_between(events, DAY1, DAY1)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(started_at), GreaterThanOrEqual(started_at" in plan


def test_stored_days_are_pruned(spark, store):
    store.merge_events(batch(spark, event("a"), event("b", DAY2)))
    one = events_between(store.read("raw", "stream_events"), DAY2, DAY2)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan
    assert [r.event_id for r in one.collect()] == ["b"]


def test_merge_updates_inserts_and_repeats(spark, store):
    store.merge_events(batch(spark, event("a"), event("b"), event("b")))
    second = batch(spark, event("b", played=2), event("c", DAY2))
    for _ in range(2):
        store.merge_events(second)
        assert stored(store) == {"a": (DAY1, 1), "b": (DAY1, 2), "c": (DAY2, 1)}


def test_merge_takes_the_latest_copy(spark, store):
    store.merge_events(
        batch(spark, event("a", played=5, hour=3), event("a", played=9, hour=2)),
        latest_by="started_at")
    assert stored(store) == {"a": (DAY1, 5)}


def test_merge_follows_an_event_to_another_day(spark, store):
    store.merge_events(batch(spark, event("a"), event("b", DAY2)))
    store.merge_events(batch(spark, event("b", DAY1, played=7)))  # nothing is left of day 2
    assert stored(store) == {"a": (DAY1, 1), "b": (DAY1, 7)}
    assert not os.path.exists(store.path("raw", "stream_events") + f"/event_date={DAY2}")


def test_merge_leaves_other_days_alone(spark, store):
    store.merge_events(batch(spark, event("a"), event("b", DAY2)))
    folder = store.path("raw", "stream_events") + f"/event_date={DAY1}"
    before = sorted(os.listdir(folder))
    store.merge_events(batch(spark, event("b", DAY2, played=3)), day_in_key=True)
    assert sorted(os.listdir(folder)) == before
    assert stored(store) == {"a": (DAY1, 1), "b": (DAY2, 3)}


def test_merge_without_a_start_time(spark, store):
    untimed = event("n")[:3] + (None,) + event("n")[4:]
    for _ in range(2):
        store.merge_events(batch(spark, untimed, event("a")))
    assert stored(store) == {"n": (None, 1), "a": (DAY1, 1)}


@pytest.mark.parametrize("day_in_key", [True, False])
def test_ignore_keeps_stored_rows(spark, store, day_in_key):
    store.insert_or_ignore("stream_events", batch(spark, event("a")), day_in_key=day_in_key)
    for _ in range(2):
        store.insert_or_ignore(
            "stream_events", batch(spark, event("a", played=9), event("b"), event("b")),
            day_in_key=day_in_key)
    assert stored(store) == {"a": (DAY1, 1), "b": (DAY1, 1)}


def test_replace_and_insert_or_replace(spark, store):
    users = raw_tables(spark)["users"]
    store.replace("raw", "users", users)
    store.replace("raw", "users", users.where("user_id <> 'idle'"))
    assert store.read("raw", "users").count() == 2
    changed = users.where("user_id = 'u1'").withColumn("country", users.country.substr(9, 1))
    store.insert_or_replace("users", changed.unionByName(users.where("user_id = 'idle'")))
    assert {r.user_id: r.country for r in store.read("raw", "users").collect()} == {
        "u1": "", "u2": "DE", "idle": "DE"}


def land(spark, folder):
    for table, df in raw_tables(spark).items():
        plain = df.drop("_dlt_load_id", "_dlt_id")
        days = {"day": "started_at", "days": [date(2025, 1, d) for d in range(1, 6)]}
        landing.write_pages(plain, f"{folder}/{table}", "0", 500,
                            **(days if table == "stream_events" else {}))


def test_pages_round_trip(spark, tmp_path):
    land(spark, tmp_path)
    for table, df in raw_tables(spark).items():
        back = landing.read_pages(spark, f"{tmp_path}/{table}", table)
        assert back.schema == RAW[table]
        assert sorted(back.collect(), key=str) == sorted(df.collect(), key=str)


def test_pages_of_several_records_and_empty_pages(spark, tmp_path):
    pages = [{"data": [{"album_id": "b1", "title": "x", "release_date": "2022-05-01"},
                       {"album_id": "b2", "title": "y", "release_date": None}],
              "page": 1, "page_size": 2, "total": 2, "has_more": True},
             {"data": [], "page": 2, "page_size": 2, "total": 2, "has_more": False}]
    (tmp_path / "albums").mkdir()
    (tmp_path / "albums" / "p.json").write_text("\n".join(map(json.dumps, pages)))
    rows = landing.read_pages(spark, f"{tmp_path}/albums", "albums").collect()
    assert [(r.album_id, r.release_date) for r in rows] == [("b1", date(2022, 5, 1)), ("b2", None)]


GOOD = [{"data": [{"user_id": "u1"}], "page": 1, "page_size": 1, "total": 2, "has_more": True},
        {"data": [{"user_id": "u2"}], "page": 2, "page_size": 1, "total": 2, "has_more": False}]


@pytest.mark.parametrize("pages", [
    [],
    GOOD[:1],                                            # the last page is missing
    GOOD[1:],                                            # the first one is
    [GOOD[0], GOOD[1] | {"page": 3}],                    # one between
    [GOOD[0], {"error": "no reply"}],
    [GOOD[0], {**GOOD[1], "data": None}],
    [GOOD[0], {"users": [{"user_id": "u2"}], "page": 2, "total": 2, "has_more": False}],
    [p | {"total": 3} for p in GOOD],                    # a wrong total
    [GOOD[0], GOOD[1] | {"total": 7}],
    [GOOD[0], GOOD[1], GOOD[1]],
], ids=str)
def test_incomplete_pages_stop_the_load_before_any_table(spark, store, tmp_path, pages):
    land(spark, tmp_path / "landing")
    folder = tmp_path / "landing" / "users"
    for file in folder.glob("*"):
        file.write_text("")
    (folder / "part-0.json").write_text("\n".join(map(json.dumps, pages)))
    with pytest.raises(ValueError, match="not complete"):
        jobs.daily_load(store, str(tmp_path / "landing"), "2025-01-03", today=TODAY)
    assert {store.read("raw", t).count() for t in RAW} == {0}
    (folder / "part-0.json").write_text("\n".join(map(json.dumps, GOOD)))
    jobs.daily_load(store, str(tmp_path / "landing"), "2025-01-03", today=TODAY)
    assert store.read("raw", "users").count() == 2 and len(stored(store)) == 9


def test_only_the_days_asked_for_are_opened(spark, store, tmp_path):
    land(spark, tmp_path)
    path = f"{tmp_path}/stream_events"
    files = landing.landed_pages(spark, path, "stream_events", [DAY2]).inputFiles()
    assert files and all(f"date={DAY2}" in f for f in files)
    found = landing.read_pages(spark, path, "stream_events", [DAY2])
    assert {r.started_at.date() for r in found.collect()} == {DAY2}
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        landing.read_pages(spark, path, "stream_events", [date(2024, 1, 1)])


def test_pages_hold_no_more_than_their_size(spark, tmp_path):
    users = raw_tables(spark)["users"]
    with pytest.raises(Exception, match="more than 2 records"):
        landing.write_pages(users, f"{tmp_path}/p", "0", 2)
    landing.write_pages(users, f"{tmp_path}/q", "length(user_id)", 2)
    pages = landing.landed_pages(spark, f"{tmp_path}/q", "users").orderBy("page").collect()
    assert [(p.page, p.total, p.has_more) for p in pages] == [(0, 3, True), (1, 3, False)]


def test_null_keys_are_refused_and_nothing_is_written(spark, store):
    good, bad = event("a"), (None,) + event("b")[1:]
    store.merge_events(batch(spark, good))
    users = raw_tables(spark)["users"]
    store.replace("raw", "users", users)
    nameless = users.selectExpr("nullif(user_id, 'u1') as user_id",
                                *(c for c in users.columns if c != "user_id"))
    for write in (
        lambda: store.merge_events(batch(spark, event("c"), bad, bad)),
        lambda: store.insert_or_ignore("stream_events", batch(spark, event("c"), bad)),
        lambda: store.insert_or_replace("stream_events", batch(spark, event("c"), bad)),
        lambda: store.replace("raw", "stream_events", batch(spark, event("c"), bad)),
        lambda: store.insert_or_replace("users", nameless),
        lambda: store.insert_or_ignore("users", nameless),
        lambda: store.replace("raw", "users", nameless),
    ):
        with pytest.raises(ValueError, match="have no"):
            write()
        assert stored(store) == {"a": (DAY1, 1)} and store.read("raw", "users").count() == 3


def test_replace_drops_other_days(spark, store):
    store.merge_events(batch(spark, event("a"), event("b", DAY2)))
    store.replace("raw", "stream_events", batch(spark, event("b", DAY2, played=4)))
    assert stored(store) == {"b": (DAY2, 4)}


def test_a_merge_that_was_cut_off_can_be_run_again(spark, store):
    """Cut off after the days were rewritten and before what moved away was deleted."""
    store.merge_events(batch(spark, event("a"), event("b", DAY2)))
    moved = batch(spark, event("b", DAY1, played=7))
    failing = Store(spark, store.root)
    object.__setattr__(failing, "_drop_stale_days", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        failing.merge_events(moved)
    store.merge_events(moved)
    assert stored(store) == {"a": (DAY1, 1), "b": (DAY1, 7)}


def test_merging_twice_equals_once(spark, store):
    import random

    rng, model = random.Random(3), {}
    for step in range(4):
        rows = [event(f"k{rng.randrange(6)}", rng.choice([DAY1, DAY2]), rng.randrange(90))
                for _ in range(5)]
        rows = list({r[0]: r for r in rows}.values())
        for _ in range(2):
            store.merge_events(batch(spark, *rows))
        model |= {r[0]: (r[3].date(), r[4]) for r in rows}
        assert stored(store) == model


def test_broken_page_stops_the_load(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"data": [{"album_id": ')
    with pytest.raises(Exception, match="(?i)malformed"):
        landing.read_pages(spark, str(tmp_path), "albums").collect()


def test_daily_load_build_test_check_report(spark, store, tmp_path):
    land(spark, tmp_path / "landing")
    assert jobs.daily_load(store, str(tmp_path / "landing"), today=TODAY, dry_run=True) == (
        DAY2, DAY2)
    assert stored(store) == {}
    jobs.daily_load(store, str(tmp_path / "landing"), today=TODAY)
    assert len(stored(store)) == 6  # yesterday only
    for _ in range(2):
        jobs.daily_load(store, str(tmp_path / "landing"), "2025-01-01", today=TODAY)
    assert len(stored(store)) == len(EVENTS)

    jobs.build(store)
    other = spark.newSession()  # sees the catalog, but no temporary views
    enriched = other.table("dev_intermediate.int_enriched_events")
    expected = jobs.enriched(jobs.staged_models(store))
    assert enriched.schema.names == expected.schema.names
    assert sorted(enriched.collect(), key=str) == sorted(expected.collect(), key=str)
    for model, df in jobs.staged_models(store).items():
        assert other.table(f"dev_staging.{model}").columns == df.columns
    assert other.sql("SELECT * FROM dev_raw.stream_events WHERE event_date = DATE '2025-01-04'"
                     ).count() == 6
    assert other.table("dev_marts.user_activity").count() == 3
    daily = store.read("marts", "daily_listening_stats").collect()
    assert {r.event_date: r.total_streams for r in daily} == {DAY1: 3, DAY2: 6}
    results = jobs.test(store)
    assert results.count() == 88
    assert not results.where("model = 'stg_tracks' and column = 'genre'").first().passed
    assert jobs.check(store).count() == 6
    counts = {r.table: r.n_rows for r in jobs.row_report(store).collect()}
    assert counts["raw.stream_events"] == 9 and counts["marts.user_activity"] == 3


def test_report_tolerates_missing_tables(spark, tmp_path):
    empty = Store(spark, str(tmp_path))
    assert {r.n_rows for r in jobs.row_report(empty).collect()} == {None}
    assert not empty.exists("raw", "users")


def test_backfill(spark, store):
    history = raw_tables(spark)
    jobs.backfill(store, history, "2025-01-04", "2025-01-04", today=TODAY, skip_reference=True)
    assert len(stored(store)) == 6 and store.read("raw", "users").count() == 0
    jobs.backfill(store, history, "2025-01-01", today=TODAY)
    assert len(stored(store)) == 9 and store.read("raw", "users").count() == 3
    with pytest.raises(ValueError):
        jobs.backfill(store, history, "2025-01-04", "2025-01-03", today=TODAY)


def test_command_line(spark, tmp_path, capsys):
    for table, df in raw_tables(spark).items():
        df.write.parquet(f"{tmp_path}/history/{table}")
    root = ["--root", str(tmp_path / "cli"), "--env", "prod"]
    fill = ["backfill", *root, "--history", str(tmp_path / "history")]
    assert main([*fill, "--start-date", "2025-02-01", "--end-date", "2025-01-01"]) == 1
    assert main([*fill, "--start-date", "2025-01-01", "--end-date", "2025-01-31"]) == 0
    assert main(["build", *root]) == 0
    assert main(["test", *root]) == 1  # the awkward rows
    assert main(["check", *root]) in (0, 1)
    assert main(["report", *root]) == 0
    assert (tmp_path / "cli" / "marts" / "genre_trends").exists()
    assert main(["load", *root, "--landing", "/none", "--dry-run"]) == 0
    assert "platform accepted_values: 1 failed" in capsys.readouterr().out


def test_merge_stream_equals_the_batch_load(spark, store, tmp_path):
    land(spark, tmp_path / "landing")
    for n in range(3):  # the same page arrives three times
        pages = spark.read.text(f"{tmp_path}/landing/stream_events").select("value")
        pages.write.mode("append").text(f"{tmp_path}/arriving")
    stream = landing.stream_pages(spark, f"{tmp_path}/arriving", "stream_events", 1)
    for _ in range(2):
        ingest.merge_stream(stream, store, f"{tmp_path}/checkpoint").awaitTermination()
        assert len(stored(store)) == len(EVENTS)


def test_stream_keeps_late_events_and_drops_copies(spark, tmp_path):
    """Batches of one file each: a new event, one ten days older, and copies of both."""
    old = event("old", date(2024, 12, 24))
    for rows in ([event("new", DAY2)], [old, event("new2", DAY2)], [old, event("new", DAY2)]):
        batch(spark, *rows).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(RAW["stream_events"]).option(
            "maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        ingest.to_table(ingest.deduplicated(stream), f"{tmp_path}/out", f"{tmp_path}/c"
                        ).awaitTermination()
    kept = spark.read.parquet(f"{tmp_path}/out").collect()
    assert sorted(r.event_id for r in kept) == ["new", "new2", "old"]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Tokyo"])
def test_daily_stream_in_any_zone(spark, tmp_path, zone):
    events = raw_tables(spark)["stream_events"].where("event_id <> 'e6'")
    events.write.parquet(f"{tmp_path}/in")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        stream = spark.readStream.schema(RAW["stream_events"]).parquet(f"{tmp_path}/in")
        ingest.latest_totals(ingest.daily_stats(stream), f"{tmp_path}/days", f"{tmp_path}/c2"
                             ).awaitTermination()
        days = {r.event_date: r for r in spark.read.parquet(f"{tmp_path}/days").collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert {d: r.total_streams for d, r in days.items()} == {DAY1: 3, DAY2: 5}
    assert days[DAY2].avg_pct_played == pytest.approx((90 + 10 + 12.3 + 6.6 + 1) / 5)


def test_a_page_without_data_stops_the_stream(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"page": 1, "error": "x"}')
    stream = landing.stream_pages(spark, str(tmp_path), "users")
    with pytest.raises(Exception, match="no data"):
        ingest.to_table(stream, f"{tmp_path}/out", f"{tmp_path}/c").awaitTermination()


def test_scratch_folder_is_shared_or_refused():
    assert default_root("yarn", "hdfs://nn:8020").startswith("hdfs://nn:8020/tmp/checkpoints/")
    assert default_root("local[8]", "file:///").startswith("file:/tmp/checkpoints/")
    for master in ("yarn", "spark://h:7077", "k8s://x", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            default_root(master, "file:///")


def test_checkpoint_folder_stays_the_same(spark):
    root = checkpoint_root(spark)
    assert checkpoint_root(spark) == root
    assert root in spark.sparkContext.getCheckpointDir()


def test_checkpoint_folder_named_by_the_session(tmp_path):
    code = (
        "from pyspark.sql import SparkSession; from tunelake.session import checkpoint_root, default_root; "
        f"s = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false')"
        f".config('spark.checkpoint.dir', '{tmp_path}').getOrCreate(); print(checkpoint_root(s))"
    )
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True,
                         timeout=120, cwd=os.path.dirname(os.path.dirname(__file__)))
    assert out.stdout.strip().endswith(str(tmp_path))


def test_a_day_without_pages_stops_the_load(spark, tmp_path):
    """An empty folder, and one that isn't there."""
    page = {"data": [], "page": 0, "page_size": 5, "total": 0, "has_more": False}
    path = tmp_path / "stream_events"
    for day in (DAY1, DAY2):
        (path / f"date={day}").mkdir(parents=True)
    (path / f"date={DAY1}" / "p.json").write_text(json.dumps(page))
    assert landing.read_pages(spark, str(path), "stream_events", [DAY1]).count() == 0
    with pytest.raises(ValueError, match=f"lack the days.*{DAY2}"):
        landing.read_pages(spark, str(path), "stream_events", [DAY1, DAY2])
    with pytest.raises(Exception):
        landing.read_pages(spark, str(path), "stream_events", [DAY1, date(2025, 1, 9)])


def marts_of(store):
    return {name: sorted(map(str, store.read("marts", name).collect())) for name in jobs.MARTS}


def rebuilt(store):
    jobs.build(store)
    return marts_of(store)


def test_refreshed_marts_equal_rebuilt_ones(spark, store):
    """New events, changed values and users, an event that moves to another day, a day that
    empties, and events without a day."""
    for table in ("artists", "albums", "tracks", "users"):
        store.replace("raw", table, landing.typed(raw_tables(spark)[table], table))
    untimed = event("n")[:3] + (None,) + event("n")[4:]
    day3 = date(2025, 1, 5)
    batches = [
        [event("a"), event("b"), event("c", DAY2), event("d", day3)],
        [event("b", played=7, hour=4), event("e", DAY2, played=90_000)],
        [event("d", DAY1), untimed],
        [event("a", played=2), event("c", DAY2, played=3)],
        [event("a", played=2), event("c", DAY2, played=3)],
    ]
    for n, rows in enumerate(batches):
        days = jobs.refresh(store, batch(spark, *rows))
        if n == 2:
            assert days == {DAY1, day3, None}
        assert marts_of(store) == rebuilt(store)


def test_a_refresh_that_was_cut_off_is_made_good(spark, store, monkeypatch):
    for table in ("artists", "albums", "tracks", "users"):
        store.replace("raw", table, landing.typed(raw_tables(spark)[table], table))
    jobs.refresh(store, batch(spark, event("a"), event("b", DAY2)))

    def cut_off(*_args):
        raise RuntimeError("cut off")

    with monkeypatch.context() as patched:
        patched.setattr(jobs, "build_marts", cut_off)
        with pytest.raises(RuntimeError):
            jobs.refresh(store, batch(spark, event("a", played=9)))
    jobs.refresh(store, batch(spark, event("c", DAY2)))
    assert marts_of(store) == rebuilt(store)
    values = store.read("marts", jobs.USER_VALUES).where("kind = 'day'").collect()
    assert sum(r.n for r in values) == 3


def test_refresh_reads_the_touched_days_only(spark, store):
    store.merge_events(batch(spark, event("a"), event("b", DAY2)))
    plan = jobs._touched(store, {DAY2})["stg_stream_events"]._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "event_date" in plan.split("PartitionFilters: [")[1]


def test_the_first_refresh_makes_users_of_the_stored_sums(spark, store, monkeypatch):
    """The events are summed once for both."""
    for table in ("artists", "albums", "tracks", "users"):
        store.replace("raw", table, landing.typed(raw_tables(spark)[table], table))
    def from_events(*_):
        raise AssertionError("the events are read once more")
    monkeypatch.setitem(jobs.MARTS, "user_activity", from_events)
    jobs.refresh(store, batch(spark, event("a"), event("b", DAY2)))
    assert store.exists("marts", "user_activity") and not store.exists("marts", jobs.UNFINISHED)
