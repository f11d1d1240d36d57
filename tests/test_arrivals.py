"""Days that arrive in parts, fields that no schema knows, distinct counts from daily states."""

import json

import pytest
from pyspark.sql import functions as F

from small_data import DAY1, DAY2, raw_tables
from tunelake.plans import jobs
from tunelake.schemas import DIMENSIONS
from tunelake.sinks.store import Store
from tunelake.sources import landing
from tunelake.streaming import distinct, ingest


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"))


def put(tmp_path, day, number, ids, total, more, **extra):
    folder = tmp_path / "in" / f"date={day}"
    folder.mkdir(parents=True, exist_ok=True)
    data = [{"event_id": i, "user_id": "u1", "started_at": f"{day}T10:00:00", "ms_played": 1} | extra
            for i in ids]
    page = {"data": data, "page": number, "page_size": 2, "total": total, "has_more": more}
    name = f"p{number}-{len(list(folder.iterdir()))}.json"
    (folder / name).write_text(json.dumps(page))


def test_a_day_is_merged_once_it_is_complete(store, tmp_path):
    def run():
        ingest.merge_complete_days(f"{tmp_path}/in", store, f"{tmp_path}/facts",
                                   f"{tmp_path}/checkpoint", 1).awaitTermination()
        return {r.event_id for r in store.read("raw", "stream_events").collect()}

    def late(after="0 seconds"):
        return [(r.date, r.records, r.total)
                for r in ingest.overdue_days(store, f"{tmp_path}/facts", after).collect()]

    put(tmp_path, DAY1, 1, ["c"], 3, False)        # the last page first
    put(tmp_path, DAY2, 0, ["x", "y"], 2, False)
    assert run() == {"x", "y"}
    assert late() == [(str(DAY1), 1, 3)] and late("1 day") == []
    put(tmp_path, DAY1, 0, ["a", "b"], 3, True)
    assert run() == {"a", "b", "c", "x", "y"} and late() == []
    put(tmp_path, DAY2, 0, ["x", "y"], 2, False)   # the same page once more
    assert run() == {"a", "b", "c", "x", "y"} and late() == []


def test_unknown_fields_are_kept_and_reported(spark, store, tmp_path):
    for table in DIMENSIONS:
        landing.write_pages(raw_tables(spark)[table].drop("_dlt_load_id", "_dlt_id"),
                            f"{tmp_path}/in/{table}", "0", 500)
    put(tmp_path / "in" / "x", DAY1, 0, ["a"], 1, False)
    folder = tmp_path / "in" / "stream_events"
    (tmp_path / "in" / "x" / "in").rename(folder)
    page = {"data": [{"event_id": "b", "started_at": f"{DAY2}T10:00:00", "mood": "calm",
                      "place": {"lat": 1.5, "name": None}},
                     {"event_id": "c", "started_at": f"{DAY2}T11:00:00", "mood": 7}],
            "page": 0, "page_size": 2, "total": 2, "has_more": False}
    (folder / f"date={DAY2}").mkdir()
    (folder / f"date={DAY2}" / "p.json").write_text(json.dumps(page) + "\n\n")
    for _ in range(2):
        jobs.daily_load(store, f"{tmp_path}/in", str(DAY1), today=DAY2.replace(day=DAY2.day + 1),
                        keep_extra=True)
    extra = store.read_extra("stream_events")
    rows = extra.selectExpr("date", "key", "field", "to_json(value) as v").collect()
    assert sorted(map(tuple, rows)) == [
        (str(DAY2), "b", "mood", '"calm"'), (str(DAY2), "b", "place", '{"lat":1.5,"name":null}'),
        (str(DAY2), "c", "mood", "7")]
    types = {r.field: (r.type, r.records) for r in landing.field_types(extra).collect()}
    assert types["mood"] == ("VARIANT", 2) and types["place"][1] == 1
    assert "lat" in types["place"][0]
    assert store.read_extra("users").count() == 0
    assert store.read("raw", "stream_events").count() == 3


def test_distinct_counts_come_from_daily_states(spark, tmp_path):
    rows = spark.range(60_000).selectExpr(
        "cast(id as string) as event_id", "cast(pmod(hash(id), 40000) as string) as user_id",
        "timestamp_ntz '2025-01-01' + make_interval(0, 0, 0, cast(id % 9 as int)) as started_at")
    null = rows.limit(3).withColumn("user_id", F.lit(None).cast("string"))
    for n, part in enumerate([rows.where("event_id % 2 = 0"),
                              rows.where("event_id % 2 = 1").union(null), rows.limit(100)]):
        part.write.parquet(f"{tmp_path}/in/arrival={n}")
        stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in/arrival=*")
        for name, states in (("exact", distinct.daily_bitmaps(stream, "user_id")),
                             ("about", distinct.daily_sketches(stream, "user_id"))):
            distinct.kept(states, f"{tmp_path}/{name}", f"{tmp_path}/c-{name}").awaitTermination()
    exact, about = spark.read.parquet(f"{tmp_path}/exact"), spark.read.parquet(f"{tmp_path}/about")
    by_day: dict = {}
    for r in rows.collect():
        by_day.setdefault(r.started_at.date(), set()).add(r.user_id)
    for days in (1, 7):
        expected = {d: len(set().union(*(u for e, u in by_day.items() if 0 <= (d - e).days < days)))
                    for d in by_day}
        found = {r.event_date: r.n_ids for r in distinct.distinct_ids(exact, days).collect()}
        assert found == expected
        near = {r.event_date: r.n_ids for r in distinct.estimated_ids(about, days).collect()}
        assert near.keys() == expected.keys()
        assert all(abs(near[d] - n) < 0.05 * n for d, n in expected.items())
