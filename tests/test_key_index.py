"""Merges with the index of keys, which tells the days to open."""

import os
from datetime import timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from test_loads import DAY1, DAY2, batch, event, stored

from tunelake.sinks.store import Store

DAYS = [DAY1 + timedelta(days=n) for n in range(100)]


@pytest.fixture
def history(spark, tmp_path):
    """A hundred days of three events, indexed."""
    store = Store(spark, str(tmp_path / "store"))
    store.create_raw_tables()
    store.replace("raw", "stream_events", batch(
        spark, *(event(f"{d}-{n}", d) for d in DAYS for n in range(3))))
    store.index_keys()
    return store


def spoil(store, days):
    """From now on, whoever opens a file of these days fails."""
    for day in days:
        folder = store.path("raw", "stream_events") + f"/event_date={day}"
        for name in os.listdir(folder):
            if not name.endswith(".crc"):
                with open(f"{folder}/{name}", "wb") as file:
                    file.write(b"no parquet")
            elif os.path.exists(f"{folder}/{name}"):
                os.remove(f"{folder}/{name}")


def rows_of(store, *days):
    table = store.read("raw", "stream_events").where(
        "event_date in (%s)" % ", ".join(f"date'{d}'" for d in days))
    return {(r.event_id, r.event_date, r.ms_played) for r in table.collect()}


def test_a_merge_opens_its_day_and_the_days_of_older_copies(spark, history):
    spoil(history, [d for d in DAYS if d not in (DAYS[99], DAYS[40])])
    moved = f"{DAYS[40]}-1"
    history.merge_events(batch(spark, event("new", DAYS[99], 5), event(moved, DAYS[99], 6)))
    assert rows_of(history, DAYS[99], DAYS[40]) == (
        {(f"{DAYS[99]}-{n}", DAYS[99], 1) for n in range(3)}
        | {("new", DAYS[99], 5), (moved, DAYS[99], 6)}
        | {(f"{DAYS[40]}-{n}", DAYS[40], 1) for n in (0, 2)})
    # The index knows the new rows: a second move finds the first.
    history.merge_events(batch(spark, event("new", DAYS[40], 7)))
    assert ("new", DAYS[40], 7) in rows_of(history, DAYS[40])
    assert not any(key == "new" for key, _, _ in rows_of(history, DAYS[99]))


def test_ignore_opens_the_days_of_stored_keys(spark, history):
    spoil(history, [d for d in DAYS if d != DAYS[7]])
    taken = f"{DAYS[7]}-2"
    late = DAYS[99] + timedelta(days=1)
    for _ in range(2):
        history.insert_or_ignore("stream_events", batch(
            spark, event(taken, late, 9), event("x", late, 9)))
        assert rows_of(history, DAYS[7], late) == {
            (f"{DAYS[7]}-{n}", DAYS[7], 1) for n in range(3)} | {("x", late, 9)}


def test_other_loads_keep_the_index_or_give_it_up(spark, history):
    history.replace("raw", "stream_events", batch(spark, event("a"), event("b", DAY2)))
    assert history.keys.ready() and history.keys.read().count() == 2
    history.merge_events(batch(spark, event("a", DAY2, 2)))
    assert stored(history) == {"a": (DAY2, 2), "b": (DAY2, 1)}
    history.append("raw", "stream_events", batch(spark, event("c")))
    assert not history.keys.ready()
    history.merge_events(batch(spark, event("c", DAY2, 3)))
    assert stored(history) == {"a": (DAY2, 2), "b": (DAY2, 1), "c": (DAY2, 3)}


def test_a_merge_that_was_cut_off_after_the_index(spark, history, monkeypatch):
    """The index has the new fingerprints, the table not the rows; the second run makes it good."""
    second = batch(spark, event(f"{DAYS[3]}-0", DAYS[4], 8), event("n", DAYS[4], 8))
    write = Store._write

    def fail(*args, **kwargs):
        raise OSError("cut off")

    monkeypatch.setattr(Store, "_write", fail)
    with pytest.raises(OSError):
        history.merge_events(second)
    monkeypatch.setattr(Store, "_write", write)
    before = history.keys.read().count()
    history.merge_events(second)
    assert history.keys.read().count() == before  # nothing is entered twice
    found = stored(history)
    assert found[f"{DAYS[3]}-0"] == (DAYS[4], 8) and found["n"] == (DAYS[4], 8)
    assert len(found) == 301


def test_a_build_that_was_cut_off_is_no_index(spark, history, monkeypatch):
    monkeypatch.setattr(type(history.keys), "_write", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        history.index_keys()
    assert not history.keys.ready()


def test_events_without_a_day(spark, history):
    untimed = event("n")[:3] + (None,) + event("n")[4:]
    history.merge_events(batch(spark, untimed))
    history.merge_events(batch(spark, event("n", DAYS[5], 4)))
    found = stored(history)
    assert found["n"] == (DAYS[5], 4) and len(found) == 301


@settings(max_examples=4, deadline=None,
          suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 3), st.integers(1, 99)),
                         min_size=1, max_size=6, unique_by=lambda x: x[0]),
                min_size=2, max_size=4))
def test_indexed_merges_equal_a_dictionary(spark, tmp_path_factory, loads):
    store = Store(spark, str(tmp_path_factory.mktemp("store")))
    store.create_raw_tables()
    store.index_keys()
    wanted = {}
    for load in loads:
        store.merge_events(batch(spark, *(event(f"k{k}", DAYS[d], n) for k, d, n in load)))
        wanted |= {f"k{k}": (DAYS[d], n) for k, d, n in load}
        assert stored(store) == wanted
