"""Lookups, concentration, modes and upserts, against plain Python."""

import random
from collections import Counter

import pytest

from tunelake.operators import lookups, ranking, upserts
from tunelake.operators.pareto import pareto_share


def skewed(n=3000, seed=1):
    rng = random.Random(seed)
    return [(i, None if i % 11 == 0 else 7 if i % 3 == 0 else rng.randrange(200)) for i in range(n)]


def test_salted_lookup_spreads_a_hot_key(spark, no_broadcast):
    fact = spark.createDataFrame(skewed(), "id long, k long")
    dim = spark.createDataFrame([(k, f"name{k}") for k in range(0, 200, 2)] + [(7, "hot")],
                                "k long, name string")
    found = lookups.lookup(fact, dim, "k", spread="id").collect()
    names = dict(dim.collect())
    assert sorted((r.id, r.k, r.name) for r in found if r.k is not None) == sorted(
        (i, k, names[k]) for i, k in skewed() if k in names)
    assert len(found) == 3000
    hot = {r["__hot_key"]: r["__parts"] for r in lookups.hot_keys(fact, "k", share=10).collect()}
    share = Counter(k for _, k in skewed() if k is not None)
    total = sum(share.values())
    assert hot == {7: -(-share[7] * 10 // total)}


def test_hot_keys_count_groups_first(spark, monkeypatch):
    """Many keys: only those of a full group are counted one by one, and no cold key of it is taken."""
    monkeypatch.setattr(lookups, "KEY_GROUPS", 50)
    fact = spark.range(4000).selectExpr("if(id < 1000, -1, id) as k")
    hot = lookups.hot_keys(fact, "k", share=10)
    assert [(r["__hot_key"], r["__parts"]) for r in hot.collect()] == [(-1, 3)]
    plan = hot._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [__group" in plan


def test_hot_keys_are_bounded_by_the_share(spark):
    fact = spark.range(1000).selectExpr("id % 50 as k")
    assert lookups.hot_keys(fact, "k", share=49).count() == 0
    parts = [r["__parts"] for r in lookups.hot_keys(fact, "k", share=100).collect()]
    assert parts == [2] * 50


def test_lookup_refuses_ambiguous_columns(spark):
    fact = spark.createDataFrame([(1, 2)], "k int, x int")
    with pytest.raises(ValueError):
        lookups.lookup(fact, fact, "k")


@pytest.mark.parametrize("threshold", ["-1", "100", "1m"])
def test_known_key(spark, no_broadcast, monkeypatch, threshold):
    """No strays, few strays and too many strays to broadcast give the same."""
    monkeypatch.setattr(lookups, "fits_broadcast", lambda dim: False)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    fact = spark.createDataFrame(skewed(), "id long, k long")
    for known in (range(200), range(150)):
        dim = spark.createDataFrame([(k,) for k in known], "k long")
        found = lookups.known_key(fact, dim, "k", spread="id")
        assert ("__stray" in found._jdf.queryExecution().analyzed().toString()) == (
            threshold == "1m" and any(k not in known for _, k in skewed() if k is not None))
        assert dict(found.collect()) == {
            i: k if k is not None and k in known else None for i, k in skewed()}


def test_broadcast_follows_the_threshold(spark, no_broadcast):
    small = spark.range(1)
    assert not lookups.fits_broadcast(small)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1m")
    assert lookups.fits_broadcast(small)
    assert not lookups.fits_broadcast(spark.range(10_000_000))
    # Rows from Python have no known size and are never taken for small.
    assert not lookups.fits_broadcast(spark.createDataFrame([(1,)], "k int"))


@pytest.mark.parametrize("fraction", ["0.2", "0.5", "0.01"])
@pytest.mark.parametrize("seed", range(4))
def test_pareto_share(spark, fraction, seed):
    rng = random.Random(seed)
    keys = [int(rng.paretovariate(0.8)) % 60 for _ in range(rng.randrange(20, 800))] + [None]
    counts = sorted(Counter(keys).values(), reverse=True)
    quota = int(len(counts) * float(fraction))
    df = spark.createDataFrame([(k,) for k in keys], "k int")
    row = pareto_share(df, "k", fraction).first()
    assert (row.n_keys, row.n_rows) == (len(counts), len(keys))
    expected = 100 * sum(counts[:quota]) / len(keys) if quota else None
    assert row.top_pct == (pytest.approx(expected) if quota else None)


def test_pareto_share_of_counted_rows(spark):
    df = spark.createDataFrame([("a", 5), ("b", 1), ("a", 3), ("c", 1), ("d", 1), ("e", 1)],
                               "k string, n long")
    assert pareto_share(df, "k", weight="n").first().top_pct == pytest.approx(100 * 8 / 12)


def test_top_per_group_limits_before_the_shuffle(spark):
    df = spark.range(10_000).selectExpr("id % 3 as g", "id as k", "id % 100 as n")
    top = ranking.top_per_group(df, "g", "n", "k", 5)
    assert "WindowGroupLimit" in top._jdf.queryExecution().toString()
    rows = top.collect()
    assert len(rows) == 15 and all(r.n == 99 for r in rows)
    assert sorted(r.k for r in rows if r.g == 0)[0] == 99


def test_one_per_key(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")],
                               "k string, at int, v string")
    assert dict(r[::2] for r in upserts.one_per_key(df, "k", "at").collect()) == {"a": "y", "b": "z"}
    first = upserts.one_per_key(df, "k", "at", keep="first").collect()
    assert dict(r[::2] for r in first) == {"a": "x", "b": "z"}
    again = upserts.one_per_key(df.repartition(5), "k").collect()
    assert sorted(again) == sorted(upserts.one_per_key(df.coalesce(1), "k").collect())


def test_copies_of_a_key_are_cut_before_the_shuffle(spark):
    df = spark.range(1000).selectExpr("if(id % 3 = 0, 0, id) as k", "id as v")
    plan = upserts.one_per_key(df, "k", "v")._jdf.queryExecution().executedPlan().toString()
    partial, shuffle = plan.index("Partial"), plan.index("Exchange hashpartitioning")
    assert shuffle < partial  # the plan is printed from the result down to the scan


def test_replace_and_ignore(spark):
    stored = spark.createDataFrame([("a", 1), ("b", 1)], "k string, v int")
    batch = spark.createDataFrame([("b", 2), ("c", 2), ("c", 3)], "k string, v int")
    assert dict(upserts.replace_rows(stored, batch, "k", "v").collect()) == {"a": 1, "b": 2, "c": 3}
    assert dict(upserts.new_rows(stored, batch, "k", "v").collect()) == {"c": 2}
    matched = upserts.stored_matches(stored, batch, "k").collect()
    assert [r.k for r in matched] == ["b"]


def test_orphans_count_rows_and_skip_nulls(spark):
    child = spark.createDataFrame([(1,), (1,), (2,), (None,)], "k int")
    parent = spark.createDataFrame([(2,), (None,)], "p int")
    assert [tuple(r) for r in lookups.orphans(child, parent, "k", "p").collect()] == [(1, 2)]


def test_large_dimension_plan_shuffles_on_key_and_salt(spark, no_broadcast):
    fact = spark.range(100).selectExpr("id", "id % 5 as k")
    dim = spark.range(5).selectExpr("id as k", "'x' as name")
    plan = lookups.lookup(fact, dim, "k", spread="id")._jdf.queryExecution().toString()
    assert "SortMergeJoin" in plan or "ShuffledHashJoin" in plan
    assert "__part" in plan


def test_global_rank_numbers_every_row(spark):
    """Ties, NULLs and many ranges; the plan has no window over the keys."""
    from tunelake.operators.ranking import global_rank

    rows = [(i, i % 7 if i % 10 else None) for i in range(500)] + [(None, 3), (None, None)]
    df = spark.createDataFrame(rows, "k int, n int").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = sorted((r["rank"], r.k, r.n) for r in global_rank(df, "n", "k").collect())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    order = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0] is None, r[0] or 0))
    assert got == [(i, *r) for i, r in enumerate(order, 1)]
    assert global_rank(df.where("1 = 0"), "n", "k").collect() == []
