import math
import re
from collections import Counter, defaultdict

import edge_data
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tunelake.llm import mixing


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 400), st.integers(0, 1000))
def test_permutation(n, key):
    there = mixing.permuted(np.arange(n), n, (key, 1))
    assert sorted(there.tolist()) == list(range(n))
    assert mixing.permuted(there, n, (key, 1), back=True).tolist() == list(range(n))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 1000), min_size=1, max_size=9))
def test_targets(sizes):
    found = mixing.targets(sizes, (3.0, 1.0, 2.0), 1.5, 2.0)
    assert sum(found) == pytest.approx(1.5 * sum(sizes))
    open_ = [(t / (3.0, 1.0, 2.0)[i % 3]) for i, (t, s) in enumerate(zip(found, sizes))
             if t < 2 * s]
    assert all(t <= 2 * s for t, s in zip(found, sizes))
    if open_:  # those below their limit share by weight; those at it would get more
        assert max(open_) == pytest.approx(min(open_))


@settings(max_examples=80, deadline=None)
@given(st.integers(1, 500), st.floats(0, 2), st.integers(1, 64))
def test_slots_come_out_at_the_target(words, part, block):
    s = mixing.planned(0, words, words * part, block, 5)
    total = 0
    for n in range(s.slots):
        epoch, at = divmod(n, s.blocks)
        b = int(mixing.permuted(np.array([at]), s.blocks, (5, 0, epoch))[0])
        length = min(block, words - b * block)
        total += s.last_take if n == s.slots - 1 else length
    assert total == round(words * part)


def test_shards_draw_all_slots_once():
    slots = np.array([300, 0, 55, 600, 45])
    at = np.zeros(5, int)
    for shard in range(10):
        counts, first = mixing.shard_counts(shard, 10, 100, slots, 3)
        assert counts.sum() == 100 and (first == at).all()
        at = at + counts
    assert (at == slots).all()


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_mix(docs, listed):
    mix = mixing.mixed(docs, block=16, per_shard=20)
    rows = mixing.taken(mix).collect()
    again = mixing.taken(mixing.mixed(docs, block=16, per_shard=20)).collect()
    key = lambda r: r["__row"]
    assert sorted(rows, key=key) == sorted(again, key=key)
    assert len(rows) == len(listed)
    words = Counter()
    for r in listed:
        words[r.source] += size(r.text)
    names = sorted(words, key=lambda s: (s is None, s or ""))
    wanted = dict(zip(names, mixing.targets([words[n] for n in names], mixing.WEIGHTS, 1.5, 2.0)))
    got = defaultdict(int)
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size
        got[(r.source_size, r.target)] += r.taken
    for name, target in wanted.items():
        assert got[(words[name], target)] == pytest.approx(target, abs=1) or list(
            words.values()).count(words[name]) > 1
    # No word is taken twice in a pass, and each span lies in its row.
    size_of = {r["__row"]: r.size for r in rows}
    seen = Counter()
    for s in mix.spans.collect():
        assert 0 <= s.start and s.start + s.n_words <= size_of[s["__row"]]
        for w in range(s.start, s.start + s.n_words):
            seen[(s["__row"], s.epoch, w)] += 1
    assert not seen or max(seen.values()) == 1


def test_documents_of_the_mix(docs, listed):
    out = mixing.mixed_documents(docs, block=16, per_shard=20)
    assert out.columns == docs.columns
    rows = out.collect()
    mix = mixing.taken(mixing.mixed(docs, block=16, per_shard=20)).collect()
    assert sum(size(r.text) for r in rows) == sum(r.taken for r in mix)
    texts = [r.text for r in listed if r.text]
    for r in rows:
        assert r.n_chars == len(r.text)
        assert all(w in VOCABULARY_OF(texts) for w in r.text.split())
    assert any(r.text in texts for r in rows)


def VOCABULARY_OF(texts, cache={}):
    if "words" not in cache:
        cache["words"] = {w for t in texts for w in t.split()}
    return cache["words"]


def test_empty(docs):
    mix = mixing.mixed(edge_data.empty(docs))
    assert mixing.taken(mix).count() == 0
    assert mixing.mixed_documents(edge_data.empty(docs)).count() == 0
    blank = docs.where("text is null")
    assert {(r.taken, r.target) for r in mixing.taken(mixing.mixed(blank)).collect()} == {(0, 0.0)}


def test_reruns_agree_however_the_table_is_split(spark, docs, tmp_path):
    path = str(tmp_path / "documents.parquet")
    more = docs.select("doc_id", "text", "source").union(spark.createDataFrame(
        [(None, "the same words again", "a")] * 700, "doc_id long, text string, source string"))
    more.repartition(1).write.parquet(path)

    def found(df):
        return sorted(((r["__id"], r.size, r.target, r.taken) for r in mixing.taken(
            mixing.mixed(df, block=8, per_shard=16, chunk_rows=50)).collect()), key=str)

    one = found(spark.read.parquet(path))
    other = found(spark.read.parquet(path).repartition(7, "text").sortWithinPartitions("source"))
    assert one == other
    assert len(one) == more.count()


def test_draws_of_any_size():
    """Against the probabilities, and of totals beyond what numpy draws."""
    rng = np.random.default_rng(5)
    for good, bad, n in ((7, 9, 5), (3, 40, 11), (30, 4, 31), (1, 1, 1), (200, 300, 250)):
        found = np.bincount([mixing.hypergeometric(rng, good, bad, n) for _ in range(20_000)],
                            minlength=good + 1)
        ways = np.array([math.comb(good, k) * math.comb(bad, n - k) / math.comb(good + bad, n)
                         if 0 <= n - k <= bad else 0 for k in range(good + 1)])
        assert not found[:good + 1][ways == 0].any()
        error = np.sqrt(20_000 * ways * (1 - ways)) + 1
        assert (np.abs(found[:good + 1] - 20_000 * ways) < 5 * error).all()
    big = [mixing.hypergeometric(rng, 10**13, 3 * 10**13, 2 * 10**13) for _ in range(2000)]
    deviation = math.sqrt(2e13 * 0.25 * 0.75 * 0.5)
    assert abs(np.mean(big) - 5e12) < 5 * deviation / math.sqrt(2000)
    assert 0.9 < np.std(big) / deviation < 1.1


def test_shards_add_up_when_no_split_is_numpys():
    slots = np.array([500, 0, 37, 1463 + 48], np.int64)
    parts = [mixing.shard_counts(i, 4, 512, slots, 3, limit=0) for i in range(4)]
    assert (sum(c for c, _ in parts) == slots).all()
    assert all(c.sum() == 512 for c, _ in parts)
    assert (np.cumsum([c for c, _ in parts], 0)[:-1] == [f for _, f in parts[1:]]).all()
