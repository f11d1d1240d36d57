import hashlib
from collections import Counter

import edge_data
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tunelake.llm import suffix_array, suffix_dedup


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=60), st.booleans())
def test_suffix_array(symbols, each):
    text = np.array([*symbols, 0])
    small, suffix_array.SMALL = suffix_array.SMALL, 1 if each else suffix_array.SMALL
    try:
        found = suffix_array.suffix_array(text, 5).tolist()
    finally:
        suffix_array.SMALL = small
    assert found == sorted(range(len(text)), key=lambda i: text[i:].tolist())


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 3), min_size=1, max_size=60))
def test_common_prefixes(symbols):
    text = np.array([*symbols, 0], np.uint8)
    sa = suffix_array.suffix_array(text, 4)
    before, common = suffix_array.common_prefixes(text, sa, 13)
    for a, b in zip(sa[:-1].tolist(), sa[1:].tolist()):
        n = 0
        while n < 13 and max(a, b) + n < len(text) and text[a + n] == text[b + n]:
            n += 1
        assert before[b] == a and common[b] == n


def brute(texts, length):
    parts = [(t or "").encode() for t in texts]
    seen = Counter(p[i:i + length] for p in parts for i in range(len(p) - length + 1))
    out = []
    for p in parts:
        covered = np.zeros(len(p), bool)
        for i in range(len(p) - length + 1):
            if seen[p[i:i + length]] > 1:
                covered[i:i + length] = True
        left = bytes(np.frombuffer(p, np.uint8)[~covered])
        spans = int((np.diff(np.r_[0, covered.astype(int)]) == 1).sum())
        out.append((len(p), int(covered.sum()), spans, hashlib.sha256(left).hexdigest()))
    return out


@pytest.mark.parametrize("length, window, many", [(200, 72, 2000), (24, 9, 2)])
def test_against_brute_force(docs, listed, monkeypatch, length, window, many):
    short = [r.text if r.text is None or len(r.text) < 20_000 else r.text[:9000] for r in listed]
    df = docs.withColumn("text", docs.text.substr(1, 9000).alias("text")) if length < 200 else docs
    texts = [r.text for r in df.collect()]
    monkeypatch.setattr(suffix_dedup, "MANY", many)
    found = suffix_dedup.without_repeats(df, length=length, window=window).collect()
    got = sorted((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found)
    assert got == sorted(brute(texts, length))
    assert len(short) == len(found)
    for r in found:
        assert hashlib.sha256(r.kept).hexdigest() == r.kept_sha256
        assert sum(s.end - s.start for s in r.spans) == r.n_removed


def test_a_line_in_very_many_texts_is_split(spark, tmp_path, monkeypatch):
    """A 150-byte line holds both anchors of thousands of different contexts; a longer passage
    repeats as well, and a run of one letter within itself."""
    line, passage = edge_data.prose(60, 50)[:150], edge_data.prose(90, 51)[:260]
    rows = []
    for i in range(2400):
        here = passage if i % 6 == 0 else "z" * (210 + i % 5) if i % 100 == 1 else line
        rows.append((i, f"{edge_data.prose(45, 2 * i + 7000)} {here} "
                        f"{edge_data.prose(45, 2 * i + 7001)}"))
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(path)
    bound, search = 1 << 15, suffix_dedup.repeated_starts

    def bounded(pieces, length):
        # A shard is parted once it has twice the bound; a key adds the bound at most.
        assert sum(map(len, pieces)) < 4 * bound
        return search(pieces, length)

    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", bound)
    monkeypatch.setattr(suffix_dedup, "MANY", 100)
    monkeypatch.setattr(suffix_dedup, "repeated_starts", bounded)
    found = suffix_dedup.without_repeats(spark.read.parquet(path), with_text=False).collect()
    got = sorted((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found)
    assert got == sorted(brute([t for _, t in rows], 200))


def test_empty(docs):
    assert suffix_dedup.without_repeats(edge_data.empty(docs)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(min_size=6, max_size=30).map(lambda b: bytes(x % 3 + 65 for x in b)),
                min_size=1, max_size=8))
def test_starts(pieces):
    seen = Counter(p[i:i + 6] for p in pieces for i in range(len(p) - 5))
    found = suffix_dedup.repeated_starts(pieces, 6)
    assert [f.tolist() for f in found] == [
        [i for i in range(len(p) - 5) if seen[p[i:i + 6]] > 1] for p in pieces]
