import re
from collections import Counter

import edge_data
import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tunelake.llm import packing, queries


def check(found, sizes, lengths):
    """Every token once, no bin overfull, offsets without overlap, lengths downsized."""
    pieces, bins = {}, {}
    for r in found:
        pieces.setdefault(r.doc_id, []).append((r.start, r.n_tokens))
        bins.setdefault(r.bin_id, []).append(r)
    for doc, parts in pieces.items():
        at = 0
        for start, n in sorted(parts):
            assert start == at or n == 0
            at = start + n
        assert at == sizes[doc]
    for rows in bins.values():
        used = sum(r.n_tokens for r in rows)
        assert {(r.bin_used, r.bin_length) for r in rows} == {
            (used, min(x for x in lengths if x >= used))}
        at = 0
        for r in sorted(rows, key=lambda r: (r.bin_offset, r.n_tokens)):
            assert r.bin_offset == at
            at += r.n_tokens


def test_all_tokens_are_packed_once(docs, listed):
    unique = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    sizes = {r.doc_id: len((r.text or "").split()) for r in listed}
    for lengths in ((16, 64, 256), (4096,)):
        found = packing.packed(unique, lengths=lengths, part_rows=100).collect()
        assert {r.doc_id for r in found} == {r.doc_id for r in unique.collect()}
        check(found, sizes, lengths)


def test_repeated_rows_null_ids_and_size_column(docs, listed):
    found = packing.packed(docs).collect()
    assert sum(r.n_tokens for r in found) == sum(len((r.text or "").split()) for r in listed)
    assert len([r for r in found if r.doc_id is None]) == 1
    given_sizes = docs.selectExpr("doc_id", "7 as size")
    assert {r.n_tokens for r in packing.packed(given_sizes, size="size").collect()} == {7}


def test_empty_table(docs):
    assert packing.packed(edge_data.empty(docs)).count() == 0


def plain(sizes, lengths, overhead):
    """Best-fit decreasing step by step: every bin is looked at for every piece, and every length for
    every bin that is opened. The sums of what is to come are 64 pieces old at most."""
    rooms, used, places, sums_of = [], [], [], None
    for n, size in enumerate(sizes):
        fits = [(room, b) for b, room in enumerate(rooms) if room > 0 and room >= size]
        if fits:
            b = min(fits)[1]
        else:
            if sums_of is None or n - sums_of >= 64:
                sums_of = n
            later, costs = sizes[sums_of + 1:], []
            for length in lengths:
                if length >= size:
                    room = length - size
                    filled = size + min(room, sum(x for x in later if x <= room))
                    costs.append(((length + overhead) / max(1, filled), length))
            rooms.append(min(costs)[1])
            used.append(0)
            b = len(rooms) - 1
        places.append((b, used[b]))
        used[b] += size
        rooms[b] -= size
    return places, [min(x for x in lengths if x >= u) for u in used]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 50), max_size=150), st.integers(0, 9))
def test_best_fit_against_a_plain_version(sizes, overhead):
    sizes = sorted(sizes, reverse=True)
    lengths = (10, 25, 50)
    bins, offsets, final = packing.pack(np.array(sizes, np.int64), lengths, overhead)
    assert (list(zip(bins, offsets)), final) == plain(sizes, lengths, overhead)


def repacked(found, lengths, overhead):
    """Every part packed again by the plain version, from its pieces alone."""
    parts, out = {}, []
    for r in found:
        parts.setdefault(r.bin_id.split("-")[0], []).append(r)
    for part, rows in parts.items():
        rows.sort(key=lambda r: (-r.n_tokens, r.doc_id is not None, r.doc_id, r.piece))
        places, final = plain([r.n_tokens for r in rows], lengths, overhead)
        filled = Counter()
        for r, (b, _) in zip(rows, places):
            filled[b] += r.n_tokens
        out += [(r.doc_id, r.piece, r.start, r.n_tokens, f"{part}-{b}", at, final[b], filled[b])
                for r, (b, at) in zip(rows, places)]
    return out


def test_query_against_a_plain_version(spark):
    found = queries.op4_best_fit_packing(spark, "/root/testdata/sf0.001").collect()
    rows = [(r.doc_id, r.piece, r.start, r.n_tokens, r.bin_id, r.bin_offset, r.bin_length,
             r.bin_used) for r in found]
    assert Counter(rows) == Counter(repacked(found, packing.LENGTHS, packing.OVERHEAD))
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    wanted = Counter()
    for r in docs:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
        for i in range(max(1, -(-n // 4096))):
            wanted[r.doc_id, i, i * 4096, min(4096, n - i * 4096)] += 1
    assert Counter(r[:4] for r in rows) == wanted


def test_rows_alike_are_spread_and_reruns_agree(spark, tmp_path):
    """A third of the rows are the same; they don't meet in one part, and the split of the scan
    changes nothing."""
    rows = [(None, "x y")] * 400 + [(f"id {i}", "a " * (i % 90)) for i in range(800)]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    results = []
    for n, order in ((1, "doc_id"), (7, "text")):
        path = str(tmp_path / f"t{n}")
        df.repartition(n).sortWithinPartitions(order).write.parquet(path)
        found = packing.packed(spark.read.parquet(path), lengths=(32, 64), part_rows=100).collect()
        results.append(Counter(map(tuple, found)))
    assert results[0] == results[1] and sum(results[0].values()) >= 1200
    alike = Counter(r.bin_id.split("-")[0] for r in found if r.doc_id is None)
    assert sum(alike.values()) == 400 and len(alike) >= 6


def test_packs_tightly():
    rng = np.random.default_rng(1)
    sizes = np.sort(rng.integers(1, 1500, 3000))[::-1]
    _, _, final = packing.pack(sizes, packing.LENGTHS, packing.OVERHEAD)
    assert sizes.sum() / sum(final) > 0.99
