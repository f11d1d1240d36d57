import hashlib
from collections import defaultdict

import edge_data
import pytest

from tunelake.llm import exact_dedup


@pytest.mark.parametrize("keep", ["largest", "smallest"])
@pytest.mark.parametrize("fan_in, shards", [(2, 3), (8, 64)])
def test_groups(docs, listed, keep, fan_in, shards):
    found = exact_dedup.duplicate_groups(docs, keep=keep, fan_in=fan_in, shards=shards).collect()
    groups = defaultdict(list)
    for r in listed:
        groups[r.text or ""].append(r.doc_id)
    assert len(found) == len(listed)
    by_sha = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    kept = defaultdict(int)
    for r in found:
        ids = by_sha[r.text_sha256]
        known = [i for i in ids if i is not None]
        best = (max if keep == "largest" else min)(known) if known else None
        assert (r.keep_id, r.group_size) == (best, len(ids))
        kept[r.text_sha256] += r.kept
        if r.kept:
            assert r["__id"] == best
    assert set(kept.values()) == {1} and len(kept) == len(groups)


def test_one_row_of_each_text_stays(docs, listed):
    left = exact_dedup.without_duplicates(docs, keep="largest")
    assert left.columns == docs.columns
    texts = [r.text or "" for r in left.collect()]
    assert sorted(texts) == sorted({r.text or "" for r in listed})


def test_empty_and_wrong(docs):
    assert exact_dedup.duplicate_groups(edge_data.empty(docs)).count() == 0
    with pytest.raises(ValueError):
        exact_dedup.duplicate_groups(docs, keep="first")
