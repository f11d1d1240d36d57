import numpy as np
import edge_data
import pytest

from tunelake.llm import ngram_join


def sets_of(listed):
    return {i: frozenset(ngram_join.grams(r.text or "").tolist()) for i, r in enumerate(listed)}


def brute(listed, threshold=0.8):
    """Links and connected sets of the rows, by comparing all."""
    sets = sets_of(listed)
    n = len(listed)
    links, up = [0] * n, list(range(n))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(n):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= threshold * (len(sets[i]) + len(sets[j]) - both):
                links[i] += 1
                links[j] += 1
                up[max(root(i), root(j))] = min(root(i), root(j))
    groups = {}
    for i in range(n):
        groups.setdefault(root(i), []).append(i)
    return links, [groups[root(i)] for i in range(n)]


def expected(listed):
    links, groups = brute(listed)
    out = []
    for i, r in enumerate(listed):
        known = [listed[j].doc_id for j in groups[i] if listed[j].doc_id is not None]
        out.append((r.doc_id if r.doc_id is not None else -1,
                    min(known) if known else -1, len(groups[i]), links[i]))
    return sorted(out)


@pytest.mark.parametrize("block", [256, 3])
def test_links_and_groups(docs, listed, block):
    found = ngram_join.near_duplicates(docs, block=block).collect()
    got = sorted((r["__id"] if r["__id"] is not None else -1,
                  r.class_id if r.class_id is not None else -1, r.class_size, r.n_links)
                 for r in found)
    assert got == expected(listed)
    assert max(r.n_links for r in found) > 5


def test_given_documents(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = ngram_join.near_duplicates(rows).collect()
    got = sorted((r["__id"], r.class_id, r.class_size, r.n_links) for r in found)
    assert got == expected(rows.collect())


def test_one_of_each_group_stays(docs, listed):
    left = ngram_join.without_near_duplicates(docs)
    assert left.columns == docs.columns
    _, groups = brute(listed)
    wanted = {tuple(g) for g in groups}
    stay = []
    for g in wanted:
        known = [listed[i].doc_id for i in g if listed[i].doc_id is not None]
        stay.append(min(known) if known else -1)
    assert sorted(r.doc_id if r.doc_id is not None else -1 for r in left.collect()) == sorted(stay)


def test_sets_without_an_id_of_their_own(spark, tmp_path):
    """Two copy groups whose ids are all null, two with the same id: one row of each stays."""
    rows = [(i, edge_data.prose(60, seed)) for i, seed in
            ((None, 900), (None, 901), (7, 902), (7, 903)) for _ in range(3)]
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(path)
    table = spark.read.parquet(path)
    left = ngram_join.without_near_duplicates(table).collect()
    assert sorted(r.text for r in left) == sorted({t for _, t in rows})
    found = ngram_join.near_duplicates(table).collect()
    assert {r.class_id for r in found} == {None, 7} and all(r.class_size == 3 for r in found)
    assert len({r.root for r in found}) == 4


def test_empty(docs):
    assert ngram_join.near_duplicates(edge_data.empty(docs)).count() == 0


def test_grams():
    same = ngram_join.grams
    assert len(same("a b c d e f")) == 2 and len(same("a b c")) == 1 and len(same("")) == 1
    assert (same("A b\nc  d e") == same("a B c d e")).all()
    assert same("a b c d e") != same("b a c d e")
    assert len(same("x " * 500)) == 1


def test_estimate_and_verification():
    rng = np.random.default_rng(2)
    seeds = rng.integers(0, 2**63, 96, dtype=np.uint64)
    a = rng.integers(0, 2**63, 400, dtype=np.uint64)
    b = np.concatenate([a[:380], rng.integers(0, 2**63, 20, dtype=np.uint64)])
    left, right = np.sort(a), np.sort(b)
    assert ngram_join.similar(np.array([0]), np.array([1]), [left, right], [left, right])[0] == (
        pytest.approx(380 / 420))
    signs = [ngram_join.minhashes(x, seeds) for x in (left, right)]
    assert (signs[0] == signs[1]).mean() == pytest.approx(380 / 420, abs=0.12)


def test_long_chain_is_one_set(spark):
    links = spark.createDataFrame(
        [(i, i + 1) for i in range(0, 200)] + [(500, 400), (400, 450)], "a long, b long")
    found = {r.text_id: r.root for r in ngram_join.connected(links).collect()}
    assert found == {i: 0 for i in range(201)} | {400: 400, 450: 400, 500: 400}


def rows_moved(df):
    """The rows that each shuffle of ``df`` writes, once it has run."""
    df.collect()
    todo, found = [df._jdf.queryExecution().executedPlan()], []
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(node.plan())
        elif kind == "ShuffleExchangeExec":
            found.append(node.metrics().apply("shuffleRecordsWritten").value())
        below = node.children()
        todo += [below.apply(i) for i in range(below.size())]
    return found


def test_only_texts_that_share_a_bucket_move(spark, tmp_path, monkeypatch, no_broadcast):
    """Of 400 texts 4 are copies and 4 near copies: the others' signatures and paths stay where
    they are, also if no table is small enough to broadcast."""
    texts = [edge_data.prose(60, 2000 + i) for i in range(400)]
    texts += texts[:4] + [t + " more" for t in texts[10:14]]
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(path)
    moved, plain = {}, ngram_join.stored

    def stored(df, label):
        if label in ("texts", "shared", "candidates", "links"):
            moved.setdefault(label, []).append(max(rows_moved(df), default=0))
        return plain(df, label)

    monkeypatch.setattr(ngram_join, "stored", stored)
    table = spark.read.parquet(path)
    found = ngram_join.near_duplicates(table).collect()
    got = sorted((r["__id"], r.class_id, r.class_size, r.n_links) for r in found)
    assert got == expected(table.collect())
    assert sum(r.n_links for r in found) == 16
    # 8 texts have a bucket in common with another one, in 16 trees at most.
    assert moved and max(n for rows in moved.values() for n in rows) <= 8 * 16 + 8, moved
