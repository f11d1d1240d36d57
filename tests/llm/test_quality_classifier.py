import zlib

import edge_data
import numpy as np
import pytest

from tunelake.llm import quality, queries


def test_measures_do_not_depend_on_neighbours():
    texts = [t or "" for t in edge_data.texts()]
    together, bags = quality.measures(texts)
    at = 0
    for text, n in zip(texts, bags):
        alone, one = quality.measures([text])
        assert one.tolist() == [n] == [max(1, -(-len(text.encode().split()) // quality.PASSAGE))]
        np.testing.assert_array_equal(alone, together[at:at + n])
        at += n
    assert quality.measures([])[0].shape == (0, quality.WIDTH)


def test_gradient():
    """One step of training lowers the loss on what it was taken on."""
    rng = np.random.default_rng(0)
    bags = rng.integers(1, 5, 40)
    x = rng.normal(size=(bags.sum(), quality.WIDTH))
    y = (rng.random(40) < 0.5).astype(float)

    def loss(model):
        p = np.clip(model.score(x, bags), 1e-9, 1 - 1e-9)
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    losses = [loss(quality.trained(x, bags, y, steps=n, rate=0.01)) for n in (1, 20, 100)]
    assert losses[0] > losses[1] > losses[2]


def test_attention_finds_the_passage_that_matters():
    rng = np.random.default_rng(1)
    bags = np.full(300, 6)
    x = rng.normal(size=(1800, quality.WIDTH))
    y = (np.arange(300) % 2).astype(float)
    x[::6, 0] = np.where(y > 0, 4, -4)  # only the first passage tells, and it is marked
    x[::6, 1] = 5
    model = quality.trained(x, bags, y, steps=300)
    f = model.forward(x, bags)
    assert ((f["p"] >= 0.5) == (y > 0)).mean() > 0.95
    assert f["a"][::6].mean() > 1 / 3


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op8_quality(spark, sf).join(
        spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
    out = [r for r in rows if r.held_out]
    assert np.mean([r.predicted == r.quality for r in out]) >= 0.95


@pytest.mark.parametrize("labels", [[], [(10, 1, 0)], [(10, None, 0), (None, 1, 0)],
                                    [(i * 10, i % 2, 0) for i in range(40)]])
def test_edges(spark, docs, listed, labels):
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = quality.fitted(docs, table)
    out = quality.scored(docs, model, score="p")
    assert out.columns == [*docs.columns, "p"]
    rows = out.collect()
    assert len(rows) == len(listed) and all(0 <= r.p <= 1 for r in rows)
    scores = {}
    for r in rows:
        assert scores.setdefault(r.text or "", r.p) == r.p
    assert quality.scored(edge_data.empty(docs), model).count() == 0
    assert quality.fitted(edge_data.empty(docs), table).score(
        np.zeros((1, quality.WIDTH)), np.array([1]))[0] == pytest.approx(0.5)
