import hashlib
import re

import edge_data
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tunelake.llm import infill

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]", re.S)


def brute(doc_id, text):
    """The contract, spelled out."""
    text = text or ""
    units = UNIT.findall(text)
    n = len(units)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = ("".join(units[i:j]) for i, j in ((0, a), (a, b), (b, n)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    if h[3] % 100 < 20:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abZ[`{@<P> \né\U0001f600KK", max_size=60),
       st.integers(1, 9))
def test_units_are_found_in_blocks_of_any_length(text, block):
    units = infill.Units(text, block)
    places = [m.start() for m in UNIT.finditer(text)] + [len(text)]
    assert units.n == len(places) - 1
    assert [units.place(k) for k in range(units.n + 1)] == places


def test_fenwick_descent_matches_running_sums():
    rng = np.random.default_rng(3)
    for size in (0, 1, 2, 7, 8, 9, 100):
        counts = rng.integers(0, 4, (size, 2))
        tree, before = infill.Fenwick(counts), np.vstack([[[0, 0]], np.cumsum(counts, 0)])
        for k in range(int(before[-1, 0]) + 1):
            at, sums = tree.descend(k)
            assert at == np.flatnonzero(before[:, 0] <= k)[-1]
            assert sums == before[at].tolist()


@pytest.mark.parametrize("block", [3, infill.BLOCK])
def test_all_rows_match_the_contract(docs, listed, block):
    got = infill.transformed(docs, block=block).withColumn("back", infill.restored()).collect()
    assert len(got) == len(listed)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    for r in got:
        mine = r.asDict()
        # The input's own column "n" has a longer name now.
        assert mine["n_"] == "x"
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == brute(r.doc_id, r.text)
        assert r.back == (r.text or "")


def test_marks_in_the_text_and_at_its_seams(spark):
    texts = ["a<P>b", "<S>", "x <M", "M> <", "<S<S <P<P", "<" * 30, ">" * 30, "S>" * 20, "<M" * 20]
    rows = [(i, t) for i in range(40) for t in texts]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for r in infill.transformed(df).withColumn("back", infill.restored()).collect():
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == brute(r.doc_id, r.text)
        assert r.back == r.text


def test_a_very_long_text_and_other_ids(spark):
    long_one = "word 123 é" * 300_000
    df = spark.createDataFrame([("a", long_one), ("b", None), (None, "x y")],
                               "doc_id string, text string")
    for r in infill.transformed(df).withColumn("back", infill.restored()).collect():
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == brute(r.doc_id, r.text)
        assert r.back == (r.text or "")


def test_empty_table(docs):
    empty = edge_data.empty(docs)
    assert infill.transformed(empty).withColumn("back", infill.restored()).collect() == []


def test_rates(spark):
    df = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("some words here").alias("text"))
    forms = dict(infill.transformed(df).groupBy("form").count().collect())
    assert 150 < forms["plain"] < 250 and 300 < forms["spm"] < 420
    assert set(dict(infill.transformed(df, rate=0).groupBy("form").count().collect())) == {"plain"}
