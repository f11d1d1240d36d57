import os
import subprocess
import sys

import edge_data
import oracle_check
import pytest

import corpus_pipeline
from tunelake.llm import queries

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SF = "/root/testdata/sf0.001"


def test_stages_in_order(spark):
    """Each stage's rows against what the stage has to do with its predecessor's."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows, counts = docs, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = corpus_pipeline.stored(stage(spark, rows, SF), "test")
        assert after.columns == docs.columns, name
        if name != "mixing":
            assert after.subtract(rows).count() == 0, name
        rows = after
        counts.append(rows.count())
    assert counts[0] > counts[1] > counts[2] > counts[3]
    words = sum(len(r.text.split()) for r in rows.collect())
    packed = corpus_pipeline.STAGES[-1][1](spark, rows, SF).collect()
    assert sum(r.n_tokens for r in packed) == words
    again = corpus_pipeline.run(spark, SF).collect()
    assert sorted(r.n_tokens for r in again) == sorted(r.n_tokens for r in packed)


def test_edge_cases_pass_all_stages(spark, docs, tmp_path):
    labels = spark.createDataFrame(
        [(10 * i, 1, 0) for i in range(0, 40, 2)], "doc_id long, quality int, toxic int")
    for table, name in ((docs, "all"), (edge_data.empty(docs), "none")):
        path = str(tmp_path / name)
        table.write.parquet(f"{path}/documents.parquet")
        labels.write.parquet(f"{path}/labels.parquet")
        found = corpus_pipeline.run(spark, path)
        assert (found.count() > 0) == (name == "all")


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_sql(spark, name):
    assert oracle_check.difference(spark, name, SF) is None


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query_on_the_smallest_tables(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0


def test_nothing_else_imports_this_package():
    code = ("import sys; sys.modules['tunelake.llm'] = None; sys.modules['corpus_pipeline'] = None;"
            "import __spark_entry__ as e; q = e.queries();"
            "assert 'daily_stats' in q and 'pipeline' not in q and set(e.oracle_sql()) == set(q)")
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)
