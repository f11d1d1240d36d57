import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import edge_data  # noqa: E402


@pytest.fixture(scope="session")
def docs(spark, tmp_path_factory):
    """The edge cases as a table on disk."""
    path = str(tmp_path_factory.mktemp("edge") / "documents.parquet")
    edge_data.documents(spark).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def listed(docs):
    return docs.collect()
