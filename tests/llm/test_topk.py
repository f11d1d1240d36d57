import math

import pytest
from pyspark.sql import functions as F

from tunelake.llm import topk

SCHEMA = "vec_id long, embedding array<float>, label int, __row string, score string, rank string"


def table(spark, vectors, path):
    rows = [(i, v, None, "x", "x", "x") for i, v in vectors]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


def brute(rows, k):
    ok = [(i, r.vec_id, [math.floor(64 * float(x)) for x in r.embedding])
          for i, r in enumerate(rows)
          if r.embedding is not None and all(x is not None and math.isfinite(x)
                                             for x in r.embedding)]
    out = []
    for i, q, v in ok:
        if q is None or q % 20:
            continue
        scores = sorted((-sum(a * b for a, b in zip(v, w)), math.inf if c is None else c, j)
                        for j, c, w in ok if j != i)
        out += [(q, n + 1, None if c == math.inf else c, -s)
                for n, (s, c, _) in enumerate(scores[:k])]
    return sorted(out, key=str)


CASES = {
    "mixed": [(i, [((i * 37 + d * 11) % 23 - 11) / 9 for d in range(5)]) for i in range(90)]
    + [(None, [0.5] * 5), (None, [0.5] * 5), (40, None), (60, [1.0, None, 2.0, 1.0, 1.0]),
       (80, [float("nan")] * 5), (20, [float("inf")] + [0.0] * 4), (20, [0.1] * 5), (20, [0.1] * 5),
       (200, []), (220, [1.0, -1.0])],
    "all equal": [(i, [0.25, -0.5]) for i in range(130)],
    "large": [(i, [(i - 20) * 1000.0, i * 3.7]) for i in range(45)],
    "few": [(0, [1.0]), (3, [-1.0]), (5, [0.0])],
    "alone": [(0, [1.0])],
}


@pytest.mark.parametrize("case", list(CASES))
def test_against_brute_force(spark, tmp_path, case):
    df = table(spark, CASES[case], str(tmp_path / "e"))
    found = topk.top_k(df, F.expr("vec_id % 20 = 0"), k=7, query_block=3)
    got = sorted(((r.query_id, r.rank, r.vec_id, r.score) for r in found.collect()), key=str)
    assert got == brute(df.collect(), 7)


def test_nothing(spark, tmp_path):
    df = table(spark, CASES["few"], str(tmp_path / "e"))
    assert topk.top_k(df.where("1 = 0"), F.expr("vec_id % 20 = 0")).count() == 0
    assert topk.top_k(df, F.expr("vec_id = 77")).count() == 0
    assert topk.top_k(df, F.lit(None).cast("boolean")).count() == 0
