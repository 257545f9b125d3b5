import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from contextlake.llm import topk

SCHEMA = "vec_id long, embedding array<float>, score int"


def brute(rows, every, k=10):
    ok = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v, _ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for i, q in ok:
        if i % every == 0:
            best = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j) for j, v in ok if j != i and len(v) == len(q))[:k]
            out |= {(i, r + 1, j, -s) for r, (s, j) in enumerate(best)}
    return out


@pytest.mark.parametrize(("n", "spread"), [(700, 1.0), (6, 1.0), (300, 1e5)])
def test_equal_to_brute_force(spark, monkeypatch, n, spread):
    rng = random.Random(n)
    common = [rng.gauss(0, spread) for _ in range(20)]
    rows = [(i, [rng.gauss(0, 1) * spread for _ in range(20)] if rng.random() < 0.7 else common, 1) for i in range(n)]
    rows += [(1000, None, 1), (1100, [1.0, None] * 10, 1), (1200, [float("nan")] * 20, 1), (1300, [float("inf")] * 20, 1), (1400, [], 1), (1500, [2.0, 3.0], 1), (1501, [1.0, -1.0], 1), (None, common, 1), (1600, [0.0] * 20, 1)]
    monkeypatch.setattr(topk, "BLOCK_ROWS", 64)
    monkeypatch.setattr(topk, "QUERY_ROWS", 3)
    got = topk.top_k(spark.createDataFrame(rows, SCHEMA).repartition(3), F.col("vec_id") % 50 == 0)
    assert {tuple(r) for r in got.collect()} == brute(rows, 50)
    assert dict(got.dtypes)["rank"] == "int"


def test_bounds_prune_and_keep_the_best():
    rng = np.random.default_rng(0)
    block = np.floor(1024 * rng.normal(size=(64, 5000)) * np.linspace(3, 0.01, 64)[:, None])
    q, ids = block[:, 17], np.arange(5000)
    rest = np.sqrt(np.array([(block[s * 8 :] ** 2).sum(axis=0) for s in range(9)]))
    got, score = topk.best_of_block(q, 17, block, ids, rest, 10)
    whole = q @ block
    whole[17] = -np.inf
    assert got.tolist() == np.lexsort((ids, -whole))[:10].tolist() and (score == whole[got]).all()


def test_no_queries(spark):
    assert topk.top_k(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 50 == 0).count() == 0
    assert topk.top_k(spark.createDataFrame([(1, [1.0], 0)], SCHEMA), F.col("vec_id") % 50 == 0).count() == 0
