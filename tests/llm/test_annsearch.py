import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagemill.llm import annsearch


def brute(rows, k, asks):
    def sound(v):
        return v and all(x is not None and math.isfinite(x) for x in v) and any(v)

    rows = [(i, np.array(v, dtype=np.float32).astype(float)) for i, v in rows if sound(v)]
    out = []
    for q, a in rows:
        if asks(q):
            near = sorted((-float(annsearch.dot(a[None], b[None])[0] / (math.sqrt(annsearch.dot(a[None], a[None])[0]) * math.sqrt(annsearch.dot(b[None], b[None])[0]))), i) for i, b in rows if i != q and len(a) == len(b))
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(near[:k])]
    return sorted(out)


@pytest.mark.parametrize("tiles", [(32768, 4096, 4096, 512), (40, 3, 7, 2)])
def test_against_brute_force(spark, monkeypatch, tiles):
    for name, n in zip(("ROWS", "QUERIES", "TILE_ROWS", "TILE_QUERIES"), tiles, strict=True):
        monkeypatch.setattr(annsearch, name, n)
    rnd = random.Random(4)
    rows = [(i, [rnd.gauss(0, 1) for _ in range(8)]) for i in range(150)]
    rows += [(200 + i, rows[i][1]) for i in range(20)] + [(300, [1e-30] * 8), (350, [1e30] * 8)]
    rows += [(400, None), (401, []), (402, [0.0] * 8), (403, [float("nan")] * 8), (404, [float("inf")] + [1.0] * 7), (405, [None] * 8), (450, [1.0, 2.0]), (451, [2.0, 1.0])]
    df = spark.createDataFrame([(i, v, 0.5) for i, v in rows], "vec_id long, embedding array<float>, score double")
    got = sorted(tuple(r) for r in annsearch.nearest(df, F.col("vec_id") % 50 == 0).collect())
    assert got == brute(rows, 5, lambda i: i % 50 == 0)


def test_wide_vectors_are_exact():
    rnd = np.random.default_rng(1)
    a, b = (rnd.integers(-127, 128, (3, 2500)).astype(np.int8) for _ in range(2))
    assert (annsearch.product(a, b) == a.astype(np.int64) @ b.astype(np.int64).T).all()


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert annsearch.nearest(df, F.col("vec_id") % 50 == 0).count() == 0


def test_components_of_any_size(spark):
    rows = [(0, [1e200, 1e200]), (1, [1e200, 1e200]), (2, [1e-200, 1e-200]), (3, [1.0, 0.0]), (4, [5e-324, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: r.score for r in annsearch.nearest(df, F.col("vec_id") == 0).collect()}
    assert got.keys() == {1, 2, 3, 4} and all(abs(got[i] - (1 if i < 3 else 0.5**0.5)) < 1e-12 for i in got)
