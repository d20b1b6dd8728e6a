from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quiverlake.functions import distance as D


@pytest.mark.parametrize("n", [1, 3, 4, 7, 128, 131])
def test_distances_equal_doubles(spark, n):
    rng = np.random.default_rng(n)
    pairs = [(rng.uniform(-1, 1, n).astype(np.float32), rng.uniform(-1, 1, n).astype(np.float32)) for _ in range(5)]
    df = spark.createDataFrame([([float(x) for x in a], [float(x) for x in b]) for a, b in pairs], "a array<float>, b array<float>")
    got = df.select(D.l2_squared("a", "b"), D.dot_distance("a", "b"), D.cosine_distance("a", "b")).collect()
    for (a, b), (l2, dot, cos) in zip(pairs, got):
        a, b = a.astype(float), b.astype(float)
        assert l2 == pytest.approx(((a - b) ** 2).sum(), rel=1e-9)
        assert dot == pytest.approx(-(a @ b), rel=1e-9, abs=1e-12)
        assert cos == pytest.approx(1 - a @ b / np.linalg.norm(a) / np.linalg.norm(b), rel=1e-9, abs=1e-12)


def test_zero_nulls_and_lengths(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 2.0]), ([1.0], [1.0, 2.0]), (None, [1.0])], "a array<float>, b array<float>")
    cos, l2, dot = zip(*df.select(D.cosine_distance("a", "b"), D.l2_squared("a", "b"), D.dot("a", "b")).collect())
    assert cos[0] == 1.0 and cos[1] is None and cos[2] is None
    assert l2[0] == 5.0 and l2[1] == math.inf and l2[2] is None
    assert dot[1] is None and dot[2] is None


def test_normalized_and_finite(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), ([float("nan")],), ([float("inf")],), ([None, 1.0],), ([],)], "v array<float>")
    out = df.select(D.normalized("v"), D.all_finite("v")).collect()
    assert out[0][0] == pytest.approx([0.6, 0.8]) and out[1][0] == [0.0, 0.0]
    assert [r[1] for r in out] == [True, True, False, False, False, True]


def test_names(spark):
    with pytest.raises(ValueError):
        D.distance("manhattan", "a", "b")
    D.register_sql(spark)
    r = spark.sql("SELECT l2_distance(array(1F, 2F), array(3F, 4F)), cosine_distance(array(1F, 0F), array(0F, 1F)), dot_distance(array(1F, 2F), array(3F, 4F)), vector_norm(array(3F, 4F))").first()
    assert tuple(r) == (8.0, 1.0, -11.0, 5.0)
    assert spark.range(1).select(D.subvector(F.array(F.lit(1), F.lit(2), F.lit(3), F.lit(4)), 1, 2)).first()[0] == [3, 4]
