"""Vector distances as Spark expressions; lower is closer for all of them.

All arithmetic is in double, in the order of the components. Vectors of unequal length have no
common distance: squared L2 is infinite, the others are null.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

METRICS = ("cosine", "l2", "dot")
_INF = float("inf")


def _c(v: Column | str) -> Column:
    return F.col(v) if isinstance(v, str) else v


def _sum(parts: Column) -> Column:
    return F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)


def _double(x: Column) -> Column:
    return x.cast("double")


def dot(a: Column | str, b: Column | str) -> Column:
    a, b = _c(a), _c(b)
    return F.when(F.size(a) == F.size(b), _sum(F.zip_with(a, b, lambda x, y: _double(x) * _double(y))))


def squared_norm(a: Column | str) -> Column:
    return _sum(F.transform(_c(a), lambda x: _double(x) * _double(x)))


def l2_squared(a: Column | str, b: Column | str) -> Column:
    a, b = _c(a), _c(b)
    d = _sum(F.zip_with(a, b, lambda x, y: (_double(x) - _double(y)) * (_double(x) - _double(y))))
    return F.when(F.size(a) == F.size(b), d).when(a.isNotNull() & b.isNotNull(), F.lit(_INF))


def dot_distance(a: Column | str, b: Column | str) -> Column:
    return -dot(a, b)


def cosine_distance(a: Column | str, b: Column | str) -> Column:
    """1 - cosine; exactly 1 if either vector is all zero."""
    a, b = _c(a), _c(b)
    na, nb = squared_norm(a), squared_norm(b)
    return F.when((na == 0) | (nb == 0), F.when(F.size(a) == F.size(b), F.lit(1.0))).otherwise(1.0 - dot(a, b) / (F.sqrt(na) * F.sqrt(nb)))


def unit_cosine_distance(a: Column | str, b: Column | str) -> Column:
    """Cosine distance of vectors that are already of length 1."""
    return 1.0 - dot(a, b)


def distance(metric: str, a: Column | str, b: Column | str) -> Column:
    """The distance named cosine (also the empty name), l2 or dot; other names are an error."""
    kinds = {"": cosine_distance, "cosine": cosine_distance, "l2": l2_squared, "dot": dot_distance}
    if metric not in kinds:
        raise ValueError(f"unknown metric {metric!r}")
    return kinds[metric](a, b)


def normalized(v: Column | str) -> Column:
    """The vector scaled to length 1 as doubles; an all-zero vector stays as it is."""
    v = _c(v)
    n = F.sqrt(squared_norm(v))
    return F.when(n == 0, v.cast("array<double>")).otherwise(F.transform(v, lambda x: _double(x) / n))


def all_finite(v: Column | str) -> Column:
    """No null, NaN or infinite component."""
    return ~F.exists(_c(v), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == _INF))


def subvector(v: Column | str, part: int | Column, size: int) -> Column:
    """Component block number ``part`` (from 0) of ``size`` components."""
    return F.slice(_c(v), F.lit(part) * size + 1, size)


def register_sql(spark: SparkSession) -> None:
    """Make l2_distance, dot_distance, cosine_distance and vector_norm available in SQL."""
    total = "aggregate(zip_with(a, b, (x, y) -> {}), 0D, (s, x) -> s + x)"
    norm = "aggregate(a, 0D, (s, x) -> s + double(x) * double(x))"
    bodies = {
        "l2_distance": f"CASE WHEN size(a) = size(b) THEN {total.format('(double(x) - double(y)) * (double(x) - double(y))')} ELSE double('inf') END",
        "dot_distance": f"CASE WHEN size(a) = size(b) THEN -{total.format('double(x) * double(y)')} END",
        "cosine_distance": f"CASE WHEN {norm} = 0 OR {norm.replace('(a,', '(b,')} = 0 THEN 1D ELSE 1 - {total.format('double(x) * double(y)')} / (sqrt({norm}) * sqrt({norm.replace('(a,', '(b,')})) END",
    }
    for name, body in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(a ARRAY<FLOAT>, b ARRAY<FLOAT>) RETURNS DOUBLE RETURN {body}")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION vector_norm(a ARRAY<FLOAT>) RETURNS DOUBLE RETURN sqrt({norm})")
