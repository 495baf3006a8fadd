"""Vector and logit expressions over ``array<float|double>`` columns.

All stay JVM-side (higher-order functions), no Python in the hot path.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _dbl(c) -> Column:
    return F.transform(F.col(c) if isinstance(c, str) else c, lambda x: x.cast("double"))


def dot(a, b) -> Column:
    """Sum of element products; arrays are cast to double first."""
    return F.aggregate(F.zip_with(_dbl(a), _dbl(b), lambda x, y: x * y),
                       F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def vector_norm(vector) -> Column:
    """Euclidean norm of a Spark ML vector from the entries it stores (a sparse one is not spread out)."""
    return norm(F.unwrap_udt(vector)["values"])


def cosine(a, b) -> Column:
    """Cosine similarity; null when either vector has zero norm."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def l1_distance(a, b) -> Column:
    return F.aggregate(F.zip_with(_dbl(a), _dbl(b), lambda x, y: F.abs(x - y)),
                       F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def l2_distance(a, b) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(_dbl(a), _dbl(b), lambda x, y: (x - y) * (x - y)),
                              F.lit(0.0).cast("double"), lambda acc, x: acc + x))


def argmax(a) -> Column:
    """0-based index of the largest element, the first one on ties."""
    arr = _dbl(a)
    best = F.array_max(F.transform(arr, lambda v, i: F.struct(v.alias("v"), (-i).alias("ni"))))
    return -best["ni"]


def softmax_expected(logits) -> Column:
    """Soft 3-class score in [0, 2]: (e^pos - e^neg) / sum(e^l) + 1.

    The row maximum is subtracted before exponentiation (same value, no overflow).
    """
    arr = _dbl(logits)
    m = F.array_max(arr)
    e = F.transform(arr, lambda x: F.exp(x - m))
    total = F.aggregate(e, F.lit(0.0).cast("double"), lambda acc, x: acc + x)
    return (e[2] - e[0]) / total + F.lit(1.0)
