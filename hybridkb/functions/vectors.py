"""Vector arithmetic and quantisation over array columns, in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hybridkb.functions.text import let


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def l2_normalize(v: Column) -> Column:
    """Unit length; a zero vector stays."""
    return let(norm(v), lambda n: F.transform(v, lambda x: x.cast("double") / F.when(n > 0, n).otherwise(1.0)))


def similarity(a: Column, b: Column, metric: str = "cosine") -> Column:
    """Higher is nearer. Cosine means the dot product of stored unit vectors; L2 is minus the squared
    distance. Any other metric counts as cosine."""
    if metric == "l2":
        return -_sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))
    return dot(a, b)


def sign_words(v: Column, dim: int) -> Column:
    """Longs of 64 sign bits, the lowest first: a bit is set where the component is 0 or more."""
    word = lambda w: F.aggregate(
        F.sequence(F.lit(0), F.lit(min(63, dim - 1 - 64 * w))),
        F.lit(0).cast("long"),
        lambda acc, i: acc.bitwiseOR(F.call_function("shiftleft", (F.get(v, i + 64 * w) >= 0).cast("long"), i)),
    )
    return F.array(*[word(w) for w in range((dim + 63) // 64)])


def hamming(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)


def int8_scale(v: Column) -> Column:
    top = F.array_max(F.transform(v, lambda x: F.abs(x.cast("double"))))
    return F.when(top > 0, top / 127.0).otherwise(F.lit(1.0))


def int8_codes(v: Column) -> Column:
    """Components over the scale, halves rounded away from zero, within ±127."""
    return let(int8_scale(v), lambda scale: F.transform(v, lambda x: F.greatest(F.lit(-127), F.least(F.lit(127), F.round(x.cast("double") / scale).cast("int")))))


def int8_dot(codes: Column, scale: Column, query: Column) -> Column:
    return dot(codes, query) * scale
