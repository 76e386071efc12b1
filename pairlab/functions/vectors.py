"""Vector expressions on array columns, computed in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def l2_distance(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y))))


def vector_fault(v: Column, length: int) -> Column:
    """null for a finite vector of that length, else the reason."""
    fine = F.forall(doubles(v), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(v.isNull(), "missing").when(F.size(v) != length, "wrong_length").when(~fine, "not_finite")


def root_normalised(v: Column) -> Column:
    """F16: L1-normalise, then square roots; zeros for a zero norm."""
    norm = total(F.transform(doubles(v), F.abs))
    scaled = F.transform(F.array(norm), lambda n: F.transform(doubles(v), lambda x: F.sqrt(F.abs(x) / n)))[0]  # the norm is summed once
    return F.when(norm > 0, scaled).otherwise(F.transform(doubles(v), lambda x: F.lit(0.0)))


def cosine(a: Column, b: Column) -> Column:
    """Dot product of the two vectors at unit length; null for a zero vector."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def two_branch_score(a: Column, b: Column, half: int) -> Column:
    """dot product of vectors whose two halves are each brought to unit length; 2 for itself."""
    part = lambda v, i: F.slice(v, 1 + i * half, half)
    return cosine(part(a, 0), part(b, 0)) + cosine(part(a, 1), part(b, 1))


def array_digest(named: dict[str, Column]) -> Column:
    """SHA-256 over named arrays, their lengths and values, in name order."""
    parts = [F.concat_ws("\n", F.lit(n), F.size(v).cast("string"), F.array_join(v.cast("array<string>"), ",", "null")) for n, v in sorted(named.items())]
    return F.sha2(F.concat_ws("\n\n", *parts), 256)
