"""Number columns: vectors, ratios, scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Null where a side is all zeros."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def ratio(a: Column, b: Column) -> Column:
    """0 where there is nothing to divide by."""
    return F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))


def f1(precision: Column, recall: Column) -> Column:
    return ratio(2 * precision * recall, precision + recall)


def number(c: Column) -> Column:
    return c.try_cast("double")


def fused(comment: Column, claim: Column, comment_weight: float = 0.3, claim_weight: float = 0.6, missing: float = 0.5) -> Column:
    """Weighted sum of two scores; the usual weights don't add to 1."""
    return comment_weight * F.coalesce(comment, F.lit(missing)) + claim_weight * F.coalesce(claim, F.lit(missing))


def budget(count: Column, usual: int = 25, most: int = 200) -> Column:
    return F.least(F.coalesce(count, F.lit(usual)), F.lit(most))


def share_of_budget(total: Column, weight: Column) -> Column:
    return F.greatest(F.lit(1), F.rint(total * weight).cast("int"))
