"""Scalar expressions of the evaluation operators; every division is guarded."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(num: Column, den: Column) -> Column:
    """num / den, 0 where den is 0 or null."""
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


def fbeta(p: Column, r: Column, beta: float = 1.0) -> Column:
    """(1 + b^2) P R / (b^2 P + R), 0 where P + R is 0."""
    b2 = float(beta) ** 2
    return F.when(p + r > 0, (1 + b2) * p * r / (b2 * p + r)).otherwise(F.lit(0.0))


def sigmoid(z: Column, temperature: float | Column = 1.0) -> Column:
    return 1.0 / (1.0 + F.exp(-z / temperature))


def distance(p: Column, same: Column) -> Column:
    """1 - p, 0 on the diagonal."""
    return F.when(same, F.lit(0.0)).otherwise(1.0 - p)


def overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Length that two right-open intervals share."""
    return F.greatest(F.lit(0), F.least(a1, b1) - F.greatest(a0, b0))


def containment(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """1 where a properly holds b, -1 where b properly holds a, else 0; closed intervals."""
    equal = (a0 == b0) & (a1 == b1)
    return F.when(~equal & (a0 <= b0) & (b1 <= a1), 1).when(~equal & (b0 <= a0) & (a1 <= b1), -1).otherwise(0)


def near(a0: Column, a1: Column, b0: Column, b1: Column, delta_pos: int = 2, delta_len: int = 2) -> Column:
    """Spans whose starts and lengths differ by the deltas at most."""
    return (F.abs(a0 - b0) <= delta_pos) & (F.abs((a1 - a0) - (b1 - b0)) <= delta_len)


def pairs_of(n: Column) -> Column:
    """n (n - 1) / 2 as a long."""
    n = n.cast("long")
    return ((n * (n - 1)) / 2).cast("long")


def path_part(num: Column, den: Column, true_negatives: bool) -> tuple[Column, Column]:
    """(n / d, weight): 0 / 0 counts as 1 with true negatives and not at all without."""
    none = (num == 0) & (den == 0)
    return F.when(none, F.lit(1.0)).otherwise(ratio(num, den)), F.when(none, F.lit(int(true_negatives))).otherwise(F.lit(1))
