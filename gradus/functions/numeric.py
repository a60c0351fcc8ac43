"""Numeric column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def percent(part: Column, whole: Column, empty: float | None = None) -> Column:
    """100 * part / whole from counts; ``empty`` where there is nothing to divide by."""
    return F.when(whole > 0, F.lit(100.0) * part / whole).otherwise(F.lit(empty).cast("double"))


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, null where whole is not positive."""
    return F.when(whole > 0, part / whole)


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), x)


def round2(x: Column) -> Column:
    """Two decimals, ties to even, as published figures have them."""
    return F.bround(x, 2)


def floor_div(a: Column, b: Column) -> Column:
    """Integer division towards minus infinity (``div`` goes towards zero)."""
    return F.floor(a.cast("double") / b).cast("bigint")


def sample_std(x: Column) -> Column:
    """Standard deviation of a sample; 0 for a single value or none."""
    return F.coalesce(F.stddev_samp(x), F.lit(0.0))


def mcnemar_exact(gained: Column, lost: Column) -> Column:
    """Exact two-sided p-value of paired changes: min(1, 2 * P(X <= min)) for a fair coin.

    Up to 1,000 changes the terms are built by a product from 2**-n, which no binomial
    can overflow; beyond, the largest term is taken in logarithms and the others relative
    to it.
    """
    n, k = (gained + lost).cast("bigint"), F.least(gained, lost).cast("bigint")
    upto = F.when(k > 0, F.sequence(F.lit(1).cast("bigint"), k)).otherwise(F.array().cast("array<bigint>"))

    def rising(acc: Column, i: Column) -> Column:
        term = acc["t"] * (n - i + 1) / i
        return F.struct(term.alias("t"), (acc["s"] + term).alias("s"))

    first = F.pow(F.lit(2.0), -n.cast("double"))
    plain = F.aggregate(upto, F.struct(first.alias("t"), first.alias("s")), rising, lambda acc: acc["s"])

    def falling(acc: Column, i: Column) -> Column:
        term = acc["t"] * (k - i + 1) / (n - k + i)
        return F.struct(term.alias("t"), (acc["s"] + term).alias("s"))

    one = F.lit(1.0)
    relative = F.aggregate(upto, F.struct(one.alias("t"), one.alias("s")), falling, lambda acc: acc["s"])
    largest = F.aggregate(upto, F.lit(0.0), lambda acc, i: acc + F.log((n - i + 1) / i)) - n * F.log(F.lit(2.0))
    tail = F.when(n <= 1000, plain).otherwise(F.exp(largest + F.log(relative)))
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * tail))
