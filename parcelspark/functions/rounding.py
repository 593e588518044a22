"""Statistics of values given to four decimals, in whole ten-thousandths.

Integer sums do not depend on the order of the rows, so a mean that falls between two rounded values
comes out the same on every run and every partitioning. Ties round up.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCALE = 10_000


def ticks(value: Column) -> Column:
    return F.round(value * SCALE).cast("long")


def mean_of(total: Column, n: Column) -> Column:
    """Mean of `n` tick values with the given sum, to four decimals; null for n = 0."""
    return F.floor((2 * total + n) / F.nullif(2 * n, F.lit(0))) / SCALE


def deviation_of(total: Column, squares: Column, n: Column) -> Column:
    """Population deviation of `n` tick values from their sum and sum of squares, to four decimals."""
    return F.round(F.sqrt((n * squares - total * total).cast("double")) / F.nullif(n, F.lit(0))) / SCALE


def mean_4dp(value: str) -> Column:
    """Aggregate: the mean of a column already rounded to four decimals; nulls do not count."""
    return mean_of(F.sum(ticks(F.col(value))), F.count(value))
