"""Numeric helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_even(c, digits: int) -> Column:
    """Half-even rounding at ``digits`` decimals (``numpy.round``).

    Sums of the same values in a different order differ by an ulp, which flips the
    rounding of an exact decimal tie (e.g. a mean of cents over 16 rows): values within
    1e-9 of a tie at the scaled position count as the tie.
    """
    c = F.col(c) if isinstance(c, str) else c
    scale = float(10 ** digits)
    s = c.cast("double") * F.lit(scale)
    f = F.floor(s).cast("double")
    tie = F.abs(s - f - F.lit(0.5)) < F.lit(1e-9)
    return F.when(tie, f + F.abs(f % F.lit(2.0))).otherwise(F.rint(s)) / F.lit(scale)
