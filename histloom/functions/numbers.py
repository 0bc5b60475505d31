"""Numeric helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_even(c: Column, digits: int) -> Column:
    """Rounded half to even; a value within 1e-7 of a tie (in the last kept digit) counts as one, so the result does not depend on the order of a sum."""
    return F.bround(F.round(c, digits + 7), digits)
