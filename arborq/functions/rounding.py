"""Decimal places of doubles, exact: by the double's own value, halves to the even neighbour."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPLIT = 134217729.0  # 2 ** 27 + 1 parts a double into two halves whose products are exact


def exact_round(value: Column, digits: int) -> Column:
    """value to so many decimal places, as a formatter of the exact binary value rounds it.

    value * 10 ** digits is computed with its error term, so a product that only seems to lie between two integers is told from one that does.
    """
    if digits == 0:
        return F.rint(value)
    scale = F.lit(float(10**digits))
    p = value * scale

    def halves(x: Column) -> tuple[Column, Column]:
        high = x * _SPLIT - (x * _SPLIT - x)
        return high, x - high

    (a, b), (c, d) = halves(value), halves(scale)
    error = ((a * c - p) + a * d + b * c) + b * d
    near, away = F.rint(p), F.abs(p - F.floor(p)) == 0.5
    whole = F.when(away & (error > 0), F.floor(p) + 1).when(away & (error < 0), F.floor(p)).otherwise(near)
    return whole.cast("double") / scale


def formatted(text: str, value: Column, *more: Column) -> Column:
    """A format whose first place is the value, rounded exactly to the places that the format shows."""
    shown = re.search(r"%(?:1\$)?\.(\d)f", text)
    return F.format_string(text, exact_round(value, int(shown[1])) if shown else value, *more)
