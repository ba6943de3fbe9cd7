"""Small numeric expressions shared by the judging and reporting operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from casebrook.functions.text import let

# --- fixed values -----------------------------------------------------------
SCORE_SCALE = 5.0
HIGH_AGREEMENT = 0.8
AGREEMENT_BANDS = (
    ("very high", 0.9),
    ("high", 0.8),
    ("moderate", 0.7),
    ("low", None),
)
HALVES = 2.0**27 + 1  # cuts the 53 digits of a double into two halves
WIDEST = 9e12  # with three decimals more, the digits of a double are used up
# ----------------------------------------------------------------------------


def round_half_even(value: Column, digits: int = 2) -> Column:
    """Scale, round half to even, scale back (``round`` goes half up)."""
    factor = float(10**digits)
    return F.rint(value * F.lit(factor)) / F.lit(factor)


def agreement(std: Column) -> Column:
    """``1 - std/5``, or 0 when the spread reaches the whole scale."""
    return F.when(std < SCORE_SCALE, 1 - std / SCORE_SCALE).otherwise(F.lit(0.0))


def agreement_band(value: Column) -> Column:
    """Name of the consensus band: above 90 %, from 80 %, from 70 %, below."""
    very_high, high, moderate, low = AGREEMENT_BANDS
    return (
        F.when(value > very_high[1], very_high[0])
        .when(value >= high[1], high[0])
        .when(value >= moderate[1], moderate[0])
        .when(value.isNotNull(), low[0])
    )


def _nearest(size: Column, digits: int) -> Column:
    """``size`` (not negative) to ``digits`` decimals, by its exact binary value;
    ties go to the even digit.

    A double's high half times a short power of ten is exact, and so is its low
    half's product: both together tell on which side of a tie the value lies.
    """
    factor = F.lit(float(10**digits))

    def build(x: Column) -> Column:
        shifted = x * F.lit(HALVES)
        high = shifted - (shifted - x)
        whole = F.floor(x * factor)
        over = (high * factor - whole - F.lit(0.5)) + (x - high) * factor
        up = (over > 0) | ((over == 0) & (whole % 2 == 1))
        return (whole + up.cast("int")) / factor

    return F.when(size < WIDEST, let(size, build)).otherwise(size)


def fixed(value: Column, digits: int) -> Column:
    """Text with ``digits`` decimals, correctly rounded; NULL stays NULL."""
    near = _nearest(F.abs(value.cast("double")), digits)
    text = F.format_string(f"%.{digits}f", F.when(value < 0, -near).otherwise(near))
    return F.when(value.isNotNull(), text)


def nan_as_null(value: Column) -> Column:
    """Spark sorts NaN above every number; reports want it last."""
    return F.when(~F.isnan(value), value)
