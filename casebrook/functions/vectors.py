"""Vector expressions over ``array<float>`` columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NORM_FLOOR = 1e-12  # fixed value: the smallest divisor used for a norm


def l2_norm(vector: Column) -> Column:
    return F.sqrt(
        F.aggregate(
            vector,
            F.lit(0.0),
            lambda acc, x: acc + x.cast("double") * x.cast("double"),
        )
    )


def l2_normalise(vector: Column) -> Column:
    """Unit vector as ``array<float>``; a zero vector stays zero."""
    from casebrook.functions.text import let

    return let(
        F.greatest(l2_norm(vector), F.lit(NORM_FLOOR)),
        lambda norm: F.transform(
            vector, lambda x: (x.cast("double") / norm).cast("float")
        ),
    )


def dimension(vector: Column) -> Column:
    return F.size(vector)
