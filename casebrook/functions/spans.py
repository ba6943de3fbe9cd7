"""Overlapping, sentence-aware character spans as one native expression.

Reading ``substring`` deep inside a long string costs time in proportion to
the position, because strings are stored as UTF-8. A text is therefore cut
once into fixed-size blocks and every slice touches at most two of them, so
the work stays linear in the length of the document.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from casebrook.functions.text import last_index, let, strip

# --- fixed values -----------------------------------------------------------
CHUNK_SIZE = 512
CHUNK_OVERLAP = 128
LOOK_BACK = 0.2
BREAKS = (". ", "\n", " | ")
# ----------------------------------------------------------------------------
_RUN = 64


@dataclass(frozen=True)
class SpanRule:
    """Size, overlap and the look-back window in which a break is sought."""

    size: int = CHUNK_SIZE
    overlap: int = CHUNK_OVERLAP

    def __post_init__(self) -> None:
        if self.size < 1 or self.overlap < 0:
            raise ValueError("size must be positive and overlap not negative")
        if self.stride < 1:
            raise ValueError(
                f"overlap {self.overlap} leaves no progress for size {self.size}"
            )

    @property
    def window(self) -> int:
        return int(self.size * LOOK_BACK)

    @property
    def stride(self) -> int:
        """The least number of characters one span moves ahead."""
        return self.size - self.window + (1 if self.window else 0) - self.overlap

    @property
    def block(self) -> int:
        return max(2 * self.size, 1024)


def _slice(blocks: Column, block: int, start: Column, length: Column | int) -> Column:
    at = F.floor(start / block).cast("int")
    pair = F.concat(
        F.get(blocks, at), F.coalesce(F.get(blocks, at + 1), F.lit(""))
    )
    length = F.lit(length) if isinstance(length, int) else length
    return F.substring(pair, start - at * block + 1, length)


def _span_end(blocks: Column, total: Column, start: Column, rule: SpanRule) -> Column:
    """End of the span that begins at ``start``; it may lie past the text."""
    full = start + rule.size
    if not rule.window:
        return full
    region = _slice(blocks, rule.block, full - rule.window, rule.window)
    broken = let(region, lambda r: last_index(r, *BREAKS))
    moved = let(
        broken,
        lambda b: F.when(b < 0, full).otherwise(full - rule.window + b + 1),
    )
    return F.when(full < total, moved).otherwise(full)


def _span_ends(blocks: Column, total: Column, rule: SpanRule) -> Column:
    """Unclamped span ends; span ``i`` begins at ``end[i-1] - overlap``.

    Appending to an array copies it, so ends are collected in runs of
    ``_RUN`` and the runs appended: a very long text stays close to linear.
    """
    none = F.expr("cast(array() as array<int>)")

    def run(ends: Column, steps: Column) -> Column:
        def step(new: Column, _: Column) -> Column:
            last = F.coalesce(
                F.try_element_at(new, F.lit(-1)), F.try_element_at(ends, F.lit(-1))
            )
            return let(
                F.coalesce(last - rule.overlap, F.lit(0)),
                lambda start: F.when(
                    start < total,
                    F.concat(new, F.array(_span_end(blocks, total, start, rule))),
                ).otherwise(new),
            )

        return F.aggregate(F.sequence(F.lit(1), F.least(steps, F.lit(_RUN))), none, step)

    return let(
        F.ceil(total / rule.stride).cast("int") + 1,
        lambda steps: F.aggregate(
            F.sequence(F.lit(1), F.ceil(steps / _RUN).cast("int")),
            none,
            lambda ends, _: F.concat(ends, run(ends, steps)),
        ),
    )


def overlapping_spans(text: Column, rule: SpanRule = SpanRule()) -> Column:
    """``array<string>`` of the spans of ``text``.

    A text no longer than ``size`` is one span, kept as it is. Otherwise a span
    ends after the last break inside its final fifth, if there is one; spans
    are stripped and each starts ``overlap`` characters before the previous
    end.
    """

    def of_long(t: Column) -> Column:
        cut = F.struct(
            F.regexp_extract_all(t, F.lit(rf"(?s).{{1,{rule.block}}}"), F.lit(0)).alias(
                "blocks"
            ),
            F.length(t).alias("total"),
        )
        return let(
            cut,
            lambda c: let(
                _span_ends(c["blocks"], c["total"], rule),
                lambda ends: F.transform(
                    ends,
                    lambda end, i: strip(
                        let(
                            F.when(i == 0, F.lit(0)).otherwise(
                                F.get(ends, i - 1) - rule.overlap
                            ),
                            lambda s: _slice(c["blocks"], rule.block, s, end - s),
                        )
                    ),
                ),
            ),
        )

    return let(
        text,
        lambda t: F.when(F.length(t) <= rule.size, F.array(t)).otherwise(of_long(t)),
    )
