"""Cutting one document into titled sections and sections into chunks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from casebrook.functions.spans import SpanRule, overlapping_spans
from casebrook.functions.text import SPACE, is_blank, let, strip

# --- fixed values -----------------------------------------------------------
HEADER_MARK = "## "
LEAD_SECTION = "Main"
WHOLE_SECTION = "Full-doc"
TITLE_HEADER = r"##[ \t]+[^\s][^\n]*"
DOLLAR_HEADER = rf"## [{SPACE}]*\$"
# ----------------------------------------------------------------------------


def _units(text: Column, header: str) -> Column:
    """The text before the first header, then each header with its body."""
    return F.split(text, rf"(?md)(?=^{header})")


def _title(line: Column, literal: bool) -> Column:
    """What follows the mark; read literally, the mark ends at its first blank."""
    marked = strip(line)
    if not literal:
        marked = F.regexp_replace(marked, r"\A##[ \t]+", HEADER_MARK)
    return F.replace(marked, F.lit(HEADER_MARK), F.lit(""))


def _section(unit: Column, header: str, literal: bool) -> Column:
    """``struct(section, body, whole)`` of one unit.

    A header line is followed by one line feed and, unless blank, its body.
    With ``literal`` set a body that itself opens with the header mark takes
    the place of the header and is never divided.
    """

    def build(head: Column) -> Column:
        body = F.substring(unit, F.length(head) + 1, F.length(unit))
        named = F.struct(
            F.when(head == "", F.lit(LEAD_SECTION)).otherwise(_title(head, literal)).alias("section"),
            F.concat(
                F.when(head == "", F.lit("")).otherwise(F.concat(head, F.lit("\n"))),
                F.when(is_blank(body), F.lit("")).otherwise(body),
            ).alias("body"),
            F.lit(False).alias("whole"),
        )
        if not literal:
            return named
        taken = F.struct(
            F.replace(strip(body), F.lit(HEADER_MARK), F.lit("")).alias("section"),
            F.concat(body, F.lit("\n")).alias("body"),
            F.lit(True).alias("whole"),
        )
        return F.when(F.startswith(strip(body), F.lit(HEADER_MARK)), taken).otherwise(named)

    return let(F.regexp_extract(unit, rf"\A({header})", 1), build)


def _numbered(section: Column, spans: Column) -> Column:
    return F.transform(
        spans,
        lambda text, i: F.struct(
            section.alias("section"),
            i.cast("int").alias("chunk_index"),
            F.size(spans).alias("total_chunks"),
            text.alias("chunk_text"),
        ),
    )


def document_chunks(
    text: Column,
    rule: SpanRule = SpanRule(),
    preserve_sections: bool = True,
    literal: bool = False,
) -> Column:
    """``array<struct<section, chunk_index, total_chunks, chunk_text>>``.

    By default a line ``## Title`` opens a section and every section is kept.
    ``literal=True`` reproduces a stricter reading: only a line ``## $`` opens
    a section, and a section shorter than the chunk size survives only at the
    end of the document.
    """
    if not preserve_sections:
        return let(
            overlapping_spans(text, rule),
            lambda spans: _numbered(F.lit(WHOLE_SECTION), spans),
        )
    header = DOLLAR_HEADER if literal else TITLE_HEADER

    def chunks(section: Column) -> Column:
        spans = F.when(section["whole"], F.array(section["body"])).otherwise(
            overlapping_spans(section["body"], rule)
        )
        return let(spans, lambda s: _numbered(section["section"], s))

    def keep(section: Column, at: Column, count: Column) -> Column:
        filled = ~is_blank(section["body"])
        if not literal:
            return filled
        long = ~section["whole"] & (F.length(section["body"]) >= rule.size)
        return filled & (long | (at == count - 1))

    def all_of(units: Column) -> Column:
        sections = F.transform(units, lambda unit: _section(unit, header, literal))
        kept = let(
            sections,
            lambda all_: F.filter(all_, lambda s, i: keep(s, i, F.size(all_))),
        )
        return F.flatten(F.transform(kept, chunks))

    return let(_units(text, header), all_of)
