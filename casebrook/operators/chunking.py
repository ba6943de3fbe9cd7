"""From documents to chunk rows, with no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casebrook.functions.sections import document_chunks
from casebrook.functions.spans import CHUNK_OVERLAP, CHUNK_SIZE, SpanRule

# 2**23 chunks need a text of over 2**31 characters, more than a string holds.
CHUNK_BITS = 23


def chunk_id(doc_ord: Column, chunk_ord: Column) -> Column:
    """A unique id that sorts like (document, chunk within document).

    An ordinal that leaves no room for the chunk's number is an error.
    """
    fits = (doc_ord >= 0) & (doc_ord < 1 << (63 - CHUNK_BITS))
    number = F.shiftleft(doc_ord, CHUNK_BITS) + chunk_ord
    refused = F.raise_error(F.concat(F.lit("document ordinal out of range: "), doc_ord.cast("string")))
    return F.when(fits | doc_ord.isNull(), number).otherwise(refused.cast("long"))


def chunk_documents(
    docs: DataFrame,
    chunk_size: int = CHUNK_SIZE,
    chunk_overlap: int = CHUNK_OVERLAP,
    preserve_sections: bool = True,
    literal: bool = False,
) -> DataFrame:
    """One row per chunk of ``(doc_ord, reference_number, doc_text)`` rows.

    Scan, project and generate run in one stage; each document is handled
    where it is read. Works on a streaming frame too.
    """
    chunks = document_chunks(
        F.col("doc_text"), SpanRule(chunk_size, chunk_overlap), preserve_sections, literal
    )
    exploded = docs.select(
        "doc_ord", "reference_number", F.posexplode(chunks).alias("chunk_ord", "chunk")
    )
    return exploded.select(
        chunk_id(F.col("doc_ord"), F.col("chunk_ord")).alias("chunk_id"),
        "doc_ord",
        F.col("chunk_ord").cast("int").alias("chunk_ord"),
        "reference_number",
        "chunk.section",
        "chunk.chunk_index",
        "chunk.total_chunks",
        "chunk.chunk_text",
    )
