"""Keys and chunks of records as they arrive.

Key extraction and chunking look at one record at a time, so the batch
operators run unchanged on a streaming frame; there is no state to keep.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from casebrook.operators.chunking import chunk_documents
from casebrook.sources.corpus import documents


def chunk_stream(records: DataFrame, **chunk_options) -> DataFrame:
    """Chunk rows of a streaming record table."""
    return chunk_documents(documents(records), **chunk_options)


def start_chunk_ingest(
    records: DataFrame, sink: str, checkpoint: str, **chunk_options
) -> StreamingQuery:
    """Append the chunks of all records now available to parquet files, each
    record once."""
    return (
        chunk_stream(records, **chunk_options)
        .writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(sink)
    )
