from casebrook.operators.chunking import chunk_documents
from casebrook.operators.corpus import distinct_keys
from casebrook.sources.corpus import documents
from casebrook.streaming.ingest import start_chunk_ingest
from casebrook.streaming.keys import KEYS, _combine, read_keys, start_key_ingest

SCHEMA = "doc_ord long, all_columns string"


def test_chunks_of_a_stream_equal_the_batch(spark, tmp_path):
    source, sink, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    rows = [(i, f"reference_number: R{i % 3} | " + "some words. " * (i * 20)) for i in range(9)]
    for part in (rows[:5], rows[5:]):
        spark.createDataFrame(part, SCHEMA).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        start_chunk_ingest(stream, sink, checkpoint).awaitTermination(120)
    batch = chunk_documents(documents(spark.read.schema(SCHEMA).parquet(source)))
    streamed = spark.read.schema(batch.schema).parquet(sink)
    assert sorted(map(tuple, streamed.collect())) == sorted(map(tuple, batch.collect()))


def _records(*rows):
    return [(i, None if key is None else f"reference_number: {key} | text") for i, key in rows]


def test_keys_of_a_stream_equal_the_batch(spark, tmp_path):
    """Over a restart, with records out of order, without texts, and empty input."""
    source, sink, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    arrivals = [
        _records((7, "A"), (8, "A"), (9, None)),
        _records((3, "A"), (4, "B")),
        [],
        _records(*((100 + i, "A") for i in range(500)), (1, "B"), (2, None)),
    ]
    for rows in arrivals:
        spark.createDataFrame(rows, SCHEMA).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
        query = start_key_ingest(stream, sink, checkpoint)
        assert query.awaitTermination(120) and query.exception() is None
        batch = distinct_keys(documents(spark.read.schema(SCHEMA).parquet(source)))
        assert sorted(map(tuple, read_keys(spark, sink).collect())) == sorted(map(tuple, batch.collect()))
    assert (("A", 3, 503)) in [tuple(r) for r in read_keys(spark, sink).collect()]


def test_a_repeated_key_is_reduced_before_its_state(spark):
    rows = spark.createDataFrame(_records(*((i, "A") for i in range(1000))), SCHEMA).coalesce(1)
    narrow = documents(rows).select("reference_number", "doc_ord")
    assert [tuple(r) for r in narrow.mapInArrow(_combine, KEYS).collect()] == [("A", 0, 1000)]
