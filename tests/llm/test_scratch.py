import pytest

from casebrook.llm.scratch import BATCH_ROWS, short_batches


def batch_sizes(spark):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])

    return [r["n"] for r in spark.range(0, 50, 1, 1).mapInArrow(run, "n long").collect()]


def test_jobs_inside_send_short_batches_and_the_setting_comes_back(spark):
    before = spark.conf.get(BATCH_ROWS)
    with pytest.raises(ConnectionError):
        with short_batches(spark, 20):
            assert batch_sizes(spark) == [20, 20, 10]
            raise ConnectionError
    assert spark.conf.get(BATCH_ROWS) == before
    assert batch_sizes(spark) == [50]


def test_a_smaller_setting_stays(spark):
    before = spark.conf.get(BATCH_ROWS)
    spark.conf.set(BATCH_ROWS, "7")
    try:
        with short_batches(spark, 20):
            assert max(batch_sizes(spark)) == 7
    finally:
        spark.conf.set(BATCH_ROWS, before)
