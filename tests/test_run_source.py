"""Run tables through the data source equal those of the store."""

import pytest
from pyspark.sql import functions as F

from casebrook import schemas
from casebrook.sources.run_source import FORMAT, register
from casebrook.sources.runs import TABLES, RunStore

METRICS = schemas.RUN_METRICS


@pytest.fixture
def store(spark, tmp_path):
    register(spark)
    return RunStore(spark, str(tmp_path))


def read(store, table, root=None):
    return store.spark.read.format(FORMAT).option("table", table).load(root or store.root)


def metrics(spark, run_ids, value):
    rows = [(r, f"k{i}", value + i) for r in run_ids for i in range(3)]
    return spark.createDataFrame(rows + [(r, "nan", float("nan")) for r in run_ids], METRICS)


def bag(df):
    return sorted(map(repr, df.collect()))


def test_rows_as_last_committed(spark, store):
    assert read(store, "run_metrics").collect() == []
    store.write("run_metrics", metrics(spark, "abc", 0.0))
    store.write("run_metrics", metrics(spark, "b", 50.0))
    store.clear(["c"])
    found = read(store, "run_metrics")
    assert found.schema == METRICS
    assert bag(found) == bag(store.read("run_metrics")) and found.count() == 8
    assert bag(read(store, "run_metrics", f"file://{store.root}")) == bag(found)


def test_conditions_leave_only_the_files_of_their_runs(spark, store):
    store.write("run_metrics", metrics(spark, "abcdef", 0.0).repartition(1))
    rows, plain = read(store, "run_metrics"), store.read("run_metrics")
    assert rows.rdd.getNumPartitions() == 6
    for condition, files in (
        ("run_id = 'b'", 1),
        ("run_id IN ('a', 'e', 'unknown')", 2),
        ("run_id IN ('a', 'b') AND run_id = 'b' AND key > 'k0'", 1),
        ("run_id > 'd'", 6),
        ("key = 'k1' OR run_id = 'a'", 6),
        ("key IN ('k1', 'k2') AND key IS NOT NULL AND key < 'k2'", 6),
        ("value >= 1.0", 6),  # in Spark a NaN is the greatest number
    ):
        assert rows.filter(condition).rdd.getNumPartitions() == files, condition
        assert bag(rows.filter(condition)) == bag(plain.filter(condition)), condition
    assert "run_id" in rows.filter("run_id = 'b'")._jdf.queryExecution().optimizedPlan().toString()
    assert rows.filter("run_id = 'unknown'").collect() == []


def test_a_schema_names_the_columns_that_are_read(spark, store):
    store.write("run_metrics", metrics(spark, "ab", 0.0))
    some = spark.read.format(FORMAT).schema("value double, run_id string").option("table", "run_metrics")
    assert bag(some.load(store.root)) == bag(store.read("run_metrics").select("value", "run_id"))
    only = spark.read.format(FORMAT).schema("run_id string").option("table", "run_metrics").load(store.root)
    assert only.groupBy("run_id").agg(F.count("*").alias("n")).where("n = 4").count() == 2


@pytest.mark.parametrize("table", sorted(TABLES))
def test_every_table_can_be_read(spark, store, table):
    """Nested and null cells included."""
    rows = spark.range(2).select(
        *[
            F.lit("r").alias(f.name)
            if f.name == "run_id"
            else F.when(F.col("id") == 0, F.lit("1").cast(f.dataType)).alias(f.name)
            if f.dataType.simpleString() in ("string", "int", "bigint", "double")
            else F.current_timestamp().alias(f.name)
            if f.dataType.simpleString() == "timestamp"
            else F.lit(None).cast(f.dataType).alias(f.name)
            for f in TABLES[table]
        ]
    )
    rows = rows.na.fill("x").na.fill(0)
    store.write(table, rows)
    assert bag(read(store, table)) == bag(store.read(table))


def test_an_unknown_table_is_an_error(spark, store):
    with pytest.raises(Exception, match="no such table"):
        read(store, "nothing").collect()
