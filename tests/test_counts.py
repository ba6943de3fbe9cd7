"""Counts per input partition: merged, replaced, and read from the store alone."""

import pytest
from pyspark.sql import functions as F

from casebrook.sources.counts import CountStore


def rows(spark, *parts):
    """Documents and chunks of ``(part, keys, chunks)``."""
    docs = spark.createDataFrame(
        [(part, key) for part, keys, _ in parts for key in keys], "part string, reference_number string"
    )
    chunks = spark.createDataFrame([(part,) for part, _, n in parts for _ in range(n)], "part string")
    return docs, chunks


def totals(store, **options):
    return tuple(store.totals(**options).collect()[0])


def test_totals_of_several_partitions(spark, tmp_path):
    store = CountStore(spark, str(tmp_path))
    assert totals(store) == (0, 0, 0, None)
    assert totals(store, exact=False) == (0, 0, 0, None)
    assert store.add(*rows(spark, ("01", "AAB", 4), ("1", "B", 0))) == ["01", "1"]
    assert totals(store) == (4, 2, 4, 1.0)
    store.add(*rows(spark, ("y", "BCD", 5)))
    assert totals(store) == (7, 4, 9, 9 / 7) == totals(store, exact=False)
    seen = {r["part"]: (r["n_documents"], r["n_chunks"], r["n_complaints"]) for r in store.per_part().collect()}
    assert seen == {"01": (3, 4, 2), "1": (1, 0, 1), "y": (3, 5, 3)}


def test_a_partition_added_again_replaces_its_counts(spark, tmp_path):
    store = CountStore(spark, str(tmp_path))
    store.add(*rows(spark, ("x", "AB", 2), ("y", "C", 1)))
    store.add(*rows(spark, ("x", "D", 7)))
    assert totals(store) == (2, 2, 8, 4.0)
    store.remove(["x"])
    assert totals(store) == (1, 1, 1, 1.0)
    assert store.add(*rows(spark)) == []
    assert totals(store) == (1, 1, 1, 1.0)


def test_a_writer_that_dies_changes_nothing(spark, tmp_path, monkeypatch):
    store = CountStore(spark, str(tmp_path))
    store.add(*rows(spark, ("x", "AB", 2)))
    with monkeypatch.context() as broken:
        broken.setattr(store.log, "commit", lambda *a: (_ for _ in ()).throw(ConnectionError("lost")))
        with pytest.raises(ConnectionError):
            store.add(*rows(spark, ("x", "CDE", 9), ("z", "F", 1)))
    assert totals(store) == (2, 2, 2, 1.0)


@pytest.mark.parametrize("parts", [[("x", "A", 1), (None, "B", 1)], [("x", "A", 1), ("only chunks", "", 3)]])
def test_rows_of_no_partition_are_refused(spark, tmp_path, parts):
    store = CountStore(spark, str(tmp_path))
    with pytest.raises(ValueError, match="not a partition"):
        store.add(*rows(spark, *parts))
    assert totals(store) == (0, 0, 0, None)


def test_adding_and_merging_read_no_other_records(spark, tmp_path):
    source = tmp_path / "in"
    store = CountStore(spark, str(tmp_path / "counts"))
    for part, keys in (("x", "AAB"), ("y", "BC")):
        docs, _ = rows(spark, (part, keys, 0))
        docs.write.parquet(str(source / part))
        read = spark.read.parquet(str(source / part))
        store.add(read, read.select("part"))
        for file in (source / part).glob("*"):  # an input that is gone can't be read again
            file.unlink()
    assert totals(store) == (5, 3, 5, 1.0)
    assert all("/counts/" in f for f in store.totals().inputFiles())
    assert all("/counts/numbers/" in f for f in store.totals(exact=False).inputFiles())


def test_the_estimate_is_near(spark, tmp_path):
    store = CountStore(spark, str(tmp_path))
    docs = spark.range(40000).select(
        F.concat(F.lit("p"), F.col("id") % 3).alias("part"), F.concat(F.lit("k"), F.col("id") % 20000).alias("reference_number")
    )
    store.add(docs, docs.select("part"))
    assert totals(store)[1] == 20000
    assert abs(totals(store, exact=False)[1] - 20000) < 20000 * 0.03
