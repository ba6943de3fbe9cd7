import random
import re

import pytest
from pyspark.sql import functions as F

from casebrook.operators import corpus, sizing
from casebrook.operators.fetch import BITMAP_BYTES, rows_with


@pytest.mark.parametrize("bound", [1 << 20, 8 * BITMAP_BYTES, 1])
def test_rows_are_picked_exactly(spark, bound):
    rng = random.Random(2)
    edges = [-(1 << 63) + 1, -32769, -32768, -1, 0, 1, 7, 8, 9, 32767, 32768, 32769, 1 << 40, (1 << 63) - 1]
    every = edges + [rng.randint(-200_000, 200_000) for _ in range(900)] + [None, None]
    rows = spark.createDataFrame([(n, f"text {n}") for n in every], "n long, text string").repartition(4)
    chosen = rng.sample(every, 300) + edges[::2] + [123_456_789] * 3
    numbers = spark.createDataFrame([(n,) for n in chosen], "n long")
    got = sorted(r["n"] for r in rows_with(rows, numbers, "n", bound).collect())
    assert got == sorted(n for n in every if n is not None and n in set(chosen))
    assert rows_with(rows, numbers.limit(0), "n", bound).collect() == []


def test_texts_stay_put_beyond_the_bound(spark, monkeypatch):
    docs = spark.createDataFrame(
        [(i, f"k{i % 70}", f"text {i}") for i in range(500)],
        "doc_ord long, reference_number string, doc_text string",
    ).repartition(3)
    wanted = docs.filter("doc_ord % 3 = 0").select("reference_number")
    whole = sorted(map(tuple, corpus.lookup_documents(docs, wanted).collect()))
    monkeypatch.setattr(sizing, "MAX_ROWS", 0)
    found = corpus.lookup_documents(docs, wanted)
    # what is shuffled, broadcast or sorted below the scan of the texts has none of them
    plan = found._jdf.queryExecution().explainString(
        found.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )
    moved = re.findall(r"\(\d+\) (?:\w*Exchange|Sort)\n(?:Input.*\n)", plan)
    above = [m for m in moved if "doc_text" in m]
    assert len(above) <= 1 and all("RoundRobin" in plan for _ in above)  # the test's own repartition
    assert sorted(map(tuple, found.collect())) == whole
    assert [r[0] for r in found.groupBy("reference_number").agg(F.count("*").alias("n")).filter("n > 1").collect()] == []
