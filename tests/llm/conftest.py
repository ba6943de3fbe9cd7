"""Rows that every operator must take: nulls, empty and very long texts, ties."""

import pathlib

import pytest
from pyspark.sql import types as T

FOLDER = "/root/testdata/sf0.001"

ODD_SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # names that the operators use themselves
        T.StructField("kept", T.StringType()),
        T.StructField("host", T.StringType()),
        T.StructField("key", T.StringType()),
        T.StructField("row", T.StringType()),
        T.StructField("measures", T.StringType()),
        T.StructField("fingerprint", T.StringType()),
        T.StructField("line", T.StringType()),
        T.StructField("hash", T.StringType()),
    ]
)


def odd_rows():
    prose = " ".join(f"word{i % 97}x{i % 89}" for i in range(400))
    long = "\n".join(" ".join(f"w{(i * j) % 4099}" for j in range(1, 60)) for i in range(900))
    texts = [
        None,
        "",
        " \t\n ",
        "one",
        "one two three",
        prose,
        prose,
        prose.upper(),
        prose + " tail",
        "x" * 300_000,
        long,
        long + "\nmore at the end",
        "the a the a the a the a " * 40,
        "café   naïve \U0001f600 İstanbul\x85end\x1cfile",
        "#a $b %c & | < > *",
        "line one is here\nline one is here\n\n\nline one is here",
    ]
    rows = [
        (i, t, "en", [None, "a", "b"][i % 3], None if t is None else len(t))
        + ("k", "h", "y", "r", "m", "f", "l", "s")
        for i, t in enumerate(texts)
    ]
    rows.append((5,) + rows[5][1:])  # a repeated row
    rows.append((None,) + rows[8][1:])  # no id
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), ODD_SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], ODD_SCHEMA)


@pytest.fixture(scope="session")
def folder():
    if not pathlib.Path(FOLDER).exists():
        pytest.skip("no test data")
    return FOLDER


@pytest.fixture(scope="session")
def docs(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.collect()}
