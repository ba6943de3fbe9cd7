"""Approximate search by signs of random projections.

A vector's signature in a table is the signs of its products with a few random
directions; like vectors share signatures. Products of vectors of any length
become angles by one more component: chunks get what they lack to the greatest
length of all, queries get 0, and both are scaled to length 1. A query visits its
own bucket in every table and those beyond its least certain signs. Buckets are
cells like those of the exact route, so a crowded one is cut into tiles.

How many of the true neighbours are found depends on the vectors; ``recall``
measures it against the exact route.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casebrook.functions.vectors import l2_norm
from casebrook.operators.blockscore import matrix

TABLES = 16
PROBES = 3
BUCKET_CHUNKS = 512
MAX_BITS = 14
_SEED = 5


def bits_for(chunks: int) -> int:
    """Signs that leave about ``BUCKET_CHUNKS`` chunks in a bucket of evenly spread vectors."""
    return max(1, min(MAX_BITS, math.ceil(math.log2(max(2, chunks / BUCKET_CHUNKS)))))


def _directions(tables: int, bits: int, dim: int) -> np.ndarray:
    return np.random.default_rng(_SEED).standard_normal((tables * bits, dim + 1))


def _products(vectors: np.ndarray, last: np.ndarray, directions: np.ndarray) -> np.ndarray:
    return vectors @ directions[:, :-1].T + last[:, None] * directions[:, -1]


def _cells(products: np.ndarray, tables: int, bits: int) -> np.ndarray:
    signs = (products > 0).reshape(len(products), tables, bits)
    return (signs << np.arange(bits)).sum(axis=2) + (np.arange(tables) << bits)


def buckets(chunks: DataFrame, dim: int, tables: int, bits: int) -> DataFrame:
    """Each chunk once per table, with its ``cell`` there."""
    longest = chunks.agg(F.max(l2_norm(F.col("embedding")))).first()[0] or 0.0
    directions = chunks.sparkSession.sparkContext.broadcast(_directions(tables, bits, dim))
    schema = T.StructType(
        [
            T.StructField("chunk_id", T.LongType()),
            T.StructField("reference_number", T.StringType()),
            T.StructField("embedding", T.ArrayType(T.FloatType())),
            T.StructField("cells", T.ArrayType(T.IntegerType())),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = matrix(batch.column("embedding"), dim)
            lacking = np.sqrt(np.maximum(longest**2 - (vectors**2).sum(axis=1), 0))
            own = _cells(_products(vectors, lacking, directions.value), tables, bits)
            cells = pa.array(own.astype(np.int32).tolist(), type=pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, cells], names=schema.names)

    rows = chunks.select("chunk_id", "reference_number", "embedding").mapInArrow(run, schema)
    return rows.select("chunk_id", "reference_number", "embedding", F.explode("cells").alias("cell"))


def visits(queries: DataFrame, dim: int, tables: int, bits: int, probes: int) -> DataFrame:
    """Each query with the ``cells`` it visits: 1 + ``probes`` in every table."""
    probes = min(probes, bits)
    directions = queries.sparkSession.sparkContext.broadcast(_directions(tables, bits, dim))
    schema = T.StructType(
        [
            T.StructField("query_id", T.StringType()),
            T.StructField("own_key", T.StringType()),
            T.StructField("query_vector", T.ArrayType(T.FloatType())),
            T.StructField("cells", T.ArrayType(T.IntegerType())),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = matrix(batch.column("query_vector"), dim)
            products = _products(vectors, np.zeros(len(vectors)), directions.value)
            own = _cells(products, tables, bits)
            unsure = np.argsort(np.abs(products.reshape(len(own), tables, bits)), axis=2)[:, :, :probes]
            near = own[:, :, None] ^ (1 << unsure)
            every = np.concatenate([own[:, :, None], near], axis=2).reshape(len(own), tables * (1 + probes))
            cells = pa.array(every.astype(np.int32).tolist(), type=pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, cells], names=schema.names)

    return queries.select("query_id", "own_key", "query_vector").mapInArrow(run, schema)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """``n_exact, n_found``: hits of the exact search, and those of them found."""
    pairs = ["query_id", "chunk_id"]
    seen = found.select(*pairs).withColumn("found", F.lit(1))
    return exact.select(*pairs).join(seen, pairs, "left").agg(
        F.count("*").alias("n_exact"), F.count("found").alias("n_found")
    )
