"""Batches of rows handed to a caller-supplied model function.

The library carries no transport: ``embed_fn`` and ``complete_fn`` own the
endpoint, the credentials and the time-outs. Spark partitions the requests and
spreads the calls; failures come back as a column, one row never fails another
batch, and callers write the result (``storage.materialise``) before they use
it twice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casebrook.functions.vectors import NORM_FLOOR
from casebrook.sources.ledger import AnswerLedger, answered, request_of

# --- fixed values -----------------------------------------------------------
EMBED_BATCH = 64
ERROR_CHARS = 500
EMBED_FAILED = "Embedding call failed: "
COMPLETE_FAILED = "LLM call failed: "
# ----------------------------------------------------------------------------

EmbedFn = Callable[[Sequence[str]], Sequence[Sequence[float]]]
CompleteFn = Callable[[Sequence[dict]], Sequence[str]]


def _call_in_batches(
    inputs: Sequence, call: Callable, batch_size: int, failed: str
) -> tuple[list, list]:
    """Call on slices; a raised error or a wrong result count marks its slice,
    an exception returned in place of a result marks its row."""
    results: list = []
    errors: list = []
    for at in range(0, len(inputs), batch_size):
        part = inputs[at : at + batch_size]
        try:
            answers = list(call(part))
            if len(answers) != len(part):
                raise ValueError(f"{len(answers)} results for {len(part)} inputs")
        except Exception as error:  # noqa: BLE001 - failures are data here
            answers = [error] * len(part)
        for answer in answers:
            bad = isinstance(answer, Exception)
            results.append(None if bad else answer)
            errors.append(failed + str(answer)[:ERROR_CHARS] if bad else None)
    return results, errors


def _append(df: DataFrame, fields: list[T.StructField]) -> T.StructType:
    return T.StructType(df.schema.fields + fields)


VECTOR = T.ArrayType(T.FloatType(), False)


def _unit(vector: Sequence[float]) -> np.ndarray:
    """Length 1 as 32-bit floats; a zero vector stays zero."""
    wide = np.asarray(vector, dtype=np.float32).astype(np.float64)
    return (wide / max(np.sqrt((wide * wide).sum()), NORM_FLOOR)).astype(np.float32)


def _units(vectors: Sequence) -> list:
    """The same for many vectors, None left as it is; at once when lengths agree."""
    given = [vector for vector in vectors if vector is not None]
    if len({len(vector) for vector in given}) != 1:
        return [None if vector is None else _unit(vector) for vector in vectors]
    wide = np.asarray(given, dtype=np.float32).astype(np.float64)
    norms = np.maximum(np.sqrt((wide * wide).sum(axis=1)), NORM_FLOOR)
    made = iter((wide / norms[:, None]).astype(np.float32))
    return [None if vector is None else next(made) for vector in vectors]


def embed_texts(
    df: DataFrame,
    embed_fn: EmbedFn,
    text_col: str = "chunk_text",
    batch_size: int = EMBED_BATCH,
    parallelism: int | None = None,
    ledger: AnswerLedger | None = None,
) -> DataFrame:
    """Add ``embedding`` (unit ``array<float>``) and ``embed_error``.

    Only the text goes to Python; all other columns stay in the JVM. With a
    ``ledger`` (of ``VECTOR``) equal texts are embedded once, ever.
    """
    rows = df.drop("embedding", "embed_error")
    if ledger is not None:
        named = rows.withColumn("text", F.col(text_col))

        def call(part: DataFrame) -> DataFrame:
            made = embed_texts(part, embed_fn, "text", batch_size, parallelism)
            return made.withColumnsRenamed({"embedding": "answer", "embed_error": "error"})

        found = answered(named, request_of(F.col("text")), ["text"], call, ledger)
        return found.drop("attempt").withColumnsRenamed({"answer": "embedding", "error": "embed_error"})
    rows = rows.repartition(parallelism) if parallelism else rows

    @F.pandas_udf(T.StructType([T.StructField("embedding", VECTOR), T.StructField("embed_error", T.StringType())]))
    def call_model(texts: pd.Series) -> pd.DataFrame:
        vectors, errors = _call_in_batches(texts.tolist(), embed_fn, batch_size, EMBED_FAILED)
        return pd.DataFrame({"embedding": pd.Series(_units(vectors), dtype=object), "embed_error": pd.Series(errors, dtype=object)})

    # not deterministic: no plan may call the model twice for one row
    made = rows.withColumn("_made", call_model.asNondeterministic()(F.col(text_col)))
    return made.select(*rows.columns, "_made.embedding", "_made.embed_error")


def complete(
    df: DataFrame,
    complete_fn: CompleteFn,
    batch_size: int = 1,
    parallelism: int | None = None,
    ledger: AnswerLedger | None = None,
) -> DataFrame:
    """Replace ``prompt`` by ``response`` and ``error`` in rows that also carry
    ``endpoint``, ``temperature`` and ``max_tokens``.

    ``complete_fn`` gets a list of dicts with these four entries. The prompt,
    by far the widest column, is not sent back. With a ``ledger`` only requests
    without an answer are made, equal ones once.
    """
    request = ["prompt", "endpoint", "temperature", "max_tokens"]
    if ledger is not None:
        sent = df.withColumn("sent", F.struct(*request))

        def call(part: DataFrame) -> DataFrame:
            made = complete(part.select("request", "sent.*"), complete_fn, batch_size, parallelism)
            return made.withColumnRenamed("response", "answer")

        found = answered(sent.drop("prompt"), request_of(*(F.col(f"sent.{c}") for c in request)), ["sent"], call, ledger)
        return found.drop("attempt").withColumnRenamed("answer", "response")
    rows = df.repartition(parallelism) if parallelism else df

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            answers, errors = _call_in_batches(
                frame[request].to_dict("records"), complete_fn, batch_size, COMPLETE_FAILED
            )
            yield frame.drop(columns="prompt").assign(response=answers, error=errors)

    schema = _append(
        df.drop("prompt"),
        [
            T.StructField("response", T.StringType()),
            T.StructField("error", T.StringType()),
        ],
    )
    return rows.mapInPandas(run, schema)


def embeddings_of_response(response: Column) -> Column:
    """Vectors of an embedding answer in any of its three usual shapes.

    ``{"embeddings": [...]}``, ``{"data": [{"embedding": [...]}]}`` or
    ``{"data": {"embeddings": [...]}}``; NULL when none fits.
    """

    def at(schema: str) -> Column:
        return F.from_json(response, schema)

    vectors = "array<array<float>>"
    listed = at("data array<struct<embedding: array<float>>>")["data"]
    return F.coalesce(
        at(f"embeddings {vectors}")["embeddings"],
        F.when(
            F.get(listed, 0)["embedding"].isNotNull(),
            F.transform(listed, lambda row: row["embedding"]),
        ),
        at(f"data struct<embeddings: {vectors}>")["data"]["embeddings"],
    )


def content_of_response(response: Column) -> Column:
    """Text of a chat-completion answer."""
    return F.get_json_object(response, "$.choices[0].message.content")


def failure_text(prefix: str, body: Column) -> Column:
    """Failure message with the first characters of an error body."""
    return F.concat(F.lit(prefix), F.substring(body, 1, ERROR_CHARS))


def assert_one_dimension(df: DataFrame, vector_col: str = "embedding") -> int:
    """The vector dimension of a table; raises when rows differ."""
    low, high = df.agg(
        F.min(F.size(vector_col)), F.max(F.size(vector_col))
    ).first()
    if low != high:
        raise ValueError(f"vectors of {low} to {high} dimensions in one table")
    return low
