"""Experiment runs kept in ordinary parquet tables.

Every table is partitioned by snapshot and ``run_id``. A write makes a snapshot
of its own; a commit at the end says which snapshot is current for which run, so
a repeated write replaces a run instead of doubling it, readers see the old run
or the new one and nothing between, and a writer that dies changes nothing.
Reading one run's rows prunes to its partition.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce
from operator import or_

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casebrook import schemas
from casebrook.schemas import METRICS
from casebrook.sources.commits import CommitLog

# --- fixed values -----------------------------------------------------------
PARAM_KEYS = (
    "llm_name",
    "llm_endpoint",
    "temperature",
    "max_tokens",
    "k_neighbors",
    "num_test_complaints",
    "num_judges",
    "judge_endpoints",
)
AVERAGE_KEYS = (
    "avg_accuracy",
    "avg_completeness",
    "avg_chronology",
    "avg_clarity",
    "avg_conciseness",
    "avg_overall_score",
    "avg_summary_length",
    "avg_judge_agreement",
    "std_accuracy",
    "std_overall_score",
    "avg_accuracy_std",
    "avg_overall_score_std",
)
RUN_SUFFIX = "yyyyMMdd_HHmmss"
ITEM_KEYS = (*METRICS, "accuracy_std", "overall_score_std", "judge_agreement")
# ----------------------------------------------------------------------------

STEADY_DIGITS = 9
MAX_KEYS = 2000  # parameters or metrics that may become columns

TABLES: dict[str, T.StructType] = {
    "runs": schemas.RUNS,
    "run_params": schemas.RUN_PARAMS,
    "run_metrics": schemas.RUN_METRICS,
    "summaries": schemas.SUMMARIES,
    "evaluations": schemas.EVALUATIONS,
    "judge_breakdown": schemas.JUDGE_BREAKDOWN,
    "failures": schemas.FAILURES,
}


def _checked(run_ids: list[str]) -> list[str]:
    for run_id in run_ids:
        if not re.fullmatch(r"[\w-][\w.-]*", run_id):
            raise ValueError(f"not a run id: {run_id!r}")
    return run_ids


class Snapshot:
    """The tables of some runs while they are written; nobody reads them yet."""

    def __init__(self, store: RunStore, run_ids: list[str]) -> None:
        self.store = store
        self.run_ids = run_ids
        self.name = uuid.uuid4().hex

    def write(self, table: str, rows: DataFrame) -> None:
        schema = TABLES[table]
        (
            rows.select(*[F.col(f.name).cast(f.dataType) for f in schema])
            .write.mode("append")
            .partitionBy("run_id")
            .parquet(f"{self.store.path(table)}/snapshot={self.name}")
        )


class RunStore:
    """The run tables below one root folder."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark = spark
        self.root = root.rstrip("/")
        self.log = CommitLog(spark, self.root)

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    @contextmanager
    def replacing(self, run_ids: list[str]) -> Iterator[Snapshot]:
        """A snapshot that takes the place of all that was recorded under these
        ids, also in tables without new rows. It does so at the end and at once;
        an error leaves everything as it was."""
        snapshot = Snapshot(self, _checked(run_ids))
        yield snapshot
        self.log.commit(snapshot.name, {table: run_ids for table in TABLES})

    def write(self, table: str, rows: DataFrame) -> None:
        """Replace one table's rows of the runs that ``rows`` names."""
        snapshot = Snapshot(self, [])
        snapshot.write(table, rows)
        written = self._all(table).filter(F.col("snapshot") == snapshot.name)
        run_ids = [r["run_id"] for r in written.select("run_id").distinct().collect()]
        self.log.commit(snapshot.name, {table: _checked(run_ids)})

    def clear(self, run_ids: list[str]) -> None:
        """Drop all that was recorded under these ids."""
        self.log.commit(None, {table: _checked(run_ids) for table in TABLES})

    def vacuum(self) -> None:
        """Delete snapshots that no commit names any more. No writer may be at work."""
        conf = self.spark._jsc.hadoopConfiguration()
        current = {(table, name) for (table, _), name in self.log.current().items()}
        for table in TABLES:
            folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(table))
            system = folder.getFileSystem(conf)
            for status in system.listStatus(folder) if system.exists(folder) else []:
                name = status.getPath().getName()
                if name.startswith("snapshot=") and (table, name.split("=", 1)[1]) not in current:
                    system.delete(status.getPath(), True)

    def _all(self, table: str) -> DataFrame:
        """Rows of every snapshot, committed or not."""
        schema = T.StructType([*TABLES[table].fields, T.StructField("snapshot", T.StringType())])
        return self.spark.read.schema(schema).parquet(self.path(table))

    def read(self, table: str) -> DataFrame:
        """The table as last committed; an empty frame of its schema before that."""
        schema = TABLES[table]
        runs: dict[str, list[str]] = {}
        for (name, run_id), snapshot in self.log.current().items():
            if name == table:
                runs.setdefault(snapshot, []).append(run_id)
        if not runs:
            return self.spark.createDataFrame([], schema)
        current = [
            (F.col("snapshot") == snapshot) & F.col("run_id").isin(run_ids)
            for snapshot, run_ids in sorted(runs.items())
        ]
        try:
            rows = self._all(table)
        except AnalysisException as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return self.spark.createDataFrame([], schema)
        return rows.filter(reduce(or_, current)).select(*schema.names)

    def read_run(self, table: str, run_id: str) -> DataFrame:
        return self.read(table).filter(F.col("run_id") == run_id)

    def export_csv(self, table: str, run_id: str, path: str) -> None:
        """One run's rows as CSV; nested cells become JSON text."""
        flatten_nested(self.read_run(table, run_id)).write.mode("overwrite").option(
            "header", True
        ).option("escape", '"').csv(path)

    def wide_runs(self, experiment: str, items: bool = False) -> DataFrame:
        """The experiment's runs with all their parameters and averages, and with
        ``items`` also the metrics of single records."""
        runs = self.read("runs").filter(F.col("experiment") == experiment)
        own = [r["run_id"] for r in runs.select("run_id").collect()]
        params = self.read("run_params").filter(F.col("run_id").isin(own))
        metrics = self.read("run_metrics").filter(F.col("run_id").isin(own))
        return wide_runs(
            runs,
            params,
            metrics,
            all_keys(params, PARAM_KEYS),
            all_keys(metrics if items else without_items(metrics), AVERAGE_KEYS),
        )


def run_name(llm_name: Column, started: Column) -> Column:
    """``<model>_<start>`` with the start as ``yyyyMMdd_HHmmss``."""
    return F.concat_ws("_", llm_name, F.date_format(started, RUN_SUFFIX))


def flatten_nested(rows: DataFrame) -> DataFrame:
    return rows.select(
        *[
            F.to_json(f.name).alias(f.name)
            if isinstance(f.dataType, (T.MapType, T.StructType, T.ArrayType))
            else F.col(f.name)
            for f in rows.schema
        ]
    )


def widen(long: DataFrame, keys: tuple[str, ...], prefix: str) -> DataFrame:
    """``(run_id, key, value)`` rows to one row per run.

    The keys are given, so the schema is known and others are filtered out at
    the scan.
    """
    wanted = long.filter(F.col("key").isin(*keys))
    return wanted.groupBy("run_id").agg(
        *[
            F.max(F.when(F.col("key") == key, F.col("value"))).alias(f"{prefix}{key}")
            for key in keys
        ]
    )


def without_items(metrics: DataFrame) -> DataFrame:
    """Metrics of whole runs: those not named ``<metric>_<position>``."""
    return metrics.filter(~F.col("key").rlike(f"^({'|'.join(ITEM_KEYS)})_[0-9]+$"))


def all_keys(long: DataFrame, first: tuple[str, ...], most: int = MAX_KEYS) -> tuple[str, ...]:
    """The keys ``first`` and after them all others there are, in order.

    They become columns, so there is a bound: more than ``most`` is an error that
    names the long table as the place for them.
    """
    other = long.select("key").filter(~F.col("key").isin(*first)).distinct()
    names = [r["key"] for r in other.limit(most + 1).collect()]
    if len(names) > most:
        raise ValueError(f"more than {most} different keys; read the table of keys and values instead")
    return (*first, *sorted(names))


def wide_runs(
    runs: DataFrame,
    params: DataFrame,
    metrics: DataFrame,
    param_keys: tuple[str, ...] = PARAM_KEYS,
    metric_keys: tuple[str, ...] = AVERAGE_KEYS,
) -> DataFrame:
    """Runs with ``params.*`` (strings) and ``metrics.*`` columns, newest first.

    Key lists make the columns; ``all_keys`` finds those of a table.
    """
    return (
        runs.join(widen(params, param_keys, "params."), "run_id", "left")
        .join(widen(metrics, metric_keys, "metrics."), "run_id", "left")
        .orderBy(F.desc("start_time"), "run_id")
    )


def average_metrics(
    evaluations: DataFrame, summaries: DataFrame, by: str = "run_id"
) -> DataFrame:
    """Per-run means and deviations over its judged records, one row per run.

    Both inputs are reduced to one row per run before they meet. Values are
    rounded far below any meaningful digit, so that the order in which
    partitions are summed cannot change a ranking.
    """

    def steady(value: Column) -> Column:
        return F.round(value, STEADY_DIGITS)

    scores = evaluations.groupBy(by).agg(
        *[steady(F.avg(name)).alias(f"avg_{name}") for name in METRICS],
        steady(F.avg("judge_agreement")).alias("avg_judge_agreement"),
        steady(F.stddev_pop("accuracy")).alias("std_accuracy"),
        steady(F.stddev_pop("overall_score")).alias("std_overall_score"),
        steady(F.avg("accuracy_std")).alias("avg_accuracy_std"),
        steady(F.avg("overall_score_std")).alias("avg_overall_score_std"),
    )
    lengths = summaries.groupBy(by).agg(
        steady(F.avg("summary_length")).alias("avg_summary_length")
    )
    return scores.join(lengths, by, "left").select(by, *AVERAGE_KEYS)


def to_metric_rows(wide: DataFrame, names: tuple[str, ...], by: str = "run_id") -> DataFrame:
    """One row per run to ``(run_id, key, value)`` rows."""
    return wide.unpivot(by, list(names), "key", "value").filter(F.col("value").isNotNull())


def item_metric_rows(evaluations: DataFrame, by: str = "run_id") -> DataFrame:
    """Per-record metrics named ``<metric>_<position in the test list>``."""
    long = evaluations.select(by, "position", *ITEM_KEYS).unpivot(
        [by, "position"], list(ITEM_KEYS), "key", "value"
    )
    return long.select(
        by,
        F.concat_ws("_", "key", F.col("position").cast("string")).alias("key"),
        "value",
    ).filter(F.col("value").isNotNull())
