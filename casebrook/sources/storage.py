"""Tables written to the shared folder of the cluster.

Expensive or non-repeatable steps (remote calls, cell assignment) are written
once and read back, so that neither a second action nor a lost executor runs
them again.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only a local session (tests) gets a folder of its own when the setting is
    absent; on a cluster a machine-local folder would be lost with the machine.
    """
    configured = spark.conf.get(CHECKPOINT_SETTING, None) or spark.sparkContext.getConf().get(
        CHECKPOINT_SETTING, None
    )
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_SETTING} to a shared folder")
    local = tempfile.mkdtemp(prefix="casebrook-")
    spark.conf.set(CHECKPOINT_SETTING, local)
    return local


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as parquet under the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/casebrook/{name}-{uuid.uuid4().hex}"
    df.write.mode("error").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
