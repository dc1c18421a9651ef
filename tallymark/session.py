"""Session-level helpers shared by the operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

HOT_KEY_ROWS = 1_000_000
"""Rows above which a key counts as hot.

A table of N rows has at most N / HOT_KEY_ROWS such keys, which bounds every broadcast of hot keys: even 10^13 rows
give at most 10^7 of them. Rows of all other keys fit easily into one task.
"""


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names in ``spark.checkpoint.dir``; fall back to /tmp in local mode only."""
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="tallymark-checkpoint-")
    context.setCheckpointDir(folder)


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder under the checkpoint folder, which all executors can reach."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{purpose}-{uuid.uuid4().hex}"


def materialised(df: DataFrame, purpose: str = "table", compression: str | None = None) -> DataFrame:
    """Write ``df`` as a table in shared storage and read it back.

    All later plans see the same rows, also after lost executors, and read only the columns they need. ``compression`` is the codec, if not
    that of the session.
    """
    folder = shared_folder(df.sparkSession, purpose)
    df.write.parquet(folder, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
