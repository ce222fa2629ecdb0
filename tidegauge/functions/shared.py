"""Cutting lineage through the folder that all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

_TEMPORARY: str | None = None


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to and read from the checkpoint folder, so that no executor's loss repeats its work.

    The folder is the session's ``spark.checkpoint.dir``; only where that is unset (tests) a temporary one
    is taken.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_path(spark))
    return df.checkpoint(eager=True)


def shared_path(spark: SparkSession) -> str:
    """The folder that all executors share: the session's ``spark.checkpoint.dir``, a temporary one where it is unset."""
    global _TEMPORARY
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    if _TEMPORARY is None:
        _TEMPORARY = tempfile.mkdtemp(prefix="tidegauge-")
    return _TEMPORARY
