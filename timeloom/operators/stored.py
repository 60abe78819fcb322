"""Intermediate tables of operators that work in rounds."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def settled(rows: DataFrame) -> DataFrame:
    """The rows, checkpointed: lineage ends in the folder that the cluster shares (spark.checkpoint.dir).

    Where that is unset and Spark runs on one machine, a temporary folder is named; elsewhere that is an error.
    """
    context = rows.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        base = rows.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not base and not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(base or "file://" + tempfile.mkdtemp(prefix="timeloom-"))
    return rows.checkpoint()
