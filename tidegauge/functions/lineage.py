"""Cutting lineage: tables that several branches of a program use are written once, so plans stay small and lost executors cost little."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """``df``, checkpointed in the session's ``spark.checkpoint.dir``; only where that is unset and the master is local, in a temporary folder."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if base is None:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir is not set: driver and executors need a shared folder")
            base = tempfile.mkdtemp(prefix="tidegauge-")
            atexit.register(shutil.rmtree, base, True)
        spark.sparkContext.setCheckpointDir(base)
    return df.checkpoint()
