"""Cutting lineage: results of repeated steps are written to the shared checkpoint folder, so that plans stay short and lost executors cost one step."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        # the cluster names its folder in spark.checkpoint.dir; a local master without one, as in tests, gets one of its own
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="terrane-")
        context.setCheckpointDir(folder)
    return df.checkpoint()
