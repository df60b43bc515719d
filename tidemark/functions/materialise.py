"""Cutting a plan where several branches would compute it again."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """``df`` by reliable checkpoint: written to the shared folder that ``spark.checkpoint.dir`` names, so that a lost
    executor loses none of it. A folder of its own is set only where the session names none, as in tests."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="tidemark-"))
    return df.checkpoint()
