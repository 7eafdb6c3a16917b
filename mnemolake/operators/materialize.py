"""Cutting the lineage of iterative plans."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame

_own: dict[str, str] = {}


def settle(df: DataFrame) -> DataFrame:
    """``df`` written once to the folder that executors share (spark.checkpoint.dir) and read back.

    The rest of an iteration then neither repeats nor depends on what came before, and lost executors cost nothing. Only
    a local session without the setting gets a temporary folder.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = _own.setdefault(context.applicationId, "file://" + tempfile.mkdtemp(prefix="mnemolake-"))
    path = f"{folder.rstrip('/')}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
