"""Shared helpers: cutting lineage through the cluster's shared folder and Arrow plumbing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WHITESPACE = " \t\n\x0b\x0c\r"
#: Java and RE2 spelling of one word: a run of anything but the six ASCII white-space characters.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

#: Spark's setting that deletes the shuffle files of a query when it ends.
_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Rows that Python workers hold as Python objects at once, and letters of the longest word that they remember.
SLICE_ROWS = 256
LONGEST_KEPT = 64

_fallback: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; in local tests, where it is unset, a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    return _fallback.setdefault(app, "file://" + tempfile.mkdtemp(prefix="mnemolake-"))


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write ``df`` once as Parquet under the shared folder and read it back.

    The result has no lineage, survives lost executors, and carries real size statistics for later join planning. Shuffle
    files of the write are deleted as soon as it has ended.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN_UP)
    spark.conf.set(_CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEAN_UP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the tables behind results of ``cut``, or a union of them, once nothing that is still to run reads it."""
    spark = df.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    for name in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
        folder = hadoop.Path(name)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(batch: pa.RecordBatch, column: int = 1) -> Iterator[bytes]:
    """UTF-8 bytes of a string column, null as empty, one value at a time."""
    for value in batch.column(column).cast(pa.large_binary()):
        yield value.as_py() or b""


def sliced(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most so many, without copies; an empty batch stays one."""
    for batch in batches:
        for at in range(0, max(1, batch.num_rows), rows):
            yield batch.slice(at, rows)


def document_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """64 bits of a document's id and text."""
    return F.xxhash64(F.col(id_col).cast("long"), F.col(id_col).isNull(), F.coalesce(F.col(text_col).cast("string"), F.lit("")))
