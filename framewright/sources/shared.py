"""Tables between the rounds of an iterative operator, in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []
_written: list[str] = []


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to ``spark.checkpoint.dir`` and read again. Only a local session may leave that unset and gets a
    temporary folder."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="framewright-"))
        folder = _own[0]
    _written.append(f"{folder}/{uuid.uuid4().hex}")
    df.write.parquet(_written[-1])
    return spark.read.schema(df.schema).parquet(_written[-1])


def drop_stored(spark: SparkSession) -> None:
    """Deletes the tables written so far. Results are read from them, so call this once all results have been saved."""
    jvm = spark.sparkContext._jvm
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
