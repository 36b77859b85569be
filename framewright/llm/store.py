"""Intermediate tables in the folder that the whole cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import DataType, StructField, StructType


_own: list[str] = []
_written: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. Only a local session, whose tasks share this machine's disk, may leave it
    unset (as in tests) and gets a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="framewright-"))
    return _own[0]


def new_path(spark: SparkSession) -> str:
    """The path of a table that doesn't exist yet; ``drop_stored`` deletes it."""
    _written.append(f"{shared_folder(spark)}/{uuid.uuid4().hex}")
    return _written[-1]


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stored(spark: SparkSession) -> None:
    """Deletes the tables written so far. Results are read from them, so call this once all results have been saved."""
    jvm = spark.sparkContext._jvm
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def schema_with(df: DataFrame, name: str, kind: DataType) -> StructType:
    """The schema of ``df`` and one more column."""
    return StructType([*df.schema.fields, StructField(name, kind)])


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    while name in df.columns:
        name += "_"
    return name
