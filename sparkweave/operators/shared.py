"""Tables that cut a job's lineage, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where no session names one, a folder of our own, on one machine only."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet and read again, so that no later step works it out anew and lost executors cost nothing of it."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(rows: DataFrame) -> DataFrame:
    """``rows`` in as many partitions as there are cores, if they are read in fewer.

    A table of few row groups is read by few tasks, and what is worked out of each text then runs in these alone. Large
    tables have more parts than cores and stay where they are: nothing of them is shuffled.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def nullable(kind: T.DataType) -> T.DataType:
    """A type whose every part may be null, as what is read from files is."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, nullable(f.dataType), True) for f in kind])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(nullable(kind.elementType), True)
    return T.MapType(nullable(kind.keyType), nullable(kind.valueType), True) if isinstance(kind, T.MapType) else kind


def typed(schema: T.StructType | str) -> T.StructType:
    """A schema, given as such or as text, with every part nullable."""
    return nullable(schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema))


def file_system(spark: SparkSession, path: str):
    """(file system, path) of Hadoop for a path."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), at
