"""The folder that all machines share, and tables written there on the way."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where none is set a local session gets a
    temporary one; on a cluster that is an error."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        path = tempfile.mkdtemp(prefix="quillspark-")
        sc.setCheckpointDir(path)
    return path.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A name of its own in the shared folder; nothing is made yet."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write, and read back with the same columns."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, keys: list[str], megabytes: int = 4) -> DataFrame:
    """``df`` by its keys in as many partitions as its files have ``megabytes``, so
    that a task has as much to sort however large the tables are. Windows, groups
    and joins by these keys need no further exchange. Where a shuffle has as
    many partitions anyway nothing is done."""
    jvm, conf, size = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration(), 0
    for file in df.inputFiles():
        at = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(file))
        size += at.getFileSystem(conf).getFileStatus(at).getLen()
    n = -(-size // (megabytes << 20))
    return df.repartition(n, *keys) if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def hadoop(spark: SparkSession, path: str):
    """(file system, path) of Hadoop, for renames and existence tests."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at
