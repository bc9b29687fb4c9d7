"""Reading the given tables, and what several operators need around them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space as Python's str.strip sees it; Java's \\s alone misses most of it.
SPACE = r"[\s\x0B\x1C-\x1F\x85\p{Z}]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` of the folder `sf_dir`."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir of the session.

    Where it is unset (local sessions and tests) a temporary folder is set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        found = spark.sparkContext.getCheckpointDir()
    return found


def handed_over(spark: SparkSession, name: str, data: bytes) -> str:
    """A file of the driver in a folder of its own below the shared folder, of whatever file system that is: its path, to be
    sent to the executors by Spark."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{uuid.uuid4().hex}/{name}")
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
    try:
        out.write(bytearray(data))
    finally:
        out.close()
    return path.toString()


_written: list[str] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a table in the shared folder, read back: lineage ends there, so a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession) -> None:
    """Deletes the tables that were written between the steps so far. Results that were not yet computed can't be any more."""
    while _written:
        path = spark._jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def as_many(df: DataFrame) -> int:
    """The number of tasks that shuffles have, for rows that are few bytes but much work, which would else be put together in few tasks."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def stripped(c: Column | str) -> Column:
    """`c` without white space (Unicode) at both ends."""
    return F.regexp_replace(c, rf"\A{SPACE}+|{SPACE}+\z", "")


def clean_type(c: Column | str) -> Column:
    """A block_type without case and surrounding spaces."""
    return F.lower(stripped(c))


def once_per_key(df: DataFrame, key: str) -> DataFrame:
    """One row of each key. Whether any key repeats is looked up on the key column alone, so that wide rows
    are only shuffled when there is something to drop. Of repeated rows any one is kept (they are copies)."""
    narrow = df.groupBy(key).count().filter("count > 1")
    return df if narrow.isEmpty() else df.dropDuplicates([key])
