"""Tables in the folder that all executors share, for jobs that run in rounds."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Only a local master may go without it (as in tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-fieldsift-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def as_table(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: writes df to the shared folder and reads it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/fieldsift/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._fieldsift_path = path
    return out


def shuffled(df: DataFrame) -> DataFrame:
    """df as a side of a join that goes by shuffle, whatever Spark takes its size for.

    Behind an explode, or read from a compressed table, rows are many times what the plan expects, and a broadcast would
    take them whole through the driver.
    """
    return df.hint("merge")


#: Rows of a task where a table is dealt by its size: some 100 MB where they are sorted.
TASK_ROWS = 250_000


def dealt(df: DataFrame, key: str, rows: int = TASK_ROWS, n: int | None = None) -> DataFrame:
    """df dealt by key to tasks of about so many rows each, for windows and groups by key.

    Left to itself Spark deals by a fixed number, or by compressed bytes, and so a task's sort grows with the input. Keys are
    counted by no one: a key with more rows than that has a larger task. Small tables and streams stay as they are. n: the
    number of rows, where it is known.
    """
    if df.isStreaming or (n := df.count() if n is None else n) <= rows:
        return df
    return df.repartition(max(n // rows + 1, df.sparkSession.sparkContext.defaultParallelism), key)


def drop_table(df: DataFrame) -> None:
    """Deletes a table written by as_table once nothing reads it any more."""
    spark, path = df.sparkSession, getattr(df, "_fieldsift_path", None)
    if path:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
