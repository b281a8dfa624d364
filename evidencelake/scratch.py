"""Intermediate tables in the folder that all executors share.

``materialize`` cuts lineage by writing a table below ``spark.checkpoint.dir`` and
reading it back, so a lost executor costs only the tasks it was running.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


HOT_ROWS, MAX_HOT_KEYS = 1000, 1_000_000


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by the session; where none is set, a local master gets a local one and a cluster an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.partition("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-evidencelake-")
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing else uses."""
    return f"{scratch_dir(spark)}/evidencelake/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize_dealt(df: DataFrame, name: str, key: str, parts: int) -> DataFrame:
    """Like ``materialize``, in ``parts`` buckets by ``key``: a task reads one bucket, however few bytes it has, and rows of a key meet without a shuffle."""
    spark, table = df.sparkSession, f"{name}_{uuid.uuid4().hex}"
    df.repartition(parts, key).write.bucketBy(parts, key).option("path", new_path(spark, name)).saveAsTable(table)
    found = spark.table(table)
    spark.sql(f"DROP TABLE {table}")  # its name only: the files lie outside the warehouse and stay
    return found


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder in whatever store it lies."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def drop_table(df: DataFrame) -> None:
    """Remove the files of a ``materialize`` that nothing will read again."""
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if "/evidencelake/" in folder:
            remove(df.sparkSession, folder)


def is_small(df: DataFrame, max_rows: int) -> bool:
    """Whether ``df`` has at most ``max_rows`` rows; counts no further than that."""
    return df.limit(max_rows + 1).count() <= max_rows


def join_per_key(rows: DataFrame, per_key: DataFrame, key: str, hot: int = HOT_ROWS) -> DataFrame:
    """``rows`` left-joined with ``per_key``, which has one row a key, without sending a hot key's rows to one task.

    Keys of more than ``hot`` rows are at most a share 1 / ``hot`` of the rows; their part of ``per_key`` is broadcast if it is
    small by count. Only the other rows are shuffled by ``key``. Rows with a null key stay, unmatched.
    """
    often = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("__n")).where(F.col("__n") > hot).select(key)
    if not 0 < often.limit(MAX_HOT_KEYS + 1).count() <= MAX_HOT_KEYS:
        return rows.join(per_key, key, "left")
    hot_rows = rows.join(F.broadcast(often.join(per_key, key, "left")), key)
    rest = rows.join(F.broadcast(often), key, "left_anti").join(per_key, key, "left")
    return hot_rows.unionByName(rest)


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """``df`` with a broadcast hint when its row count is proven small, else ``df`` as it is."""
    return F.broadcast(df) if is_small(df, max_rows) else df
