"""Scratch tables in a shared folder: what cuts lineage is written where every executor can read it."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []
#: While a table is written: its shuffle files leave the disks as soon as it is there, since it is run once; and batches of rows for
#: Python are small, since rows may hold long texts.
_WHILE_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "2000"}


def shared_root(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; only where that is unset and all runs on this machine, as in tests, a folder of our own."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is unset: executors on other machines need a shared folder")
        root = "file://" + tempfile.mkdtemp(prefix="skein-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path under the shared root that nothing else uses; removed when the session's process ends."""
    if not _made:
        atexit.register(_clean)
    path = f"{shared_root(spark)}/skein-{uuid.uuid4().hex}/{name}"
    _made.append((spark, path.rsplit("/", 1)[0]))
    return path


def materialise(df: DataFrame, name: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Write df as Parquet in the shared folder, in folders by the columns `by`, and read it back: a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = new_path(spark, name)
    before = {name: spark.conf.get(name, None) for name in _WHILE_WRITING}
    for name, value in _WHILE_WRITING.items():
        spark.conf.set(name, value)
    try:
        df.write.parquet(path, partitionBy=list(by) or None)
    finally:
        for name, value in before.items():
            spark.conf.set(name, value) if value is not None else spark.conf.unset(name)
    back = spark.read.schema(df.schema).parquet(path).select(df.columns)
    back._skein_path = path
    return back


def each_alone(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table with a partition for each row, for rows that are pieces of work."""
    return spark.createDataFrame(spark.sparkContext.parallelize(rows, max(1, len(rows))), schema)


def discard(df: DataFrame) -> None:
    """Delete a table made by materialise() that no later plan reads."""
    remove(df.sparkSession, df._skein_path.rsplit("/", 1)[0])


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _clean() -> None:
    for spark, path in _made:
        try:
            if spark.sparkContext._jsc is not None:
                remove(spark, path)
        except Exception:  # the session ended first; the folder is the cluster's to clean
            return
