"""New log lines as a stream: the same events, and running counts for each file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators.events import events
from skein.operators.sessions import session_stats


def stream_events(spark: SparkSession, folder: str, storage: str = "active") -> DataFrame:
    """Events of files as they appear below a folder. A stream has no line numbers: n is null."""
    files = spark.readStream.format("text").option("recursiveFileLookup", True).option("pathGlobFilter", "*.[jJ][sS][oO][nN][lL]").load(folder)
    lines = files.select(F.col("_metadata.file_path").alias("path"), F.lit(storage).alias("storage"), F.lit(None).cast("long").alias("n"), F.col("value").alias("raw"))
    return events(lines)


def running_counts(streamed: DataFrame) -> DataFrame:
    """Messages, tool events and latest timestamp of each file so far; one row of state for each file."""
    return session_stats(streamed)
