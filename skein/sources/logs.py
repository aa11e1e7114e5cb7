"""Log trees as DataFrames: files, numbered lines, title index.

Executors list the folders, level by level, since Spark's sources leave out files of no bytes and hidden names; lines come
from one recursive text read for each root, and only those of hidden names through Python.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from pathlib import Path

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.errors import SkeinError
from skein.functions.text import base_name
from skein.operators.events import parsed, string_at
from skein.sources.files import file_system
from skein.storage import materialise

LINES = "path string, storage string, n long, raw string"
#: Splits, of a hundred bytes each, that are broadcast at most; a hundred terabytes of logs have about as many.
MOST_SPLITS = 1_000_000


@dataclass(frozen=True)
class Roots:
    """Where the logs are. What is not given lies below home; home is given, or SKEIN_HOME, or ~/.skein."""

    home: str = ""
    sessions: str = ""
    archived: str = ""
    index: str = ""
    with_archived: bool = True

    @staticmethod
    def resolve(home: str = "", sessions: str = "", archived: str = "", index: str = "", with_archived: bool = True) -> Roots:
        home = _absolute(home or os.environ.get("SKEIN_HOME") or str(Path.home() / ".skein"))
        return Roots(home, _absolute(sessions or f"{home}/sessions"), _absolute(archived or f"{home}/archived_sessions"), _absolute(index or f"{home}/session_index.jsonl"), with_archived)


def _absolute(path: str) -> str:
    return path.rstrip("/") if "://" in path else os.path.abspath(path)


def _hadoop(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path if "://" in path else f"file://{path}")
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    system, where = _hadoop(spark, path)
    return system.exists(where)


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What stands in each folder, but for links."""
    for batch in batches:
        for folder in batch.column(0).to_pylist():
            system, where = file_system(folder)
            local = isinstance(system, fs.LocalFileSystem)
            found = [x for x in system.get_file_info(fs.FileSelector(where)) if x.type in (fs.FileType.File, fs.FileType.Directory) and not (local and os.path.islink(x.path))]
            columns = [[f"{folder}/{x.base_name}" for x in found], [x.type == fs.FileType.Directory for x in found], [x.size or 0 for x in found], [(x.mtime_ns or 0) // 1_000_000 for x in found]]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.bool_(), pa.int64(), pa.int64()), strict=True)], ["path", "folder", "size", "at"])


def _listed(spark: SparkSession, root: str) -> Iterator[DataFrame]:
    """path, folder, size, at: a table for each level of the tree."""
    level = spark.createDataFrame([(root,)], "path string")
    while not level.isEmpty():
        seen = materialise(level.mapInArrow(_entries, "path string, folder boolean, size long, at long"), "listing")
        yield seen
        level = seen.where("folder").select("path").repartition("path")


def _roots(spark: SparkSession, roots: Roots) -> list[tuple[str, str]]:
    """The roots that exist, with their storage."""
    return [(root, storage) for root, storage in ((roots.sessions, "active"), (roots.archived, "archived")) if (storage == "active" or roots.with_archived) and exists(spark, root)]


def list_files(spark: SparkSession, roots: Roots) -> DataFrame:
    """Regular files whose name ends in .jsonl in any case, below the roots that exist; links are not followed."""
    there = _roots(spark, roots)
    if not there:
        raise SkeinError("NO_SESSIONS", f"No session folders found under: {roots.home}")
    parts = [seen.withColumn("storage", F.lit(storage)) for root, storage in there for seen in _listed(spark, root)]
    found = reduce(DataFrame.unionByName, parts).where(~F.col("folder") & F.lower(base_name(F.col("path"))).endswith(".jsonl"))
    files = materialise(found.select("path", "storage", "size", F.date_format(F.timestamp_millis("at"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("modified")), "files")
    if files.isEmpty():
        raise SkeinError("NO_SESSIONS", f"No .jsonl files found under: {', '.join((roots.sessions, roots.archived))}")
    return files


def _hidden(root: str) -> Column:
    """Whether Spark's sources leave out a path below the root: a name in it begins with a dot or an underscore."""
    return F.regexp_like(F.substring(F.col("path"), len(root) + 1, 1 << 30), F.lit(r"/[_.]"))


def _decoded(path: Column) -> Column:
    return F.url_decode(F.replace(F.regexp_replace(path, "^file:(//)?", ""), F.lit("+"), F.lit("%2B")))


def numbered_text(read: DataFrame) -> DataFrame:
    """path, n, raw: lines of a text read, numbered from 1 within their file however it is split, without sorting a file.

    The lines are written once. A split's lines count on from those of the splits before it; splits are one row each.
    """
    lines = materialise(read.select(_decoded(F.col("_metadata.file_path")).alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("m"), F.col("value").alias("raw")), "lines")
    splits = lines.groupBy("path", "block").agg(F.min("m").alias("first"), F.count("*").alias("held"))
    before = F.coalesce(F.sum("held").over(Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    splits = materialise(splits.select("path", "block", (before - F.col("first")).alias("shift")), "splits")
    if splits.count() <= MOST_SPLITS:
        splits = F.broadcast(splits)
    return lines.join(splits, ["path", "block"]).select("path", (F.col("m") + F.col("shift") + 1).cast("long").alias("n"), "raw")


def _python_lines(files: DataFrame) -> DataFrame:
    """path, storage, n, raw: lines of files that the text source leaves out. files: path, storage."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, storage in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                system, where = file_system(path)
                with system.open_input_stream(where) as f:
                    lines = f.read().decode("utf-8", "replace").replace("\r\n", "\n").replace("\r", "\n").split("\n")
                lines = lines[:-1] if lines and not lines[-1] else lines
                columns = [pa.array([path] * len(lines), pa.string()), pa.array([storage] * len(lines), pa.string()), pa.array(range(1, len(lines) + 1), pa.int64()), pa.array(lines, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["path", "storage", "n", "raw"])

    return files.mapInArrow(read, LINES)


def read_lines(spark: SparkSession, roots: Roots, files: DataFrame) -> DataFrame:
    """path, storage, n, raw of every line of the files below the roots. Files of no bytes have none."""
    parts = [spark.createDataFrame([], LINES)]
    for root, storage in _roots(spark, roots):
        own = files.where((F.col("storage") == storage) & (F.col("size") > 0)).select("path", "storage")
        read = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.[jJ][sS][oO][nN][lL]").text(root)
        parts.append(numbered_text(read).join(own.where(~_hidden(root)), "path").select("path", "storage", "n", "raw"))
        parts.append(_python_lines(own.where(_hidden(root)).repartition("path")))
    return reduce(DataFrame.unionByName, parts)


def title_index(lines: DataFrame) -> DataFrame:
    """id, title, updated_at: the last line of an id counts, even with an empty title."""
    v = parsed(lines).select("n", string_at("id").alias("id"), string_at("thread_name").alias("title"), string_at("updated_at").alias("updated"))
    last = v.where("id <> ''").groupBy("id").agg(F.max_by(F.struct("title", "updated"), "n").alias("last"))
    return last.select("id", F.coalesce("last.title", F.lit("")).alias("index_title"), F.coalesce("last.updated", F.lit("")).alias("index_updated"))


def read_title_index(spark: SparkSession, path: str) -> DataFrame:
    if not exists(spark, path):
        return spark.createDataFrame([], "id string, index_title string, index_updated string")
    return title_index(numbered_text(spark.read.text(path)))
