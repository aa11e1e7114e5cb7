"""Reports on sessions: projects, lists, summaries, diagnostics, search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.text import base_name, first_known, matches_terms, search_blob, text, without_extension
from skein.operators.sessions import unicode

# What the report says of a file.
NO_META, NO_ID, NO_CWD, NO_TITLE = "no session_meta record found", "no session ID", "no stored cwd/project", "no title or first user message"
INVALID_LINES, OTHER_ID = " invalid JSON line(s)", "filename ID differs from session_meta ID "

_active = lambda: F.count_if(F.col("storage") != "archived")
_archived = lambda: F.count_if(F.col("storage") == "archived")


def project_list(sessions: DataFrame) -> DataFrame:
    """project, total, active, archived, in the order of projects."""
    counts = sessions.groupBy(first_known(F.col("cwd"), F.lit("(unknown)")).alias("project")).agg(F.count("*").alias("total"), _active().alias("active"), _archived().alias("archived"))
    return counts.orderBy(unicode("project"), "project")


def session_list_order(seq: Column) -> list[Column]:
    return [unicode("cwd"), unicode("started_at").desc(), seq]


def session_list(sessions: DataFrame, seq: str = "seq") -> DataFrame:
    """storage, title, project, started, id, file, by project and latest start."""
    name = base_name(F.col("path"))
    listed = sessions.orderBy(*session_list_order(F.col(seq)))
    return listed.select(
        "storage", first_known(F.col("title"), F.lit("(untitled)")).alias("title"), first_known(F.col("cwd"), F.lit("(unknown project)")).alias("project"), first_known(F.col("started_at"), F.lit("unknown date")).alias("started"),
        first_known(F.col("id"), without_extension(name), F.lit("unknown id")).alias("id"), name.alias("file"),
    )


def index_order(seq: Column) -> list[Column]:
    return [unicode(first_known(F.col("updated_at"), F.col("started_at"))).desc(), seq]


def summary(rows: DataFrame, seq: str = "seq") -> DataFrame:
    """project, sessions, in the order in which projects first appear."""
    return rows.groupBy(first_known(F.col("cwd"), F.lit("unknown")).alias("project")).agg(F.count("*").alias("sessions"), F.min(seq).alias("first_seq")).orderBy("first_seq")


def totals(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("sessions"), _active().alias("active"), _archived().alias("archived"))


def storage_diagnostics(records: DataFrame, sessions: DataFrame) -> DataFrame:
    """storage, files, retained: always both storages."""
    both = records.sparkSession.createDataFrame([("active",), ("archived",)], "storage string")
    files, kept = records.groupBy("storage").agg(F.count("*").alias("files")), sessions.groupBy("storage").agg(F.count("*").alias("retained"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return both.join(files, "storage", "left").join(kept, "storage", "left").select("storage", zero("files"), zero("retained"))


def file_diagnostics(records: DataFrame) -> DataFrame:
    """storage, file, problems, id, id_source, cwd, path of the files that need attention, before duplicates go."""
    problems = [
        F.when(~F.col("has_meta"), NO_META), F.when(F.col("id") == "", NO_ID), F.when(F.col("cwd") == "", NO_CWD), F.when(F.col("title") == "", NO_TITLE),
        F.when(F.col("invalid_lines") > 0, F.concat(F.col("invalid_lines").cast("string"), F.lit(INVALID_LINES))), F.when(F.col("id_mismatch"), F.concat(F.lit(OTHER_ID), "metadata_id")),
    ]
    told = records.select("storage", base_name(F.col("path")).alias("file"), F.concat_ws("; ", *problems).alias("problems"), "id", "id_source", "cwd", "path")
    return told.where("problems <> ''")


def search_index(rows: DataFrame) -> DataFrame:
    """Adds the blob that the index is searched by."""
    return rows.withColumn("blob", search_blob(first_known(F.col("project_name"), F.col("cwd")), first_known(F.col("title"), F.col("id")), F.col("storage"), F.col("started_at"), F.col("updated_at"), F.col("model")))


def search_sessions(indexed: DataFrame, query: str) -> DataFrame:
    return indexed.where(matches_terms(text("blob"), query))
