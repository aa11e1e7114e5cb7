"""One record for each log file, then one for each session.

The record is a fold over the file's lines with first-wins and last-wins fields that ends early, at the first line by which
folder, id, start, first user text and model are all known. In closed form: aggregates find where each field is first set,
their maximum is where the fold stops, and further aggregates take the values up to there. All are algebraic, so Spark
combines them before the shuffle and one very long log is no burden. The fold reads its events twice, so callers hand it
events that are written (`skein.storage.materialise`) rather than lines still to be parsed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.text import SPACE, TITLE_LENGTH, cwd_from_text, derive_title, first_known, redact, session_id_from_name, text
from skein.storage import materialise

_FAR = (1 << 63) - 1


def _min_where(where: Column) -> Column:
    return F.min(F.when(where, F.col("n")))


def session_fold(events: DataFrame, files: DataFrame) -> DataFrame:
    """path, storage, size and the record of each file; missing strings are ''.

    files has path, storage, size and modified; a file without lines has a record too.
    """
    meta, turn = F.col("kind") == "meta", F.col("kind") == "turn"
    said = ((F.col("kind") == "message") & (F.col("role") == "user") | (F.col("kind") == "prompt")) & F.col("body").isNotNull()
    has_cwd = F.col("cwd").isNotNull()
    starts = F.coalesce("meta_ts", "ts")
    firsts = events.groupBy("path").agg(
        _min_where(meta).alias("fs"), F.min_by("meta_id", F.when(meta, F.col("n"))).alias("mid"), _min_where(said).alias("fu"), F.min_by("body", F.when(said, F.col("n"))).alias("first_text"),
        _min_where((meta | turn) & has_cwd).alias("f_cwd"), _min_where(meta & starts.isNotNull()).alias("f_ts"), _min_where(turn & F.col("model").isNotNull()).alias("f_model"),
    )
    firsts = files.select("path", "storage", "size", "modified").join(firsts, "path", "left")
    firsts = firsts.withColumns({"fid": session_id_from_name(F.col("path")), "mid": text("mid"), "first_text": text("first_text")}).withColumn("text_cwd", cwd_from_text(F.col("first_text")))
    cwd_at = F.least("f_cwd", F.when(F.col("text_cwd") != "", F.col("fu")))
    id_at = F.when(F.col("fid") != "", F.lit(0)).when(F.col("mid") != "", F.col("fs"))
    set_at = [id_at, cwd_at, F.col("f_ts"), F.col("fu"), F.col("f_model")]
    all_set = cwd_at.isNotNull() & id_at.isNotNull() & F.col("f_ts").isNotNull() & F.col("fu").isNotNull() & F.col("f_model").isNotNull()
    firsts = firsts.withColumn("stop", F.when(all_set, F.greatest(*set_at)).otherwise(F.lit(_FAR)))

    narrow = events.select("path", "n", "ok", "kind", "cwd", "model", "source", starts.alias("starts"))
    within = narrow.join(firsts.select("path", "fs", "stop"), "path").where("n <= stop")
    over = (turn | (meta & (F.col("n") == F.col("fs")))) & has_cwd
    fill = meta & (F.col("n") > F.col("fs")) & has_cwd
    at = lambda where: F.when(where, F.col("n"))
    values = within.groupBy("path").agg(
        F.max_by("cwd", at(over)).alias("over"), F.min_by("cwd", at(fill)).alias("fill"), _min_where(fill).alias("fill_at"), F.min_by("starts", at(meta & F.col("starts").isNotNull())).alias("started"),
        F.max_by("model", at(turn & F.col("model").isNotNull())).alias("model"), F.min_by("source", at(meta)).alias("source"), F.count_if(~F.col("ok")).alias("invalid"), F.max("n").alias("parsed_lines"),
    )
    text_fill = (F.col("text_cwd") != "") & (F.col("fu") <= F.col("stop"))
    filled = F.when(text_fill & (F.col("fill_at").isNull() | (F.col("fu") < F.col("fill_at"))), F.col("text_cwd")).otherwise(F.col("fill"))
    has_meta = F.coalesce(F.col("fs") <= F.col("stop"), F.lit(False))
    seen_id = F.when(has_meta, F.col("mid")).otherwise("")
    return firsts.join(values, "path", "left").select(
        "path", "storage", "size", first_known(F.col("fid"), seen_id).alias("id"), F.when(F.col("fid") != "", "filename").when(seen_id != "", "session_meta").otherwise("").alias("id_source"), seen_id.alias("metadata_id"),
        ((F.col("fid") != "") & (seen_id != "") & (F.col("fid") != seen_id)).alias("id_mismatch"), text(F.coalesce("over", filled)).alias("cwd"), text(F.coalesce("started", "modified")).alias("started_at"), text("source").alias("source"),
        text("model").alias("model"), F.when(F.col("fu") <= F.col("stop"), F.col("first_text")).otherwise("").alias("first_text"), has_meta.alias("has_meta"), F.coalesce("parsed_lines", F.lit(0)).alias("parsed_lines"),
        F.coalesce("invalid", F.lit(0)).alias("invalid_lines"),
    )


def with_titles(records: DataFrame, index: DataFrame, redacted: bool = True) -> DataFrame:
    """Adds title, title_source and index_updated. index has a row for each id, so the join adds none."""
    joined = records.join(index, "id", "left")  # no entry has an empty id
    named, spoken = derive_title(text("index_title"), TITLE_LENGTH), derive_title(F.col("first_text"), TITLE_LENGTH)
    raw = first_known(named, spoken)
    source = F.when(named != "", "session_index").when(spoken != "", "first_user_message").otherwise("")
    return joined.select(*records.columns, (redact(raw) if redacted else raw).alias("title"), source.alias("title_source"), text("index_updated").alias("index_updated"))


def unicode(x: Column | str) -> Column:
    """The order of the root collation."""
    return F.collate(F.col(x) if isinstance(x, str) else x, "UNICODE")


def dedup(records: DataFrame) -> DataFrame:
    """One record for each id (files without one stay): the first in path order, an active one before an archived one.

    first_path is where the session's key first stood, for stable orders. Aggregates, not a window: copies of one id may be
    as many as they like.
    """
    keyed = records.withColumn("key", first_known(F.col("id"), F.concat(F.lit("\0"), "path")))
    everything = F.struct(*records.columns)
    order = F.struct((F.col("storage") != "active").alias("a"), unicode("path").alias("p"), F.col("path").alias("q"))
    best = keyed.groupBy("key").agg(F.min_by(everything, order).alias("r"), F.min(F.struct(unicode("path").alias("p"), F.col("path").alias("q"))).alias("f"))
    return best.select("r.*", F.col("f.q").alias("first_path"))


def export_order() -> list[Column]:
    return [unicode("started_at"), unicode("first_path"), F.col("first_path")]


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Numbers from 1 in the order, without gathering the rows: each range of the order counts on its own.

    The sorted ranges are written, so that counts and numbers agree whatever becomes of an executor.
    """
    parts = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    parts = materialise(parts.withColumn("__m", F.monotonically_increasing_id()), "numbered")
    part, place = F.shiftright("__m", 33), F.col("__m").bitwiseAND((1 << 33) - 1)
    sizes = sorted((r.p, r.c) for r in parts.groupBy(part.alias("p")).agg(F.count("*").alias("c")).collect())  # one row for each range
    offsets, total = [], 0
    for p, c in sizes:
        offsets += [F.lit(p), F.lit(total)]
        total += c
    start = F.create_map(*offsets)[part] if offsets else F.lit(0)
    return parts.withColumn(name, (start + place + 1).cast("long")).drop("__m")


def session_stats(events: DataFrame) -> DataFrame:
    """path, latest, user_messages, assistant_messages, tool_events over whole files; latest is a binary string maximum."""
    spoken = (F.col("kind") == "message") & ~F.regexp_like(text("body"), F.lit(BLANK))
    return events.groupBy("path").agg(
        F.max("ts").alias("latest"), F.count_if(spoken & (F.col("role") == "user")).alias("user_messages"), F.count_if(spoken & (F.col("role") == "assistant")).alias("assistant_messages"),
        F.count_if(F.col("kind") == "tool").alias("tool_events"),
    )


BLANK = rf"\A{SPACE}*\z"


def with_stats(sessions: DataFrame, events: DataFrame) -> DataFrame:
    """Adds updated_at and the counts; a session without lines has none."""
    fallback = first_known(F.col("index_updated"), F.col("started_at"))
    joined = sessions.join(session_stats(events.join(sessions.select("path"), "path", "left_semi")), "path", "left")
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("user_messages", "assistant_messages", "tool_events")]
    return joined.select(*sessions.columns, F.greatest(text("latest"), fallback).alias("updated_at"), *counts)


def project_key(cwd: Column) -> Column:
    return first_known(cwd, F.lit("unknown"))


def project_order(sessions: DataFrame, seq: str = "seq") -> DataFrame:
    """project, project_no: projects numbered by the first of their sessions."""
    first = sessions.groupBy(project_key(F.col("cwd")).alias("project_key")).agg(F.min(seq).alias("first_seq"))
    return numbered(first, [F.col("first_seq")], "project_no").drop("first_seq")

