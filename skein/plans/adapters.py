"""Log-shaped DataFrames out of ordinary tables, so that the real operators run over them."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators.events import events
from skein.operators.sessions import dedup, session_fold, with_titles
from skein.sources.files import file_system
from skein.storage import materialise

# What a conversation lacks is made up from its number; valid in Spark and in the SQL of the checks alike.
STORAGE = "CASE WHEN conv_id % 3 = 0 THEN 'archived' ELSE 'active' END"
PATH = f"concat('/logs/', {STORAGE}, '/chat-', cast(conv_id AS string), '.jsonl')"
CWD = "CASE WHEN conv_id % 11 = 0 THEN NULL ELSE concat('/home/demo/projects/p', cast(conv_id % 7 AS string)) END"
STAMP = "concat('2024-05-01T', lpad(cast(conv_id % 1000000 AS string), 6, '0'), ':', lpad(cast({n} AS string), 4, '0'), 'Z')"
MODEL = "CASE WHEN conv_id % 5 = 0 THEN NULL ELSE concat('model-', cast(conv_id % 4 AS string)) END"
#: One in four conversations has an entry in the title index.
INDEX_TITLE = "concat('Thread | ', cast(conv_id AS string))"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def conversation_lines(spark: SparkSession, sf_dir: str, identity: str = "concat('conv-', cast(conv_id AS string))") -> DataFrame:
    """path, storage, n, raw: a session_meta line, a turn_context line, then a line for each turn; the first two stand before turn 0."""
    stamp = lambda n: F.expr(STAMP.format(n=n))
    line = lambda kind, n, payload: F.to_json(F.struct(F.lit(kind).alias("type"), stamp(n).alias("timestamp"), payload.alias("payload")))
    meta = F.struct(F.expr(identity).alias("id"), F.expr(CWD).alias("cwd"), stamp(0).alias("timestamp"))
    turn = F.struct(F.expr(CWD).alias("cwd"), F.expr(MODEL).alias("model"))
    said = F.struct(F.lit("message").alias("type"), "role", F.array(F.struct(F.lit("text").alias("type"), "text")).alias("content"))
    at = lambda n, raw: F.struct(n.cast("long").alias("n"), raw.alias("raw"))
    own = at(F.col("turn") + 3, line("response_item", "turn + 2", said))
    heads = F.array(at(F.lit(1), line("session_meta", "0", meta)), at(F.lit(2), line("turn_context", "1", turn)), own)
    lines = F.explode(F.when(F.col("turn") == 0, heads).otherwise(F.array(own))).alias("line")
    return read(spark, sf_dir, "conversations").select(F.expr(PATH).alias("path"), F.expr(STORAGE).alias("storage"), lines).select("path", "storage", "line.*")


def conversation_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = read(spark, sf_dir, "conversations").where("turn = 0")
    return heads.select(F.expr(PATH).alias("path"), F.expr(STORAGE).alias("storage"), F.lit(1).cast("long").alias("size"), F.lit("2024-01-01T00:00:00.000Z").alias("modified"))


def conversation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = read(spark, sf_dir, "conversations").where("turn = 0 and conv_id % 4 = 0")
    return heads.selectExpr("concat('conv-', cast(conv_id AS string)) AS id", f"{INDEX_TITLE} AS index_title", "'2024-06-01T00:00:00Z' AS index_updated")


def conversation_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events, parsed once and written: folds, counts and transcripts read them from there."""
    return materialise(events(conversation_lines(spark, sf_dir)), "events")


def conversation_records(spark: SparkSession, sf_dir: str, said: DataFrame | None = None) -> DataFrame:
    return session_fold(conversation_events(spark, sf_dir) if said is None else said, conversation_files(spark, sf_dir))


def untitled_sessions(spark: SparkSession, sf_dir: str, said: DataFrame | None = None) -> DataFrame:
    """The sessions without titles and the texts they come from, which most reports have no use for."""
    return dedup(conversation_records(spark, sf_dir, said).drop("first_text"))


def conversation_sessions(spark: SparkSession, sf_dir: str, said: DataFrame | None = None) -> DataFrame:
    """The sessions; only those that dedup keeps get titles."""
    return with_titles(dedup(conversation_records(spark, sf_dir, said)), conversation_index(spark, sf_dir))


# An event table as the events of sessions, one for each user; in both dialects.
EVENT_SQL = """
    SELECT concat('/logs/u', cast(user_id AS string), '.jsonl') AS path, CASE WHEN user_id % 3 = 0 THEN 'archived' ELSE 'active' END AS storage,
        row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, event_id % 13 <> 0 AS ok,
        CASE WHEN event_id % 13 = 0 THEN NULL WHEN event_type = 'signup' THEN 'meta' WHEN event_type = 'click' THEN 'turn' WHEN event_type = 'view' THEN 'prompt'
            WHEN event_type = 'purchase' THEN 'message' ELSE 'tool' END AS kind,
        CASE WHEN event_id % 4 <> 0 THEN concat('t', lpad(cast(event_id AS string), 12, '0')) END AS ts,
        CASE WHEN event_id % 3 <> 0 AND event_type = 'signup' THEN concat('id-', cast(user_id AS string)) END AS meta_id,
        CASE WHEN event_type = 'signup' AND event_id % 2 = 0 OR event_type = 'click' AND event_id % 4 <> 0 THEN concat('/p', cast(event_id % 5 AS string)) END AS cwd,
        CASE WHEN event_type = 'click' AND event_id % 6 = 0 THEN concat('m', cast(event_id % 9 AS string)) END AS model,
        CASE WHEN event_type = 'purchase' THEN 'assistant' END AS role,
        CASE WHEN event_type = 'view' AND event_id % 5 = 0 THEN concat('see <cwd>/w', cast(event_id % 7 AS string), '</cwd>')
            WHEN event_type IN ('view', 'purchase') AND event_id % 7 <> 0 THEN concat('text ', cast(event_id AS string)) END AS body
    FROM events
"""


def event_sessions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Events and files."""
    rows = spark.sql(EVENT_SQL.replace("FROM events", "FROM {events}"), events=read(spark, sf_dir, "events"))
    missing = {c: F.lit(None).cast("string") for c in ("meta_ts", "source", "tool", "tool_name", "tool_text", "raw")}
    rows = rows.withColumns({"n": F.col("n").cast("long"), **missing})
    files = read(spark, sf_dir, "events").select("user_id").distinct().selectExpr("concat('/logs/u', cast(user_id AS string), '.jsonl') AS path", "CASE WHEN user_id % 3 = 0 THEN 'archived' ELSE 'active' END AS storage", "cast(1 AS bigint) AS size", "'s' AS modified")
    return rows, files


def empty_index(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "id string, index_title string, index_updated string")


def file_digests(paths: DataFrame) -> DataFrame:
    """path, sha of the bytes of each file, whatever its name."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for path in batch.column(0).to_pylist():
                system, where = file_system(path)
                with system.open_input_stream(where) as f:
                    found.append(hashlib.file_digest(f, "sha256").hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], ["path", "sha"])

    return paths.mapInArrow(digest, "path string, sha string")
