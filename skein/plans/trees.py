"""Queries over files: log trees written from the conversations, read back, folded, and exported as an archive."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.cli import Log, export
from skein.functions import text as t
from skein.operators import archive
from skein.operators.events import events
from skein.operators.sessions import dedup, export_order, numbered
from skein.plans import adapters as a
from skein.plans.adapters import read
from skein.plans.catalog import CELL_SQL, FOLD, HTML_SQL, SESSIONS, event_records, query, transcript_sql
from skein.sources.files import file_system
from skein.sources.logs import Roots, list_files, read_lines
from skein.storage import materialise, new_path

#: Where a conversation's log stands below the home: folders, hidden names and an extension in capitals among them.
PLACE = """concat(CASE WHEN conv_id % 3 = 0 THEN 'archived_sessions/' ELSE concat('sessions/d', cast(conv_id % 4 AS string), '/') END, CASE WHEN conv_id % 5 = 1 THEN '_' ELSE '' END,
    'chat-', cast(conv_id AS string), CASE WHEN conv_id % 7 = 2 THEN '.JSONL' ELSE '.jsonl' END)"""


def log_tree(spark: SparkSession, sf_dir: str) -> Roots:
    """Write the conversations as a tree of logs, with a title index and files that are no logs."""
    home = new_path(spark, "home")
    number = F.regexp_extract("path", r"chat-(\d+)\.", 1).cast("long").alias("conv_id")
    lines = a.conversation_lines(spark, sf_dir).select(number, "n", "raw")
    texts = lines.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("n", "raw"))).alias("lines")).select(F.expr(PLACE).alias("place"), F.concat(F.array_join("lines.raw", "\n"), F.lit("\n")).alias("text"))
    archive.write_texts(texts, home, "place", "text")
    entry = lambda title, at: F.to_json(F.struct("id", F.expr(title).alias("thread_name"), F.lit(at).alias("updated_at")))
    index = a.conversation_index(spark, sf_dir).select("id", entry("'stale'", "2020").alias("old"), entry("index_title", "2024-06-01T00:00:00Z").alias("new"))
    index = index.orderBy("id").agg(F.array_join(F.concat(F.collect_list("old"), F.collect_list("new")), "\n").alias("text"))  # one small file
    archive.write_texts(index.select(F.lit("session_index.jsonl").alias("place"), "text"), home, "place", "text")
    system, root = file_system(home)
    for name, data in (("sessions/notes.txt", b"no log"), ("archived_sessions/more/_empty.jsonl", b"")):
        system.create_dir(os.path.dirname(f"{root}/{name}"), recursive=True)
        with system.open_output_stream(f"{root}/{name}") as out:
            out.write(data)
    return Roots.resolve(home)


def _below(home: str):
    return F.substring(F.col("path"), len(home) + 2, 1 << 20)


@query(f"SELECT {PLACE} AS file, CASE WHEN conv_id % 3 = 0 THEN 'archived' ELSE 'active' END AS storage, false AS empty FROM (SELECT DISTINCT conv_id FROM conversations) UNION ALL SELECT 'archived_sessions/more/_empty.jsonl', 'archived', true")
def tree_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    roots = log_tree(spark, sf_dir)
    return list_files(spark, roots).select(_below(roots.home).alias("file"), "storage", (F.col("size") == 0).alias("empty"))


@query(f"SELECT {PLACE} AS file, CASE WHEN conv_id % 3 = 0 THEN 'archived' ELSE 'active' END AS storage, turn + 3 AS n, sha256(text) AS said FROM conversations")
def tree_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with what they say, numbered within their file; the first two of each say nothing."""
    roots = log_tree(spark, sf_dir)
    lines = read_lines(spark, roots, list_files(spark, roots))
    return events(lines).where("kind = 'message'").select(_below(roots.home).alias("file"), "storage", "n", F.sha2("body", 256).alias("said"))


@query(SESSIONS + f"SELECT {PLACE} AS file, id, title, title_source, storage, cwd, model, started_at, seq FROM m")
def tree_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole way from files to numbered sessions; the empty log, which has no id, is left out."""
    roots = log_tree(spark, sf_dir)
    rows = numbered(Log(spark, roots).sessions.where("id <> ''"), export_order(), "seq")
    return rows.select(_below(roots.home).alias("file"), "id", "title", "title_source", "storage", "cwd", "model", "started_at", "seq")


@query(transcript_sql("SELECT concat('md/', {out}, '.md') AS file, 'transcript' AS kind, sha256(markdown) AS found FROM w UNION ALL SELECT concat('raw/', {out}, '.jsonl'), 'copy', 'the same bytes' FROM w UNION ALL SELECT id, 'manifest', concat('md/', {out}, '.md') FROM w"))
def archive_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An archive written and verified, then read back: transcripts, raw copies against their logs, and the manifest's entries."""
    roots, out = log_tree(spark, sf_dir), new_path(spark, "archive")
    log = Log(spark, roots)
    log.sessions = log.sessions.where("id <> ''")
    rows = materialise(export(log, out).select("session_id", "source_jsonl", "raw_export_file"), "manifest")
    files = lambda folder: spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select(F.regexp_replace("path", "^file:(//)?", "").alias("path"), F.sha2("content", 256).alias("sha"))
    base = out.removeprefix("file://")
    here = lambda folder: files(f"{out}/{folder}").select(F.substring("path", len(base) + 2, 1 << 20).alias("file"), "sha")
    # Spark's sources leave out hidden names, which some of the logs have: those are read in Python.
    logs = a.file_digests(rows.select(F.col("source_jsonl").alias("path")))
    copies = rows.join(logs, F.col("source_jsonl") == F.col("path")).join(here("raw").withColumnRenamed("sha", "copied"), F.col("raw_export_file") == F.col("file"))
    system, root = file_system(out)
    with system.open_input_stream(f"{root}/manifest.json") as f:
        entries = [(s["session_id"], "manifest", s["markdown_file"]) for s in json.loads(f.read())["sessions"]]
    told = here("md").select("file", F.lit("transcript").alias("kind"), F.col("sha").alias("found"))
    same = copies.select("file", F.lit("copy").alias("kind"), F.when(F.col("sha") == F.col("copied"), "the same bytes").otherwise("other bytes").alias("found"))
    return told.unionByName(same).unionByName(spark.createDataFrame(entries, "file string, kind string, found string"))


_TOOL = "CASE event_id % 4 WHEN 0 THEN 'function_call' WHEN 1 THEN 'custom_tool_call' WHEN 2 THEN 'function_call_output' ELSE 'custom_tool_call_output' END"
_TICKS = "concat(event_type, ' ', repeat('`', cast(event_id % 6 AS int)), ' ', cast(user_id AS string))"


@query(f"""
    WITH e AS (SELECT event_id, {_TOOL} AS tool, CASE WHEN event_id % 5 = 0 THEN concat('{{', chr(10), '  "type": "', {_TOOL}, '",', chr(10), '  "name": "tool-', event_id % 7, '"', chr(10), '}}') ELSE {_TICKS} END AS shown FROM events WHERE event_id % 6 <> 5),
    f AS (SELECT *, repeat('`', greatest(3, 1 + coalesce(list_max(list_transform(regexp_extract_all(shown, '`+'), lambda s: length(s))), 0))) AS fence FROM e)
    SELECT event_id AS n, concat('## Tool ', tool, ' - tool-', event_id % 7, ' - t', event_id, chr(10), chr(10), fence, 'text', chr(10), shown, chr(10), fence, chr(10), chr(10)) AS block FROM f
""")
def tool_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markdown of tool events of all four types, with a text or by their whole payload; other events show nothing."""
    kind = F.when(F.expr("event_id % 6 = 5"), F.lit("reasoning")).otherwise(F.expr(_TOOL))
    shown = F.when(F.expr("event_id % 5 <> 0"), F.expr(_TICKS))
    key = lambda name, *which: F.when(F.expr(f"event_id % 4 IN ({', '.join(map(str, which))})"), shown).alias(name)
    payload = F.struct(kind.alias("type"), F.expr("concat('tool-', cast(event_id % 7 AS string))").alias("name"), key("arguments", 0), key("input", 1), key("output", 2, 3))
    raw = F.to_json(F.struct(F.lit("response_item").alias("type"), F.expr("concat('t', cast(event_id AS string))").alias("timestamp"), payload.alias("payload")))
    lines = read(spark, sf_dir, "events").select(F.lit("/x").alias("path"), F.lit("active").alias("storage"), F.col("event_id").alias("n"), raw.alias("raw"))
    return archive.blocks(events(lines), tools=True).select("n", "block")


_TARGET = "concat('md\\', CASE WHEN page_id % 3 = 0 THEN 'a b|c (d)' WHEN page_id % 3 = 1 THEN 'é&\"<x>' ELSE 'x#[y]*' END, '/', cast(page_id AS string), ' %.md')"


def _encoded(x: str) -> str:
    """SQL of the percent-encoding that leaves a URI's own characters."""
    x = f"url_encode({x})"
    for c in ";,/?:@&=+$!*~()#":
        x = f"replace({x}, '%{ord(c):02X}', '{c}')"
    return f"replace({x}, '%27', '''')"


@query(f"""
    WITH p AS (SELECT page_id, replace({_TARGET}, '\\', '/') AS link FROM pages), q AS (SELECT *, regexp_extract(link, '[^/]*$') AS name, {_encoded('link')} AS uri FROM p)
    SELECT page_id, concat('[', {CELL_SQL.format(x='name')}, '](', uri, ')') AS markdown, concat('<a href="', {HTML_SQL.format(x='uri')}, '">', {HTML_SQL.format(x="CASE WHEN page_id % 2 = 0 THEN 'a <label>' ELSE name END")}, '</a>') AS html, '' AS nothing FROM q
""")
def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.expr(_TARGET.replace("\\", "\\\\"))
    label = F.when(F.col("page_id") % 2 == 0, "a <label>").otherwise("")
    return read(spark, sf_dir, "pages").select("page_id", t.md_link(at).alias("markdown"), t.html_link(at, label).alias("html"), t.html_link(F.lit(""), F.lit("x")).alias("nothing"))


_SAME = "CASE WHEN cwd = '' THEN '' WHEN cwd LIKE '%3' THEN '/srv/Same Name-2' ELSE concat(cwd, '/Same Name') END"


@query(SESSIONS + f""", s2 AS (SELECT *, {_SAME} AS folder_of, CASE WHEN cwd = '' THEN 'unknown' WHEN cwd LIKE '%3' THEN 'same-name-2' ELSE 'same-name' END AS slug FROM m),
    f AS (SELECT folder_of, slug, min(seq) AS first_seq FROM s2 GROUP BY 1, 2), g AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY first_seq) AS k FROM f),
    taken AS (SELECT min(first_seq) AS own FROM g WHERE slug = 'same-name-2'),
    h AS (SELECT *, CASE WHEN slug = 'unknown' THEN slug WHEN slug = 'same-name-2' THEN CASE WHEN (SELECT count(*) FROM g z WHERE z.slug = 'same-name' AND z.first_seq < g.first_seq) >= 2 THEN 'same-name-2-2' ELSE slug END
        WHEN k = 1 THEN slug ELSE concat(slug, '-', k + CASE WHEN (SELECT count(*) FROM g z WHERE z.slug = 'same-name' AND z.first_seq < (SELECT own FROM taken)) >= 2 THEN 0 ELSE 1 END) END AS folder FROM g)
    SELECT id, concat('markdown/', folder, '/20240102-030405-', id, printf('-s%04d', seq), '.md') AS markdown_file, concat('raw/', folder, '/', regexp_extract(path, '[^/]*$')) AS raw_export_file FROM s2 JOIN h USING (folder_of)""")
def readable_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long names: folders of one name are told apart, and a name that looks like such a number is itself in use."""
    rows = a.untitled_sessions(spark, sf_dir).withColumn("title", F.lit("")).withColumn("cwd", F.expr(_SAME))
    return archive.with_paths(rows, readable=True, now=F.lit("2024-01-02 03:04:05").cast("timestamp")).select("id", "markdown_file", "raw_export_file")


@query(FOLD + """, y AS (SELECT *, CASE WHEN id = '' THEN concat('no id ', path) ELSE id END AS key FROM r), o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY storage <> 'active', path) AS place, min(path) OVER (PARTITION BY key) AS first_path FROM y)
    SELECT path, id, first_path FROM o WHERE place = 1""")
def dedup_without_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files without an id are sessions of their own."""
    return dedup(event_records(spark, sf_dir)).select("path", "id", "first_path")
