"""Command line: list, diagnose or export the sessions below a home folder."""

from __future__ import annotations

import os
import sys
from datetime import datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.errors import SkeinError, with_hints
from skein.functions.text import matches_project
from skein.operators import archive, reports
from skein.operators.events import events
from skein.operators.sessions import dedup, export_order, numbered, session_fold, with_stats, with_titles
from skein.sources.logs import Roots, exists, list_files, read_lines, read_title_index
from skein.storage import materialise

VERSION = "0.1.0"
FLAGS = {"all", "include-tools", "no-raw", "no-redact-markdown", "no-archived", "list", "list-sessions", "diagnose", "help", "version", "readable-paths", "allow-output-in-tool-dir"}
VALUES = {"project", "out", "home", "sessions-dir", "archived-dir", "session-index"}
HELP = """python -m skein.cli [options]

  --all | --project NAME       export every session, or those of a project folder (name or path)
  --list | --list-sessions     projects with counts, or every session
  --diagnose                   files found and kept, and files that need attention
  --out DIR                    where the export goes
  --home DIR                   home of the logs (else SKEIN_HOME, else ~/.skein)
  --sessions-dir DIR           active logs (else HOME/sessions)
  --archived-dir DIR           archived logs (else HOME/archived_sessions)
  --session-index FILE         title index (else HOME/session_index.jsonl)
  --no-archived                leave archived logs out
  --include-tools              tool events in transcripts too
  --no-raw                     no copies of the logs
  --no-redact-markdown         secrets stay in transcripts and titles
  --readable-paths             long names for people instead of short ones
  --allow-output-in-tool-dir   let the export go below this program's folder
  --help, -h   --version, -v
"""


class ArgumentError(Exception):
    pass


def parse_args(argv: list[str]) -> dict[str, str | bool]:
    """Options by name; the last of a repeated one counts."""
    out: dict[str, str | bool] = {}
    rest = iter(argv)
    for arg in rest:
        name = {"-h": "help", "-v": "version"}.get(arg, arg[2:])
        if not arg.startswith("--") and arg not in ("-h", "-v"):
            raise ArgumentError(f"unexpected argument {arg}")
        if name in FLAGS:
            out[name] = True
        elif name in VALUES:
            value = next(rest, "")
            if not value or value.startswith("--"):
                raise ArgumentError(f"--{name} needs a value")
            out[name] = value
        else:
            raise ArgumentError(f"unknown option --{name}")
    if out.get("all") and out.get("project"):
        raise ArgumentError("--all and --project exclude each other")
    return out


def is_inside(path: str, root: str) -> bool:
    """Whether path is root or below it; a child whose name begins with two dots counts as outside."""
    way = os.path.relpath(os.path.abspath(path), os.path.abspath(root))
    return way == "." or not way.startswith("..")


class Log:
    """The DataFrames of a log tree: files, events, records of all files, sessions."""

    def __init__(self, spark: SparkSession, roots: Roots, redacted: bool = True):
        self.spark, self.roots = spark, roots
        self.files = list_files(spark, roots)
        self.events = materialise(events(read_lines(spark, roots, self.files)), "events")
        self.records = materialise(with_titles(session_fold(self.events, self.files), read_title_index(spark, roots.index), redacted), "records")
        self.sessions = dedup(self.records)


def export(log: Log, out: str, project: str = "", tools: bool = False, raw: bool = True, redacted: bool = True, readable: bool = False) -> DataFrame:
    """Write the archive; returns its manifest."""
    chosen = log.sessions.where(matches_project(F.col("cwd"), project))
    if chosen.isEmpty():
        raise SkeinError("NO_PROJECT_MATCH", f"There is no session of a project like {project}")
    # Every later step reads these rows; seq must be the same in all.
    rows = materialise(with_stats(archive.with_paths(chosen, readable, raw, F.lit(datetime.now())), log.events), "rows")
    archive.write_texts(archive.transcripts(rows, log.events, redacted, tools), out, "markdown_file", "markdown")
    if raw:
        archive.copy_raw(rows, out)
    told = archive.manifest(rows)
    r = log.roots
    envelope = {"home": r.home, "sessions_dir": r.sessions, "archived_sessions_dir": r.archived if r.with_archived else "", "session_index": r.index, "path_style": "readable" if readable else "short"}
    archive.write_indexes(told, out, envelope, reports.summary(rows))
    archive.verify(rows, out)
    return told


def main(argv: list[str], spark: SparkSession | None = None) -> int:
    try:
        args = parse_args(argv)
    except ArgumentError as e:
        print(f"Argument error: {e}\nSee --help.", file=sys.stderr)
        return 2
    if args.get("help") or args.get("version"):
        print(HELP if args.get("help") else VERSION)
        return 0
    try:
        _run(args, spark)
    except SkeinError as e:
        print(with_hints(e), file=sys.stderr)
        return 1
    return 0


def _run(args: dict, spark: SparkSession | None) -> None:
    reporting = any(args.get(k) for k in ("list", "list-sessions", "diagnose"))
    if not (reporting or args.get("all") or args.get("project")):
        raise SkeinError("NO_SELECTION", "Nothing is selected.")
    readable = bool(args.get("readable-paths"))
    tool = str(Path(__file__).resolve().parent.parent)
    base = str(Path.home() / "Documents") if is_inside(os.getcwd(), tool) else os.getcwd()
    out = str(args.get("out") or f"{base}/{'chat-archive' if readable else 'ca'}-{datetime.now():%Y%m%d-%H%M%S}")
    if not reporting and not args.get("allow-output-in-tool-dir") and "://" not in out and is_inside(out, tool):
        raise SkeinError("OUTPUT_IN_TOOL_DIR", f"An export may not go below the program itself: {out}")
    spark = spark or SparkSession.builder.appName("skein").getOrCreate()
    redacted = not args.get("no-redact-markdown")
    roots = Roots.resolve(args.get("home", ""), args.get("sessions-dir", ""), args.get("archived-dir", ""), args.get("session-index", ""), not args.get("no-archived"))
    log = Log(spark, roots, redacted)
    where = [f"Active sessions directory: {roots.sessions}", f"Archived sessions directory: {roots.archived if roots.with_archived else 'disabled'}"]
    if args.get("list") or args.get("list-sessions"):
        print("\n".join([*where, f"Sessions after duplicates: {log.sessions.count()}", ""]))
    if args.get("list"):
        print_projects(log)
    elif args.get("list-sessions"):
        for r in reports.session_list(numbered(log.sessions, export_order(), "seq")).toLocalIterator():
            print(f"- [{r.storage}] {r.title} | {r.project} | {r.started} | {r.id} | {r.file}")
    elif args.get("diagnose"):
        print(f"Home: {roots.home}\nSession index: {roots.index} ({'found' if exists(spark, roots.index) else 'missing'})\n" + "\n".join(where))
        for r in reports.storage_diagnostics(log.records, log.sessions).collect():  # two rows
            print(f"{r.storage.capitalize()}: {r.files} files found, {r.retained} sessions kept")
        for r in reports.file_diagnostics(log.records).orderBy("path").toLocalIterator():
            print(f"- [{r.storage}] {r.file}\n  {r.problems}\n  ID used: {r.id or '(none)'}{f' ({r.id_source})' if r.id_source else ''}\n  Project: {r.cwd or '(unknown)'}\n  File: {r.path}")
    else:
        try:
            told = export(log, out if "://" in out else os.path.abspath(out), str(args.get("project") or ""), bool(args.get("include-tools")), not args.get("no-raw"), redacted, readable)
        except SkeinError as e:
            if e.code == "NO_PROJECT_MATCH":
                print_projects(log)
            raise
        r = reports.totals(told).first()
        print(f"Export complete: {out}\nSessions: {r.sessions}\nActive: {r.active}\nArchived: {r.archived}\nOpen {out}/index.html to browse it; keep raw/ private.")


def print_projects(log: Log) -> None:
    for r in reports.project_list(log.sessions).toLocalIterator():
        print(f"- {r.project} ({r.total}: {r.active} active, {r.archived} archived)")


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
