"""Events, the fold against a sequential one, duplicates, numbering, and the archive end to end."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from skein.cli import ArgumentError, Log, export, is_inside, main, parse_args
from skein.errors import HINTS, SkeinError, with_hints
from skein.operators import reports
from skein.operators.archive import readable_folders
from skein.operators.events import events, parsed
from skein.operators.sessions import dedup, numbered, session_fold
from skein.sources.logs import Roots


@pytest.mark.parametrize(
    "line, ok",
    [('{"a":1}', True), ('{"a":1} x', False), ('{"a":1}{"b":2}', False), ("5", True), ("null", True), ("[1]", True), ('"x"', True), ("{'a':1}", False), ('{"a":1,}', False), ('{"a":NaN}', False), ('{"a":01}', False), ('{"a":1,"a":2}', True), ("{", False), ("1,2", False), ('{"a":"\t"}', False)],
)
def test_json_is_strict(spark, line, ok):
    assert parsed(spark.createDataFrame([(line,)], "raw string")).first().ok is ok


def test_blank_lines_go(spark):
    assert parsed(spark.createDataFrame([("",), (" \t\u00a0",), ("1",)], "raw string")).count() == 1


def test_contents(spark):
    contents = ['"t"', '{"text":"o"}', '[{"type":"text","text":"a"},"b",{"input_text":"c"},{"text":"","output_text":"d"},{"x":1},5,{"text":7}]', "null", "7", "[]"]
    raw = [(f"/p{k}", "active", 1, f'{{"type":"response_item","payload":{{"type":"message","role":"user","content":{c}}}}}') for k, c in enumerate(contents)]
    got = events(spark.createDataFrame(raw, "path string, storage string, n long, raw string")).orderBy("path").collect()
    assert [r.body for r in got] == ["t", "o", "a\n\nb\n\nc\n\nd", None, None, None]


def sequential(name_id, lines):
    """The fold, line by line: an independent statement of its rules."""
    s = {"id": name_id, "cwd": "", "started_at": "", "model": "", "first_text": "", "has_meta": False, "invalid_lines": 0, "id_source": "filename" if name_id else "", "id_mismatch": False}
    for e in lines:
        if e is None:
            s["invalid_lines"] += 1
            continue
        kind, p = e["type"], e["payload"]
        if kind == "session_meta":
            start = p.get("timestamp") or e.get("timestamp") or ""
            if not s["has_meta"]:
                s["has_meta"], own = True, p.get("id") or ""
                if own and not s["id"]:
                    s["id"], s["id_source"] = own, "session_meta"
                elif own and own != s["id"]:
                    s["id_mismatch"] = True
                s["cwd"], s["started_at"] = p.get("cwd") or s["cwd"], start or s["started_at"]
            else:
                s["cwd"], s["started_at"] = s["cwd"] or p.get("cwd") or "", s["started_at"] or start
        elif kind == "turn_context":
            s["cwd"], s["model"] = p.get("cwd") or s["cwd"], p.get("model") or s["model"]
        elif kind == "event_msg":
            s["first_text"] = s["first_text"] or p.get("message") or p.get("text") or ""
        if not s["cwd"] and "<cwd>" in s["first_text"]:
            s["cwd"] = s["first_text"].split("<cwd>")[1].split("<")[0]
        if all(s[k] for k in ("id", "cwd", "started_at", "model", "first_text")):
            break
    s["started_at"] = s["started_at"] or "mtime"
    return s


def test_fold_is_the_sequential_one(spark):
    r = random.Random(7)
    maybe = lambda x: {} if r.random() < 0.45 else x
    rows, files, expect = [], [], {}
    for f in range(300):
        own = f"thr_{f}" if r.random() < 0.3 else ""
        path = f"/l/f{f}-{own}.jsonl" if own else f"/l/f{f}.jsonl"
        lines = []
        for n in range(r.randint(0, 9)):
            kind = r.choice(["session_meta", "turn_context", "event_msg", "bad", "other"])
            stamp = maybe({"timestamp": f"t{r.randint(0, 99):02d}"})
            payload = {
                "session_meta": lambda: maybe({"id": r.choice([f"m{n}", own])}) | maybe({"cwd": f"/c{n}"}) | maybe({"timestamp": f"p{n}"}), "turn_context": lambda: maybe({"cwd": f"/t{n}"}) | maybe({"model": f"g{n}"}),
                "event_msg": lambda: {"type": "user_message"} | maybe({r.choice(["message", "text"]): r.choice([f"hello {n}", f"<cwd>/x{n}</cwd>", ""])}), "other": lambda: {"x": 1}, "bad": lambda: {},
            }[kind]()
            lines.append(None if kind == "bad" else {"type": kind, **stamp, "payload": payload})
            rows.append((path, "active", n + 1, "{" if kind == "bad" else json.dumps(lines[-1])))
        files.append((path, "active", 1, "mtime"))
        expect[path] = sequential(own, lines)
    r.shuffle(rows)
    lines = spark.createDataFrame(rows, "path string, storage string, n long, raw string")
    got = {x.path: x.asDict() for x in session_fold(events(lines), spark.createDataFrame(files, "path string, storage string, size long, modified string")).collect()}
    assert got.keys() == expect.keys()
    for path, s in expect.items():
        assert {k: got[path][k] for k in s} == s, (path, s)


def test_duplicates(spark):
    rows = [("/b", "archived", "x"), ("/a", "archived", "x"), ("/c", "active", "x"), ("/B", "active", ""), ("/d", "active", "y"), ("/D", "active", "y"), ("/e", "archived", "z"), ("/f", "archived", "z")]
    got = dedup(spark.createDataFrame(rows, "path string, storage string, id string")).collect()
    assert sorted((r.id, r.path, r.first_path) for r in got) == [("", "/B", "/B"), ("x", "/c", "/a"), ("y", "/d", "/d"), ("z", "/e", "/e")]


def test_numbering(spark):
    rows = spark.range(25000).select(F.xxhash64("id").alias("x")).repartition(7)
    got = [r.x for r in numbered(rows, [F.col("x")], "n").orderBy("n").collect()]
    assert got == sorted(got)
    assert numbered(rows.where("1 = 0"), [F.col("x")], "n").count() == 0


def test_readable_folders():
    assert [f for _, f in readable_folders([("a", "x"), ("b", "x-2"), ("c", "x"), ("d", "x")])] == ["x", "x-2", "x-3", "x-4"]


WINDOWS, ODD = "C:\\work\\app|one", "/srv/o\r\ndd\np\rath"
UUID = "01234567-89ab-cdef-0123-456789abcdef"


def line(kind, at=None, **payload):
    return json.dumps({"type": kind, **({"timestamp": at} if at else {}), "payload": payload}, ensure_ascii=False)


def message(role, text, at=None):
    return line("response_item", at, type="message", role=role, content=[{"type": "text", "text": text}])


@pytest.fixture
def home(tmp_path):
    """Five sessions in the manner of a real tree, and files that are odd."""
    active, archived = tmp_path / "h/sessions/2024/05", tmp_path / "h/archived_sessions"
    active.mkdir(parents=True)
    archived.mkdir()
    secret = "gh" + "p_" + "A1" * 20
    (active / "one.jsonl").write_text("\n".join([
        line("session_meta", "2024-05-03T00:00:00Z", id="s-one", cwd=WINDOWS, timestamp="2024-05-03T00:00:00Z"), line("turn_context", cwd=WINDOWS, model="model-x"), message("user", f"Hello {secret}", "2024-05-03T00:00:01Z"), "not json",
        line("response_item", "2024-05-03T00:00:02Z", type="function_call", name="run", arguments="echo ```x```"), line("response_item", type="custom_tool_call_output", b=1, a=[2]), message("assistant", "Hi\nthere", "2024-05-03T00:00:09Z"), message("system", "no"), message("user", " "), "null",
    ]) + "\n")
    (active / "two.JSONL").write_text(line("session_meta", id="s-two", timestamp="2024-05-02T00:00:00Z") + "\r\n\r\n" + message("assistant", "Answer") + "\r\n")
    (archived / "three.jsonl").write_text("\n".join([line("session_meta", id="s-three", cwd=ODD, timestamp="2024-05-01T12:00:00Z"), message("user", "First line\nSecond line"), message("assistant", "x")]))
    (archived / "four.jsonl").write_text("\n".join([line("session_meta", id="s-four", cwd=WINDOWS, timestamp="2024-05-01T00:00:00Z"), message("user", "x"), message("assistant", "y")]))
    (archived / f"rollout-{UUID}.jsonl").write_text("\n".join([message("user", "q"), line("turn_context", cwd=WINDOWS, model="m"), message("assistant", "a")]))
    index = [{"id": "s-one", "thread_name": "Old"}, {"id": "s-one", "thread_name": "A | B \\ ü", "updated_at": "2024-05-03T00:00:05Z"}, {"id": "s-four", "thread_name": "Same"}, {"id": UUID, "thread_name": "Same"}, "junk"]
    (tmp_path / "h/session_index.jsonl").write_text("\n".join(map(json.dumps, index)) + "\n{bad\n")
    for name in ("four.jsonl", f"rollout-{UUID}.jsonl"):
        os.utime(archived / name, (1714600000, 1714600000))
    return tmp_path / "h"


@pytest.fixture
def log(spark, home):
    return Log(spark, Roots.resolve(str(home)))


def test_reports(log):
    projects = [tuple(r) for r in reports.project_list(log.sessions).collect()]
    assert sorted(projects) == sorted([("(unknown)", 1, 1, 0), (ODD, 1, 0, 1), (WINDOWS, 3, 1, 2)])
    told = {r.file: r.problems for r in reports.file_diagnostics(log.records).collect()}
    assert told == {"two.JSONL": "no stored cwd/project; no title or first user message", f"rollout-{UUID}.jsonl": "no session_meta record found"}
    assert {tuple(r) for r in reports.storage_diagnostics(log.records, log.sessions).collect()} == {("active", 2, 2), ("archived", 3, 3)}
    listed = reports.session_list(log.sessions.withColumn("seq", F.lit(1))).collect()
    assert {r.id for r in listed} == {"s-one", "s-two", "s-three", "s-four", UUID}


def test_export(log, tmp_path):
    out = tmp_path / "out"
    told = export(log, str(out), tools=True).orderBy("seq").collect()
    assert [r.session_id for r in told] == ["s-four", "s-three", UUID, "s-two", "s-one"]
    one = told[-1]
    assert (one.title, one.title_source, one.updated_at, one.model, one.user_messages, one.assistant_messages, one.tool_events) == ("A | B \\ ü", "session_index", "2024-05-03T00:00:09Z", "model-x", 1, 1, 2)
    assert told[1].title == "First line" and told[1].project == ODD and told[2].storage == "archived"
    assert one.markdown_file == "md/p001-app-one/s0005.md" and told[3].markdown_file == "md/p003-unknown/s0004.md"
    for r in told:
        assert (out / r.markdown_file).stat().st_size
        with open(r.source_jsonl, "rb") as a, open(out / r.raw_export_file, "rb") as b:
            assert a.read() == b.read()
    md = (out / one.markdown_file).read_text()
    assert "## User - 2024-05-03T00:00:01Z\n\nHello gh<REDACTED>\n" in md and "````text\necho ```x```\n````\n" in md and '{\n  "type": "custom_tool_call_output",\n  "b": 1,' in md and "- Model: model-x" in md
    saved = json.loads((out / "manifest.json").read_text())
    assert [s["session_id"] for s in saved["sessions"]] == [r.session_id for r in told] and saved["path_style"] == "short"
    index = (out / "index.md").read_text()
    assert "| app\\|one | A \\| B \\\\ ü | active |" in index and "|  | s-two | active |" in index
    page = (out / "index.html").read_text()
    assert 'type="search"' in page and "A | B \\ ü" in page and "archived" in page and "model-x" in page
    assert "Sessions exported: 5" in (out / "README.txt").read_text()


def test_command_line(spark, home, tmp_path, capsys):
    run = lambda *args: main(["--home", str(home), *args], spark)
    assert run("--list") == 0 and f"- {WINDOWS} (3: 1 active, 2 archived)" in capsys.readouterr().out
    assert run("--list-sessions") == 0 and UUID in capsys.readouterr().out
    assert run("--diagnose") == 0 and "no session_meta record found" in capsys.readouterr().out
    assert run("--project", "app|one", "--out", str(tmp_path / "r"), "--readable-paths", "--no-raw", "--no-archived") == 0
    assert (tmp_path / "r/markdown/app-one").is_dir() and not (tmp_path / "r/raw").exists()
    assert run("--project", "nothing", "--out", str(tmp_path / "n")) == 1 and HINTS["NO_PROJECT_MATCH"][0] in capsys.readouterr().err
    assert run() == 1 and main(["--home", str(tmp_path / "none"), "--list"], spark) == 1
    assert run("--all", "--out", os.path.join(os.path.dirname(os.path.dirname(__file__)), "x")) == 1
    assert main(["--all", "--project", "x"]) == 2 and main(["--nope"]) == 2 and main(["x"]) == 2 and main(["--out"]) == 2 and main(["--out", "--all"]) == 2
    assert main(["--version", "--all"]) == 0 and main(["-h"]) == 0


def test_arguments():
    assert parse_args(["--out", "a", "--out", "b", "-v"]) == {"out": "b", "version": True}
    with pytest.raises(ArgumentError):
        parse_args(["--out", ""])


def test_empty_and_hidden_files(spark, tmp_path):
    (tmp_path / "sessions").mkdir()
    (tmp_path / "sessions/empty.jsonl").write_text("")
    (tmp_path / "sessions/_hidden thr.jsonl").write_text(line("session_meta", id="h", cwd="/h") + "\r" + message("user", "hey"))
    (tmp_path / "sessions/with space%.jsonl").write_text(line("session_meta", id="s", cwd="/s"))
    (tmp_path / "sessions/link.jsonl").symlink_to(tmp_path / "sessions/empty.jsonl")
    log = Log(spark, Roots.resolve(str(tmp_path)))
    got = {r.path.rsplit("/", 1)[1]: (r.id, r.cwd, r.title) for r in log.sessions.collect()}
    assert got == {"empty.jsonl": ("", "", ""), "_hidden thr.jsonl": ("h", "/h", "hey"), "with space%.jsonl": ("s", "/s", "")}
    told = export(log, str(tmp_path / "out"))
    assert told.count() == 3


def test_containment():
    assert is_inside("/a", "/a") and is_inside("/a/b", "/a") and not is_inside("/ab", "/a") and not is_inside("/a/..x", "/a")


@pytest.mark.parametrize("code", HINTS)
def test_hints(code):
    assert HINTS[code][0] in with_hints(SkeinError(code, "message"))


def test_menu():
    from skein.menu import run as menu

    said = iter(["l", "x", "", "p", " ", "p", " app ", "/tmp/out ", "NO", "a", "", "y", "d", "q"])
    done = []
    assert menu(lambda _: next(said), lambda argv: done.append(argv) or len(done)) == 4
    assert done == [["--list"], ["--project", "app", "--out", "/tmp/out", "--no-raw"], ["--all"], ["--diagnose"]]
    for argv in done:
        parse_args(argv)

    def ended(_):
        raise EOFError

    assert menu(ended) == 0
