"""Every query of the library's own operators, and its SQL.

Ordered results carry their order as columns, numbers among them, since a result's rows have none.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import text as t
from skein.operators import archive, reports
from skein.operators.events import events, flatten_content, parsed
from skein.operators.sessions import dedup, export_order, numbered, project_order, session_fold, session_stats, with_stats, with_titles
from skein.plans import adapters as a
from skein.plans.adapters import read
from skein.storage import materialise

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


_LINE = "CASE WHEN event_id % 5 = 0 THEN concat(props, ' trailing') WHEN event_id % 7 = 0 THEN concat('{\"a\":', cast(event_id AS string)) WHEN event_id % 11 = 0 THEN cast(event_id AS string) ELSE props END"


@query(f"SELECT event_id, coalesce(json_valid({_LINE}), false) AS ok FROM events WHERE trim(coalesce({_LINE}, '')) <> ''")
def json_line_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsed(read(spark, sf_dir, "events").select("event_id", F.expr(_LINE).alias("raw"))).select("event_id", "ok")


_NAME = """concat('/logs/2024/', CASE WHEN conv_id % 3 = 0 THEN concat('rollout-2024-01-01-0199A0b0-1111-2222-3333-', lpad(cast(conv_id AS string), 12, '0'), '.jsonl')
    WHEN conv_id % 3 = 1 THEN concat('x-thr_a-', cast(conv_id AS string), '_z.JSONL') ELSE concat('note.', cast(conv_id AS string), '.jsonl') END)"""


@query(f"""
    WITH f AS (SELECT DISTINCT conv_id, {_NAME} AS path FROM conversations), b AS (SELECT *, regexp_replace(regexp_extract(path, '[^/]*$'), '\\.[^.]*$', '') AS base FROM f)
    SELECT path, CASE WHEN regexp_matches(base, '[0-9a-fA-F]{{8}}(-[0-9a-fA-F]{{4}}){{3}}-[0-9a-fA-F]{{12}}$') THEN right(base, 36) ELSE regexp_extract(base, 'thr_[A-Za-z0-9_-]+$') END AS id FROM b
""")
def session_id_from_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = read(spark, sf_dir, "conversations").select("conv_id").distinct().select(F.expr(_NAME).alias("path"))
    return paths.select("path", t.session_id_from_name(F.col("path")).alias("id"))


_ENVIRONMENT = """concat(text, CASE WHEN conv_id % 4 = 0 THEN concat(chr(10), '<CWD> /w/p', cast(turn AS string), ' </cwd>', chr(10), 'cwd: /no') WHEN conv_id % 4 = 1 THEN concat(chr(10), 'Working Directory = /d/', cast(turn AS string), '  ', chr(10), 'x')
    WHEN conv_id % 4 = 2 THEN '<cwd> </cwd>' ELSE '' END)"""


@query(f"""
    WITH c AS (SELECT conv_id, turn, {_ENVIRONMENT} AS x FROM conversations)
    SELECT conv_id, turn, CASE WHEN regexp_matches(x, '(?i)<cwd>[^<]+</cwd>') THEN trim(regexp_extract(x, '(?i)<cwd>([^<]+)</cwd>', 1))
        ELSE trim(regexp_extract(x, '(?i)(?:current working directory|working directory|cwd)\\s*[:=]\\s*([^\\r\\n]+)', 1)) END AS cwd FROM c
""")
def cwd_from_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", t.cwd_from_text(F.expr(_ENVIRONMENT)).alias("cwd"))


@query("SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text FROM conversations WHERE text <> '' GROUP BY conv_id")
def content_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.expr("CASE turn % 4 WHEN 0 THEN to_json(named_struct('type', 'text', 'text', text)) WHEN 1 THEN to_json(named_struct('text', '', 'input_text', text)) WHEN 2 THEN to_json(named_struct('output_text', text)) ELSE substr(to_json(array(text)), 2, length(to_json(array(text))) - 2) END")
    parts = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", kinds.alias("part")))).alias("p"))
    content = F.parse_json(F.concat(F.lit("["), F.array_join("p.part", ","), F.lit("]")))
    return parts.select("conv_id", flatten_content(content).alias("text"))


_TITLE_SQL = """
    list_filter(list_transform(string_split_regex({x}, '\\r?\\n'), lambda s: trim(s)), lambda s: s <> '')
"""


def _title(lines: str, most: int) -> str:
    """SQL of a title from a list of lines that are not empty."""
    chosen = f"coalesce(list_filter({lines}, lambda s: NOT regexp_full_match(s, '<[^>]+>') AND NOT regexp_full_match(s, '\\[.*\\]'))[1], ({lines})[1], '')"
    squeezed = f"regexp_replace({chosen}, '\\s+', ' ', 'g')"
    return f"CASE WHEN length({squeezed}) <= {most} THEN {squeezed} ELSE concat(rtrim(substr({squeezed}, 1, {most - 1})), '…') END"


_TAGGED = "concat(CASE WHEN turn % 3 = 0 THEN concat('<environment>', chr(10), '  [note]  ', chr(10)) ELSE '' END, text)"


@query(f"WITH c AS (SELECT conv_id, turn, {_TITLE_SQL.format(x=_TAGGED)} AS l FROM conversations) SELECT conv_id, turn, {_title('l', 96)} AS title FROM c")
def derive_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", t.derive_title(F.expr(_TAGGED)).alias("title"))


@query("SELECT page_id, lower(regexp_replace(replace(replace(url, '/', '\\'), '\\', '/') || '//', '/+$', '')) AS path FROM pages")
def normalize_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", t.normalize_path(F.concat(F.translate("url", "/", "\\"), F.lit("//"))).alias("path"))


@query("SELECT page_id, list_extract(string_split(regexp_replace(url, '/+$', ''), '/'), -1) AS name FROM pages")
def basename(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", t.portable_basename(F.translate("url", "/", "\\")).alias("name"))


_SLUG_SQL = "coalesce(nullif(lower(regexp_replace(regexp_replace(regexp_replace({x}, '[^A-Za-z0-9_.\\-]+', '-', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g')), ''), 'unknown')"


@query(f"SELECT p_partkey, {_SLUG_SQL.format(x='p_name')} AS name, {_SLUG_SQL.format(x="concat('--', p_type, ' #')")} AS kind, {_SLUG_SQL.format(x="'##'")} AS nothing FROM part")
def slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select("p_partkey", t.ascii_slug(F.col("p_name")).alias("name"), t.ascii_slug(F.concat(F.lit("--"), "p_type", F.lit(" #"))).alias("kind"), t.ascii_slug(F.lit("##")).alias("nothing"))


def _without_marks(x: str) -> str:
    """SQL that takes Latin letters with marks apart: a letter, and a hyphen for its marks, which slugs turn into one."""
    marked: dict[str, str] = {}
    for c in map(chr, range(0xC0, 0x250)):
        base, *marks = unicodedata.normalize("NFKD", c)
        if marks and base.isascii() and base.isalpha() and all(map(unicodedata.combining, marks)):
            marked[base] = marked.get(base, "") + c
    for base, letters in marked.items():
        x = f"regexp_replace({x}, '[{letters}]', '{base}-', 'g')"
    return x


@query(f"SELECT doc_id, {_SLUG_SQL.format(x=_without_marks("coalesce(text, '')"))} AS name FROM documents")
def slug_unicode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.with_slug(read(spark, sf_dir, "documents"), "name", F.col("text")).select("doc_id", "name")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN '20240102-030405' ELSE strftime(o_orderdate + to_seconds(o_orderkey % 86400), '%Y%m%d-%H%M%S') END AS stamp FROM orders")
def file_stamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.date_format(F.expr("o_orderdate + make_dt_interval(0, 0, 0, o_orderkey % 86400)"), "yyyy-MM-dd'T'HH:mm:ss")
    shown = F.when(F.col("o_orderkey") % 5 == 0, F.lit("no date")).otherwise(at)
    return read(spark, sf_dir, "orders").select("o_orderkey", t.file_stamp(shown, F.lit("2024-01-02 03:04:05").cast("timestamp")).alias("stamp"))


_TICKED = "concat(text, CASE WHEN doc_id % 4 = 0 THEN '' ELSE concat(' ', repeat('`', cast(doc_id % 9 AS int)), ' x `') END)"


@query(f"SELECT doc_id, repeat('`', greatest(3, 1 + coalesce(list_max(list_transform(regexp_extract_all({_TICKED}, '`+'), lambda s: length(s))), 0))) AS fence FROM documents")
def markdown_fence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", t.markdown_fence(F.expr(_TICKED)).alias("fence"))


CELL_SQL = "replace(replace(replace(replace(replace(coalesce({x}, ''), '\\', '\\\\'), '|', '\\|'), chr(13) || chr(10), ' '), chr(13), ' '), chr(10), ' ')"
HTML_SQL = "replace(replace(replace(replace(coalesce({x}, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"


@query(f"SELECT doc_id, sha256({CELL_SQL.format(x="text || chr(13) || chr(10) || '\\|'")}) AS cell FROM documents")
def md_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.sha2(t.md_cell(F.concat("text", F.lit("\r\n\\|"))), 256).alias("cell"))


@query(f"SELECT page_id, sha256({HTML_SQL.format(x='html')}) AS escaped FROM pages")
def html_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", F.sha2(t.html_escape(F.col("html")), 256).alias("escaped"))


# Tokens are put together here, so that no secret scanner trips over them; each between spaces.
_TOKEN = """concat(text, ' ', CASE conv_id % 11 WHEN 0 THEN concat('sk', '-', repeat('a1B_', 6)) WHEN 1 THEN concat('sk', '-proj-', repeat('x', 20)) WHEN 2 THEN concat('AI', 'za', repeat('Q-', 13)) WHEN 3 THEN concat('gh', 'p_', repeat('z9', 15))
    WHEN 4 THEN concat('AK', 'IA', repeat('7X', 8)) WHEN 5 THEN concat('xo', 'xb-', repeat('1', 20)) WHEN 6 THEN concat('np', 'm_', repeat('k', 30)) WHEN 7 THEN concat('gl', 'pat-', repeat('-', 20))
    WHEN 8 THEN concat('sk', '_live_', repeat('5', 16)) WHEN 9 THEN concat('bEARER   ', repeat('~', 20)) ELSE concat(repeat('Ab+/', 12), '==') END, ' end ', repeat('0f', 32))"""
_MARKERS = [
    ("sk-(proj-|svcacct-|admin-)?[A-Za-z0-9_-]{20,}", "sk-<REDACTED>"), ("AIza[0-9A-Za-z_-]{25,}", "AIza<REDACTED>"), ("gh[pousr]_[A-Za-z0-9_]{30,}", "gh<REDACTED>"), ("AKIA[0-9A-Z]{16}", "AKIA<REDACTED>"), ("xox[baprs]-[A-Za-z0-9-]{20,}", "xox<REDACTED>"),
    ("npm_[A-Za-z0-9]{30,}", "npm_<REDACTED>"), ("glpat-[A-Za-z0-9_-]{20,}", "glpat-<REDACTED>"), ("sk_(live|test)_[A-Za-z0-9]{16,}", "sk_\\1_<REDACTED>"), ("(?i) bearer\\s+[A-Za-z0-9._~+/-]{20,}", " Bearer <REDACTED>"),
    (" [A-Za-z0-9+/]{48,}={1,2} ", " <POSSIBLE_BASE64_SECRET_REDACTED> "),
]


def _redact_sql(x: str) -> str:
    for pattern, marker in _MARKERS:
        x = f"regexp_replace({x}, '{pattern}', '{marker}', 'g')"
    return x


@query(f"SELECT conv_id, turn, {_redact_sql(_TOKEN)} AS text FROM conversations")
def redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", t.redact(F.expr(_TOKEN)).alias("text"))


_WANTED = "en"


@query(f"""
    WITH p AS (SELECT page_id, lower(regexp_replace(url, '/+$', '')) AS c FROM pages), q AS (SELECT *, list_extract(string_split(c, '/'), -1) AS leaf FROM p)
    SELECT page_id FROM q WHERE c = '{_WANTED}' OR starts_with(c, '{_WANTED}/') OR contains(c, '/{_WANTED}/') OR contains(leaf, '{_WANTED}')
""")
def project_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").where(t.matches_project(F.col("url"), "EN/")).select("page_id")


# Sessions of the conversations, in the SQL of the checks.
SESSIONS = f"""
    WITH c AS (SELECT *, turn + 3 AS n FROM conversations),
    first_text AS (SELECT conv_id, arg_min(text, turn) AS x FROM c WHERE role = 'user' AND text <> '' GROUP BY conv_id),
    counts AS (SELECT conv_id, count(*) FILTER (WHERE role = 'user') AS user_messages, count(*) FILTER (WHERE role = 'assistant') AS assistant_messages, max(turn) AS last_turn FROM c GROUP BY conv_id),
    spoken AS (SELECT conv_id, {_TITLE_SQL.format(x="coalesce(x, '')")} AS l FROM counts LEFT JOIN first_text USING (conv_id)),
    s AS (
        SELECT conv_id, concat('conv-', conv_id) AS id, {a.PATH} AS path, {a.STORAGE} AS storage, coalesce({a.CWD}, '') AS cwd, coalesce({a.MODEL}, '') AS model, {a.STAMP.format(n='0')} AS started_at,
            CASE WHEN conv_id % 4 = 0 THEN {a.INDEX_TITLE} ELSE {_title('l', 120)} END AS title, user_messages, assistant_messages,
            greatest({a.STAMP.format(n='last_turn + 2')}, CASE WHEN conv_id % 4 = 0 THEN '2024-06-01T00:00:00Z' ELSE '' END) AS updated_at
        FROM counts JOIN spoken USING (conv_id)
    ),
    m AS (
        SELECT *, CASE WHEN conv_id % 4 = 0 THEN 'session_index' WHEN title <> '' THEN 'first_user_message' ELSE '' END AS title_source, row_number() OVER (ORDER BY started_at, path) AS seq FROM s
    ),
    p AS (SELECT *, dense_rank() OVER (ORDER BY first_seq) AS project_no FROM (SELECT *, min(seq) OVER (PARTITION BY cwd) AS first_seq FROM m))
"""


@query(SESSIONS + "SELECT id, title, title_source FROM m")
def title_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.conversation_sessions(spark, sf_dir).select("id", "title", "title_source")


@query(SESSIONS + "SELECT CASE WHEN cwd = '' THEN '(unknown)' ELSE cwd END AS project, count(*) AS total, count(*) FILTER (WHERE storage = 'active') AS active, count(*) FILTER (WHERE storage = 'archived') AS archived FROM m GROUP BY 1")
def project_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.project_list(a.untitled_sessions(spark, sf_dir))


@query(SESSIONS + "SELECT CASE WHEN cwd = '' THEN 'unknown' ELSE cwd END AS project, count(*) AS sessions, min(seq) AS first_seq FROM m GROUP BY 1")
def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.summary(numbered(a.untitled_sessions(spark, sf_dir), export_order(), "seq"))


@query(SESSIONS + "SELECT count(*) AS sessions, count(*) FILTER (WHERE storage = 'active') AS active, count(*) FILTER (WHERE storage = 'archived') AS archived FROM m")
def totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.totals(a.untitled_sessions(spark, sf_dir))


@query(SESSIONS + "SELECT id FROM m WHERE contains(lower(concat_ws(' ', regexp_extract(cwd, '[^/]*$'), title, storage, started_at, updated_at, model)), 'archived') AND contains(lower(concat_ws(' ', regexp_extract(cwd, '[^/]*$'), title, storage, started_at, updated_at, model)), 'p3')")
def search_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = a.conversation_events(spark, sf_dir)
    rows = with_stats(a.conversation_sessions(spark, sf_dir, said), said).withColumn("project_name", t.portable_basename(F.col("cwd")))
    return reports.search_sessions(reports.search_index(rows), " P3  ARCHIVED ").select("id")


@query(SESSIONS + "SELECT id, updated_at FROM m")
def latest_timestamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = a.conversation_events(spark, sf_dir)
    return with_stats(a.conversation_sessions(spark, sf_dir, said), said).select("id", "updated_at")


@query(f"""
    WITH c AS (SELECT {a.PATH} AS path, role, text FROM conversations)
    SELECT path, count(*) FILTER (WHERE role = 'user' AND trim(text) <> '') AS user_messages, count(*) FILTER (WHERE role = 'assistant' AND trim(text) <> '') AS assistant_messages, 0 AS tool_events FROM c GROUP BY path
    UNION ALL SELECT concat('u', cast(user_id AS string)), 0, count(*) FILTER (WHERE event_type = 'purchase' AND event_id % 13 <> 0 AND event_id % 7 <> 0), count(*) FILTER (WHERE event_type = 'error' AND event_id % 13 <> 0) FROM events GROUP BY 1
""")
def message_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["path", "user_messages", "assistant_messages", "tool_events"]
    spoken = session_stats(a.conversation_events(spark, sf_dir)).select(columns)
    return spoken.unionByName(session_stats(a.event_sessions(spark, sf_dir)[0]).select(F.regexp_replace("path", r"^/logs/|\.jsonl$", "").alias("path"), *columns[1:]))


@query(SESSIONS + "SELECT id, model FROM m")
def model_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.untitled_sessions(spark, sf_dir).select("id", "model")


FOLD = f"""
    WITH e AS ({a.EVENT_SQL}),
    u AS (SELECT *, kind = 'prompt' AND body IS NOT NULL AS said FROM e),
    f AS (
        SELECT path, min(storage) AS storage, min(n) FILTER (WHERE kind = 'meta') AS fs, min(n) FILTER (WHERE said) AS fu, min(n) FILTER (WHERE kind IN ('meta', 'turn') AND cwd IS NOT NULL) AS fc,
            min(n) FILTER (WHERE kind = 'meta' AND ts IS NOT NULL) AS ft, min(n) FILTER (WHERE kind = 'turn' AND model IS NOT NULL) AS fm FROM u GROUP BY path
    ),
    g AS (
        SELECT f.*, coalesce((SELECT meta_id FROM u WHERE u.path = f.path AND u.n = f.fs), '') AS mid, coalesce((SELECT body FROM u WHERE u.path = f.path AND u.n = f.fu), '') AS first_text FROM f
    ),
    h AS (SELECT *, regexp_extract(first_text, '<cwd>([^<]+)</cwd>', 1) AS text_cwd FROM g),
    k AS (SELECT *, least(fc, CASE WHEN text_cwd <> '' THEN fu END) AS c_at FROM h),
    z AS (SELECT *, CASE WHEN mid = '' OR c_at IS NULL OR ft IS NULL OR fu IS NULL OR fm IS NULL THEN 9223372036854775807 ELSE greatest(fs, c_at, ft, fu, fm) END AS stop FROM k),
    v AS (
        SELECT z.path, arg_max(cwd, n) FILTER (WHERE cwd IS NOT NULL AND (kind = 'turn' OR kind = 'meta' AND n = fs)) AS over_cwd, arg_min(cwd, n) FILTER (WHERE cwd IS NOT NULL AND kind = 'meta' AND n > fs) AS fill_cwd,
            min(n) FILTER (WHERE cwd IS NOT NULL AND kind = 'meta' AND n > fs) AS fill_at, arg_min(ts, n) FILTER (WHERE kind = 'meta' AND ts IS NOT NULL) AS started, arg_max(model, n) FILTER (WHERE kind = 'turn' AND model IS NOT NULL) AS model,
            count(*) FILTER (WHERE NOT ok) AS invalid_lines, max(n) AS parsed_lines FROM z JOIN u ON u.path = z.path AND u.n <= z.stop GROUP BY z.path
    ),
    r AS (
        SELECT path, storage, CASE WHEN fs <= stop THEN mid ELSE '' END AS id,
            coalesce(over_cwd, CASE WHEN text_cwd <> '' AND fu <= stop AND (fill_at IS NULL OR fu < fill_at) THEN text_cwd ELSE fill_cwd END, '') AS cwd,
            coalesce(started, 's') AS started_at, coalesce(model, '') AS model, CASE WHEN fu <= stop THEN first_text ELSE '' END AS first_text, coalesce(fs <= stop, false) AS has_meta, invalid_lines, parsed_lines
        FROM z JOIN v USING (path)
    )
"""


@query(FOLD + "SELECT * FROM r")
def session_fold_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = session_fold(*a.event_sessions(spark, sf_dir))
    return fold.select("path", "storage", "id", "cwd", "started_at", "model", "first_text", "has_meta", "invalid_lines", "parsed_lines")


def event_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_titles(session_fold(*a.event_sessions(spark, sf_dir)), a.empty_index(spark))


@query(FOLD + "SELECT storage, count(*) AS files, count(*) AS retained FROM r GROUP BY storage")
def diag_storage(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = event_records(spark, sf_dir)
    return reports.storage_diagnostics(records, dedup(records))


@query(FOLD + """, d AS (
        SELECT path, concat_ws('; ', CASE WHEN NOT has_meta THEN 'no session_meta record found' END, CASE WHEN id = '' THEN 'no session ID' END, CASE WHEN cwd = '' THEN 'no stored cwd/project' END,
            CASE WHEN first_text = '' THEN 'no title or first user message' END, CASE WHEN invalid_lines > 0 THEN concat(invalid_lines, ' invalid JSON line(s)') END) AS problems, storage, id, cwd FROM r)
    SELECT storage, regexp_extract(path, '[^/]*$') AS file, problems, id, CASE WHEN id <> '' THEN 'session_meta' ELSE '' END AS id_source, cwd, path FROM d WHERE problems <> ''
""")
def diag_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.file_diagnostics(event_records(spark, sf_dir))


_COPIES = "concat('key-', cast(conv_id % 40 AS string))"


@query(f"""
    WITH s AS (SELECT DISTINCT conv_id, {_COPIES} AS id, {a.PATH} AS path, {a.STORAGE} AS storage FROM conversations),
    r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY storage <> 'active', path) AS k, min(path) OVER (PARTITION BY id) AS first_path FROM s)
    SELECT id, path, storage, first_path FROM r WHERE k = 1
""")
def dedup_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = a.conversation_lines(spark, sf_dir, _COPIES)
    return dedup(session_fold(materialise(events(lines), "events"), a.conversation_files(spark, sf_dir))).select("id", "path", "storage", "first_path")


@query(SESSIONS + """SELECT storage, CASE WHEN title = '' THEN '(untitled)' ELSE title END AS title, CASE WHEN cwd = '' THEN '(unknown project)' ELSE cwd END AS project, started_at AS started, id, regexp_extract(path, '[^/]*$') AS file,
    row_number() OVER (ORDER BY cwd, started_at DESC, seq) AS place FROM m""")
def session_list_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = numbered(a.conversation_sessions(spark, sf_dir), export_order(), "seq")
    placed = numbered(rows, reports.session_list_order(F.col("seq")), "place")
    return reports.session_list(placed).join(placed.select("id", "place"), "id")


@query(SESSIONS + "SELECT id, row_number() OVER (ORDER BY updated_at DESC, seq) AS place FROM m")
def index_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = a.conversation_events(spark, sf_dir)
    rows = with_stats(numbered(a.conversation_sessions(spark, sf_dir, said), export_order(), "seq"), said)
    return numbered(rows, reports.index_order(F.col("seq")), "place").select("id", "place")


@query(SESSIONS + "SELECT id, printf('s%04d', seq) AS code FROM m")
def session_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = numbered(a.untitled_sessions(spark, sf_dir), export_order(), "seq")
    return rows.select("id", archive.session_code(F.col("seq")).alias("code"))


@query(SESSIONS + "SELECT DISTINCT CASE WHEN cwd = '' THEN 'unknown' ELSE cwd END AS project_key, project_no FROM p")
def project_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project_order(numbered(a.untitled_sessions(spark, sf_dir), export_order(), "seq"))


SESSION_OUT = "concat(printf('p%03d-', project_no), CASE WHEN cwd = '' THEN 'unknown' ELSE regexp_extract(cwd, '[^/]*$') END, printf('/s%04d', seq))"


@query(SESSIONS + f"SELECT id, concat('md/', {SESSION_OUT}, '.md') AS markdown_file, concat('raw/', {SESSION_OUT}, '.jsonl') AS raw_export_file FROM p")
def output_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.with_paths(a.untitled_sessions(spark, sf_dir)).select("id", "markdown_file", "raw_export_file")


@query(SESSIONS + f"""SELECT cwd AS project, regexp_extract(cwd, '[^/]*$') AS project_name, title, title_source, storage, id AS session_id, started_at, updated_at, model, user_messages, assistant_messages, 0 AS tool_events, path AS source_jsonl,
    regexp_extract(path, '[^/]*$') AS source_jsonl_name, concat('md/', {SESSION_OUT}, '.md') AS markdown_file, concat('raw/', {SESSION_OUT}, '.jsonl') AS raw_export_file, seq FROM p""")
def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = a.conversation_events(spark, sf_dir)
    rows = archive.with_paths(a.conversation_sessions(spark, sf_dir, said))
    return archive.manifest(with_stats(rows, said))


def transcript_sql(select: str) -> str:
    """SQL over w, the sessions with their transcripts; {out} in it is the path of a session's files without their folder and ending."""
    return SESSIONS + f""", blocks AS (
        SELECT conv_id, string_agg(concat('## ', CASE role WHEN 'user' THEN 'User' ELSE 'Assistant' END, ' - ', {a.STAMP.format(n='turn + 2')}, chr(10), chr(10), text, chr(10), chr(10)), '' ORDER BY turn) AS b
        FROM conversations WHERE role IN ('user', 'assistant') AND trim(text) <> '' GROUP BY conv_id),
    w AS (SELECT p.*, concat('# ', CASE WHEN title = '' THEN '{archive.UNTITLED}' ELSE title END, chr(10), chr(10), '- Project: ', cwd, chr(10), '- Storage: ', storage, chr(10), '- Session ID: ', id, chr(10),
        '- Started: ', started_at, chr(10), '- Updated: ', updated_at, chr(10), CASE WHEN model = '' THEN '' ELSE concat('- Model: ', model, chr(10)) END, '- Raw JSONL: raw/', {SESSION_OUT}, '.jsonl', chr(10), chr(10), '{archive.NOTE}', chr(10), '{archive.REDACTED_NOTE}', chr(10), chr(10),
        coalesce(b, '')) AS markdown FROM p LEFT JOIN blocks USING (conv_id))
    """ + select.replace("{out}", SESSION_OUT)


@query(transcript_sql("SELECT path, concat('md/', {out}, '.md') AS markdown_file, markdown FROM w"))
def transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = a.conversation_events(spark, sf_dir)
    rows = with_stats(archive.with_paths(a.conversation_sessions(spark, sf_dir, said)), said)
    return archive.transcripts(rows, said)


@query(f"""
    SELECT {a.PATH} AS path, {a.STORAGE} AS storage, count(*) + 2 AS lines FROM conversations WHERE conv_id % 3 = 0 GROUP BY conv_id
    UNION ALL SELECT {a.PATH}, {a.STORAGE}, count(*) + 2 FROM conversations WHERE conv_id % 3 <> 0 AND conv_id % 7 = 1 AND conv_id % 11 <> 0 GROUP BY conv_id
""")
def location_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both storages' lines: all archived ones, and those of active sessions of one project."""
    lines, sessions = a.conversation_lines(spark, sf_dir), a.untitled_sessions(spark, sf_dir)
    chosen = sessions.where((F.col("storage") == "archived") | t.matches_project(F.col("cwd"), "p1"))
    return lines.join(chosen.select("path"), "path", "left_semi").groupBy("path", "storage").agg(F.count("*").alias("lines"))
