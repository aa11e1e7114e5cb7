"""Scalar functions on columns: names, paths, titles, redaction, escaping. All but the slug's normalisation are built in."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The white space of ECMAScript, and the patterns of token-shaped secrets in their order.
SPACE = r"[\t\n\x0B\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
SECRETS = [
    (r"sk-(?:proj-|svcacct-|admin-)?[A-Za-z0-9_-]{20,}", "sk-<REDACTED>"),
    (r"AIza[0-9A-Za-z_-]{25,}", "AIza<REDACTED>"),
    (r"gh[pousr]_[A-Za-z0-9_]{30,}", "gh<REDACTED>"),
    (r"AKIA[0-9A-Z]{16}", "AKIA<REDACTED>"),
    (r"xox[baprs]-[A-Za-z0-9-]{20,}", "xox<REDACTED>"),
    (r"npm_[A-Za-z0-9]{30,}", "npm_<REDACTED>"),
    (r"glpat-[A-Za-z0-9_-]{20,}", "glpat-<REDACTED>"),
    (r"sk_(live|test)_[A-Za-z0-9]{16,}", "sk_$1_<REDACTED>"),
    (rf"(?<![A-Za-z0-9_])(?i:bearer){SPACE}+[A-Za-z0-9._~+/-]{{20,}}", "Bearer <REDACTED>"),
    (r"(?<![A-Za-z0-9+/])(?:(?=[A-Za-z0-9]*[+/])[A-Za-z0-9+/]{48,}={0,2}|[A-Za-z0-9]{48,}={1,2})(?![A-Za-z0-9+/])", "<POSSIBLE_BASE64_SECRET_REDACTED>"),
]
TITLE_LENGTH = 120


def text(x: Column | str) -> Column:
    """Null as an empty string: every output field is a string."""
    return F.coalesce(F.col(x) if isinstance(x, str) else x, F.lit(""))


def known(x: Column) -> Column:
    """An empty string as null."""
    return F.nullif(x, F.lit(""))


def first_known(*xs: Column) -> Column:
    return F.coalesce(*map(known, xs), F.lit(""))


def trim_js(x: Column) -> Column:
    return F.regexp_replace(x, rf"^{SPACE}+|{SPACE}+\z", "")


def extract(x: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, '' without one."""
    return F.regexp_extract(x, pattern, group)


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def without_extension(name: Column) -> Column:
    """A file's name up to its last dot, unless that is the first character."""
    return F.regexp_replace(name, r"(?<=.)\.[^.]*\z", "")


def session_id_from_name(path: Column) -> Column:
    base = without_extension(base_name(path))
    uuid = r"(?i)([0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})\z"
    return first_known(extract(base, uuid), extract(base, r"(thr_[A-Za-z0-9_-]+)\z"))


def cwd_from_text(x: Column) -> Column:
    """The folder in a cwd tag, else behind the words for it; a tag counts even if it is blank."""
    tag = r"(?i)<cwd>([^<]+)</cwd>"
    line = rf"(?i)(?:current working directory|working directory|cwd){SPACE}*[:=]{SPACE}*([^\r\n]+)"
    return trim_js(F.when(F.regexp_like(text(x), F.lit(tag)), extract(text(x), tag)).otherwise(extract(text(x), line)))


def derive_title(x: Column, most: int = 96) -> Column:
    """First line that is neither a lone tag nor in brackets, else the first line; squeezed, and cut with an ellipsis."""
    lines = F.filter(F.transform(F.split(text(x), "\r?\n"), trim_js), lambda s: s != "")
    plain = F.filter(lines, lambda s: ~F.regexp_like(s, F.lit(r"^<[^>]+>\z")) & ~F.regexp_like(s, F.lit(r"^\[[^\n\r\u2028\u2029]*\]\z")))
    chosen = F.coalesce(F.try_element_at(plain, F.lit(1)), F.try_element_at(lines, F.lit(1)), F.lit(""))
    compact = F.regexp_replace(chosen, f"{SPACE}+", " ")
    cut = F.regexp_replace(F.substring(compact, 1, max(1, most - 1)), rf"{SPACE}+\z", "")
    return F.when(F.length(compact) <= most, compact).otherwise(F.concat(cut, F.lit("…")))


def posix_path(x: Column) -> Column:
    return F.translate(text(x), "\\", "/")


def _no_end_slash(x: Column) -> Column:
    return F.regexp_replace(posix_path(x), r"/+\z", "")


def normalize_path(x: Column) -> Column:
    return F.lower(_no_end_slash(x))


def portable_basename(x: Column) -> Column:
    return base_name(_no_end_slash(x))


def matches_project(cwd: Column, wanted: str) -> Column:
    """Equal, equal leaf, below or above a folder of the name, or the name within the leaf; literal, never a pattern."""
    if not wanted:
        return F.lit(True)
    f = normalize_path(F.lit(wanted))
    c, leaf = normalize_path(cwd), F.lower(portable_basename(cwd))
    hit = (c == f) | (leaf == f) | F.startswith(c, F.concat(f, F.lit("/"))) | F.contains(c, F.concat(F.lit("/"), f, F.lit("/"))) | F.contains(leaf, f)
    return (text(cwd) != "") & hit


@F.pandas_udf(StringType())
def _nfkd(x: pd.Series) -> pd.Series:
    return x.str.normalize("NFKD")


def slug(x: Column) -> Column:
    """A name for files, by way of Python for the compatibility decomposition. A plan sends every row there: see with_slug."""
    return _slug_of(_nfkd(text(x)))


def ascii_slug(x: Column) -> Column:
    """The same for texts known to be ASCII: no Python in the plan."""
    return _slug_of(text(x))


def with_slug(rows: DataFrame, name: str, x: Column) -> DataFrame:
    """Adds the slug of x as a column. Only rows whose text is beyond ASCII go to Python: a condition around a UDF would not
    hold the others back, two branches do. rows are read twice."""
    odd = F.regexp_like(text(x), F.lit(r"[^\x00-\x7f]"))
    return rows.where(~odd).withColumn(name, ascii_slug(x)).unionByName(rows.where(odd).withColumn(name, slug(x)))


def _slug_of(x: Column) -> Column:
    squeezed = F.regexp_replace(F.regexp_replace(x, r"[^A-Za-z0-9_.\-]+", "-"), "-+", "-")
    return F.coalesce(known(F.lower(F.regexp_replace(squeezed, r"^-|-\z", ""))), F.lit("unknown"))


def file_stamp(x: Column, now: Column) -> Column:
    """Session-local YYYYMMDD-HHMMSS; what is no time becomes `now`."""
    return F.date_format(F.coalesce(F.try_to_timestamp(x), now), "yyyyMMdd-HHmmss")


def markdown_fence(x: Column) -> Column:
    runs = F.transform(F.regexp_extract_all(text(x), F.lit("`+"), F.lit(0)), F.length)
    return F.repeat(F.lit("`"), F.greatest(F.lit(3), F.coalesce(F.array_max(runs), F.lit(0)) + 1))


def md_cell(x: Column) -> Column:
    x = text(x)
    for old, new in (("\\", "\\\\"), ("|", "\\|"), ("\r\n", " "), ("\r", " "), ("\n", " ")):
        x = F.replace(x, F.lit(old), F.lit(new))
    return x


def encode_uri(x: Column) -> Column:
    """Percent-encoding that leaves the characters of a whole URI as they are."""
    x = F.replace(F.url_encode(x), F.lit("+"), F.lit("%20"))
    for c in ";,/?:@&=+$!~'()#":
        x = F.replace(x, F.lit(f"%{ord(c):02X}"), F.lit(c))
    return x


def md_link(path: Column) -> Column:
    link = posix_path(path)
    return F.concat(F.lit("["), md_cell(base_name(link)), F.lit("]("), encode_uri(link), F.lit(")"))


def html_escape(x: Column) -> Column:
    x = text(x)
    for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        x = F.replace(x, F.lit(old), F.lit(new))
    return x


def html_link(path: Column, label: Column) -> Column:
    link = posix_path(path)
    shown = F.coalesce(known(label), base_name(link))
    return F.when(link == "", F.lit("")).otherwise(F.concat(F.lit('<a href="'), html_escape(encode_uri(link)), F.lit('">'), html_escape(shown), F.lit("</a>")))


def redact(x: Column) -> Column:
    """Ten replacements in order, each on what the one before has left."""
    for pattern, marker in SECRETS:
        x = F.regexp_replace(x, pattern, marker)
    return x


def search_blob(*fields: Column) -> Column:
    return F.lower(F.concat_ws(" ", *map(text, fields)))


def matches_terms(blob: Column, query: str) -> Column:
    """Whether every term of the query stands in the blob."""
    terms = F.filter(F.split(trim_js(F.lower(F.lit(query))), f"{SPACE}+"), lambda t: t != "")
    return F.forall(terms, lambda t: F.contains(blob, t))
