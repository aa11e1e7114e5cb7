"""Archives and main texts of pages."""

import base64
import hashlib
import itertools
import random

import pytest

from skein.llm.html_extract import START, described, extract_pages, fit, main_text, minimum_cut, train
from skein.storage import new_path
from skein.llm.warc import FIELDS, LoserTree, RunReader, archive_round_trip, members, parse_record, read_archives, url_key, write_archives, write_run


def pages_of(spark):
    rows = [(1, "http://b.example/x", "<p>one</p>"), (2, "https://www.A.example:443/Y?q=1#f", "<p>one</p>"), (3, None, None), (4, "http://a.example/y?q=1", ""), (5, "bad url\n[", "<p>" + "long " * 50000 + "</p>"), (6, "http://b.example/x", "<p>two</p>"), (None, "http://c.example", "é"), (8, "http://c.example", "<p>one</p>")]
    return spark.createDataFrame([(*r, "k", 9, "d") for r in rows], "page_id long, url string, html string, id string, n int, digest string"), rows


def test_archives_round_trip(spark):
    pages, rows = pages_of(spark)
    got = archive_round_trip(pages.repartition(3)).collect()
    best = {}
    for i, _, h in rows:
        best[h or ""] = max(best.get(h or "", -1), -1 if i is None else i)
    for r in got:
        h = next(h or "" for i, _, h in rows if i == r.id)
        keeps = best[h] in (r.id, -1)
        assert (r.n, r.digest, r.kind, r.refers) == (len(h.encode()), base64.b32encode(hashlib.sha1(h.encode()).digest()).decode(), "response" if keeps else "revisit", None if keeps else best[h])
    assert len(got) == len(rows)
    assert sorted(r.position for r in got) == list(range(len(rows)))
    order = [(r.key, r.time, -1 if r.id is None else r.id) for r in sorted(got, key=lambda r: r.position)]
    assert order == sorted(order)
    assert archive_round_trip(pages.where("1 = 0")).count() == 0
    kinds = {r.id: r.kind for r in archive_round_trip(pages, least=6).collect()}
    assert kinds[3] == kinds[4] == "response" and kinds[1] == "revisit"


def test_merging_in_passes(spark):
    from skein.llm.warc import merge_runs

    pages, rows = pages_of(spark)
    folder = new_path(spark, "warc-test")
    runs = read_archives(write_archives(pages, f"{folder}/a", archive_bytes=1), f"{folder}/r")
    assert runs.count() > 2
    got = merge_runs(spark, runs, f"{folder}/r", fan_in=2).collect()
    assert sorted(r.id or 0 for r in got) == sorted(r[0] or 0 for r in rows)
    order = [(r.key, r.time) for r in sorted(got, key=lambda r: r.position)]
    assert order == sorted(order) and sorted(r.position for r in got) == list(range(len(rows)))


def test_one_url_is_cut_into_ranges_and_copies_count_by_what_is_written(spark, monkeypatch):
    from skein.llm import warc

    monkeypatch.setattr(warc, "ARCHIVE_CAPTURES", 50)
    rows = [(k if k % 7 else None, "http://a.example/x" if k % 3 else None, "same" if k % 2 else None) for k in range(600)] + [(1, "http://a.example/x", "same")] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    folder = new_path(spark, "warc-test")
    archives = write_archives(pages, f"{folder}/a")
    assert archives.count() >= 12
    runs = read_archives(archives, f"{folder}/r")
    assert runs.agg({"n": "max"}).first()[0] <= 50
    got = warc.merge_runs(spark, runs, f"{folder}/r").collect()
    assert [r.position for r in sorted(got, key=lambda r: r.position)] == list(range(602))
    order = [(r.key, r.time, -1 if r.id is None else r.id) for r in sorted(got, key=lambda r: r.position)]
    assert order == sorted(order) and len({r["range"] for r in got if r.key == "example,a)/x"}) > 1
    best = {t or "": max((i for i, _, x in rows if (x or "") == (t or "") and i is not None)) for _, _, t in rows}
    for r in got:
        assert (r.kind == "response") == (r.id in best.values()), r


def test_archive_is_a_valid_file(spark, tmp_path):
    pages, _ = pages_of(spark)
    path = write_archives(pages.where("page_id = 1").coalesce(1), f"file://{tmp_path}").first().path
    with open(path.removeprefix("file://"), "rb") as f:
        (_, info), (at, data) = members(f)
        f.seek(at)
        assert next(members(f))[1] == data
    assert parse_record(info)[0]["warc-type"] == "warcinfo"
    fields, body = parse_record(data)
    assert fields["warc-target-uri"] == "http://b.example/x" and body.endswith(b"\r\n\r\n<p>one</p>")


def test_url_keys():
    assert url_key("https://www.A.example:443/Y?q=1#f") == "example,a)/y?q=1" == url_key("http://a.example/y?q=1")
    assert url_key("http://a.example:8080") == "example,a:8080)/"


def test_loser_tree():
    r = random.Random(1)
    for k in range(9):
        runs = [sorted(r.choices(range(30), k=r.randint(0, 12))) for _ in range(k)]
        assert list(LoserTree([iter(x) for x in runs], lambda x: x)) == sorted(itertools.chain(*runs))


def test_run_reader(tmp_path):
    captures = [dict.fromkeys(FIELDS) | {"key": f"k{i // 3:05d}", "time": "t", "id": i, "offset": i} for i in range(2000)]
    write_run(f"file://{tmp_path}/run", iter(captures))
    reader = RunReader(f"file://{tmp_path}/run")
    at = lambda key, id_=-1: (key, "t", id_)
    for low, high in ((None, None), (at("k00100"), at("k00300")), (at("k00085"), None), (at("a"), at("k00001", 4)), (at("k00001", 4), at("k00003", 10)), (at("z"), None)):
        assert [c["offset"] for c in reader.between(low, high)] == [c["offset"] for c in captures if (low is None or (c["key"], "t", c["id"]) >= low) and (high is None or (c["key"], "t", c["id"]) < high)]


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>no";</script></head><body>
<header><a href=/>Home</a></header><nav><ul><li><a href=a>Menu one</a><li><a href=b>Menu two</a></ul></nav>
<div class="cookie-notice">We use cookies to make this site work. Please accept them all.</div>
<main><article><h1>A &amp; B</h1><p>First   paragraph with <b>bold</b>
words&hellip; and <a href=x>a link</a> in it.<p>Second paragraph ends here.<div class="ad">Buy now, it is cheap and it is good for you.</div><blockquote>A quoted line of the article.</blockquote>
<ul><li>Point one of the list.<li>Point two of it.</ul><form><p>Your name <input></p><button>Send</button></form></article></main>
<aside><p>Related stories that you may like, told at some length here.</p></aside>
<section id="comments"><h2>Comments</h2><p>I liked this very much, thank you for writing it down.</p></section><!-- x <p>no</p> -->
<footer><p>&copy; Someone. All rights reserved by the owner of this page.</p></footer></body></html>"""


def test_main_text():
    assert main_text(PAGE) == "A & B\n\nFirst paragraph with bold words… and a link in it.\n\nSecond paragraph ends here.\n\nA quoted line of the article.\n\nPoint one of the list.\n\nPoint two of it."


@pytest.mark.parametrize("html", [None, "", "   ", "<", "<p", "<script>x", "<!--", "<nav><a href=a>only a menu</a></nav>"])
def test_pages_without_main_text(html):
    assert main_text(html) in ("", "<")


def test_extract_pages(spark):
    pages, rows = pages_of(spark)
    got = {r.page_id: (r.url, r.text, r.n_chars) for r in extract_pages(pages).collect()}
    assert got[3] == (None, "", 0) and got[4][1] == "" and got[5][2] == len(("long " * 50000).strip())
    assert extract_pages(pages.where("1 = 0")).count() == 0


def test_minimum_cut_is_the_least_of_all_labellings():
    r = random.Random(5)
    for _ in range(200):
        n = r.randint(1, 8)
        gains = [r.choice([-3.0, -1.0, -0.5, 0.0, 0.5, 1.0, 2.5]) for _ in range(n)]
        edges = [(i, j, r.choice([0.25, 0.5, 1.5])) for i in range(n) for j in range(i + 1, n) if r.random() < 0.5]
        cost = lambda x: sum(-g if y and g < 0 else g if not y and g > 0 else 0 for g, y in zip(gains, x)) + sum(w for a, b, w in edges if x[a] != x[b])  # noqa: E731,B023
        assert cost(minimum_cut(gains, edges)) == pytest.approx(min(map(cost, itertools.product([False, True], repeat=n))))


def blocks_by_hand(html):
    """The main text of the tables' pages, whose only article says all: the text of its heading and paragraphs."""
    import html as entities
    import re

    inside = re.search(r"<article>(.*?)</article>", html or "", re.S)
    parts = re.split(r"</?(?:p|h\d|ul|ol|li|div|blockquote|table|tr|td|th|pre|section)\b[^>]*>", inside[1]) if inside else []
    texts = [re.sub(r"\s+", " ", entities.unescape(re.sub(r"<[^>]+>", "", re.sub(r"<br\s*/?>", " ", re.sub(r"<!--.*?-->|<(script|style)\b.*?</\1>", "", p, flags=re.S))))).strip() for p in parts]
    return "\n\n".join(t for t in texts if t)


def test_pages_of_the_tables_against_a_plain_version(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    html = {r.page_id: r.html for r in rows.collect()}
    got = {r.page_id: r.text for r in extract_pages(rows).collect()}
    assert got.keys() == html.keys()
    for i, text in got.items():
        assert text == blocks_by_hand(html[i]), i


PARAGRAPHS = "<p>A first paragraph that is part of it.</p><p>A second paragraph, which is longer than that.</p>"
ALL = "A first paragraph that is part of it.\n\nA second paragraph, which is longer than that."


@pytest.mark.parametrize(
    ("html", "expect"),
    [
        ("<p title=it's>A first paragraph that is part of it.</p><p>A second paragraph, which is longer than that.</p>", ALL),
        ('<p title="x>A first paragraph that is part of it.</p><p>A second paragraph, which is longer than that.</p>', ALL),
        ('<p class=a"" id=\'b\'c>A first paragraph that is part of it.</p><p =x>A second paragraph, which is longer than that.</p>', ALL),
        (f'<div class="elementor-widget-container">{PARAGRAPHS}</div>', ALL),
        (f'<div class="text-widget">{PARAGRAPHS}</div>', ALL),
        (f'<div class="widget-text"><article>{PARAGRAPHS}</article></div>', ALL),
        (f'<article><h1 class="page-header">Heading</h1>{PARAGRAPHS}</article>', "Heading\n\n" + ALL),
        (f'<article>{PARAGRAPHS}<ul><li><a href=a>One link</a><li><a href=b>Another</a></ul></article>', ALL + "\n\nOne link\n\nAnother"),
        (f'<div class="layout has-sidebar"><div id=sidebar><p>Some words beside it all.</p></div><main>{PARAGRAPHS}</main></div>', ALL),
        (f'<form action=/><nav><a href=/>Home</a></nav><article>{PARAGRAPHS}</article></form>', ALL),
        (f'<article>{PARAGRAPHS}<form><p>Please write to us, we would like to hear it.</p></form></article>', ALL),
        (f'<article>{PARAGRAPHS}</article><div class="comments"><article class=comment><p>I have liked this very much, thank you for all of it.</p></article></div>', ALL),
        (f'<div class=content>{PARAGRAPHS}</div><div id="comment-list"><article><p>I have liked this very much, thank you for all of it.</p></article></div>', ALL),
        (f'<div class="header"><h1>The site</h1></div><article>{PARAGRAPHS}</article>', ALL),
        (f'<article>{PARAGRAPHS}<button>Send <b>it</b></button><svg><text>no</text></svg></article>', ALL),
    ],
)
def test_main_text_of_odd_pages(html, expect):
    assert main_text(html) == expect


def test_deep_and_long_pages_take_time_in_proportion():
    import time

    began = time.time()
    assert main_text("<div>" * 5000 + PARAGRAPHS + "</div>" * 5000) == ALL
    assert main_text("<article>" + PARAGRAPHS * 5000 + "</article>") == "\n\n".join([ALL] * 5000)
    assert main_text("<article>" + "<p>unclosed <b>words" * 3000 + "</article>").count("unclosed") == 3000
    assert time.time() - began < 5


def test_equal_pages_in_several_rows_are_each_extracted(spark):
    rows = [(1, None, PARAGRAPHS), (1, "u", PARAGRAPHS), (None, "u", PARAGRAPHS), (None, None, None)]
    table = spark.createDataFrame([(*r, "t", 3) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    got = sorted(((r.page_id, r.url, r.text) for r in extract_pages(table).collect()), key=str)
    assert got == sorted(((i, u, ALL if h else "") for i, u, h in rows), key=str)


def page(r, landmarks):
    """A page of the kind that weights are learned from, and its main text; or one whose elements say nothing of themselves."""
    word = lambda: "".join(r.choice("aeioubcdfgl") for _ in range(r.randint(1, 9)))
    words = lambda a, b: " ".join(word() for _ in range(r.randint(a, b)))
    menu = "".join(f"<li><a href=x>{words(1, 3)}</a></li>" for _ in range(r.randint(4, 9)))
    paragraphs = [f"{words(8, 60)}." for _ in range(r.randint(3, 7))]
    inside = "".join(f"<p>{p}</p>" for p in paragraphs)
    foot = f"{words(2, 5)} <a href=y>{words(1, 2)}</a>"
    nav, article, footer = ("nav", "article", "footer") if landmarks else ("div", "div", "div")
    return f"<body><{nav}><ul>{menu}</ul></{nav}><{article}>{inside}</{article}><{footer}>{foot}</{footer}></body>", "\n\n".join(paragraphs)


def test_weights_learned_in_landmarks_hold_where_there_are_none(spark):
    r = random.Random(4)
    learned = [page(r, True) for _ in range(60)]
    weights = fit(h for h, _ in learned)
    assert weights != START and weights == fit(h for h, _ in learned)
    assert all(main_text(h, weights) == t for h, t in learned)
    others = [page(r, False) for _ in range(100)]
    right, before = (sum(main_text(h, w) == t for h, t in others) for w in (weights, START))
    assert right >= 99 and right > before, (right, before)
    table = spark.createDataFrame([(k, "u", h, 1) for k, (h, _) in enumerate(learned)] + [(None, None, None, 0)], "page_id long, url string, html string, n int").repartition(3)
    assert train(table) == pytest.approx(fit(sorted({h for h, _ in learned} | {""})))
    assert train(table.where("1 = 0")) == START == fit(["<p>no landmarks here.</p>", ""])


def test_what_blocks_are_like():
    got = [like for _, like, _ in described("<h2>One two</h2><p>A sentence.</p><ul><li><a href=x>link</a> is</ul><article><p><a href=x>abc</a></p></article>")]
    assert got == [(1.0, 0.2, 0.0, 0.0, 0.0, 1.0, 0.0), (1.0, 0.2, 1.0, 0.0, 0.0, 0.0, 0.0), (1.0, 0.2, 0.0, pytest.approx(4 / 7), 0.0, 0.0, 1.0), (1.0, 0.1, 0.0, 0.0, 1.0, 0.0, 0.0)]


def test_the_sample_is_the_pages_of_smallest_hash(spark, monkeypatch):
    from pyspark.sql import functions as F

    from skein.llm import html_extract

    monkeypatch.setattr(html_extract, "PAGES", 10)
    r = random.Random(6)
    table = spark.createDataFrame([(k, page(r, True)[0]) for k in range(300)], "page_id long, html string").repartition(4)
    ordered = table.select("html", F.xxhash64("page_id", "html").alias("h")).orderBy("h", "html").collect()
    assert train(table) == pytest.approx(fit(x.html for x in ordered[:10]))
