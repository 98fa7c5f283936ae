import html
import re

import numpy as np

from daymark.llm import article


def expected(page):
    """The article of a page of the given template, by cutting strings."""
    body = page.split("<article>", 1)[1].split("</article>", 1)[0] if "<article>" in page else ""
    body = re.sub(r"<[a-zA-Z/!][^>]*$", "", body.rsplit("<footer", 1)[0])
    blocks = re.split(r"</?(?:p|h1)\b[^>]*>", body)
    texts = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in blocks]
    return "\n".join(t for t in texts if t)


def test_given_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    raw = {r["page_id"]: r["html"] for r in pages.collect()}
    got = article.main_texts(pages).collect()
    assert len(got) == len(raw)
    for r in got:
        assert r["text"] == expected(raw[r["page_id"]])
        assert r["n_chars"] == len(r["text"])


PAGE = """<html><head><title>T</title><script>var a = "<p>no</p>";</script></head><body>
<header><h1>Site</h1><nav><a href=/>Home</a> <a href=/b>About</a></nav></header>
<div class="cookie-notice">We use cookies to make this site better for all of its many visitors today.</div>
<main><article><header><h1>Head &amp; line</h1></header>
<p>First   paragraph with <b>bold</b> and<br>broken text that is long enough to count as content here.
<p>Second <script>track("<b>")</script>paragraph, also long enough to be taken for content, one would think.</p>
<p>Ok.</p><ul><li>point one<li>point two</ul>
<aside>See also other things</aside><form><p>Sign up</p><input></form>
<section id="comments"><p>A reader's long comment that says a great deal about nothing much at all.</p></section>
</article></main>
<div class="ad-box">Buy a very nice thing from us now because it is the best thing that money can buy.</div>
<footer>&copy; Site</footer></body></html>"""


def test_parts_of_a_page():
    assert article.main_text(PAGE).split("\n") == [
        "Head & line",
        "First paragraph with bold and broken text that is long enough to count as content here.",
        "Second paragraph, also long enough to be taken for content, one would think.",
        "Ok.",
        "point one",
        "point two",
    ]


def test_without_sections_content_lines_decide():
    links = "".join(f"<div><a href=/{i}>go {i}</a> <a href=/x{i}>to</a></div>" for i in range(12))
    text = "".join(f"<div>Sentence number {i} of a text that runs on for a good while, as main texts do.</div>" for i in range(6))
    lines = article.main_text(f"<body>{links}{text}{links}</body>").split("\n")
    assert [x for x in lines if x.startswith("Sentence")] == [f"Sentence number {i} of a text that runs on for a good while, as main texts do." for i in range(6)]
    assert len(lines) <= 8


def test_cut_off_and_broken_pages():
    assert article.main_text("<article><p>all of this text &am") == "all of this text &am"
    assert article.main_text("<article><p>all of this text</p><a hre") == "all of this text"
    assert article.main_text("<article><p>all of this text</p><!-- a > b") == "all of this text"
    assert article.main_text("plain 3 < 4 text") == "plain 3 < 4 text"
    assert article.main_text("<head><title>x</title><body><p>body text") == "body text"
    assert article.main_text("</p></div></b>text") == "text"
    for empty in (None, "", "   ", "<script>x</script>", "<nav>menu</nav>"):
        assert article.main_text(empty) == ""


def test_threshold_splits_two_levels():
    got = article.content_lines(np.array([1.0, 2.0, 50.0, 60.0, 1.5]))
    assert got.tolist() == [False, False, True, True, False]
    assert article.content_lines(np.ones(4)).all()
    assert np.allclose(article.smooth(np.full(7, 3.0)), 3.0)


def test_long_page_and_odd_rows(spark):
    long_page = "<article>" + "<p>some words of a paragraph that repeats</p>" * 20000
    rows = [(1, None, long_page, "x"), (None, "u", None, "y"), (1, "u", "", "z"), (1, "u", "", "z")]
    got = article.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted((r["n_chars"], r["page_id"] or 0) for r in got)[:3] == [(0, 0), (0, 1), (0, 1)]
    assert max(r["n_chars"] for r in got) == 20000 * 40 - 1 + 20000 * 0 or max(r["n_chars"] for r in got) > 700000
    assert article.main_texts(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def long_text(i):
    return f"Sentence number {i} of a text that runs on for a good while, as main texts do."


def test_all_content_sections_are_kept():
    one, two = (f"<article><h2>Head {k}</h2><p>{long_text(k)}</p><p>{long_text(k + 1)}</p></article>" for k in (1, 3))
    links = "".join(f"<div><a href=/{i}>go {i}</a> <a href=/x{i}>to</a></div>" for i in range(6))
    teaser = "<article><div><a href=/t>more</a> <a href=/u>here</a></div></article>"
    lines = article.main_text(f"<body>{links}{one}{links}{two}{links}{teaser}</body>").split("\n")
    assert lines == ["Head 1", long_text(1), long_text(2), "Head 3", long_text(3), long_text(4)]


def test_main_text_beside_an_article():
    links = "".join(f"<div><a href=/{i}>go {i}</a> <a href=/x{i}>to</a></div>" for i in range(6))
    page = f"<body>{links}<main><h1>Title</h1><p>{long_text(1)}</p><article><p>{long_text(2)}</p><p>{long_text(3)}</p></article><p>The end.</p></main>{links}</body>"
    assert article.main_text(page).split("\n") == ["Title", long_text(1), long_text(2), long_text(3), "The end."]
    page = f"<body>{links}<main><h1>Title</h1><article><p>{long_text(2)}</p><p>{long_text(3)}</p></article></main>{links}</body>"
    assert article.main_text(page).split("\n") == ["Title", long_text(2), long_text(3)]


def test_headings_next_to_the_region_without_sections():
    links = "".join(f"<div><a href=/{i}>go {i}</a> <a href=/x{i}>to</a></div>" for i in range(6))
    text = "".join(f"<p>{long_text(i)}</p>" for i in range(4))
    lines = article.main_text(f"<body>{links}<h1>Title</h1><h2>Sub</h2>{text}<p>The end.</p><p>Bye.</p>{links}</body>").split("\n")
    assert [x for x in lines if not x.startswith("go")] == ["Title", "Sub", *(long_text(i) for i in range(4)), "The end.", "Bye."]


def test_a_small_section_does_not_hide_the_text():
    text = "".join(f"<div>{long_text(i)}</div>" for i in range(5))
    lines = article.main_text(f"<body>{text}<article><p>{long_text(9)}</p></article></body>").split("\n")
    assert lines == [long_text(i) for i in (0, 1, 2, 3, 4, 9)]


def test_comment_marks_outside_comments():
    body = f"<article><p>{long_text(1)}</p><p>{long_text(2)}</p></article>"
    want = f"{long_text(1)}\n{long_text(2)}"
    for before in ('<script>document.write("<!-- ad");</script>', "<style>/* <!-- */</style>", '<div title="<!-- x"></div>'):
        assert article.main_text(f"<html><body>{before}{body}</body></html>") == want
    assert article.main_text(f"<body>{body}<!-- cut off <p>here") == want
