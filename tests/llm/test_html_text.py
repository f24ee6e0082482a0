"""Page texts against the articles cut out by hand, and on pages made for each rule."""

import html
import re
import time
import tracemalloc

import numpy as np
import pytest

from tidemark.llm import html_text


def article(page):
    inner = page[page.index("<article>") + 9:page.index("</article>")]
    blocks = [re.sub(r"\s+", " ", html.unescape(re.sub(r"</?b>", "", re.sub(r"<br>", " ", b)))).strip()
              for b in re.split(r"</?(?:p|h1)>", inner)]
    return "\n".join(b for b in blocks if b)


def test_given_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {r.page_id: (r.url, article(r.html)) for r in pages.collect()}
    got = html_text.extracted(pages).collect()
    assert len(got) == len(want)
    for r in got:
        assert (r.url, r.text) == want[r.page_id] and r.n_chars == len(r.text)


TEXT = "A paragraph of the article that is long enough to count as running text, with some more words to it."


@pytest.mark.parametrize("page, want", [
    (None, ""), ("", ""), ("   ", ""), ("<p></p>", ""), ("just text &amp; more", "just text & more"),
    (f"<nav><a href=x>Home</a></nav><div id=content><h2>Short</h2><p>{TEXT}</p><p>Tiny.</p><p>{TEXT}</p></div>"
     f"<div class='comments list'><p>{TEXT}</p></div><aside><p>{TEXT}</p></aside><footer><p>{TEXT}</p></footer>",
     f"Short\n{TEXT}\nTiny.\n{TEXT}"),
    (f"<article><header><h1>Title</h1></header><p>{TEXT}<br>next</p><div class=ad>{TEXT}</div><form>{TEXT}</form>"
     f"<script>var x = '<p>{TEXT}';</script><style>p{{}}</style><ul><li>one<li>two</ul></article><p>{TEXT}</p>",
     f"Title\n{TEXT} next\none\ntwo"),
    (f"<main><p>a&nbsp;b\n\t c &lt;tag&gt; &#233;<p>{TEXT}</main><div class='cookie-notice'>{TEXT}</div>", f"a b c <tag> é\n{TEXT}"),
    (f"<body><p>{TEXT}</b></i></div><p>{TEXT}<p hidden>{TEXT}<p style='display: none'>{TEXT}", f"{TEXT}\n{TEXT}"),
    (f"<article><p>{TEXT}", TEXT), ("<table><tr><td>x<td>y</table>", "x\ny"),
    ("<article><p>Be.</p></article><div>" + TEXT + "</div>", "Be."),
    ("<p><b>bold <i>both</b> rest</p><!-- <p>no</p> -->", "bold both rest"),
])
def test_rules(page, want):
    assert html_text.extract(page) == want


def test_links_beside_the_text_are_left_out():
    links = "".join(f"<li><a href=/{k}>Some link text {k}</a></li>" for k in range(30))
    page = f"<div><ul>{links}</ul></div><div><p>{TEXT}</p><p>{TEXT}</p><p>{TEXT}</p></div>"
    assert html_text.extract(page) == "\n".join([TEXT] * 3)


def test_long_and_deep_pages():
    assert html_text.extract("<p>" * 5000 + TEXT) == TEXT
    assert html_text.extract("<div>" * 3000 + TEXT + "</div>" * 3000) == TEXT
    assert len(html_text.extract(f"<article>{'<p>' + TEXT * 200 + '</p>'}</article>" * 5)) == 5 * 200 * len(TEXT) + 4


def test_smoothing_and_threshold():
    flat = np.full(9, 4.0)
    assert np.allclose(html_text.smoothed(flat), flat)
    peak = html_text.smoothed(np.array([0, 0, 0, 9.0, 0, 0, 0]))
    assert peak.argmax() == 3 and np.allclose(peak, peak[::-1])
    assert 1 < html_text.threshold(np.array([0, 1, 1, 9, 10, 11.0])) < 9
    assert html_text.threshold(np.array([3.0, 3.0])) == 3


def test_rows(spark):
    pages = spark.createDataFrame([(1, None, None, "n"), (None, "u", f"<p>{TEXT}", "n"), (1, "v", "<p>x", "n"), (1, "v", "<p>x", "n")],
                                  "page_id bigint, url string, html string, text string")
    got = sorted(map(tuple, html_text.extracted(pages).collect()), key=str)
    assert got == sorted([(1, None, "", 0), (None, "u", TEXT, len(TEXT)), (1, "v", "x", 1), (1, "v", "x", 1)], key=str)
    assert html_text.extracted(pages.limit(0)).count() == 0


def test_seeds_choose_among_articles():
    card = "<article><h3><a href=/x>A card</a></h3><p>Few words.</p></article>"
    page = f"{card}{card}<article><h1>Title</h1><p>{TEXT}</p><p>Tiny.</p><p>{TEXT}</p></article>{card}{card}"
    assert html_text.extract(page) == f"Title\n{TEXT}\nTiny.\n{TEXT}"
    assert html_text.extract(f"<main><h1>Title</h1><div><p>{TEXT}</p><p>{TEXT}</p></div>{card}</main>") == f"Title\n{TEXT}\n{TEXT}"


def test_seeds_outside_of_cards_are_the_text():
    cards = "<article><h3>A card</h3><p>Few words.</p></article>" * 4
    page = f"<div><h1>Title</h1>{''.join(f'<p>{TEXT}</p>' for _ in range(6))}</div><section>{cards}</section>"
    assert html_text.extract(page) == "\n".join(["Title"] + [TEXT] * 6)
    one = f"<article><p>Be.</p></article><div>{''.join(f'<p>{TEXT}</p>' for _ in range(6))}</div>"
    assert html_text.extract(one) == "\n".join(["Be."] + [TEXT] * 6)


@pytest.mark.parametrize("page, want", [
    (f"<div class='layout with-sidebar'><article><p>{TEXT}</p></article><div class='sidebar'>{TEXT}</div></div>", TEXT),
    (f"<div id='content-no-sidebar'><p>{TEXT}</p><p>{TEXT}</p></div>", f"{TEXT}\n{TEXT}"),
    (f"<div class='page has-banner'><nav>{TEXT}</nav><main><p>{TEXT}</p></main></div>", TEXT),
    (f"<form action=x><nav>Home</nav><div><p>{TEXT}</p><p>{TEXT}</p></div><footer>{TEXT}</footer></form>", f"{TEXT}\n{TEXT}"),
    (f"<div class='widget'><article><p>{TEXT}</p></article></div><div class='comments'><p>{TEXT}</p><p>{TEXT}</p></div>", TEXT),
    (f"<article><div class='post-header'>By me</div><p>{TEXT}</p><div class='social-policy'>{TEXT}</div></article>",
     f"By me\n{TEXT}\n{TEXT}"),
    (f"<article><p>{TEXT}</p></article><div class='comments'>" + f"<article><p>{TEXT}</p></article>" * 9 + "</div>", TEXT),
    (f"<nav>Home</nav><div><h2><a href=x>Linked title</a></h2><p>{TEXT}</p><p>{TEXT}</p><h3>References</h3><ul><li><a href=y>"
     f"Source one</a></li></ul></div>", f"Linked title\n{TEXT}\n{TEXT}\nReferences\nSource one"),
])
def test_wrappers_and_links_are_not_boilerplate_by_name(page, want):
    assert html_text.extract(page) == want


def test_links_in_a_page_without_containers():
    links = "".join(f"<li><a href=/{k}>Some link text {k}</a></li>" for k in range(30))
    page = f"<body><div><ul>{links}</ul></div><p>{TEXT}</p><p>{TEXT}</p><p><a href=x>Linked</a></p></body>"
    assert html_text.extract(page) == f"{TEXT}\n{TEXT}\nLinked"


@pytest.mark.parametrize("unit", ["<div>x ", "<div class=ad>x ", "<article>x ", "<section><b>x ", "<div></ul>x ", "<p><i>x "])
def test_a_page_of_elements_that_never_close(unit):
    html = unit * (400_000 // len(unit))
    tracemalloc.start()
    start = time.time()
    text = html_text.extract(html)
    taken, peak = time.time() - start, tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 << 20 and taken < 60
    # an advert that holds most of the page's text is a layout's name, the ones inside it are adverts
    assert len(text.split()) > html.count("x") / 2 or "class=ad" in unit


def test_inner_marks_and_regions_by_parents():
    page = ("<body><div class=menu>top<div>inside</div></div><div class=page>" + "<p>one two three four five six seven eight</p>" * 4
            + "<div><div class=share>share this</div><p>" + "nine ten eleven twelve " * 5 + "</p></div></div></body>")
    text = html_text.extract(page)
    assert "top" not in text and "inside" not in text and "share this" not in text
    assert text.count("seven eight") == 4 and "eleven twelve" in text
