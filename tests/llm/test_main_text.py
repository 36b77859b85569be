"""Main text of hand-made pages of many layouts, and edge cases."""

import time

import pytest

from framewright.llm.main_text import extract_main_text, lines_of, main_text, spans
from framewright.llm.queries import QUERIES

P1 = "The first paragraph tells at length what happened on the river that day, and who was there to see it."
P2 = "A second one goes on about the boats, the weather and the long way home through the marshes by night."
P3 = "The last paragraph ends the story with all the people asleep and the lights out along the whole shore."
MENU = "<ul>" + "".join(f'<li><a href="/{k}">Section {k}</a></li>' for k in range(8)) + "</ul>"
WANT = f"River day\n{P1}\n{P2}\n{P3}"
STORY = f"<h1>River day</h1><p>{P1}</p><p>{P2}</p><p>{P3}</p>"

LAYOUTS = {
    "article": f"<html><body><header><h1>Daily</h1></header><nav>{MENU}</nav><article>{STORY}</article><footer>(c) Daily</footer></body></html>",
    "main": f"<body><div class='cookie-notice'>We use cookies. {P1}</div><main id=main>{STORY}</main><aside>{P2}</aside></body>",
    "classes": f"<body><div id=top-nav>{MENU}</div><div class=content>{STORY}</div><div class='sidebar'><p>{P2}</p></div><div id=comments><p>{P3}</p></div></body>",
    "plain divs": f"<body><div>{MENU}</div><div>{STORY}</div><div>{MENU}</div></body>",
    "no containers": f"<body>{MENU}{STORY}{MENU}</body>",
    "reader comments": f"<article>{STORY}<section class='comments'><h2>Comments</h2><p>{P1}</p><p>{P2}</p></section></article>",
    "adverts inside": f"<article><h1>River day</h1><p>{P1}</p><div class='ad'>Buy now</div><p>{P2}</p><ins class='adsense'>Buy</ins><p>{P3}</p></article>",
    "form inside": f"<article>{STORY}<form><p>{P1}</p><input name=q><button>Send</button></form></article>",
    "page in a form": f"<body><form action=/><div class=menu>{MENU}</div><div class=text>{STORY}</div></form></body>",
    "unclosed": f"<body><nav>{MENU}</nav><article><h1>River day<p><b>{P1}<p>{P2}<br><p>{P3}",
    "menu inside": f"<article>{STORY}{MENU}</article>",
    "link lines": f"<article><h1><a href=/>River day</a></h1><p>{P1}</p><p>{P2}</p><p>{P3}</p></article>",
    "scripts": f"<head><title>x</title><style>p{{}}</style></head><body><script>var t='<p>{P1}</p>';</script><article>{STORY}</article><noscript>{P1}</noscript>",
    "comment tags": f"<!-- <article>{P1}</article> --><article>{STORY}<!-- <p>{P2}</p> --></article>",
    "misread class": f"<body class='has-sidebar'><div class='with-sidebar no-comments'>{STORY}</div></body>",
    "marked wrapper": f"<body><div class='page-widget'>{STORY}</div></body>",
    "hidden": f"<article>{STORY}<p hidden>{P1}</p><p style='display: none'>{P1}</p><p aria-hidden=true>{P1}</p></article>",
    "roles": f"<div role=navigation>{P1}</div><div role=main class=x>{STORY}</div><div role=contentinfo>{P3}</div>",
    "own header": f"<article><header class='entry-header'><h1>River day</h1><p>By somebody</p></header><p>{P1}</p><p>{P2}</p><p>{P3}</p></article>",
    "header class": f"<article><div class='entry-header'><h1>River day</h1><span>May</span></div><p>{P1}</p><p>{P2}</p><p>{P3}</p></article>",
    "teasers": f"<main><article>{STORY}</article><article class=related><p>{P1}</p></article></main><article><p>Read this, too.</p></article>",
    "upper case": f"<BODY><NAV>{MENU}</NAV><ARTICLE>{STORY}</ARTICLE><FOOTER>x</FOOTER></BODY>",
    "table layout": f"<table><tr><td>{MENU}<td>{STORY}<td>{MENU}</table>",
    "quotes in tags": f"<nav title='a > b'>{MENU}</nav><article data-x=\"1 > 0\" data-y='</article>'>{STORY}</article>",
}


@pytest.mark.parametrize("name", LAYOUTS)
def test_layouts(name):
    assert main_text(LAYOUTS[name]) == WANT


def test_blocks_and_white_space():
    page = f"<article><h1> A\n  title </h1>{P1}<p>one\t two<br>three&nbsp;four</p><ul><li>x<li>y</ul><pre>a\n  b</pre><table><tr><td>1<td>2</table><p>in <b>bo</b>ld</article>"
    assert main_text(page) == f"A title\n{P1}\none two three four\nx\ny\na b\n1\n2\nin bold"


def test_character_references():
    page = "<article><p>" + P1 + "</p><p>&lt;b&gt; &amp;amp; &copy &#233;&#xE9; &#128512; &hellip; &am &nowhere; AT&T a<b 1 < 2 &#0;</p></article>"
    assert main_text(page).split("\n")[1] == "<b> &amp; © éé 😀 … &am &nowhere; AT&T a"
    assert main_text(f"<p>{P1} 1 < 2 & 3</p>") == f"{P1} 1 < 2 & 3"


@pytest.mark.parametrize("cut", ["<", "</", "<p", '<p class="x', "<!--", "<!", "<script>", "<style> p {", "&am", "<a href='"])
def test_cut_pages(cut):
    """A page cut off anywhere keeps what stood before."""
    assert main_text(f"<article>{STORY}{cut}") == WANT + ({"&am": "\n&am", "<": "\n<"}.get(cut, ""))


def test_without_text():
    for page in (None, "", " \n", "<html></html>", "<nav>menu</nav>" * 0, "<script>x</script>", "<!-- x -->", "<p></p>"):
        assert main_text(page) == ""


def test_short_texts_stay():
    assert main_text("<article><h1>Hi</h1><p>Yes.</p></article>") == "Hi\nYes."
    assert main_text("one line") == "one line"


def test_distribution():
    """A span runs from the surge to the dive; gaps shorter than a window stay inside."""
    assert spans([0, 0, 90, 5, 90, 0, 0, 0, 0, 90], 80) == [(2, 5), (9, 10)]
    assert spans([1, 1, 1], 80) == [] and spans([], 0) == []
    assert spans([90, 0, 0, 90], 80) == [(0, 4)] and spans([90, 0, 0, 0, 90], 80) == [(0, 1), (4, 5)]
    # links count as no text of their own
    assert [x.own for x in lines_of("<p>ab <a>cd</a> ef<p><a>gh</a><h2><a>ij</a></h2>")[0]] == [4, 0, 2]


@pytest.mark.parametrize("page", ["<div>" * 50_000 + P1, "<a<" * 100_000, "<p " + "x='" * 100_000, "<b>" * 100_000 + P1, "</div>" * 100_000, "<i><p></i>" * 30_000,
                                  "<li>" * 50_000, "&amp" * 100_000, "<!--" * 100_000, "<h1><a>" * 20_000, "a<" * 200_000])
def test_time_in_proportion(page):
    began = time.time()
    main_text(page)
    assert time.time() - began < 5


def test_table(spark):
    rows = [(1, LAYOUTS["article"], "t"), (1, LAYOUTS["article"], "t"), (2, None, "t"), (3, "", "t"), (None, "<p>x</p>", "t"), (4, f"<p>{P1}" * 20_000, "t")]
    df = spark.createDataFrame(rows, "page_id long, html string, text string").repartition(3)
    found = extract_main_text(df, name="text")
    assert found.columns == ["page_id", "html", "text"]
    texts = sorted((r["page_id"] or 0, r["text"]) for r in found.collect())
    assert texts == sorted([(1, WANT), (1, WANT), (2, ""), (3, ""), (0, "x"), (4, "\n".join([P1] * 20_000))])
    assert extract_main_text(df.filter("false")).count() == 0


def test_query(spark, tmp_path):
    spark.createDataFrame([(1, "u", "<p>é x"), (2, None, None)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    rows = QUERIES["op11_html_extraction"](spark, str(tmp_path)).collect()
    assert sorted((r["page_id"], r["url"], r["text"], r["n_chars"]) for r in rows) == [(1, "u", "é x", 3), (2, None, "", 0)]
