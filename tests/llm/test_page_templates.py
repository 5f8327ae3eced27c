"""Main text of pages: given pages against their plain article, made-up hosts, odd html."""

import html
import re

from fieldledger.llm.page_templates import extract, main_texts, measure


def plain_article(page):
    inner = re.sub(r"<br>", " ", re.search(r"<article>(.*?)(</article>|\Z)", page, re.S)[1])
    blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:h1|p|ul|li|div)[^>]*>", inner))
    return "\n\n".join(b for b in blocks if b)


def test_given_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {r.page_id: plain_article(r.html) for r in pages.collect()}
    got = main_texts(pages).collect()
    assert {r.page_id: r.text for r in got} == want and all(r.n_chars == len(r.text) for r in got) and len(got) == len(want)


def test_hosts_without_article_tags(spark):
    """The content element is found by the host's template: the div that holds most words, not the menu or the teaser."""
    rows = []
    for k in range(12):
        body = "".join(f"<p>Text {k} {j} " + "word " * 30 + "</p>" for j in range(k % 4 + 1))
        rows.append((k, f"https://u@News.example.com:80/{k}", f"<body><div class='top-menu'><ul><li>Home</ul></div><div id=teaser>Short</div><div class='c1'>{body}<div class=comments><p>{'reply ' * 90}</div></div><div class='sidebar'>{'x ' * 200}</div></body>"))
    rows += [(100, None, "no tags &amp; all"), (101, "", None), (102, "odd", ""), (None, "https://news.example.com/z", "<div class=c1>One&nbsp; two<p>three"), (0, rows[0][1], rows[0][2])]
    d = spark.createDataFrame([(i, u, h, 1) for i, u, h in rows], "page_id long, url string, html string, host int")
    got = {(r.page_id, r.url): r for r in main_texts(d).collect()}
    assert len(got) == 16 and main_texts(d).count() == 17
    text = got[3, rows[3][1]].text
    assert text.count("\n\n") == 3 and text.startswith("Text 3 0 word") and "reply" not in text and "Home" not in text
    assert got[100, None].text == "no tags & all" and got[101, ""].text == "" and got[102, "odd"].n_chars == 0
    assert got[None, "https://news.example.com/z"].text == "One two\n\nthree"


def test_one_page():
    page = '<html><head><title>T</title></head><body class="x"><header>Top</header><main><h1>A &lt;b&gt;</h1><script>if (a<b) "</p>"</script><p title="a>b">x<br>y<p>z <!-- no <p> --> end<form>f</form><table><tr><td>1<td>2</table></main><footer>F</footer>'
    assert extract(page, "main") == extract(page, None) == "A <b>\n\nx y\n\nz end\n\n1 2"
    assert measure(page)["main"][0] == 1
    assert extract("<p>a" + "<b>" * 5000 + "deep" + "</b>" * 5000, None) == "adeep"
    assert extract("<article>a < b &zzz; <![CDATA[c]]> d <!-- open", None) == "a < b &zzz; d"


def test_empty_table(spark):
    assert main_texts(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
