"""Whole articles of several elements, and article parts whose ids or classes look like boilerplate names."""

from fieldledger.llm.page_templates import main_texts


def texts(spark, pages):
    d = spark.createDataFrame([(k, f"https://h.example/{k}", p) for k, p in enumerate(pages)], "page_id long, url string, html string")
    return [r.text.split("\n\n") for r in sorted(main_texts(d).collect(), key=lambda r: r.page_id)]


def test_article_of_several_elements(spark):
    """Title, lead and sibling sections stay with the body, in an article and in a plain div."""
    for tag in ("article", "div class=k1"):
        page = lambda k: f"<body><nav>Home</nav><{tag}><header><h1>Title {k}</h1></header><div class=lead>Lead {k}</div><div class=story-body><p>{f'body{k} ' * 40}</p></div><section class=k2>Last {k}</section></{tag.split()[0]}><div class=sidebar>x y z</div></body>"  # noqa: E731, B023
        for k, got in enumerate(texts(spark, [page(k) for k in range(4)])):
            assert got == [f"Title {k}", f"Lead {k}", " ".join([f"body{k}"] * 40), f"Last {k}"]


def test_article_parts_with_names(spark):
    """Only containers by class or role that stand on most pages of the host are dropped inside the content."""
    odd = "<h2 id=related-work>Related</h2><p id=legal-notice-1990>Legal</p><p>A <span class=share-price>9 dollars</span></p><h2 id=Search_methods>Search</h2><section id=comments-on-kant>Kant</section><section class=legal-texts>Texts</section>"
    page = lambda k: f"<body><article><h1>T{k}</h1>{odd if k == 1 else ''}<p>{'word ' * 30}</p><div class=comments><p>Reply</p></div></article></body>"
    got = texts(spark, [page(k) for k in range(4)])
    words = " ".join(["word"] * 30)
    assert got[0] == ["T0", words]
    assert got[1] == ["T1", "Related", "Legal", "A 9 dollars", "Search", "Kant", "Texts", words]
