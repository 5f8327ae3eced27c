"""Equivalence classes of tags and words: text that a host's template repeats is told from the text in its slots."""

import random

from fieldledger.llm.page_templates import holding, in_block, in_line, main_texts


def texts(spark, pages):
    d = spark.createDataFrame([(k, f"https://{h}/{k}", p) for k, (h, p) in enumerate(pages)], "page_id long, url string, html string")
    return {r.page_id: r.text.split("\n\n") for r in main_texts(d).collect()}


def story(r, least=2):
    return [" ".join(r.choice(["the", "of", "a", *(f"w{j}" for j in range(400))]) for _ in range(r.randint(12, 60))) for _ in range(r.randint(least, 5))]


def test_hosts_of_opaque_names(spark):
    """Made-up hosts without one telling name: menu, teasers and closing lines are template, stories come back whole."""
    r, pages, want = random.Random(4), [], []
    for h in range(6):
        menu = "".join(f"<li><a href=/{k}>Item{h}{k} more</a></li>" for k in range(4))
        teaser = f"<div class=r9><p>Also on h{h} today</p><p>Ten places to see</p></div>"
        for k in range(8):
            s = story(r)
            want.append(s)
            body = "".join(f"<p>{p}</p>" for p in s)
            early, late = (teaser, "") if k % 3 else ("", teaser if h % 2 else "")
            pages.append((f"h{h}.example", f"<body><div class=x1><ul class=q7>{menu}</ul></div><div class=z3>{early}{body}{late}<p>You have reached the end. Sign up for mail {h}.</p></div><div class=w2>All rights kept by the firm</div></body>"))
    got = texts(spark, pages)
    for k, s in enumerate(want):
        assert got[k] == s, (k, got[k], s)


def test_blocks_with_own_words_stay_whole(spark):
    """A label before a value is template, the block is not; copies of one page are one page; few pages prove nothing."""
    page = lambda k, s: f"<body><div class=m><p>Home World Sport</p></div><div class=c><p>Written by author{k} in Rome</p><p>{s}</p></div></body>"
    r = random.Random(9)
    stories = [" ".join(story(r)) for _ in range(6)]
    got = texts(spark, [("a.example", page(k, s)) for k, s in enumerate(stories)])
    assert all(got[k] == [f"Written by author{k} in Rome", s] for k, s in enumerate(stories))
    copies = texts(spark, [("a.example", page(0, stories[0]))] * 8)
    assert all(got == ["Home World Sport", "Written by author0 in Rome", stories[0]] or got == ["Written by author0 in Rome", stories[0]] for got in copies.values())


def test_classes_hold_in_order_and_nested():
    words = lambda *ws: in_block(("body",), list(ws))
    a, b, c = words("one", "two"), words("three", "four"), words("five", "six")
    page = "<body><p>one two</p><p>own</p><p>three four</p><p>own</p><p>five six</p></body>"
    assert holding(page, [a, b, c]) == {*a, *b, *c} and holding(page, [[*a, *c], b]) == {*a, *b, *c}
    assert holding(page, [[*a, *b], [*c, *words("gone")]]) == {*a, *b}  # not whole on this page
    assert holding(page, [[*c, *a], b]) in ({*a, *b}, {*c, *b})  # out of line
    three = "<body><p>one two</p><p>three four</p><p>own</p><p>one two</p><p>three four</p></body>"
    assert holding(three, [[*a, *b]]) == {*a, *b}
    crossing = "<body><p>one two</p><p>three four</p><p>five six</p><p>seven eight nine</p></body>"
    d = words("seven", "eight", "nine")
    assert holding(crossing, [[*a, *c], [*b, *d]]) == {*b, *d}
    assert in_line([3, 0, 1, 4, 2]) in ({0, 1, 2}, {0, 1, 4})
