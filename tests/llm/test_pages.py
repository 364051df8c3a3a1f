from plumbline.llm import pages

SCHEMA = "page_id long, url string, html string, text string"


def page(kind, body):
    junk = "<aside class='sidebar'>side words here</aside><div id='cookie-notice'>We use cookies.</div>"
    wrap = {"a": "<div class='wrap'><div class='post-12'>{}</div></div>", "b": "<main><section>{}</section></main>"}[kind]
    return (f"<html><head><title>t</title><style>p{{}}</style></head><body><header><h1>Site</h1></header><nav><ul><li><a href='/'>Home</a></li></ul></nav>"
            f"{junk}{wrap.format(body)}<div class='comments'><p>{'A reader says very much, at great length. ' * 30}</p></div><footer>&copy; x</footer></body></html>")


def test_article_without_the_rest(spark):
    body = "<h2>T &amp; x</h2><p>Hello <em>big</em>\n  world.<p>Second&nbsp;one.<script>var t='</p>';</script><ul><li>item<li>other</ul><div class=ad>buy</div><form>f</form>"
    for kind in "ab":
        assert pages.extract(page(kind, body), []) == "T & x\nHello big world.\nSecond one.\nitem\nother"


def test_the_host_outvotes_a_page(spark):
    long = "<p>" + "A sentence of the article, with words. " * 5 + "</p>"
    usual = [(i, "http://h.example/x", page("a", long * 3), "clash") for i in range(8)]
    # this page's own best container would be a box beside the article
    odd = page("a", "<p>Short article.</p>").replace("<main>", "").replace("</header>", "</header><div class='box'>" + long * 4 + "</div>")
    frame = spark.createDataFrame(usual + [(9, "http://h.example/y", odd, None)], SCHEMA)
    out = {r["page_id"]: r["main"] for r in pages.main_text(frame, into="main").collect()}
    assert out[9] == "Short article." and len(out[0].split("\n")) == 3
    assert pages.extract(odd, []) != "Short article."


def test_odd_pages(spark):
    rows = [(1, None, None, None), (2, "", "", None), (3, "http://x", "no tags & all", None), (4, "http://x/", "<p>open <b>ends", None), (5, "http://x", "<div", None),
            (6, "http://x", "<a title='5 > 3'>t</a> x < y", None), (6, "http://x", "<a title='5 > 3'>t</a> x < y", None), (7, "u", "<div>" * 3000 + "deep", None)]
    out = pages.main_text(spark.createDataFrame(rows, SCHEMA), into="main").collect()
    got = {r["page_id"]: r["main"] for r in out}
    assert len(out) == 8 and got == {1: "", 2: "", 3: "no tags & all", 4: "open ends", 5: "", 6: "t x < y", 7: "deep"}
    assert pages.main_text(spark.createDataFrame([], SCHEMA), into="main").count() == 0


def test_all_pages_equal_their_articles(spark):
    """The given pages hold one article element each."""
    import html
    import re
    rows = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    for r in pages.main_text(rows).collect():
        body = re.search(r"<article>(.*?)(</article>|$)", r["html"], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", body)]
        assert r["text"] == "\n".join(b for b in blocks if b)


def test_layout_classes_do_not_empty_a_page():
    text = "A sentence of the article, with words. " * 5
    small = "<div class='promo-teaser'><p>Buy.</p></div>"
    for name in ("content has-sidebar", "no-sidebar", "post comments-open", "search-result", "tag-promotion", "legal-news"):
        assert pages.extract(f"<body><div class='{name}'><p>{text}</p><p>{text}</p>{small}</div></body>", []) == f"{text.strip()}\n{text.strip()}"
        apart = f"<div class='{name}'><p>{text}</p></div>" * 8  # each a small part, together all
        assert pages.extract(f"<body><div>{apart}</div></body>", []) != ""


def test_a_winner_that_holds_nothing_of_a_page_is_not_its_path(spark):
    text = "<p>" + "A sentence of the article, with words. " * 5 + "</p>"
    usual = [(i, "http://h.example/x", f"<body><div class='a'>{text * 3}</div></body>", None) for i in range(8)]
    other = f"<body><div class='a'><p>x</p></div><div class='b'>{text * 3}</div></body>"
    nowhere = [(20 + i, None, f"<body><div class='a'>{text * 3}</div></body>", None) for i in range(8)]
    mixed = f"<body><div class='a'><p>A short box, with words.</p></div><div class='b'>{text * 3}</div></body>"
    frame = spark.createDataFrame(usual + [(9, "http://h.example/y", other, None)] + nowhere + [(30, None, mixed, None)], SCHEMA)
    out = {r["page_id"]: r["main"] for r in pages.main_text(frame, into="main").collect()}
    assert all(len(out[i].split("\n")) == 3 for i in (0, 9, 20, 30))


TEXT = "A sentence of the article, with words. " * 5


def test_no_word_of_the_article_goes_by_its_name():
    names = ("search-algorithms", "login-flow", "copyright-law", "comment-syntax", "advert-spending", "search", "legal", "share", "intro")
    body = "".join(f"<section id='{n}'><h2 id='{n}'>About {n}</h2><p>{TEXT}</p></section>" for n in names)
    got = pages.extract(f"<body><nav><a href='/'>Home</a></nav><article>{body}</article></body>", [])
    assert got == "\n".join(f"About {n}\n{TEXT.strip()}" for n in names)
    odd = ("<h2 id='search'>Search</h2><section id='legal'><p>Law.</p></section><table class='share'><tr><td>1</td></tr></table>"
           "<pre>x = 1 <span class='comment'># one</span></pre><p class='notice' id='ad'>Let <math><mi>x</mi> <mo>=</mo> <mn>2</mn></math> <object>hold</object>.</p>")
    for around in ("<article>{}</article>", "<main>{}</main>", "<div class='post-7'>{}</div>"):
        assert pages.extract(around.format(f"<p>{TEXT}</p>" + odd), []) == f"{TEXT.strip()}\nSearch\nLaw.\n1\nx = 1 # one\nLet x = 2 hold."


def test_headline_and_lead_belong_to_the_article():
    inner = "<div class='article-body'>" + "<p>Short one, here.</p>" * 5 + "</div>"
    related = "<div class='more-related'><a href='/1'>One thing</a><a href='/2'>Another thing</a></div>"
    want = "Head\nLead\n" + "\n".join(["Short one, here."] * 5)
    for page_ in (f"<article><h1>Head</h1><p>Lead</p>{inner}{related}</article>", f"<article><header><h1>Head</h1></header><p>Lead</p>{inner}</article>",
                  f"<body><div class='x'><h1>Head</h1><p>Lead</p>{inner}</div><div class='y'><p>Else, not of it.</p></div></body>"):
        assert pages.extract(page_, []) == want


def test_what_is_left_out_inside_an_article():
    body = (f"<p>{TEXT}</p><div class='ad-slot'>Buy.</div><ul class='share-links'><li><a href='/'>Share</a></ul><form>name</form><p hidden>no</p><p>x<span hidden>no</span>y</p>"
            "<div class='comments'><article class='comment-body'><p>A reader says.</p></article></div><footer>By us</footer>")
    assert pages.extract(f"<article>{body}</article>", []) == f"{TEXT.strip()}\nxy"


def test_a_box_with_such_an_id_around_the_whole_page():
    assert pages.extract(f"<body><div id='modal'><p>{TEXT}</p></div></body>", []) == TEXT.strip()
    assert pages.extract(f"<body><p>{TEXT}</p><div id='cookie-notice'><p>We use cookies.</p></div></body>", []) == TEXT.strip()


def test_deep_pages_take_linear_time():
    import time
    begun = time.monotonic()
    for odd in ("<div><p>x</p>" * 20_000, "<div>" * 20_000 + "x", "<div class='no-sidebar'><p>x</p>" * 20_000, "<div>" * 20_000 + "</section>x" * 20_000,
                "<span hidden>x" * 20_000):
        pages.extract(odd, [])
    assert time.monotonic() - begun < 20


def test_votes_equal_a_count_by_hand(spark):
    from collections import Counter
    import random
    rng, rows = random.Random(5), []
    for i in range(120):
        kind, h = rng.choice("aaab"), rng.choice("xyz")
        rows.append((i, f"http://{h}.example/{i}", page(kind if h != "z" else "b", f"<p>{TEXT}</p>" * rng.randint(1, 3)), None))
    got = {r["host"]: r["paths"] for r in pages.winning_paths(spark.createDataFrame(rows, SCHEMA)).collect()}
    votes = {}
    for _, url, text, _ in rows:
        p = pages.Page(text)
        votes.setdefault(url.split("/")[2], Counter())[p.path(p.best())] += 1
    assert got == {h: sorted(p for p, n in c.items() if n >= pages.SHARE * sum(c.values())) for h, c in votes.items()}
    assert any(len(p) > 1 for p in got.values())
