from tessera.llm import html

PAGE = "<html><head><title>t</title></head><body><nav>menu</nav><div class='wrap{k}'><div class='sidebar'>side</div><div class='post-{k}'><h1>Head &amp; line</h1><p>one <b>bo</b>ld<p>two&nbsp;three<script>x</script></div></div><footer>foot</footer></body></html>"


def test_parsing_cases():
    cases = {
        "": "", "plain": "plain", "a<br>b": "a b", "a<b>b</b>c": "abc", "<p>x<p>y": "x y", "a &lt;b&gt; &amp c &quot;": 'a <b> & c "',
        "<style>p{}</style><article>in</article>": "in", "<article>text<div class='comments'>no</div> more</article>": "text more",
        "<article>cut <b": "cut", "<article>cut &am": "cut &am", "<article>x<!-- a > b -->y</article>": "xy", "<article>x<form>f</form></article>": "x",
        "<header>top</header><main><h1>T</h1>t</main>": "T t", '<a title="a > b">q</a> r': "q r", "<ul><li>1<li>2</ul>": "1 2", "<p hidden>no</p><p>yes</p>": "yes",
        "<article>a<script>var t='</p>';</script>b</article>": "ab", "1 < 2 and <3": "1 < 2 and <3",
    }
    for page, want in cases.items():
        assert html.main_text(page, None)[0] == want, page


def test_hosts_agree_on_a_path(spark):
    rows = [(k, f"http://H.example/{k}", PAGE.replace("{k}", str(k))) for k in range(6)]
    short = "<html><body><div class='wrap9'><div class='post-9'><h1>Head</h1><p>tiny</div><div class='other'>a longer text that is not the post</div></div></body></html>"
    rows += [(9, "http://h.example/9", short), (10, "no url", "<main>alone</main>"), (11, None, None), (12, "http://x.org", ""), (None, "http://h.example/2", PAGE.replace("{k}", "2")), (2, "http://H.example/2", PAGE.replace("{k}", "2"))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = [(r.page_id, r.text) for r in html.extract(pages).collect()]
    want = [(k, "Head & line one bold two three") for k in (*range(6), 2, None)] + [(9, "Head tiny"), (10, "alone"), (11, ""), (12, "")]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert all(r.n_chars == len(r.text) for r in html.extract(pages).collect())
    assert html.extract(pages.limit(0)).count() == 0
    assert {r.host: r.winner for r in html.winners(pages).collect()}["h.example"] == "/body/div.wrap#/div.post-#"


def test_the_join_beyond_the_broadcast_gives_the_same(spark, monkeypatch):
    pages = spark.createDataFrame([(k, f"http://h{k % 3}/", PAGE.replace("{k}", str(k))) for k in range(9)], "page_id long, url string, html string")
    want = sorted(map(tuple, html.extract(pages).collect()))
    monkeypatch.setattr(html, "BROADCAST_BYTES", 0)
    assert sorted(map(tuple, html.extract(pages).collect())) == want


def test_names_that_only_mention_what_is_unwanted():
    for names in ("content no-sidebar", "entry-content has-sidebar", "post comments-open", "main-text share-enabled", "col-main with-ads", "story related-work"):
        page = f"<body><div>top</div><div class='{names}'><p>the text of the article</p></div></body>"
        assert "the text of the article" in html.main_text(page, None)[0], names
    for names in ("ad", "x sidebar", "sidebar-left", "left_sidebar y", "ad-slot-2", "nav-menu", "social-share-buttons", "related-posts", "comment-list", "site-footer", "sidebar-content"):
        page = f"<article><p>a text that is longer than the other</p><div class='{names}'><p>out</p></div></article>"
        assert html.main_text(page, None)[0] == "a text that is longer than the other", names


def test_a_left_out_element_with_most_of_the_text_is_read():
    page = "<body><p>top</p><div class='widget'><p>" + "the article " * 9 + "</p><div class='share'><p>no</p></div></div></body>"
    assert "the article" in html.main_text(page, None)[0] and "no" not in html.main_text(page, None)[0]
    page = "<article><p>the article</p><div class='comments'><p>" + "a reader " * 3 + "</p></div></article>"
    assert html.main_text(page, None)[0] == "the article"
    assert "x" not in html.main_text("<article>y<div class='ad' hidden><p>x</p></div></article>", None)[0]


def test_long_pages_keep_headline_and_lead():
    body = "".join(f"<p>{'the body of the article goes on ' * 8}</p>" for _ in range(40))
    whole = " ".join(f"Headline Lead {'the body of the article goes on ' * 320}".split())
    inner = f"<div class='content'>{body}</div>"
    for page in (
        f"<article><h1>Headline</h1><p>Lead</p>{inner}</article>", f"<article><h1>Headline</h1><div class='a'><p>Lead</p><div class='b'>{inner}</div></div></article>",
        f"<body><nav>menu</nav><div class='story'><h1>Headline</h1><p>Lead</p>{inner}</div><div><a href='x'>other pages of the site</a></div></body>",
        f"<main><div><h1>Headline</h1></div><p>Lead</p>{inner}</main>",
    ):
        assert html.main_text(page, None)[0] == whole
        for winner in html.scores(html.parse(page)):
            assert whole in html.main_text(page, winner)[0], winner


def test_a_winner_that_holds_a_part_of_the_article_is_widened():
    part = lambda name, n: f"<div class='{name}'><p>{name} {'and so on ' * n}</p></div>"
    page = f"<body><div class='post'>{part('first', 20)}{part('second', 60)}</div></body>"
    text = html.main_text(page, "/body/div.post/div.first")[0]
    assert "first" in text and "second" in text


def test_known_articles_come_back_whole(spark):
    """Pages made of known blocks amid menus, notices and comments, nested at random: what is lost of the articles and what is added."""
    import random
    from collections import Counter

    r = random.Random(8)
    say = lambda n, stem: " ".join(f"{stem}{r.randrange(5000)}" for _ in range(n))
    rows, want = [], {}
    for k in range(60):
        host, blocks = k % 4, [say(r.randrange(3, 9), "h")] + [say(r.randrange(15, 60), "t") for _ in range(r.randrange(2, 12))]
        inner = f"<h1>{blocks[0]}</h1>" + "".join(f"<p>{b[: len(b) // 2]}<b>{b[len(b) // 2 :]}</b></p>" for b in blocks[1:])
        wrap = (f"<article>{inner}</article>", f"<div class='post-{k}'><div class='entry'>{inner}</div></div>", f"<main><div id='c{k}'>{inner}</div></main>", f"<div class='story'>{inner}</div>")[host]
        around = f"<nav><a href='/'>{say(4, 'n')}</a></nav><div class='cookie-notice'>{say(9, 'n')}</div>{wrap}<div class='sidebar'><p>{say(20, 'n')}</p></div><div class='comments'><p>{say(25, 'n')}</p></div><footer>{say(9, 'n')}</footer>"
        rows.append((k, f"https://host{host}.example/{k}", f"<html><head><title>x</title><style>a{{}}</style></head><body>{around}<script>var n1;</script></body></html>"))
        want[k] = Counter(" ".join(blocks).split())
    got = {x.page_id: Counter(x.text.split()) for x in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    both = sum(sum((got[k] & want[k]).values()) for k in want)
    assert both >= 0.99 * sum(sum(w.values()) for w in want.values()) and both >= 0.99 * sum(sum(g.values()) for g in got.values())


def test_extra_columns_ties_and_very_long_pages(spark):
    long = "<article>" + "<p>one more block of the article</p>" * 40_000 + "</article>"
    even = "<body><div class='a'><p>same words here</p></div><div class='b'><p>same words here</p></div></body>"
    df = spark.createDataFrame([(1, "http://a/", long, "t", 3), (2, "http://b/", even, None, 1), (2, "http://b/", even, None, 1), (3, None, "", "h", 2)], "page_id long, url string, html string, text string, n_chars int")
    got = {(x.page_id, x.text) for x in html.extract(df).collect()}
    assert (1, " ".join(["one more block of the article"] * 40_000)) in got and (3, "") in got and len(got) == 3


def test_a_short_article_beside_the_host_s_winner_comes_back_whole():
    own = "the whole of a short article, which stands in a container of its own and not in the one that the other pages of this host have it in"
    page = f"<body><div class='x'><p>{own}</p></div><div class='y'><p>a few words that stand where others do</p></div></body>"
    assert own in html.main_text(page, "/body/div.y")[0]
    for n in (1, 2, 5, 40):
        text = " ".join([own] * n)
        assert text in html.main_text(page.replace(own, text), "/body/div.y")[0]


def test_formulas_are_text():
    page = "<article><p>the area is <math><mi>r</mi><mo>*</mo><mi>r</mi><annotation>r^2</annotation></math> times that of a square</p></article>"
    assert html.main_text(page, None)[0] == "the area is r*r times that of a square"


def test_ambiguous_names_inside_an_article_are_judged_by_what_they_hold():
    for names in ("share lead", "social", "menu", "related", "notice"):
        for tag in ("article", "main"):
            page = f"<{tag}><p>before</p><div class='{names}'><p>a paragraph of the article</p></div><p>after</p></{tag}>"
            assert html.main_text(page, None)[0] == "before a paragraph of the article after", names
            links = f"<{tag}><p>before it there is text</p><div class='{names}'><a href='x'>one link</a> <a href='y'>and another</a></div><p>after</p></{tag}>"
            assert html.main_text(links, None)[0] == "before it there is text after", names
            form = f"<{tag}><p>before it there is text</p><div class='{names}'><p>say</p><form>your name and address <input></form></div><p>after</p></{tag}>"
            assert html.main_text(form, None)[0] == "before it there is text after", names
    assert html.main_text("<article><p>a text that is longer than the other</p><div class='sidebar social'><p>aside</p></div></article>", None)[0] == "a text that is longer than the other"
