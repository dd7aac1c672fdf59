import pytest

from sonoflock.llm import html_text

PAGE = """<!DOCTYPE html><html lang="en"><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head>
<body><nav><ul><li><a href="/x">menu</a></li></ul></nav><!-- ad > --><div class="ad">buy</div>
<article><h1>Head {k} &amp; more</h1><p><b>One
 {k}<br>two<br><p>Th<i>re</i>e &quot;{k}&quot; &amp</p><div class="box1">Follow us on our channel</div><p>{copy}</p>
<section class="comments"><p>first!</p></section><form><p>mail</p></form></article>
<div id="x{k}">Promoted by the house</div><footer>&copy; us</footer></body></html>"""


def page(k, copy="same text on all pages"):
    return PAGE.format(k=k, copy=copy)


def want(k):
    return f'Head {k} & more\n\nOne {k} two\n\nThree "{k}" &'


def test_text_of_articles(spark):
    rows = [(k, f"http://a.example.com/{k}", page(k)) for k in range(12)]
    rows += [(100, None, None), (101, "http://b.example.com", ""), (102, "x", "plain &lt;text&gt; <b>here</b>"), (None, "", "<p>a<p>b")]
    rows += [(103, "http://b.example.com", page(7)[:400]), (12, rows[0][1], page(0))]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "page_id long, url string, html string, low int, host int").repartition(3)
    got = {r.page_id: r for r in html_text.extract(df).collect()}
    assert len(got) == len(rows)
    assert all(got[k].text == want(k) for k in range(12)) and got[12].text == want(0)
    assert got[100].text == got[101].text == "" and got[100].n_chars == 0
    assert got[102].text == "plain <text> here" and got[None].text == "a\n\nb"
    assert got[103].text.startswith("Head 7 & more\n\nOne 7 two")
    assert all(r.n_chars == len(r.text) for r in got.values())


def test_low_branches_without_telling_names(spark):
    html = "<body><div class='k{}'><p>Story {} of the day {}</p></div><div class='zz'>Join our club today</div></body>"
    rows = [(k, "https://c.example.com/p", html.format(0, k, "x" * k)) for k in range(20)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_text.extract(df).collect()}
    assert got == {k: f"Story {k} of the day {'x' * k}".strip() for k in range(20)}


def test_importance_follows_entropy(spark):
    html = "<body><div class='a'>{}</div><div class='b'>{}</div></body>"
    rows = [("h", html.format(k, k % 2)) for k in range(16)]
    tree = html_text.style_trees(spark.createDataFrame(rows, "host string, html string")).collect()
    assert sorted(round(r.importance, 6) for r in tree) == [0.25, 1.0]
    # of 16 pages, 4 presentations and one content: (1 - g**4) / 2 outweighs the content
    rows = [("h", "<body><div class='a'>" + "x" + "<i></i>" * (k % 4) + "</div></body>") for k in range(16)]
    rows = [(h, t.replace("</body>", f"<p>{k}</p></body>")) for k, (h, t) in enumerate(rows)]
    (r,) = html_text.style_trees(spark.createDataFrame(rows, "host string, html string")).collect()
    assert abs(r.importance - (1 - 0.9**4) / 2) < 1e-9


def test_large_hosts_are_decided_by_the_tree(spark):
    """Menus without a telling tag or name go, named ones too; an article that is called like a
    menu stays; without the tree both would be wrong."""
    html = (
        "<body><div class='k1'><div>Home {m}</div><div>News {m}</div></div><nav>Go {m}</nav><ul><li>Bare list</li></ul>"
        "<h2>Number {k}</h2><div class='side'><h1>Story {k}</h1><p>Text {k}</p></div><p>Bare notice</p><div class='zz'>Club {m}</div></body>"
    )
    rows = [(k, "https://big.example.com/p", html.format(k=k, m=k % 12)) for k in range(80)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    assert {r.page_id: r.text for r in html_text.extract(df).collect()} == {k: f"Number {k}\n\nStory {k}\n\nText {k}" for k in range(80)}
    got = html_text.extract(df, enough=1000).collect()
    assert all("Home" in r.text and "Story" not in r.text for r in got)


def test_one_rule_at_every_size(spark):
    """Menus of links that differ on every page, and bare branches that are shared, go on hosts of
    any size from five different pages on."""
    html = (
        "<body><nav><a>N{k}</a> <a>M{k}</a></nav><div class='k1'><div>Home {m}</div></div>"
        "<div class='k7'><h1>Story {k}</h1><p>Text <a>{k}</a></p></div><div class='zz'>Club {m}</div></body>"
    )
    rows = [(100 * n + k, f"https://h{n}.example.com/p", html.format(k=k, m=k // 3)) for n in (6, 9, 20, 60) for k in range(n)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    assert {r.page_id: r.text for r in html_text.extract(df).collect()} == {r[0]: f"Story {r[0] % 100}\n\nText {r[0] % 100}" for r in rows}


def test_importance_equals_that_of_its_definition(spark):
    """The whole chain from pages to importance, for branches with class, against a plain count."""
    import math
    import random
    from collections import Counter

    rng = random.Random(6)
    parts = [("a", 2), ("b", 7), ("c", 1000)]
    pages = [{c: (rng.randrange(3), rng.randrange(n)) for c, n in parts} for _ in range(40)]

    def made(k, page):
        return f"<body><p>{k}</p>" + "".join(f"<div class='{c}'>" + "<i>t</i>" * shape + f"{x}</div>" for c, (shape, x) in page.items()) + "</body>"

    rows = [("h", made(k, page)) for k, page in enumerate(pages)]
    tree = html_text.style_trees(spark.createDataFrame(rows, "host string, html string")).collect()

    def entropy(values):
        return -sum(n / 40 * math.log(n / 40, 40) for n in Counter(values).values())

    want = []
    for c, _ in parts:
        shapes, contents = entropy(p[c][0] for p in pages), entropy(p[c] for p in pages)
        weight = 0.9 ** len({p[c][0] for p in pages})
        want.append(max(contents, (1 - weight) * shapes + weight * contents))
    assert sorted(round(r.importance, 9) for r in tree) == sorted(round(x, 9) for x in want)


ARTICLE = "<h1>Head {k}</h1><p>Text {k}</p>"
KEPT = [
    ("<body style='overflow:hidden'><article>{}</article></body>", ""),
    ("<body class='modal-open hidden'><article style='overflow: hidden' hidden-x>{}</article></body>", ""),
    ("<body><article aria-hidden='false'>{}<p data-hidden='x' title='A hidden gem'>Part {k}</p></article></body>", "Part {k}"),
    ("<body><article>{}<div data-role='dialog' data-id='form-1'>Part {k}</div></article></body>", "Part {k}"),
    ("<body><article>{}<section id='discussion'><p>Part {k} is discussed</p></section></article></body>", "Part {k} is discussed"),
    ("<body><article>{}<section id='related-work'><p>Others {k}</p></section></article></body>", "Others {k}"),
    ("<body><main>{}<h2 id='comment-on-method'>Method {k}</h2></main></body>", "Method {k}"),
    ("<body><main>{}<p class='search-term'>Term {k}</p><p class='lead alert-level'>Lead {k}</p></main></body>", "Term {k}\n\nLead {k}"),
    ("<body><article>{}<div id='legal-history'>Law {k}</div><div class='foot'>Foot {k}</div></article></body>", "Law {k}\n\nFoot {k}"),
    ("<body><article><header>{}</header><p>More {k}</p></article></body>", "More {k}"),
    ("<body><article>{}<p>Let <math><mi>x{k}</mi></math> be <button>odd</button> or <svg><text>even</text></svg></p></article></body>", "Let x{k} be odd or even"),
]
GONE = [
    "<div style='color:red; display: none'>Part {k}</div>",
    "<div hidden>Part {k}</div>",
    "<div class='related'><a href='/'>Other story {k}</a></div>",
    "<div id='search-box'>Search <input> {k}</div>",
    "<section class='comments'><p>First {k}</p></section>",
    "<div class='ad-box'>Buy {k}</div>",
    "<div class='comment-list'>Reader {k}</div>",
    "<div><button>Share {k}</button></div>",
    "<form>Mail {k}</form>",
]


@pytest.mark.parametrize("n", [1, 8, 80])
def test_names_are_read_whole_and_backed_by_what_they_hold(spark, n):
    pages = [(html.replace("{}", ARTICLE), more) for html, more in KEPT]
    pages += [(f"<body><article>{ARTICLE}{gone}</article></body>", "") for gone in GONE]
    rows, want = [], {}
    for h, (html, more) in enumerate(pages):
        for k in range(n):
            rows.append((1000 * h + k, f"http://h{h}.example.com/{k}", html.replace("{k}", str(k))))
            want[1000 * h + k] = f"Head {k}\n\nText {k}" + (f"\n\n{more}".replace("{k}", str(k)) if more else "")
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {r.page_id: r.text for r in html_text.extract(df).collect()}
    assert {k: t for k, t in got.items() if t != want[k]} == {}


def test_a_very_long_page(spark):
    html = "<article>" + "".join(f"<p>Word {k} of it</p>" for k in range(200_000)) + "</article>"
    df = spark.createDataFrame([(1, "http://a.example.com", html)], "page_id long, url string, html string")
    (r,) = html_text.extract(df).collect()
    assert r.text.count("\n\n") == 199_999 and r.text.endswith("Word 199999 of it")


def test_deep_and_broken_pages_take_linear_time(spark):
    import time

    began = time.time()
    deep = "<div class='a'>" * 20_000 + "x"
    pages = [deep, "<article>" * 20_000 + "y", "<span>" * 20_000 + "</b>" * 20_000 + "z", "<li><p>" * 20_000 + "w"]
    for html in pages:
        root = html_text.parse(html)
        assert html_text.places(root) is not None and html_text.same_text(root)
        host = html_text.Host(repeated=frozenset([1]), weak=frozenset([2]), enough=True)
        assert html_text.main_text(html, host)[-1] in "xyzw"
    assert time.time() - began < 20


def test_a_third_of_copies_keeps_its_article(spark):
    rows = [(k, "http://a.example.com/", page(1)) for k in range(30)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.text for r in html_text.extract(df).collect()} == {want(1) + "\n\nsame text on all pages"}


def test_copies_keep_their_text(spark):
    inside = "<body><article><div class='body'><p>Story {}</p></div></article><script>track({})</script></body>"
    plain = "<body><div class='content'><p>Story {}</p></div><script>track({})</script></body>"
    rows = [(k, f"http://{'ab'[k % 2]}.example.com/{k}", (inside, plain)[k % 2].format(7, k)) for k in range(60)]
    rows += [(60 + k, f"http://{'ab'[k % 2]}.example.com/x", (inside, plain)[k % 2].format(k, k)) for k in range(4)]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()
    assert {r.page_id: r.text for r in got} == {k: f"Story {7 if k < 60 else k - 60}" for k in range(64)}


def test_many_copies_among_different_pages(spark):
    html = "<body><article><div class='body'><p>Story {}</p></div><div class='zz'>Join our club</div></article></body>"
    rows = [(k, "http://a.example.com/", html.format(max(k, 90))) for k in range(100)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    assert {r.page_id: r.text for r in html_text.extract(df).collect()} == {k: f"Story {max(k, 90)}" for k in range(100)}


def test_empty_table(spark):
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
